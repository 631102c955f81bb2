"""The keyed store and calls in rounds."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelworks.operators import keyed_store, store
from labelworks.sources.scratch import fresh_path


@pytest.fixture
def made(spark):
    return keyed_store.create(spark, fresh_path(spark, "test-store"), "key string, v string, created_ms long, ttl_ms long", 32)


def rows(spark, pairs):
    return spark.createDataFrame([(*p, 100) for p in pairs], "key string, v string, created_ms long, ttl_ms long")


def test_newest_row_stays(spark, made):
    keyed_store.merge(made, rows(spark, [(f"k{i}", "a", 1) for i in range(500)] + [(None, "lost", 1), ("k1", "b", 1), ("k2", "z", 0)]))
    keyed_store.merge(made, rows(spark, [("k3", "new", 2), ("k4", "old", 0), ("k3", "newer", 3), ("k900", "more", 2)]))
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k3",), ("k4",), ("k900",), ("nobody",), (None,)], "key string")
    got = {(r.key, r.v) for r in keyed_store.look_up(made, keys).collect()}
    assert got == {("k1", "b"), ("k2", "a"), ("k3", "newer"), ("k4", "a"), ("k900", "more")}
    assert made.rows(spark).where("key is not null").count() == 501


def test_look_up_reads_its_buckets_only(spark, made):
    keyed_store.merge(made, rows(spark, [(f"k{i}", "a", 1) for i in range(2000)]))
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3)], "key string")
    buckets = {r.b for r in keys.select(made.bucket(F.col("key")).alias("b")).collect()}
    got = keyed_store.look_up(made, keys)
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    files = {r.f for r in made.rows(spark, sorted(buckets)).select(F.input_file_name().alias("f")).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} == buckets and len(buckets) < 32
    # Unknown keys: hardly a bucket is opened, though they fall into all of them.
    unknown = spark.range(300).select(F.concat(F.lit("u"), "id").alias("key"))
    assert keyed_store.possible(made, unknown).count() < 30 and keyed_store.look_up(made, unknown).count() == 0


def test_merge_leaves_other_buckets_alone(spark, made):
    keyed_store.merge(made, rows(spark, [(f"k{i}", "a", 1) for i in range(2000)]))
    before = set(made.rows(spark).inputFiles())
    touched = keyed_store.merge(made, rows(spark, [("k7", "b", 2)]))
    after = set(made.rows(spark).inputFiles())
    changed = {int(f.split("bucket=")[1].split("/")[0]) for f in before ^ after}
    assert len(touched) == 1 and changed == set(touched)


def test_rows_outlive_their_time(spark, made):
    keyed_store.merge(made, rows(spark, [("a", "x", 1)]))
    keyed_store.merge(made, rows(spark, [("a", "y", 2)]), now_ms=500)
    assert keyed_store.look_up(made, rows(spark, [("a", "", 0)])).count() == 0
    keyed_store.merge(made, rows(spark, [("a", "z", 600)]), now_ms=650)
    assert [r.v for r in keyed_store.look_up(made, rows(spark, [("a", "", 0)])).collect()] == ["z"]


def test_many_pages(spark, monkeypatch, made):
    monkeypatch.setattr(keyed_store, "KEY_BITS", 4000)
    keyed_store.merge(made, rows(spark, [(f"k{i}", "a", 1) for i in range(900)]))
    assert made.filters(spark).agg(F.max("pages")).first()[0] > 1
    assert keyed_store.look_up(made, spark.range(900).select(F.concat(F.lit("k"), "id").alias("key"))).count() == 900


def test_empty_store_and_keys(spark, made):
    assert keyed_store.look_up(made, rows(spark, [("a", "", 0)])).count() == 0
    assert keyed_store.merge(made, rows(spark, [("a", "", 0)]).where("false")) == []
    assert keyed_store.look_up(made, rows(spark, [("a", "", 0)]).where("false")).count() == 0


def failing(prompts, turn):
    out = [(p, None, None) if p == "ok" or p == f"on {turn}" else (None, "no", "context" if p == "never" else "rate") for p in prompts]
    return pd.DataFrame(out, columns=["text", "error", "code"], index=prompts.index)


def test_rounds(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "on 2"), ("c", "on 3"), ("d", "never"), ("e", "late"), ("a", "ok")], "key string, prompt string")
    got = {(r.key, r.response, r.error_type, r.rounds) for r in store.call_in_rounds(df, failing, wait=0.01).collect()}
    assert got == {("a", "ok", None, 1), ("b", "on 2", None, 2), ("c", "on 3", None, 3), ("d", None, "context_length_error", 1), ("e", None, "rate_limit_error", 3)}
    assert {r.rounds for r in store.call_in_rounds(df, failing, rounds=1).collect()} == {1}
    assert store.call_in_rounds(df.where("false"), failing).count() == 0


def test_budget_of_calls(spark):
    df = spark.createDataFrame([(str(i), "ok") for i in range(25)], "key string, prompt string")
    got = store.call_in_rounds(df, failing, rounds=2, calls=1, most_calls=10).groupBy("error_type", "rounds").count().collect()
    assert {(r.error_type, r.rounds, r["count"]) for r in got} == {(None, 1, 10), (None, 2, 10), (store.OVER_BUDGET, 2, 5)}
