"""Prefix sums, dense numbers and slices by ranges of an order, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from labelworks.functions.text import SHORT, _common
from labelworks.operators import metrics, rows, scan


def table(spark, n=500, seed=1):
    draw = random.Random(seed)
    made = [(i, draw.choice(["a", "b", None]), draw.choice([None, *range(9), 4, 4, 4, 4, 4]), draw.randrange(-5, 6)) for i in range(n)]
    return made, spark.createDataFrame(made, "i int, g string, k int, v int").repartition(5)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_prefix_sums(spark, parts):
    made, df = table(spark)
    got = scan.prefix_sums(df, ["g"], [F.col("k"), F.col("i")], {"up": "v"}, parts).collect()
    low = lambda x: (x is not None, x or 0)
    want = set()
    for g in ("a", "b", None):
        own, s = sorted((r for r in made if r[1] == g), key=lambda r: (low(r[2]), r[0])), 0
        for r in own:
            s += r[3]
            want.add((*r, s, sum(x[3] for x in own)))
    assert len(got) == len(made) and set(map(tuple, got)) == want


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_dense_ids(spark, parts):
    made, df = table(spark)
    got = scan.dense_ids(df, [F.col("k"), F.col("i")], "n", parts).collect()
    want = sorted(made, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(len(made)))


def test_a_range_is_found_without_meeting_every_bound(spark, monkeypatch):
    import time

    monkeypatch.setattr(scan, "SAMPLE_PER_RANGE", 2)
    df = spark.range(0, 300_000, 1, 4).select(F.xxhash64("id").alias("a"), "id")

    def seconds(parts):
        part, took = scan.ranges(df, [F.col("a"), F.col("id")], parts), []
        for _ in range(3):
            began = time.time()
            assert df.agg(F.max(part)).first()[0] <= 2 * parts
            took.append(time.time() - began)
        return min(took)

    few, many = seconds(8), seconds(800)
    assert many < 8 * few + 0.5


@pytest.mark.parametrize("parts", [2, 7, 33])
def test_ranges_follow_the_order_of_any_type(spark, parts):
    draw = random.Random(parts)
    made = [(draw.choice([float("nan"), -0.0, 0.0, 1.5, float("-inf"), None]), draw.choice(["", "z", "é", "￿", "😀", "a\x00", None]), i) for i in range(400)]
    df = spark.createDataFrame(made, "x double, s string, i int").repartition(3)
    for order in (["x", "s", "i"], ["s", "x", "i"]):
        got = df.withColumn("part", scan.ranges(df, [F.col(c) for c in order], parts)).orderBy(*order).collect()
        assert [r.part for r in got] == sorted(r.part for r in got) and {r.part for r in got} > {0}
        numbered = scan.dense_ids(df, [F.col(c) for c in order], "n", parts).orderBy("n").collect()
        assert [r.i for r in numbered] == [r.i for r in got]


@pytest.mark.parametrize("start, most", [(0, 7), (5, None), (499, None), (500, None), (900, 3), (123, 200), (250, 1), (0, None)])
def test_slices(spark, start, most):
    made, df = table(spark)
    want = sorted(r[0] for r in made)[start : None if most is None else start + most]
    assert [r.i for r in scan.slice_of_order(df, [F.col("i")], start, most, 6).collect()] == want
    assert [r.i for r in rows.slice_by_key(df, "i", start, most).collect()] == want


def test_slices_with_ties_and_nothing(spark):
    _, df = table(spark)
    every = [r.k for r in df.select("k").orderBy("k").collect()]
    assert [r.k for r in rows.slice_by_key(df.select("k"), "k", 100).collect()] == every[100:]
    none = df.where("false")
    assert scan.slice_of_order(none, [F.col("i")], 1, None).collect() == [] and scan.dense_ids(none, [F.col("i")]).collect() == []
    assert scan.prefix_sums(none, ["g"], [F.col("i")], {"up": "v"}).collect() == []


def test_slices_keep_many_partitions(spark):
    df = spark.range(20_000).withColumn("x", F.col("id") % 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for got in (rows.slice_by_key(df, "id", 5), rows.shuffle_rows(df, 1, "id", 5), rows.shuffle_rows(df, 1, "id")):
            assert got.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_thresholds_of_distinct_confidences(spark):
    draw = random.Random(2)
    made = [("a", "1" if draw.random() < 0.5 else "0", "1", i / 997, None) for i in range(600)] + [("b", "x", "x", 0.5, None)]
    long = spark.createDataFrame(made, "attribute string, pred string, truth string, conf double, error string")
    pos, neg = [r[3] for r in made if r[0] == "a" and r[1] == r[2]], [r[3] for r in made if r[0] == "a" and r[1] != r[2]]
    won = sum(p > n for p in pos for n in neg) / (len(pos) * len(neg))
    assert {r.attribute: round(r.auroc, 9) for r in metrics.auroc(long).collect()} == {"a": round(won, 9), "b": 1.0}
    t = metrics.threshold_table(long, parts=7)
    for r in t.where("attribute = 'a'").collect():
        assert (r.tp, r.fp) == (sum(p >= r.threshold for p in pos), sum(n >= r.threshold for n in neg))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert all("part#" in line for line in plan.splitlines() if "Window [" in line)


def by_hand(a, b):
    best = 0
    for i in range(len(a)):
        while i + best < len(a) and a[i : i + best + 1] in b:
            best += 1
    return best


@pytest.mark.parametrize("letters", ["a", "ab", "abcé😀", "abcdefghijklm"])
def test_common_substring_of_long_texts(letters):
    draw = random.Random(len(letters))
    for _ in range(150):
        a, b = ("".join(draw.choices(letters, k=draw.randrange(3 * SHORT))) for _ in range(2))
        b += draw.choice(["", a[5:70], a])
        assert _common(a, b) == _common(b, a) == by_hand(a, b)


def test_common_substring_is_quick_on_long_texts():
    a, b = "x" * 200_000, "x" * 150_000 + "y" * 60_000
    assert _common(a, b) == 150_000


def test_tables_put_together(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 5), (2, None, 5)], "id int, k string, n int")
    made = spark.createDataFrame([("x", "X", 1.5), (None, "none", 2.5)], "k string, code string, n double")
    got = rows.beside(a, made, ["k"])
    assert got.columns == ["id", "k", "code", "n"] and sorted(map(tuple, got.collect()), key=repr) == [(1, "x", "X", 1.5), (2, None, "none", 2.5), (2, None, "none", 2.5)]
    assert rows.beside(a, made.where("false"), ["k"]).where("code is null and n is null").count() == 3
    truth = spark.createDataFrame([(1, "X"), (3, "Y")], "id int, t string")
    assert [tuple(r) for r in rows.paired(a, truth, "id", {"n": "t"}).collect()] == [(1, "t", None, "X")]
    every = rows.appended(a, spark.createDataFrame([("7", True)], "n string, more boolean"), a.limit(0))
    assert every.columns == ["id", "k", "n", "more"] and {tuple(r) for r in every.collect()} == {(1, "x", None, None), (2, None, "5", None), (None, None, "7", True)}


@pytest.mark.parametrize("small", [True, False])
def test_no_task_gets_all_rows_of_a_shared_input(spark, monkeypatch, small):
    from labelworks.operators import vectors
    from labelworks.sources.scratch import stored

    if not small:
        monkeypatch.setattr(vectors, "MOST_BROADCAST_ROWS", 5)
        monkeypatch.setattr(rows, "OFTEN", 0.2)
    key = F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 10 < 7, F.lit(None)).otherwise((F.col("id") % 100).cast("string"))
    df = stored(spark.range(2_000).select("id", key.alias("k"), F.repeat(F.col("id").cast("string"), 20).alias("text")), "beside")
    made = df.select("k").distinct().where("k is null or k <> '19'").select("k", F.concat(F.lit("<"), F.coalesce("k", F.lit("none")), F.lit(">")).alias("code"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows.beside(df, made, ["k"])
        found = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.columns == ["id", "k", "text", "code"] and len(found) == 2_000 and len({r.id for r in found}) == 2_000
    assert all(r.code == (None if r.k == "19" else f"<{r.k or 'none'}>") for r in found)
    plan = got._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and ("SortMergeJoin" in plan) == (not small)
