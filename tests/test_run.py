"""The model step's whole result, and the second question about an answer."""

import pandas as pd
from pyspark.sql import functions as F

from labelworks.functions import confidence
from labelworks.operators import store


def test_model_step_returns_logprobs_cost_and_types(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, "c", "z")], "row_id long, key string, prompt string")
    kept = spark.createDataFrame([("c", "old", [("old", -0.5)], 0, 100)], f"key string, response string, logprobs {store.TOKENS}, created_ms long, ttl_ms long")
    calls = spark.sparkContext.accumulator(0)

    def fn(p):
        calls.add(len(p))
        bad = p == "y"
        return pd.DataFrame({"text": p.str.upper().where(~bad), "error": pd.Series("full", index=p.index).where(bad), "code": pd.Series("context_window", index=p.index).where(bad), "logprobs": [[(x, -0.1)] for x in p], "cost": 0.5})

    answers, made = store.label_prompts(prompts, kept, fn, 50, write_to=f"{tmp_path}/made")
    got = {r.row_id: (r.response, r.error, r.error_type, r.logprobs and [tuple(x) for x in r.logprobs], r.cost, r.cached) for r in answers.collect()}
    assert got[1] == got[2] == ("X", None, None, [("x", -0.1)], 0.5, False)
    assert got[3][:3] == (None, "full", "context_length_error") and got[4] == ("old", None, None, [("old", -0.5)], 0.0, True)
    assert made.count() == 2 and calls.value == 2

    def broken(p):
        raise RuntimeError("no context here")

    rows = store.call_model(prompts.dropDuplicates(["key"]), broken, 1).collect()
    assert {(r.error, r.error_type) for r in rows} == {("llm_provider_error: no context here", "llm_provider_error")}


def test_p_true_of_two(spark):
    one = lambda t, p: F.array(F.struct(F.lit(t).alias("token"), F.lit(p).alias("logprob")))
    none = F.lit(None).cast(store.TOKENS)
    r = spark.range(1).select(confidence.p_true_of_two(one("Yes", -0.1), one("No", -0.2)), confidence.p_true_of_two(one("Yes", -0.3), one("No", -0.2)), confidence.p_true_of_two(one("Yes", -0.1), none)).first()
    assert [round(x, 4) for x in r] == [0.9048, -0.8187, 0.0]
    assert spark.range(1).select(confidence.p_true_prompt(F.lit("P "), F.lit("A"))).first()[0].startswith("P A\n")


def test_run_needs_registered_hooks(spark):
    import pytest

    from labelworks.operators import enrich, run

    df = spark.createDataFrame([(1, "x", "1")], "row_id long, line string, quality string")
    plan = run.Plan("Judge.", {"quality": ["0", "1"]}, "{line}", "nobody's")
    with pytest.raises(ValueError, match="nobody's"):
        run.prompts_of(df, df, plan)
    enrich.register_selector("nobody's", lambda rows, seeds: rows.where("false").select("row_id", F.array(F.lit("")).alias("examples")))
    assert run.prompts_of(df, df, plan).first().prompt == "Judge.\n\nquality: Options: 0,1\n\nx"
    # No answers at all: the first generation's error, no prediction, no metric to speak of.
    empty = spark.createDataFrame([], "key string, response string, created_ms long, ttl_ms long")
    found = run.label(df, df, plan, lambda p, turn, g: pd.DataFrame({"text": None, "error": "no", "code": "context"}, index=p.index, dtype=object), empty, 0)
    assert [tuple(r) for r in found.collect()] == [(1, "quality", None, 0.0, 0, "context_length_error")]


def test_tables_with_a_row_for_each_prompt_are_not_broadcast(spark):
    from labelworks.operators import enrich, run
    from labelworks.sources.scratch import stored

    keyed = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("key"), F.lit("a prompt").alias("prompt"))
    prompts = stored(keyed, "prompts")
    known = stored(keyed.where("row_id % 2 = 0").select("key", F.lit("old").alias("known"), F.lit(None).cast(store.TOKENS).alias("known_logprobs")), "known")
    none = [F.lit(None).cast("string").alias(c) for c in ("error", "error_type")]
    made = stored(keyed.where("row_id % 2 = 1").select("key", F.lit("new").alias("response"), *none, F.lit(None).cast(store.TOKENS).alias("logprobs"), F.lit(1.0).alias("cost")), "made")
    answered = store.answered(prompts, known, made)
    assert {r.row_id: r.response for r in answered.collect()} == {i: ("new" if i % 2 else "old") for i in range(50)}
    plan = run.Plan("Judge.", {"quality": ["0", "1"]}, "{key}", "none's")
    enrich.register_selector("none's", lambda rows, seeds: rows.select("row_id", F.array(F.lit("shot")).alias("examples")))
    said = stored(answered.withColumn("pos", F.lit(0)), "said")
    voted = run.voted(said, plan)
    truths = stored(keyed.select("row_id", F.lit("quality").alias("attribute"), F.lit("1").alias("truth")), "truths")
    seeds = prompts.limit(1).withColumn("quality", F.lit("1"))
    for df in (answered, store.misses(prompts, known), store.hits(prompts, known), run.prompts_of(prompts.drop("prompt"), seeds, plan), voted):
        assert df.count() in (25, 50)
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert run.evaluated(voted, truths, plan).where("attribute = 'quality' and metric = 'support'").first().value == 0


def test_a_small_table_is_small_in_bytes(spark, monkeypatch):
    from labelworks.operators import vectors

    df = spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("text"), F.array("id").alias("many"))
    assert vectors.is_small(df) and vectors.is_small(df.limit(0))
    monkeypatch.setattr(vectors, "MOST_BROADCAST_BYTES", 4_000)
    assert not vectors.is_small(df) and vectors.is_small(df.limit(10))
    met = df.join(vectors.small(df.withColumnRenamed("text", "other")), "id")
    assert met.count() == 100 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
