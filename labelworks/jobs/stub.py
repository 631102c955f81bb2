"""A labelled table made of ``documents`` and ``labels`` with a deterministic stand-in for the model, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = {"quality": ("pred_quality", "quality", "conf"), "toxic": ("pred_toxic", "toxic", "conf")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    flip = lambda c, m: F.when(i % 23 != 0, F.when(i % m == 0, 1 - F.col(c)).otherwise(F.col(c)).cast("string"))
    df = docs.join(labels, "doc_id").withColumns({
        "row_id": i, "error": F.when(i % 23 == 0, F.lit("llm_provider_error")), "pred_quality": flip("quality", 7), "pred_toxic": flip("toxic", 11), "conf": ((i * 37) % 101) / F.lit(100.0),
    })
    df = df.withColumns({"quality": F.col("quality").cast("string"), "toxic": F.col("toxic").cast("string")})
    answer = F.concat(F.lit('{"quality": "'), F.when(i % 5 == 3, F.lit("9")).otherwise(F.col("pred_quality")), F.lit('", "toxic": "'), F.col("pred_toxic"), F.lit('"}'))
    answer = F.when(i % 5 == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(i % 5 == 2, F.concat(F.lit("Sure, here it is: "), answer, F.lit(" That is all."))).when(i % 5 == 4, F.lit("I cannot tell.")).otherwise(answer)
    tokens = F.array(*[F.struct(F.lit(t).alias("token") if isinstance(t, str) else t.alias("token"), p.cast("double").alias("logprob")) for t, p in (("{", F.lit(-0.1)), ('"quality":', F.lit(-0.2)), (F.col("pred_quality"), -(i % 10) / F.lit(10.0)), ("}", F.lit(-0.05)))])
    return df.withColumns({"answer": F.when(F.col("error").isNull(), answer), "logprobs": F.when(F.col("error").isNull(), tokens)})


LAB = """lab AS (SELECT d.doc_id AS row_id, d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(l.quality AS VARCHAR) AS quality, CAST(l.toxic AS VARCHAR) AS toxic,
 CASE WHEN d.doc_id % 23 = 0 THEN 'llm_provider_error' END AS error,
 CASE WHEN d.doc_id % 23 <> 0 THEN CAST(CASE WHEN d.doc_id % 7 = 0 THEN 1 - l.quality ELSE l.quality END AS VARCHAR) END AS pred_quality,
 CASE WHEN d.doc_id % 23 <> 0 THEN CAST(CASE WHEN d.doc_id % 11 = 0 THEN 1 - l.toxic ELSE l.toxic END AS VARCHAR) END AS pred_toxic,
 CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100.0 AS conf FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
 long AS (SELECT row_id, error, 'quality' AS attribute, pred_quality AS pred, quality AS truth, conf FROM lab UNION ALL SELECT row_id, error, 'toxic', pred_toxic, toxic, conf FROM lab)"""
