"""The stateless operators on a stream of answer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse


def stream_labels(spark: SparkSession, folder: str, attributes: list[str]) -> DataFrame:
    """New JSON Lines files of (key, response) as they come, parsed to a label per attribute."""
    answers = spark.readStream.schema("key string, response string").json(folder)
    parsed = answers.withColumn("label", parse.parse_answer(F.col("response")))
    error = F.when(F.col("label").isNull(), F.lit("invalid_llm_response_error"))
    labels = {f"{a}_label": F.when(F.col("label").isNull(), F.lit(parse.NO_LABEL)).otherwise(F.coalesce(F.col("label")[a], F.lit(""))) for a in attributes}
    return parsed.withColumns({"error": error} | labels)
