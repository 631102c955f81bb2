"""Reading and writing tables (S1 to S6). Text formats are read as strings only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Texts that a CSV cell may hold for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str = ",", quoting: bool = True, multi_line: bool = True) -> DataFrame:
    """All columns as strings, missing-value texts as null. ``multi_line=False`` keeps files splittable.

    Without ``columns`` only the header line is read for the names.
    """
    options = {"header": "true", "sep": delimiter, "escape": '"', "multiLine": str(multi_line).lower(), "quote": '"' if quoting else ""}
    if columns is None:
        columns = spark.read.options(**options).csv(path).columns
    df = spark.read.options(**options).schema(_strings(columns)).csv(path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in columns])


def read_jsonl(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """JSON Lines; every field as a string."""
    return spark.read.schema(_strings(columns)).json(path)


def load(spark: SparkSession, source: str | DataFrame, columns: list[str] | None = None, **csv_options) -> DataFrame:
    """A frame as it is, or a file by its ending; any other ending raises ValueError."""
    if isinstance(source, DataFrame):
        return source
    if source.endswith(".csv"):
        return read_csv(spark, source, columns, **csv_options)
    if source.endswith((".jsonl", ".json")):
        if columns is None:
            raise ValueError("JSON Lines need the names of their columns")
        return read_jsonl(spark, source, columns)
    if source.endswith(".parquet"):
        return spark.read.parquet(source)
    raise ValueError(f"unknown kind of table: {source}")


def save(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Write CSV, JSON Lines or Parquet by the path's ending; nested columns go into CSV as JSON."""
    if path.endswith(".csv"):
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields]
        df.select(*flat).write.options(header="true", sep=delimiter, escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    elif path.endswith((".jsonl", ".json")):
        df.write.json(path)
    elif path.endswith(".parquet"):
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown kind of table: {path}")


def seeds(spark: SparkSession, source: list[dict] | str | DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Few-shot examples from rows in the configuration, or from a table; ``position`` keeps the order of rows."""
    if isinstance(source, list):
        names = columns or sorted({k for r in source for k in r})
        rows = [tuple(None if r.get(n) is None else str(r[n]) for n in names) + (i,) for i, r in enumerate(source)]
        return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", position long")
    return load(spark, source, columns)


def file_pages(spark: SparkSession, paths: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page_num (from 1) and text of every page of every file; ``extract`` turns a file's bytes into pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                pages = extract(bytes(content))
                yield pd.DataFrame({"path": pd.Series([path] * len(pages), dtype=object), "page_num": range(1, len(pages) + 1), "text": pd.Series(pages, dtype=object)})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, page_num long, text string")
