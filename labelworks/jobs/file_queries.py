"""Queries that write whole tables as files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import fresh_path
from ..sources.tables import file_pages, load, save
from .registry import query
from .stub import table


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang FROM documents")
def s2_jsonl(spark, d):
    path = fresh_path(spark, "lines") + ".jsonl"
    save(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return load(spark, path, ["doc_id", "text", "lang"]).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, concat('["', lang, '","', source, '"]') AS both, concat(' ', lang) AS lang FROM documents""")
def s4_nested_csv(spark, d):
    """Nested columns go into CSV as JSON, and blanks at a cell's ends stay."""
    path = fresh_path(spark, "nested") + ".csv"
    save(table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("both"), F.concat(F.lit(" "), "lang").alias("lang")), path)
    return load(spark, path, ["doc_id", "both", "lang"], multi_line=False)


def _lines(content: bytes) -> list[str]:
    return content.decode().splitlines()


@query("SELECT md5(text) AS text, count(*) AS rows FROM documents GROUP BY 1")
def s6_file_pages(spark, d):
    """Every document's digest as a page of some file."""
    path = fresh_path(spark, "files")
    table(spark, d, "documents").select(F.md5("text").alias("value")).repartition(16).write.text(path)
    return file_pages(spark, f"{path}/*.txt", _lines).where("page_num >= 1").groupBy("text").agg(F.count("*").alias("rows"))
