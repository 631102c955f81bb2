"""CSV files with quoted line ends, read by many tasks each.

Spark's own reader takes a whole file per task where a cell may hold line ends. Here files are read as lines, in the splits
that Spark makes. Whether a line begins inside a quoted cell is a matter of how many quotes stand before it in the
file: each split counts its own, the splits' totals are summed up in order, and each line adds those of its split. Records of one
line, nearly all, are parsed where they are; only the lines of longer ones are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scan import offsets
from .tables import MISSING


def read_split_csv(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """All columns as strings, missing-value texts as null, and ``row_id``: a number from 0 in the order of file names and of
    records in them.

    Cells may be quoted, with doubled quotes and line ends inside; a quote inside a cell that isn't quoted is not allowed. A
    record's cells that are missing at its end are null, surplus ones are left out. Empty lines between records are no records;
    a file without records, and an empty folder, give no rows. Without ``columns`` the first line names them.
    """
    if columns is None:
        columns = spark.read.options(header="true", sep=delimiter, escape='"').csv(path).columns
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    quotes = lines.withColumn("quotes", marks.cast("long"))
    in_split = Window.partitionBy("file", "part").orderBy("at")
    whole = in_split.rowsBetween(Window.unboundedPreceding, 0)
    before = offsets(quotes.groupBy("file", "part").agg(F.sum("quotes").alias("quotes")), ["file"], ["quotes"]).select("file", "part", "before_quotes")
    # Totals are a row per split: fewer than tasks.
    told = quotes.join(F.broadcast(before), ["file", "part"])
    inside = (F.sum("quotes").over(whole) - F.col("quotes") + F.col("before_quotes")) % 2 == 1
    told = told.withColumn("inside", inside).withColumn("open", (F.col("inside").cast("int") + F.col("quotes")) % 2 == 1)
    # A record begins at a line that isn't inside a cell; the lines after it, up to the next beginning, are its own.
    begins = told.where(F.col("inside") | F.col("open") | (F.regexp_replace("value", r"\r$", "") != "")).withColumn("begins", (~F.col("inside")).cast("long"))
    counts = offsets(begins.groupBy("file", "part").agg(F.sum("begins").alias("begins")), ["file"], ["begins"]).select("file", "part", "before_begins")
    numbered = begins.join(F.broadcast(counts), ["file", "part"]).withColumn("record", F.col("before_begins") + F.sum("begins").over(whole) - 1)
    alone = numbered.where(~F.col("inside") & ~F.col("open")).select("file", "record", "value")
    pieces = numbered.where(F.col("inside") | F.col("open")).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("part", "at", "value"))).alias("lines"))
    joined = pieces.select("file", "record", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    records = alone.unionByName(joined).where(F.col("record") >= int(header)).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    # Files follow each other in the order of their names.
    per_file = begins.groupBy("file").agg((F.sum("begins") - int(header)).alias("n")).withColumn("every", F.lit(0))
    bases = offsets(per_file.withColumnRenamed("file", "part"), ["every"], ["n"]).select(F.col("part").alias("file"), "before_n")
    cells = F.from_csv("value", ", ".join(f"`{c}` string" for c in columns), {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    parsed = records.join(F.broadcast(bases), "file").select((F.col("record") - int(header) + F.col("before_n")).alias("row_id"), cells.alias("c"))
    return parsed.select("row_id", *[F.when(~F.col(f"c.`{c}`").isin(MISSING), F.col(f"c.`{c}`")).alias(c) for c in columns])
