"""CSV with quoted line ends, in splits of a few bytes, against Python's reader."""

import csv
import random

import pytest

from labelworks.sources.split_csv import read_split_csv
from labelworks.sources.tables import MISSING


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cells(draw):
    return ["".join(draw.choices(["a", "é", " ", '"', ",", "\n", "\n", "\r\n", "long " * 9], k=draw.randrange(7))) for _ in range(3)]


def written(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([["x", "y", "z z"], *rows])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_ends(spark, small_splits, tmp_path, end):
    draw, every = random.Random(4), []
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = [["", "", "one,two"], *[r for r in (cells(draw) for _ in range(0 if name == "b.csv" else 90)) if any(r)]]
        written(tmp_path / name, rows, end)
        every += rows
    df = read_split_csv(spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert df.columns == ["row_id", "x", "y", "z z"] and [r[0] for r in got] == list(range(len(every)))
    assert [r[1:] for r in got] == [tuple(None if c in MISSING else c for c in r) for r in every]
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 6  # many tasks a file


def test_short_rows_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1\n\n2,"b\nb",3\n')
    (tmp_path / "b.csv").write_text("x,y\n")
    (tmp_path / "c.csv").write_text("")
    got = sorted(map(tuple, read_split_csv(spark, str(tmp_path), ["x", "y"]).collect()))
    assert got == [(0, "1", None), (1, "2", "b\nb")]
    (tmp_path / "d.csv").write_text('"k;k";v')
    got = read_split_csv(spark, str(tmp_path / "d.csv"), ["x", "y"], delimiter=";", header=False).collect()
    assert [tuple(r) for r in got] == [(0, "k;k", "v")]
