"""Slices, shuffles and filters of labelled tables (P1, P2, F1 to F7), and tables put together (J5, J6, U1)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .scan import slice_of_order
from .vectors import is_small

#: Rows up to which a slice is sorted by tasks that keep its best rows only.
TOP_ROWS = 10_000
#: An input that more than this part of all rows share is met by a broadcast; there are fewer of them than its inverse.
OFTEN = 0.001


def slice_rows(df: DataFrame, start: int = 0, most: int | None = None, row_id: str = "row_id") -> DataFrame:
    """Skip ``start`` rows, then at most ``most`` (None or 0: all), by a dense row id: a filter, no sort."""
    kept = F.col(row_id) >= start
    if most:
        kept &= F.col(row_id) < start + most
    return df.where(kept)


def _ordered_slice(df: DataFrame, order: list[Column], start: int, most: int | None) -> DataFrame:
    """A short slice from the start is a top-k; any other one is cut from ranges of the order."""
    if most and start + most <= TOP_ROWS:
        return df.orderBy(*order).offset(start).limit(most)
    if not start and not most:
        return df.orderBy(*order)
    return slice_of_order(df, order, start, most)


def slice_by_key(df: DataFrame, key: str, start: int = 0, most: int | None = None) -> DataFrame:
    """The same by the order of a key, where no dense id exists; in order. Rows of equal keys are in any order."""
    return _ordered_slice(df, [F.col(key)], start, most)


def shuffle_rows(df: DataFrame, seed: int, key: str, start: int = 0, most: int | None = None) -> DataFrame:
    """A seeded order that any partitioning reproduces, then a slice of it."""
    order = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    return _ordered_slice(df, [order, F.col(key)], start, most)


def filter_rows(df: DataFrame, label_column: str, truth_column: str | None = None, label: str | None = None, truth: str | None = None, predicate: Column | None = None) -> DataFrame:
    if label:
        df = df.where(F.col(label_column) == label)
    if truth and truth_column:
        df = df.where(F.col(truth_column) == truth)
    return df if predicate is None else df.where(predicate)


def completed(df: DataFrame, error: str = "error") -> DataFrame:
    return df.where(F.col(error).isNull())


def non_completed(df: DataFrame, error: str = "error") -> DataFrame:
    return df.where(F.col(error).isNotNull())


def _truth(column: str | None) -> str:
    if not column:
        raise ValueError("a truth column is needed")
    return column


def incorrect(df: DataFrame, label_column: str, truth_column: str | None, label: str | None = None, truth: str | None = None) -> DataFrame:
    """Label and truth differ; a missing one differs from everything."""
    same = F.coalesce(F.col(label_column) == F.col(_truth(truth_column)), F.lit(False))
    return filter_rows(df.where(~same), label_column, truth_column, label, truth)


def correct(df: DataFrame, label_column: str, truth_column: str | None) -> DataFrame:
    return df.where(F.coalesce(F.col(label_column) == F.col(_truth(truth_column)), F.lit(False)))


def by_confidence(df: DataFrame, threshold: float = 0.5, column: str | None = None, map_column: str | None = None) -> DataFrame:
    """Confidence >= threshold, of a column or the least one of a map over attributes."""
    if column is None and map_column is None:
        raise ValueError("confidence was not computed")
    return df.where((F.col(column) if column else F.array_min(F.map_values(map_column))) >= threshold)


def with_truth(df: DataFrame, truth_column: str) -> DataFrame:
    return df.where(F.col(truth_column).isNotNull() & (F.col(truth_column) != "nan"))


def paired(found: DataFrame, truths: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """key, attribute, pred and truth: answers beside the truth of the same row, for each attribute {answer's column: truth's
    column}. Rows that one side lacks have no pair; a missing answer or truth is null in its pair."""
    both = found.select(key, *[F.col(p).alias(f"pred_{i}") for i, p in enumerate(names)]).join(truths.select(key, *[F.col(t).alias(f"truth_{i}") for i, t in enumerate(names.values())]), key)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("attribute"), F.col(f"pred_{i}").cast("string").alias("pred"), F.col(f"truth_{i}").cast("string").alias("truth")) for i, t in enumerate(names.values())]))
    return both.select(key, each.alias("x")).select(key, "x.*")


def beside(df: DataFrame, made: DataFrame, on: list[str]) -> DataFrame:
    """All rows of ``df`` with the columns of ``made``, which has a row for each different input ``on`` (nulls count as equal).

    Columns of ``made`` replace those of the same name; rows without a result have nulls in them. A short ``made`` is broadcast; of a
    longer one the results of inputs that many rows share are, so that no task gets all rows of an input.
    """
    new = [c for c in made.columns if c not in on]
    right = made.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[F.col(c).alias(f"_new_{c}") for c in new])
    every = lambda left, other: functools.reduce(Column.__and__, [F.col(f"{left}{c}").eqNullSafe(F.col(f"{other}{c}")) for c in on])
    met = lambda rows, results: rows.join(results, every("", "_on_"), "left").select(*[c for c in df.columns if c not in new], *[F.col(f"_new_{c}").alias(c) for c in new])
    if is_small(right):
        return met(df, F.broadcast(right))
    counts = df.groupBy(*on).agg(F.count("*").alias("_rows"))
    often = counts.where(F.col("_rows") > OFTEN * df.count()).select(*[F.col(c).alias(f"_often_{c}") for c in on])
    often = F.broadcast(stored(often, "often"))
    shared = met(df.join(often, every("", "_often_"), "left_semi"), F.broadcast(right.join(often, every("_on_", "_often_"), "left_semi")))
    return shared.unionByName(met(df.join(often, every("", "_often_"), "left_anti"), right.hint("merge")))


def appended(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables under the columns of all, in the order in which they appear; missing cells are null. A column that has
    different types is text."""
    tables = [first, *others]
    types: dict[str, set[str]] = {}
    for t in tables:
        for f in t.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    plain = [t.select(*[F.col(f"`{c}`").cast("string").alias(c) if len(types[c]) > 1 else F.col(f"`{c}`") for c in t.columns]) for t in tables]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plain)
