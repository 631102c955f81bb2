"""Prefix sums and dense numbers over a whole order, without a task that sees all rows.

A key's range is known from bounds taken of a sample; they are literals of the plan, so a row's range depends on the row
alone and a repeated task finds the same. Sums run inside each range; each range's totals give what comes before it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Sampled keys for each range: ranges differ by about a tenth in size.
SAMPLE_PER_RANGE = 100


def ranges(df: DataFrame, order: list[Column], parts: int | None = None) -> Column:
    """The number of each row's range, ascending with the order's columns (nulls first): a column of ``df``.

    Rows with equal keys are in one range; any bounds give right results, the sample only evens out the ranges.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A struct's fields are keys of their own.
    fields = df.select(*[c.alias(f"c{i}") for i, c in enumerate(order)]).schema.fields
    order = [x for c, f in zip(order, fields, strict=True) for x in ([c[n] for n in f.dataType.names] if isinstance(f.dataType, StructType) else [c])]
    keys = df.select(*[c.alias(f"k{i}") for i, c in enumerate(order)]).where(" and ".join(f"k{i} is not null" for i in range(len(order))))
    rows, wanted = keys.count(), parts * SAMPLE_PER_RANGE
    sample = keys if rows <= wanted else keys.sample(min(1.0, 1.2 * wanted / rows), seed=7)
    found = sorted(map(tuple, sample.collect()))
    step = max(1, len(found) // parts)
    bounds = sorted(set(found[step::step]))
    if not bounds:
        return F.lit(0)
    types = [f.dataType for f in keys.schema.fields]
    known = F.sort_array(F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, types, strict=True))]) for b in bounds]))
    key = F.struct(*[c.cast(t).alias(f"k{i}") for i, (c, t) in enumerate(zip(order, types, strict=True))])
    # A binary search: bounds up to the key, found by steps of falling powers of two; beyond the last bound the comparison is null.
    steps = F.array(*[F.lit(2**i) for i in reversed(range(len(bounds).bit_length()))])
    search = lambda k: F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(known, n + step - 1) <= k, n + step).otherwise(n))
    return F.transform(F.array(key), search)[0]


def offsets(totals: DataFrame, group: list[str], sums: list[str], part: str = "part") -> DataFrame:
    """group, part, ``before_x`` and ``all_x`` for each x of ``sums``, from one row for each group and range."""
    every = totals.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(part, *sums))).alias("t"))
    add = lambda rows, x: F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + r[x])
    made = F.transform("t", lambda r, i: F.struct(r[part].alias(part), *[add(F.slice("t", 1, i), x).alias(f"before_{x}") for x in sums], *[add(F.col("t"), x).alias(f"all_{x}") for x in sums]))
    return every.select(*group, F.explode(made).alias("r")).select(*group, "r.*")


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """``df`` with, for each (name -> column of whole numbers) of ``sums``, the sum over the group's rows up to and with this one
    as ``name`` and over all of them as ``all_name``.

    A group's rows are dealt to ranges of the order, so a group of all rows is spread over tasks; only one row of totals
    for each group and range is brought together.
    """
    ranged = df.withColumn("part", ranges(df, [*map(F.col, group), *order], parts))
    totals = ranged.groupBy(*group, "part").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])
    inside = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    before = offsets(totals, group, list(sums)).withColumnsRenamed({g: f"of_{g}" for g in [*group, "part"]})
    same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in [*group, "part"]]
    met = local.join(before, functools.reduce(Column.__and__, same))
    return met.select(*df.columns, *[(F.col(n) + F.col(f"before_{n}")).alias(n) for n in sums], *[f"all_{n}" for n in sums])


def dense_ids(df: DataFrame, order: list[Column], name: str = "row_id", parts: int | None = None) -> DataFrame:
    """``df`` with a number from 0 in the given order. Equal keys must be equal in all that matters: their order is free."""
    ranged = df.withColumn("part", ranges(df, order, parts))
    totals = ranged.groupBy("part").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("part").orderBy(*order)
    met = ranged.withColumn(name, F.row_number().over(inside)).join(F.broadcast(offsets(totals, [], ["n"])), "part")
    return met.select(*df.columns, (F.col(name) + F.col("before_n") - 1).cast("long").alias(name))


def slice_of_order(df: DataFrame, order: list[Column], start: int, most: int | None, parts: int | None = None) -> DataFrame:
    """The rows from place ``start`` on, at most ``most``, in order.

    Rows per range tell which ranges the slice takes whole: these are neither ranked nor moved before the last sort; rows of
    other ranges are dropped where they are read, and only the one or two ranges that it cuts are numbered.
    """
    part = ranges(df, order, parts)
    ranged = df.withColumn("part", part)
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    end, at, whole, cut = None if not most else start + most, 0, [], {}
    for p, n in counts:
        lo, hi = max(start - at, 0), n if end is None else min(end - at, n)
        if lo < hi:
            if (lo, hi) == (0, n):
                whole.append(p)
            else:
                cut[p] = (lo, hi)
        at += n
    taken = ranged.where(F.col("part").isin(whole)) if whole else ranged.where("false")
    if cut:
        inside = Window.partitionBy("part").orderBy(*order)
        numbered = ranged.where(F.col("part").isin(list(cut))).withColumn("place", F.row_number().over(inside) - 1)
        fits = [(F.col("part") == p) & F.col("place").between(lo, hi - 1) for p, (lo, hi) in cut.items()]
        taken = taken.unionByName(numbered.where(fits[0] if len(fits) == 1 else fits[0] | fits[1]).drop("place"))
    return taken.orderBy(*order).select(*df.columns)
