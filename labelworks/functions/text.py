"""Scalar text functions (X1, X2, X3, X4) as columns; all work on batch and streaming frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def normalize(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks. Null stays null."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    # Where only white space parts words they are filtered as a list; other marks need the slower Unicode word bounds.
    words = F.filter(F.split(bare, r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))
    bounded = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))
    return F.when(bare.rlike(r"[^\x00-\x7F\p{L}\p{N}]"), bounded).otherwise(F.array_join(words, " "))


def tokens(text: Column) -> Column:
    """Words between white space; an empty array for null and empty texts."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def md5_of(*parts: Column) -> Column:
    """md5 over the md5 of each part, in order; null counts as empty text."""
    return F.md5(F.concat(*[F.md5(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]))


#: Texts up to this length (of the shorter one) are compared by rolling rows, longer ones by binary search.
SHORT = 48

# The multipliers of the public splitmix64 finalizer.
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _rolling_common(x: np.ndarray, y: np.ndarray) -> int:
    row, best = np.zeros(len(x) + 1, np.int32), 0
    for c in y:
        row[1:] = np.where(x == c, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def _prefix_hashes(x: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Prefix sums of scrambled characters times powers of an odd number, modulo 2**64."""
    v = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * _MIX[0]
    v = (v ^ (v >> np.uint64(27))) * _MIX[1]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((v ^ (v >> np.uint64(31))) * powers[: len(x)])])


def _common(a: str, b: str) -> int:
    """Length of the longest common substring.

    A common substring of a length has common ones of all smaller lengths, so the length is found by binary search: the
    hashes of all runs of that length of the shorter text are sorted and those of the longer one are looked up. A hit counts once
    the characters agree; should hits of one length all be collisions, rolling rows decide.
    """
    if len(a) < len(b):
        a, b = b, a
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    if len(y) <= SHORT:
        return _rolling_common(x, y) if len(y) else 0
    # Characters shared with their counts bound the length from above.
    own, n = np.unique(y, return_counts=True)
    at = np.searchsorted(own, x)
    at[at == len(own)] = 0
    shared = np.minimum(np.bincount(at[own[at] == x], minlength=len(own)), n).sum()
    odd = 0xD1342543DE82EF95
    up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(x), w, np.uint64)])) for w in (odd, pow(odd, -1, 1 << 64)))
    hx, hy = _prefix_hashes(x, up), _prefix_hashes(y, up)

    def has(size: int) -> bool | None:
        p, q = (h[size:] - h[:-size] for h in (hx, hy))
        p, q = p * down[: len(p)], q * down[: len(q)]
        order = np.argsort(q)
        found = np.searchsorted(q, p, sorter=order)
        found[found == len(q)] = 0
        hits = np.flatnonzero(q[order[found]] == p)
        for i in hits[:4].tolist():
            j = int(order[found[i]])
            if np.array_equal(x[i : i + size], y[j : j + size]):
                return True
        return None if len(hits) else False

    low, high = 0, int(shared)
    while low < high:
        size = (low + high + 1) // 2
        there = has(size)
        if there is None:
            return _rolling_common(x, y)
        low, high = (size, high) if there else (low, size - 1)
    return low


@F.pandas_udf(LongType())
def common_substring_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters of the longest common substring; null where a text is null."""
    return pd.Series([None if x is None or y is None else len(x) if x == y else _common(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def similar_text(a: Column, b: Column, least: float = 0.95) -> Column:
    """Whether two texts match: common substring over the longer length (plus 1e-5) above ``least``; two empty texts don't.

    Equal texts, and texts whose lengths rule a match out, are decided without the helper.
    """
    a, b = F.replace(a, F.lit('"'), F.lit("'")), F.replace(b, F.lit('"'), F.lit("'"))
    longer = F.greatest(F.length(a), F.length(b)) + F.lit(1e-5)
    near = F.least(F.length(a), F.length(b)) / longer > least
    # Python functions see all rows, whatever stands around them: rows that are decided come as nulls.
    ratio = F.when(near & (a != b), common_substring_length(F.when(near & (a != b), a), b)).when(a == b, F.length(a)).otherwise(0) / longer
    return F.coalesce(ratio > least, F.lit(False))
