"""Operator 5: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct buckets of its words, word pairs and pairs with one word between. The learner
keeps for each bucket the sums z and n of FTRL-proximal: a rate of its own per coordinate, and L1 so that most weights are
exactly 0. It learns on at most ``most_rows`` labelled rows with at most ``most_bytes`` of text (documented bounds: they are
chosen by a hash of the id, and beyond the bounds by one of the row). One learner sees them all, whatever their number. The
weights that are not 0 are broadcast as two short arrays.

Scoring covers whole texts. Edge cases: a null or empty text has only the intercept; null labels are not learned from;
a null doc id is scored, never learned from and not held out; with no labelled rows every score is 0.5; repeated rows, and
repeated labels of an id, are learned from once with their number as a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WordHasher, bytes_of, held_out, mix, pieces, rolling, stored
from .decontaminate import word_bytes

BITS = 20
MOST_ROWS = 40_000
MOST_BYTES = 128 << 20


@dataclass
class FtrlModel:
    """Buckets with a weight, their weights, and the intercept."""

    at: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


_hasher: list[WordHasher] = []


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and text numbers of words, pairs and skip-pairs."""
    if not _hasher:
        _hasher.append(WordHasher(word_bytes()))
    h, owner, _, _ = _hasher[0](texts)
    mask = np.uint64((1 << BITS) - 1)
    out = [((h & mask).astype(np.int64), owner)]
    if len(h) > 1:
        same = owner[1:] == owner[:-1]
        out.append(((rolling(h, 2) & mask).astype(np.int64)[same], owner[1:][same]))
    if len(h) > 2:
        same = owner[2:] == owner[:-2]
        skip = mix(h[:-2] * np.uint64(0x9FB21C651E98DF25) + h[2:])
        out.append(((skip & mask).astype(np.int64)[same], owner[2:][same]))
    return out


def _learn(rows: pd.DataFrame, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> pd.DataFrame:
    """FTRL-proximal over the rows, in the order of their hash; the weights that are not 0, bucket -1 the intercept."""
    rows = rows.sort_values(["turn", "y", "x"], kind="stable")
    xs = rows["x"].to_numpy()
    ys, times = rows["y"].to_numpy(float), rows["times"].to_numpy(float)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for b, y, weight in zip(xs, ys, times, strict=True):
            x = np.concatenate([np.frombuffer(b, np.int32), [1 << BITS]])
            w = weights(x)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = weight * (p - y)
            was = n[x]
            sigma = (np.sqrt(was + g * g) - np.sqrt(was)) / alpha
            z[x] += g - sigma * w
            n[x] = was + g * g
    w = weights(slice(None))
    at = np.flatnonzero(w)
    return pd.DataFrame({"bucket": np.where(at == 1 << BITS, -1, at), "weight": w[at]})


def within(rows: DataFrame, place: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The rows with the smallest ``place`` (0 to below 2**30), about as many as the bounds allow: places go by thousands, unless
    the first thousand is too much; the first place is taken in any case."""
    till = 1 << 30
    for step in (1 << 20, 1 << 10, 1):
        part = F.floor(F.col(place) / step)
        counts = rows.where(F.col(place) < till).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).orderBy("part").collect()  # 1,024 at most
        fits = (np.cumsum([r.n for r in counts]) <= most_rows) & (np.cumsum([r["size"] for r in counts]) <= most_bytes)
        if fits.all():
            break
        first = counts[int(fits.sum())].part
        till = first * step
        if fits.any():
            break
        till = (first + 1) * step
    return rows.where(F.col(place) < till)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, kept_out: int = 1, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> FtrlModel:
    """Learn from labelled rows of the training folds, at most ``most_rows`` of them with ``most_bytes`` of text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, kept_out))
    known = known.groupBy("doc_id", "y").agg(F.count("*").alias("labels"))
    turn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30))
    share = min(1.0, most_rows / max(known.count(), 1))
    # About most_rows ids with each of their labels: small enough to broadcast, so that only the texts of the sample are shuffled.
    sample = known.withColumn("turn", turn).where(F.col("turn") < int(share * (1 << 30)))
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # Repeated rows become one, and what repeated ids add beyond the bounds goes by a hash of the whole row.
    folded = chosen.groupBy("doc_id", "turn", "y", "text").agg(F.sum("labels").cast("double").alias("times"))
    place, size = F.pmod(F.xxhash64("doc_id", "y", "text"), F.lit(1 << 30)), F.octet_length("text").cast("long")
    folded = stored(folded.withColumns({"place": place, "size": size}), "toxicity-sample")
    bounded = within(folded, "place", "size", most_rows, most_bytes)

    names = ["turn", "y", "times"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = features(bytes_of(part, "text"))
                key = np.unique(np.concatenate([(o << BITS) | b for b, o in found]))
                bounds = np.searchsorted(key >> BITS, np.arange(part.num_rows + 1))
                own = (key & ((1 << BITS) - 1)).astype(np.int32)
                xs = [own[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(xs, pa.binary())], names=[*names, "x"])

    rows = bounded.select("text", *names).mapInArrow(extract, "turn long, y int, times double, x binary")
    # One group: the sample is bounded, and averaged weights of several learners would depend on their number.
    learned = rows.groupBy(F.lit(0).alias("learner")).applyInPandas(lambda pdf: _learn(pdf, epochs, alpha, beta, l1, l2), "bucket long, weight double")
    got = learned.toPandas().sort_values("bucket")
    is_bias = got["bucket"] < 0
    return FtrlModel(got.loc[~is_bias, "bucket"].to_numpy(np.int64), got.loc[~is_bias, "weight"].to_numpy(np.float32), float(got.loc[is_bias, "weight"].sum()))


def score(documents: DataFrame, model: FtrlModel, threshold: float = 0.7) -> DataFrame:
    """All columns of ``documents`` with score and predicted (columns of these names are replaced)."""
    documents = documents.drop("score", "predicted")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    made: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(shared.value.dense())
        weights = made[0]
        for batch in batches:
            for part in pieces(batch, "text"):
                keys = []
                for at, owner in features(bytes_of(part, "text")):
                    there = np.flatnonzero(weights[at])
                    keys.append((owner[there] << BITS) | at[there])
                key = np.unique(np.concatenate(keys))
                logit = shared.value.intercept + np.bincount(key >> BITS, weights=weights[key & ((1 << BITS) - 1)], minlength=part.num_rows)
                p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, *StructType.fromDDL("score double, predicted int").fields]))


def op5_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels)
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
