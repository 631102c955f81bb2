"""Operator 8: quality classifier on random Fourier features.

One pass reduces each whole text to some statistics. Random Fourier features of the standardised statistics approximate
a Gaussian kernel; partitions sum their part of the normal equations, whose ridge solution gives a raw score, and isotonic
regression over a histogram of raw scores turns that into the share of good documents.

Only matrices of the features' number squared, and a histogram, reach the driver.
Edge cases: a null or empty text has all-zero statistics and is scored like any other; null labels are not learned from;
null doc ids are scored, never learned from and not held out; with no labelled rows each score is 0.5; repeated rows count
as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WordHasher, bytes_of, held_out, pieces, stored

STATS = ["log_bytes", "log_words", "word_length", "word_spread", "upper", "lower", "digit", "blank", "line_end", "mark", "sign", "bar", "shout", "high", "distinct", "commonest", "repeats", "lines", "line_distinct", "sentence_length", "near_repeats", "word_signs"]


#: Sums of one line of the normal equations that reach the driver, at most.
PARTS = 8


def _space_words() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[32, 9, 10, 11, 12, 13]] = False
    return inside


_hasher: list[WordHasher] = []
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line_end": (10,), "mark": b".,;:'\"()?-", "sign": b"#$%&*@^~_=+<>{}[]\\/`", "bar": b"|", "shout": b"!", "high": range(128, 256)}


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATS for each text."""
    if not _hasher:
        _hasher.append(WordHasher(_space_words(), lower=False))
    out = np.zeros((len(texts), len(STATS)))
    h, owner, starts, ends = _hasher[0](texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    sizes = ends - starts
    signs = np.zeros(256, bool)
    signs[list(b"#$%&*!|")] = True
    last_sign = signs[data[ends - 1]] if len(ends) else np.empty(0, bool)
    columns = [np.array(list(v)) for v in _CLASSES.values()]
    for i, t in enumerate(texts):
        if not t:
            continue
        a, b = bounds[i], bounds[i + 1]
        counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        n, row = len(t), out[i]
        row[0] = np.log1p(n)
        row[4:14] = [counts[c].sum() / n for c in columns]
        row[17] = np.log1p(counts[10])
        if b > a:
            own, length = h[a:b], sizes[a:b]
            k = b - a
            _, each = np.unique(own, return_counts=True)
            row[1], row[2], row[3] = np.log1p(k), length.mean(), length.std()
            row[14], row[15] = len(each) / k ** 0.9, each.max() / k
            row[16] = (own[1:] == own[:-1]).mean() if k > 1 else 0
            row[20] = max(((own[s:] == own[:-s]).mean() for s in (2, 3, 4, 5, 6, 8) if k > s), default=0)
            row[21] = last_sign[a:b].mean()
            row[19] = np.log1p(k / (1 + counts[46] + counts[63] + counts[33]))
        lines = t.split(b"\n")
        row[18] = len(set(lines)) / len(lines)
    return out


def with_statistics(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and an array column ``stats``; the texts themselves are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = statistics(bytes_of(part, "text"))
                column = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(STATS), dtype=np.int32), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), column], names=[*keep, "stats"])

    wanted = documents.select(*keep, F.col("text").cast("string").alias("text")) if "text" not in keep else documents.select(*keep)
    return wanted.mapInArrow(run, StructType([*(documents.schema[c] for c in keep), *StructType.fromDDL("stats array<double>").fields]))


@dataclass
class RidgeModel:
    """Standardisation, random features, ridge weights and the isotonic steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.omega + self.phase)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for s, c in zip(sums.tolist(), counts.tolist(), strict=True):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), s / c) for s, c, k in blocks]) if blocks else np.empty(0)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, kept_out: int = 0, features: int = 256, ridge: float = 1e-2, bandwidth: float = 6.0, seed: int = 3) -> RidgeModel:
    """``stats``: doc_id and stats of all documents. Learns from every labelled row of the training folds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, kept_out))
    rows = stored(stats.select(F.col("doc_id").cast("long").alias("doc_id"), "stats").join(known, "doc_id").select("stats", "y"), "quality-train")
    moments = rows.agg(*[f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(len(STATS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(len(STATS))])
    scale = np.maximum(np.array([moments[f"s{i}"] or 0.0 for i in range(len(STATS))]), 1e-6)
    rng = np.random.default_rng(seed)
    model = RidgeModel(mean, scale, rng.normal(0, 1 / bandwidth, (len(STATS), features)) * np.sqrt(2), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.empty(0), np.empty(0))
    size = features + 2

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for pdf in batches:
            z = np.column_stack([model.features(np.stack(pdf["stats"].to_numpy())), pdf["y"]]) if len(pdf) else np.empty((0, size))
            total += z.T @ z
        yield pd.DataFrame({"part": TaskContext.get().partitionId() % PARTS, "line": np.arange(size), "total": [x.tobytes() for x in total]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for part, line, total in zip(pdf["part"], pdf["line"], pdf["total"], strict=True):
                sums[part, line] = sums.get((part, line), 0) + np.frombuffer(total)
        yield pd.DataFrame({"line": [line for _, line in sums], "total": [x.tobytes() for x in sums.values()]})

    # Every partition sums its own rows, where they are. Lines of these matrices are dealt and summed again, so that neither the
    # number of tasks is fixed nor the driver gets more than PARTS lines for each line.
    lines = rows.mapInPandas(equations, "part int, line int, total binary").repartition("part", "line").mapInPandas(added, "line int, total binary")
    total = np.zeros((size, size))
    for r in lines.collect():
        total[r.line] += np.frombuffer(r.total)
    n = total[size - 2, size - 2]
    if n == 0:
        return model
    model.weights = np.linalg.solve(total[:-1, :-1] + ridge * np.eye(size - 1), total[:-1, -1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"bin": np.clip(np.floor(model.raw(np.stack(pdf["stats"].to_numpy())) * 256), -256, 511).astype(int), "y": pdf["y"]})

    bins = rows.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("s"), F.count("*").alias("c")).orderBy("bin").collect()  # 768 rows at most
    model.knots = np.array([(b.bin + 0.5) / 256 for b in bins])
    model.levels = isotonic(np.array([b.s for b in bins]), np.array([float(b.c) for b in bins]))
    return model


def score_texts(documents: DataFrame, model: RidgeModel, threshold: float = 0.3) -> DataFrame:
    """All columns of ``documents`` with score and predicted, from their texts (columns of these names are replaced)."""
    documents = documents.drop("score", "predicted")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                p = shared.value.score(statistics(bytes_of(part, "text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, *StructType.fromDDL("score double, predicted int").fields]))


def score_column(model: RidgeModel) -> Callable[[Column], Column]:
    """The score of a column of statistics; null where they are null."""

    @F.pandas_udf("double")
    def run(stats: pd.Series) -> pd.Series:
        out, known = pd.Series(np.nan, stats.index, float), stats.notna().to_numpy()
        if known.any():
            out[known] = model.score(np.stack(stats[known].to_numpy()))
        return out

    return run


def score_statistics(stats: DataFrame, model: RidgeModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted from stored statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = shared.value.score(np.stack(pdf["stats"].to_numpy()))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": p, "predicted": (p >= threshold).astype(int)})

    return stats.select(F.col("doc_id").cast("long").alias("doc_id"), "stats").mapInPandas(run, "doc_id long, score double, predicted int")


def op8_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    stats = stored(with_statistics(documents, ["doc_id"]), "quality-stats")
    model = fit(stats, labels)
    return score_statistics(stats, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
