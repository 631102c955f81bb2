"""Operator 9: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a text's vector bundles (adds) the vectors of all its n-grams, and so does a language's prototype
over all texts of the training folds. A text gets the language whose prototype has the largest cosine with its vector.

Letters are lower-cased; a run of other characters is one blank letter. Letters beyond a-z share CLASSES vectors by their
code point. Prototypes are D numbers per language, summed natively over partial sums of batches and kept as a table; what
the driver and the tasks hold of them is a block of about MOST_LANGUAGES.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; null langs are not learned from; null doc ids
are predicted, never learned from and not held out; without any prototype everything is ``und``; ties go to the language
that sorts first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held_out, pieces, spark_sum_vectors, stored, texts_of

D, N, CLASSES, SEED = 512, 3, 128, 11
#: Most n-gram vectors that a worker keeps; beyond that it starts anew.
MOST_GRAMS = 30_000
#: Languages whose prototypes are met in one pass; a column with more of them (a dirty one) takes more passes.
MOST_LANGUAGES = 4096


class Encoder:
    """Letters to classes, n-grams to codes, codes to vectors."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.letters = rng.choice(np.array([-1, 1], np.int8), (CLASSES, D))
        self.class_of = np.zeros(0x3000, np.uint8)
        for c in range(0x3000):
            if chr(c).isalpha():
                low = chr(c).lower()
                self.class_of[c] = self._class(ord(low[0]))
        self._reset()

    @staticmethod
    def _class(c: int) -> int:
        return c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 >> 7) % (CLASSES - 27)

    def _reset(self) -> None:
        self.row_of = np.full(CLASSES**N, -1, np.int32)
        self.rows = np.empty((1024, D), np.int8)
        self.used = 0

    def forget(self) -> None:
        """Let go of all vectors: other stages share the worker."""
        self._reset()

    def _classes(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        if len(c) and int(c.max()) >= len(self.class_of):
            far = c >= len(self.class_of)
            near = self.class_of[np.where(far, 0, c)]
            own, back = np.unique(c[far], return_inverse=True)
            near[far] = np.array([self._class(int(x)) if chr(int(x)).isalpha() else 0 for x in own], np.uint8)[back]
            return near
        return self.class_of[c]

    def codes(self, text: str) -> np.ndarray:
        """Codes of all n-grams of letters and blanks; empty where the text has no letter."""
        x = self._classes(text)
        if not x.any():
            return np.empty(0, np.int32)
        x = np.concatenate([[0], x, [0]]).astype(np.int32)
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        return (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """A row for each of the distinct codes."""
        if self.used > MOST_GRAMS:
            self._reset()
        new = codes[self.row_of[codes] < 0]
        if len(new):
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            made = np.ones((len(new), D), np.int8)
            for place in range(N):
                letter = new // CLASSES ** (N - 1 - place) % CLASSES
                made *= np.roll(self.letters, N - 1 - place, axis=1)[letter]
            self.rows[self.used : self.used + len(new)] = made
            self.row_of[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.rows[self.row_of[codes]].astype(np.float32)

    def bundle(self, codes: np.ndarray) -> np.ndarray:
        own, counts = np.unique(codes, return_counts=True)
        return counts.astype(np.float32) @ self.vectors(own)


_made: list[Encoder] = []


def encoder() -> Encoder:
    if not _made:
        _made.append(Encoder())
    return _made[0]


@dataclass
class Profiles:
    """A stored table (lang, vector) of one prototype per language, met in ``blocks`` parts by a hash of the name."""

    table: DataFrame
    blocks: int

    def block(self, number: int) -> tuple[list[str], np.ndarray]:
        """Names in order, and a unit vector for each."""
        rows = self.table.where(F.pmod(F.xxhash64("lang"), F.lit(self.blocks)) == number).collect()  # about MOST_LANGUAGES at most
        rows.sort(key=lambda r: r.lang)
        vectors = np.array([r.vector for r in rows]).reshape(len(rows), D)
        return [r.lang for r in rows], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def fit(documents: DataFrame, modulus: int = 5, kept_out: int = 0) -> Profiles:
    """Bundle every text of the training folds into its language's prototype."""
    known = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, kept_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        totals: dict[str, np.ndarray] = {}

        def summed() -> pa.RecordBatch:
            return pa.record_batch([list(totals), [v.tolist() for v in totals.values()]], schema=pa.schema([("lang", pa.string()), ("part", pa.list_(pa.float64()))]))

        for batch in batches:
            for part in pieces(batch, "text"):
                if len(totals) > MOST_LANGUAGES // 4:
                    yield summed()
                    totals.clear()
                held: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(texts_of(part, "text"), part.column("lang").to_pylist(), strict=True):
                    held.setdefault(lang, []).append(e.codes(text))
                for lang, codes in held.items():
                    own, n = np.unique(np.concatenate(codes).astype(np.int64), return_counts=True)
                    total = totals.setdefault(lang, np.zeros(D))
                    for a in range(0, len(own), 4096):
                        total += n[a : a + 4096].astype(np.float32) @ e.vectors(own[a : a + 4096])
        e.forget()
        if totals:
            yield summed()

    sums = spark_sum_vectors(known.select("text", "lang").mapInArrow(run, "lang string, part array<double>"), ["lang"], "part")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "total")))  # D of them
    table = stored(sums.groupBy("lang").agg(F.transform(ordered, lambda x: x["total"]).alias("vector")), "language-profiles")
    return Profiles(table, max(1, math.ceil(table.count() / MOST_LANGUAGES)))


def _nearest(documents: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """``documents``, of which the columns lang_pred and score hold the best of earlier blocks, with the best of these too."""
    shared = documents.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, (names, prototypes) = encoder(), shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                best_names, scores = part.column("lang_pred").to_pylist(), part.column("score").to_pylist()
                for i, text in enumerate(texts_of(part, "text")):
                    codes = e.codes(text) if text else ()
                    if not len(codes) or not names:
                        continue
                    v = e.bundle(codes).astype(float)
                    cosine = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(cosine.argmax())
                    name, score = names[best], float(np.clip((cosine[best] + 1) / 2, 0, 1))
                    if best_names[i] == "und" or (-score, name) < (-scores[i], best_names[i]):
                        best_names[i], scores[i] = name, score
                columns = [part.column(c) for c in part.schema.names[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best_names, pa.string()), pa.array(scores, pa.float64())], names=part.schema.names)
        e.forget()

    return documents.mapInArrow(run, documents.schema)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of ``documents`` with lang_pred and score, the cosine moved to 0..1 (columns of these names are replaced).

    One pass for each block of languages; a pass is stored before the next one.
    """
    found = documents.drop("lang_pred", "score").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    for number in range(profiles.blocks):
        found = _nearest(stored(found, "language-pass") if number else found, *profiles.block(number))
    return found


def op9_query(documents: DataFrame) -> DataFrame:
    found = identify(documents.select("doc_id", "text"), fit(documents))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
