"""Operator 3: benchmark decontamination by winnowing.

Both sides keep, of every WINDOW consecutive hashes of K words each, the smallest (all of them on a tie). Which ones
are kept depends on the words inside the window alone, so a shared run of K + WINDOW - 1 = 13 words always leaves a
common fingerprint at the same place of both. The fingerprints are joined, and each hit is extended to the windows of 13
words around it, which are compared with the items' windows by hash, each different one once: a run that repeats itself on
both sides costs its words, not their product. Items of fewer words are one window each.

The benchmark is taken in blocks of at most ``block_words`` words, which is what a task holds of it; a larger benchmark
makes more passes over the documents, and the hits of a document are then united. Documents are never shuffled.

Edge cases: a null or empty text has no words, no hits and is not contaminated; null and repeated doc ids are kept as
rows; null item texts, and items without words, are never found; repeated items each count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WordHasher, bytes_of, pieces, rolling, stored

K, WINDOW = 7, 7
SPAN = K + WINDOW - 1
BLOCK_WORDS = 8_000_000
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_bytes() -> np.ndarray:
    """Bytes of words: digits, letters and all of UTF-8 beyond ASCII (capitals are lower-cased)."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return inside


def _extreme(x: np.ndarray, w: int, pick, fill: np.uint64, back: bool) -> np.ndarray:
    """Smallest or largest of each w neighbours from a place on, or up to it, by doubling."""
    out, done = x.copy(), 1
    while done < w:
        step = min(done, w - done)
        moved = np.full(len(x), fill, np.uint64)
        if back:
            moved[step:] = out[: max(0, len(x) - step)]
        else:
            moved[: max(0, len(x) - step)] = out[step:]
        out, done = pick(out, moved), done + step
    return out


def fingerprints(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed K-word runs; owner: the text of each word."""
    grams = rolling(hashes, K)
    if not len(grams):
        return np.empty(0, np.int64), grams
    whole = owner[: len(grams)] == owner[K - 1 :]
    grams = np.where(whole, grams, TOP)
    least = _extreme(grams, WINDOW, np.minimum, TOP, back=False)
    least[max(0, len(least) - WINDOW + 1) :] = 0  # no full window starts there; those of the last texts are padded below
    kept = whole & (_extreme(least, WINDOW, np.maximum, np.uint64(0), back=True) == grams)
    at = np.flatnonzero(kept)
    return at, grams[at]


def _table(hashes: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their items, each pair once."""
    h, i = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((hashes, np.uint64), (items, np.int32)))
    order = np.lexsort((i, h))
    h, i = h[order], i[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1])
    return h[new], i[new]


class Matcher:
    """A block of the benchmark, ready to be looked up: fingerprints, and the windows of each number of words."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.hasher = WordHasher(word_bytes())
        # Items of one text are looked up once.
        equal: dict[bytes, list[str]] = {}
        for name, raw in items:
            equal.setdefault(raw, []).append(name)
        self.names = list(equal.values())
        # Padding keeps the last item's windows whole.
        hashes, owner, _, _ = self.hasher([*equal, b"a " * SPAN])
        bounds = np.searchsorted(owner, np.arange(len(equal) + 1))
        sizes = np.diff(bounds)
        at, found = fingerprints(hashes, owner)
        long = np.append(sizes >= SPAN, False)
        self.found = np.unique(found[long[owner[at]]])
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SPAN + 1):
            own = np.flatnonzero(sizes == n if n < SPAN else sizes >= n)
            if len(own):
                grams = [rolling(hashes[bounds[i] : bounds[i + 1]], n) for i in own]
                self.windows[n] = _table(grams, [np.full(len(g), i, np.int32) for g, i in zip(grams, own, strict=True)])

    def match(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Where each text's words begin, which words are hit, and the items with windows in each text.

        A fingerprint found in the benchmark is extended to the windows that hold it, and these are looked up; shorter items
        are looked up at all places. Time grows with the words and what is found, however often either side repeats itself.
        """
        hashes, owner, _, _ = self.hasher([*texts, b"a " * SPAN])
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        last = int(bounds[-1])
        edges = np.zeros(last + 1, np.int32)
        pairs: list[np.ndarray] = []
        for n, (table, items) in self.windows.items():
            grams = rolling(hashes, n)[: max(0, last - n + 1)]
            asked = owner[: len(grams)] == owner[n - 1 : n - 1 + len(grams)]
            if n == SPAN:
                at, found = fingerprints(hashes, owner)
                at = at[(at < last) & np.isin(found, self.found)]
                around = np.zeros(last + SPAN + 1, np.int32)
                np.add.at(around, np.maximum(at - (WINDOW - 1), 0), 1)
                np.add.at(around, at + 1, -1)
                asked &= np.cumsum(around)[: len(grams)] > 0
            at = np.flatnonzero(asked)
            first = np.searchsorted(table, grams[at], "left")
            there = table[np.minimum(first, len(table) - 1)] == grams[at]
            at, first = at[there], first[there]
            edges[at] += 1
            edges[at + n] -= 1
            # A text and a window that it holds, once; then the window's items.
            once = np.unique(owner[at] * len(table) + first)
            text, first = once // len(table), once % len(table)
            many = np.searchsorted(table, table[first], "right") - first
            row = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs.append(np.unique(np.repeat(text, many) * len(self.names) + items[row]))
        own: list[list[int]] = [[] for _ in texts]
        for x in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
            own[x // len(self.names)].append(x % len(self.names))
        return bounds, np.cumsum(edges)[:last] > 0, own


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of at most so many words (or one item), streamed to the driver one after the other."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").toLocalIterator():
        raw = row.t.encode()
        n = max(1, len(raw) // 2)  # words at most
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.i or "", raw))
        size += n
    yield block


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _marked(documents: DataFrame, items: list[tuple[str, bytes]], spans: bool) -> DataFrame:
    """Documents with the result columns or, with spans, with the hit words and items of this block."""
    shared = documents.sparkSession.sparkContext.broadcast(items)
    made: list[Matcher] = []
    names = documents.columns
    added = ["n_words", "hit_words", "hit_items"] if spans else ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())] if spans else [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(shared.value))
        matcher = made[0]
        for batch in batches:
            for part in pieces(batch, "text"):
                bounds, is_hit, found = matcher.match(bytes_of(part, "text"))
                rows = []
                for a, b, items in zip(bounds[:-1].tolist(), bounds[1:].tolist(), found, strict=True):
                    n, own = b - a, [name for i in items for name in matcher.names[i]]
                    hit = np.flatnonzero(is_hit[a:b])
                    rows.append((n, hit.tolist(), own) if spans else (n, len(hit), len(own), _digest(own), len(hit) > 0 and 20 * len(hit) >= n))
                columns = list(part.columns) + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    extra = "n_words long, hit_words array<long>, hit_items array<string>" if spans else RESULT
    schema = StructType([*documents.schema.fields, *StructType.fromDDL(extra).fields])
    return documents.mapInArrow(run, schema)


def find_contamination(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``documents`` (doc_id and text are used) with n_words, n_hit, n_items, items_sha256, contaminated.

    Columns of ``documents`` that have one of these names are replaced.
    """
    documents = documents.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    blocks = list(_first_two(_blocks(benchmark, block_words)))
    if len(blocks) == 1:
        return _marked(documents, blocks[0], spans=False)
    # Several blocks: rows keep a number of their own, under a name that no column has, and hits are united by it.
    row = "row"
    while row.lower() in {c.lower() for c in documents.columns}:
        row += "_"
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    # One block after the other: the driver never holds more than one.
    texts = numbered.select(F.col(row).alias("row"), "text")
    parts = [stored(_marked(texts, b, spans=True).select("row", "n_words", "hit_words", "hit_items"), "decontaminate-hits") for b in _blocks(benchmark, block_words)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    words = every.select("row", F.explode("hit_words").alias("w")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    items = every.where(F.size("hit_items") > 0).groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("hit_items"))).alias("items"))
    n_hit, n_items = F.coalesce("n_hit", F.lit(0)), F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0))
    found = parts[0].select("row", "n_words").join(words, "row", "left").join(items, "row", "left").select(
        F.col("row").alias(row), "n_words", n_hit.cast("long").alias("n_hit"), n_items.cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
    return numbered.join(found, row).drop(row)


def _first_two(blocks: Iterator) -> Iterator:
    for _, b in zip(range(2), blocks, strict=False):
        yield b


def op3_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contamination(documents.select("doc_id", "text"), benchmark).drop("text")
