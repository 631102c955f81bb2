"""Operator 11: phrase collocations from sorted count streams.

Words are known by 64-bit hashes, and where the frequent ones fit a filter by their places in it. Three passes over the texts count words, word pairs, and phrases of three and four words;
a batch counts its own phrases by sorting them, and the counts are combined on the map side before they are shuffled. A
phrase that occurs often enough consists of such phrases, so a pass skips what the pass before has ruled out (a filter of more
than ``MOST_FILTER`` numbers is one of bits and lets some other phrases through; the threshold decides: the result is the same).

The counts that reach the threshold are laid out twice, in prefix order (by first, second, .. word) and in suffix order (by
last, last but one, ..), ranges of both being dealt to tasks by the first two words of the order. One scan of the first
stream in lockstep with itself gives each phrase the counts of its beginnings and the largest count of a phrase that has one
word more on the right; the second stream gives the ends and the left. Both streams are then joined by merging. No longer
phrase needs a look: one that holds a phrase holds a one-word extension of it, which occurs at least as often.

Edge cases: null text is empty, null lang is ``und``; empty pieces, and pieces of one word, give no phrases; equal scores and
counts are ordered by the phrase's bytes; an empty table gives no rows; other columns are ignored. Two different words with
one hash in a language are noticed, and the run starts again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import STEP_BYTES, WordHasher, bytes_of, give_back, mix, pieces, stored

LEAST = 30
MOST_WORDS = 4
TOP = 2000
#: Parts of a language's phrases that are cut to their first TOP before one task ranks what is left, TOP from each.
RANK_PARTS = 64
#: Numbers of a filter that all tasks hold (8 bytes each).
MOST_FILTER = 4_000_000
#: A filter of more numbers than that is 2 ** LOG_BITS bits (32 MB), made in BIT_PARTS parts, a power of two.
LOG_BITS = 28
BIT_PARTS = 64
#: Words, and bytes of them, that a join broadcasts; more are joined by merging.
MOST_BROADCAST = 300_000
MOST_BROADCAST_BYTES = 8 << 20
WORDS = ["w1", "w2", "w3", "w4"]
COUNTS = ", ".join(["lang string", *(f"{w} long" for w in WORDS), "f long"])


def _breaks() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, and bytes that end a piece."""
    end = np.zeros(256, bool)
    end[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    word = ~end
    word[[0x20, 0x09]] = False
    return word, end


class Reader:
    """Words of a batch: their hashes, language numbers, places, and whether the next word is in the same piece."""

    def __init__(self, seed: int):
        self.is_word, self.is_end = _breaks()
        self.hasher = WordHasher(self.is_word, seed=seed)
        self.seeds: dict[str, int] = {}

    def __call__(self, batch: pa.RecordBatch):
        texts = bytes_of(batch, "text")
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        h, owner, self.starts, self.ends = self.hasher(texts)
        codes = batch.column("lang").dictionary_encode()
        self.names = codes.dictionary
        lang = codes.indices.to_numpy(zero_copy_only=False).astype(np.int32)[owner]
        ended = np.cumsum(self.is_end[self.data], dtype=np.int32)
        same = np.zeros(len(h), bool)
        if len(h) > 1:
            same[:-1] = ended[self.starts[1:]] == ended[self.ends[:-1] - 1]
        salt = np.array([self.salt(x) for x in self.names.to_pylist()], np.uint64)
        return h, lang, salt[lang] if len(h) else np.empty(0, np.uint64), same

    def salt(self, name: str) -> int:
        return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().lower().decode()


def phrase_keys(words: list[np.ndarray], salt: np.ndarray) -> np.ndarray:
    """A 64-bit key for each phrase of the words at the same place of the given arrays."""
    out = np.zeros(len(salt), np.uint64)
    for w in words:
        out = out * np.uint64(0xD1342543DE82EF95) + w
    return mix(mix(out) ^ salt)


def runs(x: np.ndarray, n: int) -> list[np.ndarray]:
    """``x`` from its first, second, .. n-th place on, all of the length that n neighbours leave."""
    m = max(0, len(x) - n + 1)
    return [x[i : i + m] for i in range(n)]


def counted(key: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of equal phrases, found by sorting; rows count as equal if all their parts are."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(key, kind="stable")
    new = np.zeros(len(key), bool)
    new[0] = True
    for p in parts:
        s = p[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(key)))


def places(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted array ``known``, and whether it does."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys


def bit_places(keys: np.ndarray) -> np.ndarray:
    """Where a key's bit is in a filter of bits."""
    return (keys >> np.uint64(64 - LOG_BITS)).astype(np.int64)


def in_bits(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    at = bit_places(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def is_exact(known) -> bool:
    """Whether a broadcast filter holds the keys themselves, so that a key has a place in it."""
    return known.value.dtype == np.uint64


def _arrow_long(x: np.ndarray | None, n: int) -> pa.Array:
    return pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, w1, f and the word itself, of all words; ``clash`` where two words have one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(seed)
        for whole in batches:
            for batch in pieces(whole, "text", STEP_BYTES):
                h, lang, salt, _ = read(batch)
                at, f = counted(phrase_keys([h], salt), [h, lang])
                words = pa.array([read.word(i) for i in at.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([read.names.take(pa.array(lang[at])), _arrow_long(h[at], len(at)), words, _arrow_long(f, len(at))], ["lang", "w1", "word", "f"])
        give_back()

    partial = docs.mapInArrow(run, "lang string, w1 long, word string, f long")
    return partial.groupBy("lang", "w1").agg(F.sum("f").alias("f"), F.min("word").alias("word"), (F.min("word") != F.max("word")).alias("clash"))


def phrase_counts(docs: DataFrame, seed: int, sizes: tuple[int, ...], words, pairs=None) -> DataFrame:
    """Counts of all phrases of the given sizes whose words and pairs of words are all in the broadcast filters (pairs None: any is).

    A word's id is its place in the filter of words, or where that is one of bits its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(seed)
        of = 1 if pairs is None else 2
        for whole in batches:
            for batch in pieces(whole, "text", STEP_BYTES):
                h, lang, salt, same = read(batch)
                good = np.ones(max(0, len(h) - of + 1), bool)
                key = phrase_keys([h], salt)
                if is_exact(words):
                    at, found = places(key, words.value)
                    h = at.astype(np.uint64)
                else:
                    found = in_bits(key, words.value)
                good &= np.logical_and.reduce(runs(found, of))
                if pairs is not None:
                    key = phrase_keys(runs(h, 2), runs(salt, 2)[0])
                    good &= places(key, pairs.value)[1] if is_exact(pairs) else in_bits(key, pairs.value)
                for n in sizes:
                    m = len(h) - n + 1
                    if m <= 0:
                        continue
                    fits = np.logical_and.reduce([*runs(same, n)[: n - 1], *[good[i : i + m] for i in range(n - of + 1)]])
                    place = np.flatnonzero(fits)
                    parts = [h[place + i] for i in range(n)]
                    first, f = counted(phrase_keys(parts, salt[place]), [*parts, lang[place]])
                    columns = [_arrow_long(parts[i][first] if i < n else None, len(first)) for i in range(MOST_WORDS)]
                    yield pa.RecordBatch.from_arrays([read.names.take(pa.array(lang[place[first]])), *columns, _arrow_long(f, len(first))], ["lang", *WORDS, "f"])
        give_back()

    return docs.mapInArrow(run, COUNTS).groupBy("lang", *WORDS).agg(F.sum("f").alias("f"))


def keys_in(batch: pa.RecordBatch, n: int, read: Reader) -> np.ndarray:
    """The keys of the first n words of a batch's phrases."""
    salt = np.array([read.salt(x) for x in batch.column("lang").to_pylist()], np.uint64)
    return phrase_keys([batch.column(w).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for w in WORDS[:n]], salt)


def keyed(df: DataFrame, n: int) -> DataFrame:
    """``df`` with the key of its first n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(0)
        for b in batches:
            yield b.append_column("key", _arrow_long(keys_in(b, n, read), b.num_rows))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("key", LongType())]))


def packed(df: DataFrame, n: int) -> DataFrame:
    """The keys of the first n words, 8 bytes each: one row holds those of a whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([keys_in(b, n, read).tobytes()], pa.binary())], ["keys"])

    return df.mapInArrow(run, "keys binary")


def bits_of(frequent: DataFrame, n: int) -> np.ndarray:
    """A filter of bits for the keys of the first n words; a task sets the bits of whole parts, whatever the number of keys."""
    size = (1 << LOG_BITS) // BIT_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = bit_places(b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            part = at // size
            for k in np.unique(part).tolist():
                held.setdefault(k, np.zeros(size, bool))[at[part == k] % size] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
        give_back()

    dealt = keyed(frequent, n).select("key").repartition(BIT_PARTS, F.shiftrightunsigned("key", 64 - BIT_PARTS.bit_length() + 1))
    bits = np.zeros((BIT_PARTS, size // 8), np.uint8)
    for row in dealt.mapInArrow(run, "part long, bits binary").collect():
        bits[row.part] |= np.frombuffer(row.bits, np.uint8)
    return bits.ravel()


def filter_of(frequent: DataFrame, n: int, most: int):
    """The keys of a stored table of frequent phrases of n words, sorted and broadcast; bits for them where they are more than
    ``most``, or where two have one key. The driver gets keys as bytes: a Python row for each takes some sixty times its 8 bytes."""
    words = frequent.select("lang", *WORDS[:n])
    keys = None
    if frequent.count() <= most:
        keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(row.keys, np.uint64) for row in packed(words, n).collect())])
        keys.sort()
    if keys is None or (keys[1:] == keys[:-1]).any():
        keys = bits_of(words, n)
    give_back()
    return frequent.sparkSession.sparkContext.broadcast(keys)


def with_places(known: DataFrame, words) -> DataFrame:
    """Frequent words under the ids that ``phrase_counts`` uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if is_exact(words):
                at, _ = places(b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), words.value)
                b = b.set_column(b.schema.get_field_index("w1"), "w1", _arrow_long(at, b.num_rows))
            yield b

    made = keyed(known, 1)
    return made.mapInArrow(run, made.schema).drop("key")


def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(lang, a, b, c, d, f) in order, shorter phrases first: each with the counts of its first two and first three words (None
    where it has no more words than that) and the largest count of a phrase with one word more.

    Only the phrase of two words and the one of three words that are open are held.
    """
    two = three = None
    for lang, a, b, c, d, f in rows:
        if three is not None and (d is None or three[:4] != [lang, a, b, c]):
            yield tuple(three)
            three = None
        if c is None:
            if two is not None:
                yield tuple(two)
            two = [lang, a, b, None, None, f, None, None, 0]
        elif d is None:
            two[8] = max(two[8], f)
            three = [lang, a, b, c, None, f, two[5], None, 0]
        else:
            three[8] = max(three[8], f)
            yield lang, a, b, c, d, f, two[5], three[5], 0
    yield from (tuple(x) for x in (three, two) if x is not None)


def stream(frequent: DataFrame, order: list[str]) -> DataFrame:
    """Scan the phrases of two and more words in the order of the columns a, b, c, d, which ``order`` names."""
    names = ["lang", "a", "b", "c", "d", "f", "in2", "in3", "longer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(n).to_pylist() for n in names[:6]], strict=True)

        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "lang" else pa.int64()) for n, x in zip(names, columns, strict=True)], names)

        for row in scan(rows()):
            held.append(row)
            if len(held) == 10_000:
                yield made()
                held.clear()
        if held:
            yield made()

    turned = frequent.select("lang", *[F.expr(x).alias(n) for n, x in zip("abcd", order, strict=True)], "f")
    dealt = turned.repartitionByRange("lang", "a", "b").sortWithinPartitions("lang", *[F.col(x).asc_nulls_first() for x in "abcd"])
    return dealt.mapInArrow(run, "lang string, a long, b long, c long, d long, f long, in2 long, in3 long, longer long")


#: The columns of the suffix order: the last word first.
BACKWARD = ["coalesce(w4, w3, w2)", "if(w4 is not null, w3, if(w3 is not null, w2, w1))", "if(w4 is not null, w2, if(w3 is not null, w1, null))", "if(w4 is not null, w1, null)"]


#: Cuts by their first part's words: the columns with the counts of both parts, for phrases of two, three and four words.
CUTS = {2: [("f1", "fn")], 3: [("f1", "out2"), ("in2", "fn")], 4: [("f1", "out3"), ("in2", "out2"), ("in3", "fn")]}


def best_cut() -> F.Column:
    """The struct (score, k, l, r) of the cut with the lowest score, then the smallest k; products are decimals of 27 digits."""
    cut = lambda k, l, r: f"struct(CAST(2000000 AS DECIMAL(7,0)) * CAST(f AS DECIMAL(19,0)) div (CAST({l} AS DECIMAL(19,0)) + CAST({r} AS DECIMAL(19,0))) AS score, {k} AS k, {l} AS l, {r} AS r)"
    of = {n: "array_min(array(" + ", ".join(cut(k + 1, *x) for k, x in enumerate(c)) + "))" for n, c in CUTS.items()}
    return F.expr(f"CASE WHEN w4 IS NOT NULL THEN {of[4]} WHEN w3 IS NOT NULL THEN {of[3]} ELSE {of[2]} END")


def phrases(docs: DataFrame, least: int = LEAST, most_filter: int = MOST_FILTER, seed: int = 7) -> DataFrame:
    """All candidates that no longer one covers: lang, phrase, a, l, r, n, score."""
    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(word_counts(plain, seed).withColumn("word", F.when(F.col("f") >= least, F.col("word"))), "words")
    if counts.where("clash").take(1):
        return phrases(docs, least, most_filter, seed + 1)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where(F.col("f") >= least).select("lang", "w1", "word", "f")
    words = filter_of(known, 1, most_filter)
    known = stored(with_places(known, words), "known-words")
    pairs = stored(phrase_counts(plain, seed, (2,), words).where(F.col("f") >= least), "pairs")
    more = stored(phrase_counts(plain, seed, (3, 4), words, filter_of(pairs, 2, most_filter)).where(F.col("f") >= least), "phrases")
    frequent = pairs.unionByName(more)
    name = lambda a, b, c, d: [F.col(a).alias("k1"), F.col(b).alias("k2"), F.coalesce(F.expr(c), F.lit(0)).alias("k3"), F.coalesce(F.expr(d), F.lit(0)).alias("k4"), F.when(F.col("d").isNotNull(), 4).when(F.col("c").isNotNull(), 3).otherwise(2).alias("size")]
    left = stream(frequent, WORDS).select("lang", F.col("a").alias("w1"), F.col("b").alias("w2"), F.col("c").alias("w3"), F.col("d").alias("w4"), "f", "in2", "in3", F.col("longer").alias("longer_right"), *name("a", "b", "c", "d"))
    back = stream(frequent, BACKWARD).select("lang", F.col("in2").alias("out2"), F.col("in3").alias("out3"), F.col("longer").alias("longer_left"), *name("a", "b", "c", "d"))
    # The suffix stream's words, turned round again.
    turned = back.select("lang", "out2", "out3", "longer_left", "size", F.expr("CASE size WHEN 4 THEN k4 WHEN 3 THEN k3 ELSE k2 END").alias("k1"), F.expr("CASE size WHEN 4 THEN k3 WHEN 3 THEN k2 ELSE k1 END").alias("k2"), F.expr("CASE size WHEN 4 THEN k2 WHEN 3 THEN k1 ELSE 0 END").alias("k3"), F.expr("CASE size WHEN 4 THEN k1 ELSE 0 END").alias("k4"))
    both = left.hint("merge").join(turned, ["lang", "size", "k1", "k2", "k3", "k4"])
    kept = both.where("100 * greatest(longer_right, longer_left) < 80 * f").select("lang", *WORDS, "f", "in2", "in3", "out2", "out3")
    few = known.agg((F.count("*") <= MOST_BROADCAST) & (F.coalesce(F.sum(F.octet_length("word")), F.lit(0)) <= MOST_BROADCAST_BYTES)).first()[0]
    for i, w in enumerate(WORDS, 1):
        names = known.select("lang", F.col("w1").alias(w), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"))
        kept = kept.join(F.broadcast(names) if few else names, ["lang", w], "left")
    scored = kept.withColumn("fn", F.coalesce("f4", "f3", "f2")).withColumn("best", best_cut())
    named = scored.select("lang", F.concat_ws(" ", "word1", "word2", "word3", "word4").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "best.score")
    return named.join(totals, "lang")


def op11_query(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: the first ones of each of RANK_PARTS parts of a language are ranked together."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = phrases(docs).withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
