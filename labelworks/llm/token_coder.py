"""Operator 1: token ids of whole texts in a compressed binary format.

Ids go through an adaptive context-mixing range coder. A block holds whole documents, is reset independently of all
others and carries a checksum. Inside a block the ids are dealt to up to 2,048 lanes (runs of neighbouring ids) that
are coded in step, so that NumPy works on all lanes at once; the lanes share the block's models:

* order 0: frequencies of the block's ids so far, renewed after each run of steps;
* order 1 and order 2: the id that last followed the last id, or the last two ids (hashed), with a confidence of 0 to 3.

Each id is coded once, with the mixed probability ``m2 * [p2 = x] + m1 * [p1 = x] + (1 - m2 - m1) * order0(x)``, where the
weights m2 and m1 follow how often predictions of that confidence have come true in the block.

A block, little-endian: ``magic, version, n_docs, n_ids, n_alphabet, lanes, crc32 of the ids, crc32 of all that follows the
header, lengths of the sections``,
then, zlib-compressed, doc ids, ids per document and the alphabet (gaps of the sorted ids), then each lane's number of
16-bit units and the units. Edge cases: a null text is an empty one; null and repeated doc ids are kept; a block
without ids has no lanes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, pieces
from .tokens import tokenizer

MAGIC = b"LWTK"
HEAD = struct.Struct("<4sBIIIIIIIII")
#: Ids after which a block is closed; a longer document makes a longer block.
BLOCK_IDS = 1 << 20
LANES, ORDER2_BITS, LEAST_TOTAL_BITS = 2048, 17, 20
#: Different ids that a block may hold; the coder's products stay exact up to it.
MOST_ALPHABET = 1 << 22
#: Steps of all lanes after which the order-0 frequencies and the weights are renewed: soon at first, then rarely.
FIRST_RUN, LONGEST_RUN = 4, 64
CODE_MASK = np.uint64((1 << 48) - 1)
NO_ID = np.iinfo(np.int64).min
#: What a miss (first four) or a hit adds to an entry, by its confidence.
STEP = np.array([0, 0, -2, -2, 1, 1, 1, 0], np.int32)


class _Models:
    """The adaptive state of a block, the same in the coder and in the decoder."""

    def __init__(self, alphabet: int):
        self.n = alphabet
        if alphabet > MOST_ALPHABET:
            raise ValueError(f"a block can hold {MOST_ALPHABET} different ids, not {alphabet}")
        self.bits = max(14, int(alphabet).bit_length() + 2)
        self.total = max(LEAST_TOTAL_BITS, self.bits + 2)
        self.counts = np.zeros(alphabet, np.int64)
        self.after1 = np.zeros(alphabet + 1, np.int32)
        self.after2 = np.zeros(1 << ORDER2_BITS, np.int32)
        self.hits = np.ones((2, 4)) * np.array([0.02, 0.2, 0.4, 0.6])
        self.seen = np.ones((2, 4))
        self.renew()

    def renew(self) -> None:
        """Cumulative order-0 frequencies that add up to 2**bits, each at least 1, and the two weights by confidence."""
        whole = 1 << self.bits
        share = (self.counts * 32 + 1) / (self.counts.sum() * 32 + self.n)
        freq = 1 + (share * (whole - self.n)).astype(np.int64)
        freq[int(freq.argmax())] += whole - int(freq.sum())
        self.cum = np.concatenate([[0], np.cumsum(freq)])
        room = (1 << self.total) - whole
        rate = np.clip(self.hits / self.seen, 0.0005, 0.98)
        self.weight = (rate * room * np.array([[0.33], [0.66]])).astype(np.int64)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.cum))

    @staticmethod
    def key2(last1: np.ndarray, last2: np.ndarray) -> np.ndarray:
        """Slot of a pair of ids (uint32 arithmetic, so that it wraps)."""
        return (last2 * np.uint32(0x9E3779B1) + last1 * np.uint32(0x85EBCA77)) >> np.uint32(32 - ORDER2_BITS)

    @staticmethod
    def learn(table: np.ndarray, key: np.ndarray, entry: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> None:
        """An entry is id * 4 + confidence. A hit raises the confidence to 3 at most; a miss takes 2 off, or takes in the new id."""
        new = entry + STEP.take((entry & 3) + (hit << 2))
        lost = np.flatnonzero(~hit & ((entry & 2) == 0))
        new[lost] = fresh[lost]
        table[key] = new

    def note(self, k2: np.ndarray, hit2: np.ndarray, k1: np.ndarray, hit1: np.ndarray, x: np.ndarray) -> None:
        """Take the outcomes of a run of steps into the statistics."""
        for row, (k, hit) in enumerate(((k1, hit1), (k2, hit2))):
            both = np.bincount(((k << 1) + hit).ravel(), minlength=8).reshape(4, 2)
            self.seen[row] += both.sum(1)
            self.hits[row] += both[:, 1]
        self.counts += np.bincount(x.ravel(), minlength=self.n)
        self.renew()


def _runs(steps: int) -> Iterator[tuple[int, int]]:
    first, size = 0, FIRST_RUN
    while first < steps:
        yield first, min(steps, first + size)
        first, size = first + size, min(2 * size, LONGEST_RUN)


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // 256)) if n else 0


def _code(x: np.ndarray, alphabet: int) -> list[bytes]:
    """Range-code ids that are indices into the alphabet; one string of units for each lane."""
    n, lanes = len(x), _lanes(len(x))
    steps = -(-n // lanes)
    grid = np.zeros(steps * lanes, np.int32)
    grid[:n] = x
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    alive = np.ascontiguousarray((np.arange(steps * lanes) < n).reshape(lanes, steps).T)
    m = _Models(alphabet)
    none = np.full((1, lanes), alphabet, np.int32)
    before1 = np.vstack([none, grid[:-1]])
    keys2 = m.key2(before1.view(np.uint32), np.vstack([none, before1[:-1]]).view(np.uint32))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, CODE_MASK, np.uint64)
    wide = 2 * steps + 8
    out, at = np.zeros(lanes * wide, np.uint32), np.arange(lanes) * wide  # at: each lane's next unit
    b16, b32 = np.uint64(16), np.uint64(32)
    top = np.uint64(1 << 32)
    for first, stop in _runs(steps):
        rows = slice(first, stop)
        e1, e2 = (np.empty(grid[rows].shape, np.int32) for _ in range(2))
        for i in range(first, stop):
            s = i - first
            k1, k2, own, fresh = before1[i], keys2[i], grid[i], grid[i] << 2
            e1[s], e2[s] = a1, a2 = m.after1.take(k1), m.after2.take(k2)
            m.learn(m.after1, k1, a1, (a1 >> 2) == own, fresh)
            m.learn(m.after2, k2, a2, (a2 >> 2) == own, fresh)
        x, live = grid[rows], alive[rows]
        p1, p2, c1, c2 = e1 >> 2, e2 >> 2, e1 & 3, e2 & 3
        w1, w2 = m.weight[0].take(c1), m.weight[1].take(c2)
        rest = (1 << m.total) - w1 - w2
        start0, end0 = m.cum.take(x) * rest >> m.bits, m.cum[1:].take(x) * rest >> m.bits
        hit1, hit2 = p1 == x, p2 == x
        start = (start0 + w1 * (p1 < x) + w2 * (p2 < x)).view(np.uint64)
        freq = (end0 - start0 + w1 * hit1 + w2 * hit2).view(np.uint64)
        every = bool(live.all())
        for s in range(x.shape[0]):
            unit = span >> np.uint64(m.total)
            if every:
                low += unit * start[s]
                span = unit * freq[s]
            else:
                low, span = np.where(live[s], low + unit * start[s], low), np.where(live[s], unit * freq[s], span)
            over = np.flatnonzero(low > CODE_MASK)
            if len(over):
                out[at[over] - 1] += 1
                low[over] &= CODE_MASK
            small = np.flatnonzero(span < top)
            while len(small):
                bottom, part, place = low.take(small), span.take(small) << b16, at.take(small)
                out[place] = bottom >> b32
                at[small] = place + 1
                low[small] = (bottom << b16) & CODE_MASK
                span[small] = part
                small = small[part < top]
        m.note(c2, hit2, c1, hit1, x)
    out, at = out.reshape(lanes, wide), at - np.arange(lanes) * wide
    for shift in (b32, b16, np.uint64(0)):
        out[np.arange(lanes), at] = (low >> shift) & np.uint64(0xFFFF)
        at += 1
    for j in range(int(at.max()) - 1, 0, -1):
        out[:, j - 1] += out[:, j] >> 16
    out &= 0xFFFF
    return [out[j, : at[j]].astype("<u2").tobytes() for j in range(lanes)]


def _decode(n: int, alphabet: int, lanes: int, units: list[np.ndarray]) -> np.ndarray:
    steps = -(-n // lanes)
    m = _Models(alphabet)
    wide = max(map(len, units)) + 4
    data = np.zeros((lanes, wide), np.uint64)
    for j, u in enumerate(units):
        data[j, : len(u)] = u
    b16, top, low20 = np.uint64(16), np.uint64(1 << 32), np.uint64(m.total)
    code = (data[:, 0] << np.uint64(32)) | (data[:, 1] << b16) | data[:, 2]
    span, last_value = np.full(lanes, CODE_MASK, np.uint64), np.uint64((1 << m.total) - 1)
    grid = np.zeros((steps, lanes), np.int32)
    alive = np.ascontiguousarray((np.arange(steps * lanes) < n).reshape(lanes, steps).T)
    last1 = np.full(lanes, alphabet, np.int32)
    last2 = last1.copy()
    flat, at = data.reshape(-1), np.arange(lanes) * wide + 3
    for first, stop in _runs(steps):
        shape = (stop - first, lanes)
        c1, c2, h1, h2 = np.empty(shape, np.int32), np.empty(shape, np.int32), np.empty(shape, bool), np.empty(shape, bool)
        slots, cum, upper, last_slot = m.slots(), m.cum, m.cum[1:], np.uint64((1 << m.bits) - 1)
        weight1, weight2, every = m.weight[0], m.weight[1], bool(alive[first:stop].all())
        for i in range(first, stop):
            s = i - first
            k2 = m.key2(last1.view(np.uint32), last2.view(np.uint32))
            e1, e2 = m.after1.take(last1), m.after2.take(k2)
            p1, p2 = e1 >> 2, e2 >> 2
            c1[s], c2[s] = e1 & 3, e2 & 3
            w1, w2 = weight1.take(c1[s]), weight2.take(c2[s])
            rest = (1 << m.total) - w1 - w2
            unit = span >> low20
            v = np.minimum(code // unit, last_value).view(np.int64)
            # The interval of a predicted id, if the value lies in it; else the value without the weights below it.
            below, same = p1 < p2, p1 == p2
            s1 = (cum.take(p1) * rest >> m.bits) + w2 * ~(below | same)
            t1 = (upper.take(p1) * rest >> m.bits) + w2 * ~below + w1
            s2 = (cum.take(p2) * rest >> m.bits) + w1 * below
            t2 = (upper.take(p2) * rest >> m.bits) + w1 * (below | same) + w2
            in1, in2 = (v >= s1) & (v < t1), (v >= s2) & (v < t2)
            v0 = v - w1 * (v >= t1) - w2 * (v >= t2)
            guess = np.minimum(((v0 + 1 << m.bits) - 1).view(np.uint64) // rest.view(np.uint64), last_slot).view(np.int64)
            x = np.where(in1, p1, np.where(in2, p2, slots.take(guess)))
            if not every:
                x = np.where(alive[i], x, np.int32(0))
            grid[i] = x
            start0, end0 = cum.take(x) * rest >> m.bits, upper.take(x) * rest >> m.bits
            h1[s], h2[s] = p1 == x, p2 == x
            start = (start0 + w1 * (p1 < x) + w2 * (p2 < x)).view(np.uint64)
            freq = (end0 - start0 + w1 * h1[s] + w2 * h2[s]).view(np.uint64)
            if every:
                code, span = code - unit * start, unit * freq
            else:
                code, span = np.where(alive[i], code - unit * start, code), np.where(alive[i], unit * freq, span)
            small = np.flatnonzero(span < top)
            while len(small):
                place, part = at.take(small), span.take(small) << b16
                code[small] = (code.take(small) << b16) | flat.take(place)
                at[small] = place + 1
                span[small] = part
                small = small[part < top]
            fresh = x << 2
            m.learn(m.after1, last1, e1, h1[s], fresh)
            m.learn(m.after2, k2, e2, h2[s], fresh)
            last2, last1 = last1, x
        m.note(c2, h2, c1, h1, grid[first:stop])
    return grid.T.reshape(-1)[:n]


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and each id's number among them."""
    if not len(ids) or int(ids.max()) >= MOST_ALPHABET:
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(int(ids.max()) + 1, bool)
    seen[ids] = True
    return np.flatnonzero(seen).astype(np.uint32), (np.cumsum(seen, dtype=np.int32) - 1).take(ids)


def pack_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One self-contained block of whole documents. ``doc_ids``: int64, NO_ID for null."""
    ids = np.ascontiguousarray(ids, "<u4")
    alphabet, x = _alphabet(ids)
    lanes = _code(x, len(alphabet)) if len(ids) else []
    meta = [zlib.compress(np.ascontiguousarray(a).tobytes(), 6) for a in (np.diff(doc_ids.astype("<i8"), prepend=np.int64(0)), counts.astype("<u4"), np.diff(alphabet, prepend=np.uint32(0)).astype("<u4"))]
    body = b"".join([*meta, np.array([len(b) // 2 for b in lanes], "<u4").tobytes(), *lanes])
    return HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), len(alphabet), len(lanes), zlib.crc32(ids.tobytes()), zlib.crc32(body), *map(len, meta)) + body


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, ids per document and all ids of a block; a damaged block raises ValueError."""
    magic, version, n_docs, n, n_alphabet, n_lanes, crc, body_crc, *sizes = HEAD.unpack_from(block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    if zlib.crc32(memoryview(block)[HEAD.size :]) != body_crc:
        raise ValueError("a token block's checksum is wrong")
    at, parts = HEAD.size, []
    for k, kind in zip(sizes, ("<i8", "<u4", "<u4"), strict=True):
        parts.append(np.frombuffer(zlib.decompress(block[at : at + k]), kind))
        at += k
    doc_ids, counts, alphabet = np.cumsum(parts[0]), parts[1].astype(np.int64), np.cumsum(parts[2], dtype=np.uint32)
    if len(doc_ids) != n_docs or len(alphabet) != n_alphabet:
        raise ValueError("damaged token block")
    lengths = np.frombuffer(block, "<u4", n_lanes, at).astype(np.int64)
    units = np.frombuffer(block, "<u2", int(lengths.sum()), at + 4 * n_lanes)
    ids = np.empty(0, "<u4")
    if n:
        ids = alphabet[_decode(n, n_alphabet, n_lanes, np.split(units, np.cumsum(lengths)[:-1]))].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a token block's checksum is wrong")
    return doc_ids, counts, ids


BLOCKS = pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])


def write_token_blocks(documents: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text and write blocks in ascending doc_id order to ``path``; the table of blocks.

    ``file_no`` then ``block_no`` give the order. The container is an uncompressed Parquet table with a block per row, so
    that Spark commits it and any store that Spark writes to will do.
    """
    spark = documents.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no, block_no, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.record_batch([[file_no], [block_no], [len(doc_ids)], [len(ids)], [pack_block(doc_ids, counts, ids)]], schema=BLOCKS)
            held.clear()
            return row

        for batch in batches:
            for part in pieces(batch, "text"):
                ids, counts = tokenizer(tokenizer_path).encode(part.column("text"))
                if end_id is not None:
                    ends = np.cumsum(counts)
                    ids = np.insert(ids, ends, end_id)
                    counts = counts + 1
                doc_ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                upto = np.cumsum(counts)
                a = 0
                while a < len(counts):
                    done = int(upto[a - 1]) if a else 0
                    b = min(len(counts), max(a + 1, int(np.searchsorted(upto, done + block_ids - size, "left")) + 1))
                    held.append((doc_ids[a:b], counts[a:b], ids[done : int(upto[b - 1])]))
                    size += int(upto[b - 1]) - done
                    a = b
                    if size >= block_ids:
                        yield flush()
                        block_no, size = block_no + 1, 0
        if held:
            yield flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encode, "file_no int, block_no int, n_docs long, n_ids long, block binary").write.option("compression", "none").parquet(path)
    return read_token_blocks(spark, path)


def read_token_blocks(spark, path: str) -> DataFrame:
    return spark.read.schema("file_no int, block_no int, n_docs long, n_ids long, block binary").parquet(path)


def read_token_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    kind = pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts, ids = unpack_block(batch.column("block")[row].as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(counts)
                columns = [np.full(n, batch.column("file_no")[row].as_py(), np.int32), np.full(n, batch.column("block_no")[row].as_py(), np.int32), pa.array(doc_ids, mask=doc_ids == NO_ID), ends - counts, counts, np.array(crc, np.int64)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=kind)

    extra = ", ids array<int>" if with_ids else ""
    docs = blocks.select("file_no", "block_no", "block").mapInArrow(decode, "file_no int, block_no int, doc_id long, inside long, n_tokens long, ids_crc32 long" + extra)
    # Ids before each block: totals of the files first (a row per file), then inside each file. No window over all blocks.
    heads = blocks.select("file_no", "block_no", "n_ids")
    before_file = heads.groupBy("file_no").agg(F.sum("n_ids").alias("file_ids"))
    files = before_file.withColumn("file_start", F.sum("file_ids").over(Window.orderBy("file_no")) - F.col("file_ids")).select("file_no", "file_start")
    inside = Window.partitionBy("file_no").orderBy("block_no")
    starts = heads.withColumn("before", F.sum("n_ids").over(inside) - F.col("n_ids")).join(files, "file_no").select("file_no", "block_no", (F.col("before") + F.col("file_start")).alias("block_start"))
    wanted = ["doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return docs.join(starts, ["file_no", "block_no"]).select(*wanted)


def op1_query(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    blocks = write_token_blocks(documents, fresh_path(documents.sparkSession, "tokens"), tokenizer_path)
    return read_token_documents(blocks)

