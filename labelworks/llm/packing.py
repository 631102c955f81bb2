"""Operator 4: best-fit packing of documents into sequences, by linear grouping.

Lengths are whole numbers of at most ``capacity`` tokens, so the corpus enters the optimiser as a histogram of at most
2,048 rows, whatever its size:

1. the larger lengths are sorted and cut into groups of equal cardinality, and rounded up to their group's largest;
2. a covering program over configurations of the few rounded sizes is solved by column generation (a knapsack prices
   new configurations) and rounded down; what is left over is placed by best fit;
3. actual lengths take the rounded ones' places, the longest first, and the last place of a configuration goes to the
   longest one that still fits; what is left is grouped and solved again;
4. small lengths go, the largest first, to the sequence with the least room that still holds them.

All four steps work on runs of equal sequences. The plan is a list of (length, ranks, sequences, offset) runs; a piece
finds its run by its rank among the pieces of its length. Ranks come from counts by (length, bucket of a hash) and a
window inside each bucket, so a length that a third of all pieces have is still spread over many tasks.

Edge cases: a null text is an empty one and still has its end id; a longer document is cut into whole pieces and a rest;
null and repeated doc ids are kept, equal rows get places of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, pieces, stored
from .tokens import forget, tokenizer

#: Words that a task keeps the ids of; it lets go of them at its end, as other stages share its worker.
MOST_WORDS = 200_000
#: Bytes of text that are encoded at once.
STEP = 1 << 19
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", STEP):
                ids, counts = tokenizer(tokenizer_path, MOST_WORDS).encode(part.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), n)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(counts[owner] - start, capacity)
                at = ((np.cumsum(counts) - counts)[owner] + start).tolist()
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at, length.tolist(), strict=True)]
                yield pa.record_batch([part.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=PIECES)
        forget()
        give_back()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of largest value that fits (unbounded knapsack over whole sizes)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    small = int(sizes.min())
    for room in range(small, capacity + 1):
        fits = sizes <= room
        got = np.where(fits, best[np.maximum(room - sizes, 0)] + values, -1.0)
        k = int(got.argmax())
        if got[k] > best[room - 1] + 1e-12:
            best[room], pick[room] = got[k], k
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room >= small:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, turns: int = 300) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, by column generation on the covering program; demands are never exceeded."""
    g = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(turns):
        duals = np.linalg.solve(basis.T, np.ones(g))
        value, new = _price(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        x, way = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, new.astype(float))
        ratios = np.where(way > 1e-9, np.maximum(x, 0) / np.maximum(way, 1e-12), np.inf)
        if not np.isfinite(ratios).any():
            break
        basis[:, int(ratios.argmin())] = new
    x = np.linalg.solve(basis, demand.astype(float))
    left, out = demand.copy(), []
    for j in np.argsort(-x):
        column = np.rint(basis[:, j]).astype(np.int64)
        used = column > 0
        times = int(min(np.floor(max(x[j], 0) + 1e-9), (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            out.append((column, times))
            left -= column * times
    return out


class _Bins:
    """Runs of equal sequences by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.placed: list[tuple[int, int, int, int]] = []  # length, first sequence, sequences, offset

    def open(self, n: int) -> tuple[int, int]:
        self.count += n
        return self.count - n, n

    def put(self, run: tuple[int, int], room: int) -> None:
        if run[1] <= 0 or room <= 0:
            return
        if not self.by_room[room]:
            insort(self.rooms, room)
        self.by_room[room].append(run)

    def place(self, run: tuple[int, int], room: int, length: int, copies: int) -> None:
        for c in range(copies):
            self.placed.append((length, *run, self.capacity - room + c * length))
        self.put(run, room - copies * length)

    def best_fit(self, length: int, n: int) -> None:
        """Place n pieces of a length, each where the least room is left that holds it; copies go on into the same sequence."""
        while n:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                room, run = self.capacity, self.open(max(1, n // (self.capacity // length)))
            else:
                room = self.rooms[i]
                run = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.rooms.pop(i)
            each = min(n, room // length)
            take = min(run[1], n // each)
            self.place((run[0], take), room, length, each)
            self.put((run[0] + take, run[1] - take), room)
            n -= each * take


def group_sizes(stock: dict[int, int], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounded sizes, the largest first, and the number of pieces rounded up to each: groups of equal cardinality, but for
    pieces of one length, which stay together."""
    lengths = sorted((s for s, n in stock.items() if n), reverse=True)
    each = -(-sum(stock[s] for s in lengths) // groups)
    sizes: list[int] = []
    demand: list[int] = []
    for s in lengths:
        if not sizes or demand[-1] >= each:
            sizes.append(s)
            demand.append(0)
        demand[-1] += stock[s]
    return np.array(sizes), np.array(demand)


class _Stock:
    """Unplaced large pieces by length."""

    def __init__(self, pieces: dict[int, int]):
        self.left = {s: n for s, n in pieces.items() if n}
        self.lengths = sorted(self.left)

    def longest(self, most: int, taken: list[int]) -> int | None:
        """The longest length of at most ``most`` of which there are more pieces than in ``taken``."""
        i = bisect_right(self.lengths, most) - 1
        while i >= 0 and self.left[self.lengths[i]] <= taken.count(self.lengths[i]):
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def take(self, chosen: list[int], n: int) -> None:
        for s in chosen:
            self.left[s] -= n
            if not self.left[s]:
                del self.left[s]
                self.lengths.remove(s)


def plan(histogram: dict[int, int], capacity: int = 2048, groups: int = 24, small_share: float = 1 / 6) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """Runs (length, first sequence, sequences, offset) that place every piece, the number of sequences, and how many of
    them configurations have opened.

    Configurations are solved for the pieces that are left, up to three times. Each slot of a configuration takes the
    longest piece of its group, the last slot the longest one that still fits. Then small ones, and the few large ones
    that rounding down has left over, go by best fit, the largest first.
    """
    bins = _Bins(capacity)
    if histogram.get(capacity, 0):
        bins.place(bins.open(histogram[capacity]), capacity, capacity, 1)
    stock = _Stock({s: n for s, n in histogram.items() if capacity * small_share < s < capacity})
    opened = bins.count
    for _ in range(3):
        if not stock.left:
            break
        sizes, demand = group_sizes(stock.left, groups)
        for column, times in configurations(sizes, demand, capacity):
            slots = [int(sizes[g]) for g in np.flatnonzero(column).tolist() for _ in range(int(column[g]))]
            while times:
                chosen: list[int] = []
                room = capacity
                for k, size in enumerate(slots):
                    s = stock.longest(room if k == len(slots) - 1 else min(size, room), chosen)
                    if s is not None:
                        chosen.append(s)
                        room -= s
                if not chosen:
                    break
                n = min(times, *(stock.left[s] // chosen.count(s) for s in chosen))
                stock.take(chosen, n)
                run, at = bins.open(n), 0
                for s in chosen:
                    bins.placed.append((s, *run, at))
                    at += s
                bins.put(run, room)
                times -= n
    opened = bins.count - opened
    rest = stock.left | {s: n for s, n in histogram.items() if 0 < s <= capacity * small_share and s < capacity}
    for s in sorted(rest, reverse=True):
        if rest[s]:
            bins.best_fit(s, rest[s])
    return bins.placed, bins.count, opened


def best_plan(histogram: dict[int, int], capacity: int = 2048) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """The plan with the fewest sequences over a few numbers of groups and limits of small lengths; it ends at the floor."""
    floor = -(-sum(s * n for s, n in histogram.items()) // capacity)
    best = None
    for groups, share in ((12, 1 / 3), (48, 1 / 3), (48, 1 / 4), (48, 1 / 2), (24, 1 / 6)):
        got = plan(histogram, capacity, groups, share)
        if best is None or got[1] < best[1]:
            best = got
        if best[1] <= floor:
            break
    return best


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, rows_of_bucket: int = 200_000) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    # The row number, kept in the table, spreads repeated equal rows over the buckets.
    cut = stored(cut_documents(documents, tokenizer_path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    spark = cut.sparkSession
    histogram = {int(r.length): int(r.n) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _, _ = best_plan(histogram, capacity)
    buckets = max(64, -(-sum(histogram.values()) // rows_of_bucket))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    by = Window.partitionBy("length", "bucket").orderBy("row")
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "base")
    ranked = dealt.withColumn("inside", F.row_number().over(by) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside"))
    # The runs of each length, by rank: a bounded table, as each run uses up a length or a kind of sequence.
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    for length, first, n, offset in runs:
        table[length].append((used[length], first, offset))
        used[length] += n
    if dict(used) != {s: n for s, n in histogram.items() if n}:
        raise AssertionError("the plan does not place every piece once")
    shared = spark.sparkContext.broadcast({s: np.array(rows, np.int64) for s, rows in table.items()})
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(lengths).tolist():
                own, rows = np.flatnonzero(lengths == s), shared.value[s]
                k = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                sequence[own], offset[own] = rows[k, 1] + rank[own] - rows[k, 0], rows[k, 2]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


op4_query = pack
