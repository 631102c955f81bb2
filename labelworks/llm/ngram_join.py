"""Operator 10: n-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct 5-word shingles. Shingles are hashed into GROUPS groups, and a document's point is its
number of shingles in each group. For any two documents the sum of the smaller coordinates is at least their overlap,
and a Jaccard similarity of 0.8 needs an overlap of 4/9 of both sizes' sum: pairs that the sum rules out are never
compared. The points are held in R-trees: a node keeps the largest coordinates and the range of sizes below it, which
bounds the overlap with everything in it, and a tree is joined with itself node by node. Pairs that survive are verified
on the shingles themselves.

The join is dealt out by shingles, without losing a pair: in one fixed order of all shingles two linked documents share
one among the first n - ceil(0.8 n) + 1 (the prefix) of each. The order decides only the cost: shingles go by their hash,
those of 0.1 % of the documents or more after the others (a million of them at most: where there are more, the share rises),
and those that more than MOST_MEMBERS documents have among their first ones at the very end. Each document deals out a quarter more
than its prefix, so that it can give up shingles of the last kind. Then

1. documents with equal sets count as one, the smallest id;
2. each member of a shingle's cell is compared with the cell's smallest id: this links a group of copies by as many pairs
   as it has members;
3. cells whose members are now in different components, and only those, search an R-tree for the remaining pairs. They
   have MOST_MEMBERS members at most. Documents that would have to give up more than they have dealt out (families of
   near copies, in the main) meet all others in the order before that, in cells of any size: blocks of
   those that ask meet two by two, and each meets the blocks of the others, which do not meet each other. A pair is passed over where both had the same cell just before, as it was met there, and where the
   shingles behind their places in both prefixes are too few.

Components of the links are found by contraction, in tables. Sets are only made of documents in a surviving pair, from
their texts; texts are never shuffled by content, and pairs of one document with many others are spread over tasks.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer than five words
are one shingle; documents with the same id are one document; a null id is linked with nothing and has a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHasher, bytes_of, give_back, pieces, rolling, stored

WORDS, GROUPS, LEAF, FAN = 5, 64, 16, 8
#: A cell with more members gives up its shingle; only documents that cannot do without it meet there.
MOST_MEMBERS = 64
#: Rows of a block of a large cell; two blocks meet in one task.
BLOCK = 2_048
#: Probes of a cell up to which they meet its other rows one by one.
FEW_PROBES = 64
#: Pairs of one document that one task verifies; more are spread over tasks, and the document with them.
MOST_PAIRS = 256
#: Ids that a semi-join may broadcast (8 MB of them); more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000
#: Rows of a shingle's cell beyond which its state is broadcast to them; they stay where they are.
MOST_CELL_ROWS = 10_000
COMMON_SHARE = 0.001
#: Common shingles that the driver and each task hold (8 MB); where there are more, only the most frequent of them count as such.
MOST_COMMON = 1_000_000


def _space_words() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[32, 9, 10, 11, 12, 13]] = False
    return inside


_hasher: list[WordHasher] = []


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text."""
    if not _hasher:
        _hasher.append(WordHasher(_space_words()))
    h, owner, _, _ = _hasher[0](texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    grams = rolling(h, WORDS).view(np.int64)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= WORDS:
            s = np.sort(grams[a : b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(rolling(h[a:b], b - a).view(np.int64) if b > a else np.empty(0, np.int64))
    return out


def pack_points(counts: np.ndarray) -> bytes:
    """A count vector in the narrowest whole numbers that hold it."""
    return counts.astype(next(k for k in (np.uint8, np.uint16, np.int32) if counts.max(initial=0) <= np.iinfo(k).max)).tobytes()


def unpack_points(packed: list[bytes]) -> np.ndarray:
    """A row (int32) for each packed count vector."""
    out, widths = np.empty((len(packed), GROUPS), np.int32), np.fromiter(map(len, packed), np.int64, len(packed)) // GROUPS
    for width, kind in ((1, np.uint8), (2, np.uint16), (4, np.int32)):
        rows = np.flatnonzero(widths == width)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(packed[i] for i in rows), kind).reshape(-1, GROUPS)
    return out


def fine_groups(n: int) -> int:
    """Groups of the finer count vector that a set of n shingles has: GROUPS, or a power of two from n / 8 to n / 4."""
    return max(GROUPS, 1 << max(0, n.bit_length() - 3))


def fine_overlap(a: bytes, na: int, b: bytes, nb: int) -> int:
    """Sum of the smaller counts of two finer vectors; the longer one is folded onto the shorter one."""
    x, y = (np.frombuffer(p, {1: np.uint8, 2: np.uint16, 4: np.int32}[len(p) // fine_groups(n)]).astype(np.int64) for p, n in ((a, na), (b, nb)))
    if len(x) > len(y):
        x = x.reshape(-1, len(y)).sum(0)
    elif len(y) > len(x):
        y = y.reshape(-1, len(x)).sum(0)
    return int(np.minimum(x, y).sum())


def overlap_bound(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Sum of the smaller coordinates of rows i of x and rows j of y."""
    return np.concatenate([np.empty(0, np.int64), *(np.minimum(x[i[k : k + step]], y[j[k : k + step]]).sum(1) for k in range(0, len(i), step))])


def prefix_length(n: int) -> int:
    """Shingles of a set of n, in the fixed order, among which a linked one has a shingle too."""
    return n + 1 - -(-4 * n // 5) if n else 0


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Least overlap that links sets of these sizes: 100 i >= 80 (na + nb - i)."""
    return -(-4 * (na + nb) // 9)


class CountTree:
    """An R-tree over count vectors, bulk-loaded by slabs of the coordinates with the widest spread."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.arange(len(points))
        runs = [order]
        while max(map(len, runs)) > LEAF:
            cut: list[np.ndarray] = []
            for r in runs:
                if len(r) <= LEAF:
                    cut.append(r)
                    continue
                spread = points[r].max(0) - points[r].min(0)
                by = r[np.argsort(points[r, int(spread.argmax())] if spread.max() > sizes[r].max() - sizes[r].min() else sizes[r], kind="stable")]
                cut += np.array_split(by, min(FAN, -(-len(by) // LEAF)))
            runs = cut
        self.points, self.sizes, self.leaves = points, sizes, runs
        # Levels from the leaves up: largest coordinates, least and largest size, first and last child.
        self.levels = [(np.stack([points[r].max(0) for r in runs]), np.array([sizes[r].min() for r in runs]), np.array([sizes[r].max() for r in runs]))]
        while len(self.levels[-1][0]) > FAN:
            hi, least, most = self.levels[-1]
            starts = np.arange(0, len(hi), FAN)
            self.levels.append((np.maximum.reduceat(hi, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves, the first one not after the second, whose bounds do not rule out a link between their rows."""
        a, b = np.triu_indices(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, least, most = self.levels[depth]
            fits = (5 * most[a] >= 4 * least[b]) & (5 * most[b] >= 4 * least[a])
            a, b = a[fits], b[fits]
            fits = overlap_bound(hi, hi, a, b) >= needed(least[a], least[b])
            a, b = a[fits], b[fits]
            if depth:
                x, y = np.broadcast_arrays(a[:, None, None] * FAN + np.arange(FAN)[:, None], b[:, None, None] * FAN + np.arange(FAN))
                x, y = x.ravel(), y.ravel()
                fits = (x <= y) & (y < len(self.levels[depth - 1][0]))
                a, b = x[fits], y[fits]
        return a, b

    def row_pairs(self, leaf_pairs: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of joined leaves, two by two, in steps of bounded size."""
        rows = np.full((len(self.leaves), max(map(len, self.leaves))), -1)
        for k, leaf in enumerate(self.leaves):
            rows[k, : len(leaf)] = leaf
        a, b = self.joined()
        place = np.arange(rows.shape[1])
        for lo in range(0, len(a), leaf_pairs):
            x, y = a[lo : lo + leaf_pairs], b[lo : lo + leaf_pairs]
            i, j = np.broadcast_arrays(rows[x][:, :, None], rows[y][:, None, :])
            fits = (i >= 0) & (j >= 0) & ((x < y)[:, None, None] | (place[:, None] < place))
            yield i[fits], j[fits]


def _describe(documents: DataFrame, common: np.ndarray) -> DataFrame:
    """A row per document: doc_id, n_shingles, a digest of the set, the count vectors, the first shingles (a quarter more
    than the prefix) and how many of these aren't common."""
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for s in shingle_sets(bytes_of(part, "text")):
                    n = len(s)
                    groups = fine_groups(n)
                    counts = np.bincount(s & (groups - 1), minlength=groups)
                    points, fine = pack_points(counts.reshape(-1, GROUPS).sum(0)), pack_points(counts)
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    first, rare = min(n, -(-5 * prefix_length(n) // 4)), n
                    if len(often) and n:
                        late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                        rare = n - int(late.sum())
                        s = np.concatenate([s[~late], s[late]]) if rare < n else s
                    rows.append((n, key, points, fine, s[:first], min(rare, first)))
                n, key, points, fine, first, rare = zip(*rows, strict=True)
                lengths = np.cumsum([0, *map(len, first)]).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(first), pa.int64())), pa.array(rare, pa.int32())], names=["doc_id", "n_shingles", "key", "points", "fine", "first", "rare"])

    return documents.mapInArrow(run, "doc_id long, n_shingles long, key binary, points binary, fine binary, first array<bigint>, rare int")


def common_shingles(documents: DataFrame, step: int = 2_000_000, most: int = MOST_COMMON) -> np.ndarray:
    """Sorted shingles seen in COMMON_SHARE of all documents at least, counting those that are frequent where they were read.

    Where they are more than ``most``, those seen twice, four times, .. as often: the first such share that few enough reach.
    """
    share = COMMON_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = docs = 0

        def flush() -> pa.RecordBatch:
            own, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(3, int(docs * share))
            return pa.record_batch([pa.array(own[often]), pa.array(counts[often].astype(np.int64))], names=["shingle", "n"])

        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(bytes_of(part, "text"))
                held += sets
                docs += len(sets)
                size += sum(map(len, sets))
                if size > step:
                    yield flush()
                    held, size, docs = [], 0, 0
        if held:
            yield flush()

    total = documents.count()
    seen = documents.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    least = max(20, int(total * share))
    often = stored(seen.where(F.col("n") >= least), "common-shingles")
    # Shingles by the doubling of the least count that they reach: some dozens of rows. The order decides about costs only.
    steps = often.groupBy((F.length(F.bin(F.expr(f"n div {least}"))) - 1).alias("step")).count().orderBy(F.desc("step")).collect()
    held, first = 0, 0
    for r in steps:
        held += r["count"]
        if held > most:
            first = r["step"] + 1
            break
    rows = often.where(F.col("n") >= least * 2**first).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64))


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """id and component (its smallest id) of all ids in ``edges`` (a, b), by contraction to the smallest neighbour."""
    edges = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    known: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("id"), "c")
        step = stored(step, "contract")
        for _ in range(2):  # pointer jumping: chains shrink to a quarter
            nxt = step.select(F.col("id").alias("c"), F.col("c").alias("further"))
            step = step.join(nxt, "c", "left").select("id", F.coalesce("further", "c").alias("c"))
        step = stored(step, "contract")
        if known is None:
            known = step
        else:
            moved = step.select(F.col("id").alias("c"), F.col("c").alias("further"))
            known = stored(known.join(moved, "c", "left").select("id", F.coalesce("further", "c").alias("c")), "components")
        a, b = step.select(F.col("id").alias("a"), F.col("c").alias("a2")), step.select(F.col("id").alias("b"), F.col("c").alias("b2"))
        moved = edges.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct()
        edges = stored(moved, "links")
    if known is None:
        return spark.createDataFrame([], "id long, component long")
    return known.select("id", F.col("c").alias("component"))


def _verified(pairs: DataFrame, documents: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) of a table that are linked: bounded by their count vectors, then compared by their sets."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_pylist() for c in ("fa", "fb", "na", "nb"))
            kept = [5 * min(x, y) >= 4 * max(x, y) and fine_overlap(p, x, q, y) >= needed(x, y) for p, q, x, y in zip(a, b, na, nb, strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    ends = pairs.select("a").unionAll(pairs.select("b")).groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "id")
    ends = stored(ends, "pair-ids")
    many = ends.where(F.col("n") > MOST_PAIRS).select("id", F.ceil(F.col("n") / MOST_PAIRS).cast("int").alias("parts"))
    spread = many.count()

    def attach(rows: DataFrame, side: DataFrame, end: str, other: str) -> DataFrame:
        """``rows`` with the columns of ``side`` (id, ...) for their ``end``; one with many pairs goes to several tasks."""
        side = side.withColumnRenamed("id", end)
        if not spread:
            return rows.join(side, end)
        parts = many.withColumnRenamed("id", end)
        parts = F.broadcast(parts) if spread <= MOST_BROADCAST_IDS else parts
        rows = rows.join(parts, end, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), "parts").cast("int"), F.lit(0))).drop("parts")
        side = side.join(parts, end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return rows.join(side, [end, "part"]).drop("part")

    vectors = points.select("id", "fine", "n_shingles")
    found = attach(pairs, vectors.withColumnsRenamed({"fine": "fa", "n_shingles": "na"}), "a", "b")
    found = attach(found, vectors.withColumnsRenamed({"fine": "fb", "n_shingles": "nb"}), "b", "a")
    pairs = stored(found.where("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b", "fa", "fb", "na", "nb").mapInArrow(bounded, "a long, b long"), "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    few = ids.count() <= MOST_BROADCAST_IDS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(bytes_of(part, "text"))
                lengths = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(sets), pa.int64()))], names=["id", "s"])

    sets = stored(documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(make, "id long, s array<bigint>"), "sets")
    joined = attach(attach(pairs, sets.withColumnRenamed("s", "sb"), "b", "a"), sets.withColumnRenamed("s", "sa"), "a", "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * 80).select("a", "b").distinct()


CELL_ROWS = "cell long, id long, component long, own boolean, side int, probe boolean, place int, before long, points binary"


def cell_pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller id, larger id) that may be linked, of each cell of a table of CELL_ROWS, in steps of bounded size.

    Rows of a cell stand together. A pair needs one row that is its cell's own, one that is a probe, rows of both sides in
    a cell of two blocks (side 2: one block), and different components. Leaves of many small cells are scanned at once.
    """
    cell, ids, component, own, side, probe, place = (rows.column(c).to_numpy() for c in ("cell", "id", "component", "own", "side", "probe", "place"))
    before, first = rows.column("before").fill_null(0).to_numpy(), rows.column("before").is_null().to_numpy()
    points = unpack_points(rows.column("points").to_pylist())
    sizes = points.sum(1)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(cell)))

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fits = (component[i] != component[j]) & (own[i] | own[j]) & (probe[i] | probe[j]) & ((side[i] == 2) | (side[i] != side[j]))
        fits &= first[i] | first[j] | (before[i] != before[j])
        i, j = i[fits], j[fits]
        # What both have from here on in the order has to suffice.
        fits = 9 * np.minimum(sizes[i] - place[i], sizes[j] - place[j]) >= 4 * (sizes[i] + sizes[j])
        i, j = i[fits], j[fits]
        fits = overlap_bound(points, points, i, j) >= needed(sizes[i], sizes[j])
        a, b = ids[i[fits]], ids[j[fits]]
        return np.minimum(a, b), np.maximum(a, b)

    for m in np.unique(lengths).tolist():
        begins = starts[lengths == m]
        if 1 < m <= LEAF:
            i, j = np.triu_indices(m, 1)
            per = max(1, 100_000 // len(i))
            for lo in range(0, len(begins), per):
                base = begins[lo : lo + per, None]
                yield kept((base + i).ravel(), (base + j).ravel())
        elif m > LEAF:
            for at in begins.tolist():
                asking = np.flatnonzero(probe[at : at + m])
                if len(asking) <= FEW_PROBES and len(asking) < m:
                    # Few rows ask: they meet the others without a tree.
                    for lo in range(0, m, max(1, 100_000 // max(1, len(asking)))):
                        other = np.arange(lo, min(m, lo + max(1, 100_000 // max(1, len(asking)))))
                        i, j = np.repeat(asking, len(other)), np.tile(other, len(asking))
                        once = (i < j) | ~probe[at + j]
                        yield kept(at + i[once], at + j[once])
                    continue
                for i, j in CountTree(points[at : at + m], sizes[at : at + m]).row_pairs():
                    yield kept(at + i, at + j)


def _dealt(cells: DataFrame) -> DataFrame:
    """Rows of CELL_ROWS, as often as they are needed: by classes of sizes, and by blocks in large cells."""
    # Linked sizes differ by a factor of 1.25 at most: each document is in its own class, and a guest of the next smaller one.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    classes = F.array(F.struct(size_class.alias("c"), F.lit(True).alias("own")), F.struct((size_class - 1).alias("c"), F.lit(False).alias("own")))
    # A cell of up to BLOCK rows is one; of a larger one, blocks of probes meet two by two, and each meets each block of the
    # other rows, which stay apart: few probes cost each of the others one row, however many these are.
    whole = F.col("members") <= BLOCK
    probes = F.greatest(F.ceil(F.col("probes") / BLOCK).cast("int"), F.lit(1))
    others = F.ceil((F.col("members") - F.col("probes")) / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    to = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    place_of = lambda part, x, y, side: F.struct(F.lit(part).alias("part"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    among = F.transform(to(probes), lambda i: place_of(1, F.least(i, at(probes)), F.greatest(i, at(probes)), F.when(i == at(probes), 2).otherwise((at(probes) > i).cast("int"))))
    ask = F.transform(to(others), lambda i: place_of(2, at(probes), i, F.lit(0)))
    answer = F.transform(to(probes), lambda i: place_of(2, i, at(others), F.lit(1)))
    spots = F.when(whole, F.array(place_of(0, F.lit(0), F.lit(0), F.lit(2)))).when(F.col("probe"), F.concat(among, ask)).otherwise(answer)
    dealt = cells.withColumn("spot", F.explode(spots)).withColumn("x", F.explode(classes)).withColumn("side", F.col("spot.side"))
    cell = F.xxhash64("kind", "token", "x.c", "spot.part", "spot.x", "spot.y")
    return dealt.select(cell.alias("cell"), "id", "component", "x.own", "side", "probe", "place", "before", "points")


def _tree_pairs(cells: DataFrame) -> DataFrame:
    """Candidate pairs of ``cells`` (kind, token, id, n, component, probe, place, before, members, probes, points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column("cell").to_numpy()
            # The last cell may go on in the next batch.
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if last:
                yield from found(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None:
            yield from found(held)
        give_back()

    def found(rows: pa.Table, most: int = 100_000) -> Iterator[pa.RecordBatch]:
        steps: list[np.ndarray] = []
        size = 0
        for a, b in cell_pairs(rows):
            steps.append(np.stack([a, b]))
            size += len(a)
            if size > most:
                yield batch_of(steps)
                steps, size = [], 0
        if size:
            yield batch_of(steps)

    def batch_of(steps: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(steps, axis=1), axis=1)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return _dealt(cells).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def _cells(singles: DataFrame) -> DataFrame:
    """token, place, id, n, members, hub and hub_n of each first shingle that several sets have."""
    posts = singles.select(F.posexplode("first").alias("place", "token"), "id", F.col("n_shingles").cast("int").alias("n"), "rare")
    hub, members = F.min(F.struct("id", "n")), F.count("*")
    cell = Window.partitionBy("token")
    rare = posts.where("place < rare").withColumn("hub", hub.over(cell)).withColumn("members", members.over(cell))
    # A common shingle may be in a third of all rows: these are counted on the map side first.
    common = posts.where("place >= rare")
    counted = stored(common.groupBy("token").agg(hub.alias("hub"), members.alias("members")), "common-cells")
    few = counted.count() <= MOST_BROADCAST_IDS
    common = common.join(F.broadcast(counted) if few else counted, "token")
    names = ["token", "place", "id", "n", "members", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")]
    return rare.select(*names).unionAll(common.select(*names)).where("members > 1")


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with the state (token, rows, ...) of their cells; those of large cells are not shuffled to one task."""
    large = state.where(F.col("rows") > MOST_CELL_ROWS)
    count = large.count()
    if not 0 < count <= MOST_BROADCAST_IDS:
        return rows.join(state, "token")
    others = rows.join(F.broadcast(large.select("token")), "token", "left_anti").join(state.where(F.col("rows") <= MOST_CELL_ROWS), "token")
    return rows.join(F.broadcast(large), "token").unionByName(others)


def _search_rows(cells: DataFrame, singles: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of ``cells`` that still have to be searched, as ``_tree_pairs`` takes them.

    Kind 0: the prefixes of documents that can give up the shingles of large cells. Kind 1: the prefixes of all documents in
    the order before that, in cells of the others (probes). Documents whose id has several sets are probes, too.
    """
    large = cells.where(F.col("members") > MOST_MEMBERS).select("id", "n", "place", F.lit(False).alias("several"))
    several = singles.groupBy("id").agg(F.count("*").alias("k"), F.max("n_shingles").cast("int").alias("n")).where("k > 1")
    told = large.unionByName(several.select("id", "n", F.lit(None).cast("int").alias("place"), F.lit(True).alias("several")))
    told = told.groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("given"), F.max("several").alias("several"), F.max("n").alias("most"))
    prefix = lambda n: n + 1 - F.ceil(4 * n / 5)
    dealt = lambda n: F.least(n, F.ceil(5 * prefix(n) / 4))
    told = told.select("id", "given", "several", (F.col("several") | (dealt(F.col("most")) - F.size("given") < prefix(F.col("most")))).alias("probe"))
    rows = cells.select("token", "place", "id", "n", "members").join(near, "id", "left").join(told, "id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "id")).withColumn("probe", F.coalesce("probe", F.lit(False))).withColumn("several", F.coalesce("several", F.lit(False)))
    # Places in the two orders; null where the row isn't of that kind.
    given = F.coalesce(F.size(F.filter("given", lambda x: x < F.col("place"))), F.lit(0))
    rows = rows.withColumn("place0", F.when(~F.col("probe") & (F.col("members") <= MOST_MEMBERS) & (F.col("place") - given < prefix(F.col("n"))), F.col("place") - given))
    rows = rows.withColumn("place1", F.when(F.col("place") < prefix(F.col("n")), F.col("place")))
    rows = stored(rows.where("place0 is not null or place1 is not null").select("token", "id", "component", "probe", "several", "place0", "place1"), "prefix-rows")
    # Only cells of different components, and of kind 1 only those with a probe.
    state = rows.groupBy("token").agg(*[F.expr(f"{how}(if(place{kind} is not null, component, null))").alias(f"{name}{kind}") for kind in (0, 1) for how, name in (("min", "lo"), ("max", "hi"), ("count", "m"))], F.count_if(F.col("probe") & F.col("place1").isNotNull()).alias("asked"), F.count("*").alias("rows"))
    state = state.select("token", "rows", F.expr("if(lo0 <> hi0, m0, null)").alias("m0"), F.expr("if(asked > 0 and lo1 <> hi1, m1, null)").alias("m1"), F.col("m0").alias("p0"), F.col("asked").alias("p1")).where("m0 is not null or m1 is not null")
    state = stored(state, "cell-state")
    kinds = F.array(*[F.when(F.col(f"place{k}").isNotNull() & F.col(f"m{k}").isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(f"place{k}").alias("place"), F.col(f"m{k}").alias("members"), F.col(f"p{k}").alias("probes"))) for k in (0, 1)])
    rows = _with_state(rows, state).select("token", "id", "component", "probe", "several", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("as"))
    rows = rows.select("as.*", "token", "id", "component", "probe", "several").repartition("id")
    in_order = Window.partitionBy("kind", "id").orderBy("place")
    rows = rows.withColumn("before", F.when(~F.col("several"), F.lag("token").over(in_order)))
    rows = rows.withColumn("probe", F.col("probe") | (F.col("kind") == 0))
    return rows.join(singles.select("id", "points", F.col("n_shingles").cast("int").alias("n")), "id")


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row (doc_id and text are used)."""
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = stored(_describe(documents, common_shingles(documents)), "shingles")
    known = every.where("n_shingles > 0 and doc_id is not null")
    first = stored(known.groupBy("key").agg(F.min("doc_id").alias("id")), "first-of-sets")
    # Later copies of an equal set are few enough to broadcast, or else shuffled: the sets' long rows stay where they are.
    copies = stored(known.select("doc_id", "key").join(first, "key").where("doc_id <> id").select("doc_id", "key", "id"), "copies")
    few = copies.count() <= MOST_BROADCAST_IDS
    later = copies.select("doc_id", "key").distinct()
    singles = known.join(F.broadcast(later) if few else later, ["doc_id", "key"], "left_anti").withColumnRenamed("doc_id", "id")
    singles = singles.select("id", "n_shingles", "points", "fine", "first", "rare")
    points = stored(singles.select("id", "n_shingles", "points", "fine"), "points")
    cells = stored(_cells(singles), "cells")
    stars = cells.where("id <> hub and 5 * least(n, hub_n) >= 4 * greatest(n, hub_n)").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(_verified(stored(stars, "stars"), documents, points), "star-links")
    rest = stored(_tree_pairs(_search_rows(cells, points, components(links, spark))), "tree-pairs")
    more = _verified(rest, documents, points)
    # Links of documents with equal ids but different sets, and of equal sets, go in as well.
    same = copies.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    linked = components(links.union(more).union(same), spark)
    found = every.select("doc_id", "n_shingles").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_groups(documents: DataFrame) -> DataFrame:
    """``documents`` without those that are linked, by a chain of links, to a document with a smaller id."""
    found = jaccard_components(documents)
    later = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "later-copies")
    few = later.count() <= MOST_BROADCAST_IDS
    return documents.join(F.broadcast(later) if few else later, "doc_id", "left_anti").select(*documents.columns)


op10_query = jaccard_components
