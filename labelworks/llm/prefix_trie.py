"""Operator 13: the prefix trie of conversations, built as a burst trie.

Every conversation is a sequence of turns; a node is a sequence of first turns that some conversation has. Equal
conversations are one class, with its members' number and smallest id. A container holds the suffixes of all classes that
start with the same turns. It bursts while it holds more than ``limit`` turns of two or more classes: its top becomes a trie
head, and each next turn id below gets a container of its own. The size of a container is a sum over its classes and falls
with depth, so one group-by over prefixes (combined on the map side, so a common first turn is no hot spot) finds all heads
at once, however deep. What remains is dealt to shards: a container of one class is a chain and needs no sorting; the others,
of at most ``limit`` turns, are sorted and swept into nodes with a stack. Heads then add up the containers below them.

A prefix is known by its depth and the exclusive-or of two 64-bit hashes of each (turn id, place), and a turn by SHA-256 of
its role and text, so that prefix sums over places give all prefixes of a conversation without holding it: turns are numbered
in blocks of ``BLOCK`` consecutive turn numbers, so a very long conversation is many groups.

Edge cases: rows with a null conversation id belong to none; a null turn number comes first, equal turn numbers are in order
of the turns' ids; null role and text are empty; repeated rows are repeated turns; a conversation without turns is a member
of the root alone; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, stored

#: Consecutive turn numbers that are numbered together.
BLOCK = 1024
#: Turns that a container may hold before it bursts.
LIMIT = 16_384
#: Ids whose numbers agree but for so many bits are joined to one text before a class's digest is taken.
PIECE_BITS = 16
#: Heads are broadcast up to so many rows (of some 60 bytes), joined beyond that.
MOST_BROADCAST = 500_000

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def running(df: DataFrame, group: str, block: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Prefix aggregates (``sums``: name -> aggregate, an associative one named total_ or mixed_) over a group's blocks, in two
    levels: inside each block, and over the blocks' totals."""
    inside = Window.partitionBy(group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy(F.col(block).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    join = {n: (F.bit_xor if n.startswith("mixed_") else F.sum) for n in sums}
    totals = df.groupBy(group, block).agg(*[a.alias(n) for n, a in sums.items()])
    offsets = totals.select(F.col(group).alias("g"), F.col(block).alias("b"), *[F.coalesce(join[n](n).over(before), F.lit(0)).alias(f"before_{n}") for n in sums])
    met = df.join(offsets, F.col(group).eqNullSafe(F.col("g")) & F.col(block).eqNullSafe(F.col("b"))).drop("g", "b")
    add = lambda n, x: F.col(f"before_{n}").bitwiseXOR(x) if n.startswith("mixed_") else F.col(f"before_{n}") + x
    return met.select(*df.columns, *[add(n, a.over(inside)).alias(n) for n, a in sums.items()])


def known_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, the turn's place from 0, its id and its text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ids = F.unhex(F.substring(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256), 1, 32))
    plain = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), ids.alias("turn_id"), F.octet_length(text).cast("long").alias("bytes"))
    dealt = plain.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    placed = running(dealt, "conv_id", "block", [F.col("turn").asc_nulls_first(), F.col("turn_id")], {"total_turns": F.count(F.lit(1))})
    return placed.select("conv_id", (F.col("total_turns") - 1).alias("place"), "turn_id", "bytes")


def regrouped(turns: DataFrame, span: int = 5, modulus: int = 9) -> DataFrame:
    """Conversation c takes its first h turns from conversation c - c % span and goes on with its own turns after h; h is the
    crc32 of c in decimal, modulo ``modulus``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    base = F.col("conv_id") - F.col("conv_id") % span
    heads = turns.where((F.col("conv_id") % span == 0) & (F.col("place") < modulus - 1)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count("*").alias("base_turns"))
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base")).join(lengths, "base", "left")
    taken = heads.join(convs, "base").where("place < h").select("conv_id", "place", "turn_id", "bytes")
    # Where the base has fewer turns than h, a conversation's own turns move up.
    moved = convs.select("conv_id", (F.col("h") - F.least("h", F.coalesce("base_turns", F.lit(0)))).alias("by")).where("by > 0")
    own = turns.where(F.col("place") >= h).join(moved, "conv_id", "left")
    return own.select("conv_id", (F.col("place") - F.coalesce("by", F.lit(0))).alias("place"), "turn_id", "bytes").unionByName(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, the turn's hashes o1 and o2, those of the sequence up to it (k1, k2), and its bytes, alone and summed."""
    hashed = turns.select("conv_id", (F.col("place") + 1).alias("depth"), F.xxhash64("turn_id", "place").alias("o1"), F.xxhash64("place", "turn_id").alias("o2"), "bytes")
    dealt = hashed.withColumn("block", F.floor(F.col("depth") / BLOCK))
    sums = {"mixed_1": F.bit_xor("o1"), "mixed_2": F.bit_xor("o2"), "total_bytes": F.sum("bytes")}
    found = running(dealt, "conv_id", "block", [F.col("depth")], sums).drop("block")
    return found.withColumnsRenamed({"mixed_1": "k1", "mixed_2": "k2", "total_bytes": "sum_bytes"})


def ids_digest(whole: DataFrame, classes: DataFrame) -> DataFrame:
    """rep and ends_sha256: SHA-256 of each class's conversation ids, ascending and comma-joined.

    Ids are joined to texts of at most 2 ** PIECE_BITS ids where they lie close; a class of several pieces is read in order by
    one task, piece after piece, and never held.
    """
    name = ["length", "k1", "k2"]
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = whole.groupBy(*name, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(texts.alias("ids"))
    both = pieces.join(classes.select(*name, "rep", (F.shiftright("rep", PIECE_BITS) == F.shiftright("last", PIECE_BITS)).alias("single")), name)
    single = both.where("single").select("rep", F.sha2("ids", 256).alias("ends_sha256"))
    many = both.where("not single").select("rep", "piece", "ids").repartition("rep").sortWithinPartitions("rep", "piece")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda pairs: pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.string())], ["rep", "ends_sha256"])
        at, state = None, None
        for batch in batches:
            out = []
            for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if rep == at:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((at, state.hexdigest()))
                at, state = rep, hashlib.sha256(ids.encode())
            yield done(out)
        if state is not None:
            yield done([(at, state.hexdigest())])

    return single.unionByName(many.mapInArrow(read, "rep long, ends_sha256 string"))


def sweep(rows: list[tuple], out: list[list]) -> None:
    """Nodes of one container, from (class, depth, o1, o2, bytes, members) rows.

    Its suffixes are sorted by turn ids; each is compared with the one before, what differs of that is closed, and a closed
    node adds itself to the one above. A node is a list: smallest member, depth, parent's smallest member, members, children,
    leaves, saved bytes, the class that ends there, bytes.
    """
    suffixes: dict[int, list] = {}
    for rep, depth, o1, o2, size, n in rows:
        suffixes.setdefault(rep, []).append((depth, o1, o2, size, n))
    order = sorted((([x[1:3] for x in sorted(s)]), rep) for rep, s in suffixes.items())
    first = min(x[0] for s in suffixes.values() for x in s)
    path: list[list] = []

    def close(down_to: int) -> None:
        while len(path) > down_to:
            node = path.pop()
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[8]
            if path:
                up = path[-1]
                up[0], up[3], up[4] = min(up[0], node[0]), up[3] + node[3], up[4] + 1
                up[5], up[6] = up[5] + node[5], up[6] + node[6]
            out.append(node)

    def parents(begin: int) -> None:
        """A node's parent is known by its smallest member once the whole container is swept."""
        by_depth: dict[int, int] = {}
        for node in reversed(out[begin:]):
            by_depth[node[1]] = node[0]
            node[2] = by_depth.get(node[1] - 1)

    begin, before = len(out), []
    for ids, rep in order:
        same = 0
        while same < min(len(ids), len(before)) and ids[same] == before[same]:
            same += 1
        close(same)
        turns = sorted(suffixes[rep])
        path.extend([rep, first + i, None, 0, 0, 0, 0, None, turns[i][3]] for i in range(same, len(ids)))
        end = path[-1]
        end[0], end[3], end[7] = min(end[0], rep), end[3] + turns[0][4], rep
        before = ids
    close(0)
    parents(begin)


_SWEPT = pa.schema([(n, pa.int64()) for n in ("c1", "c2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep")])


def swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers (c1, c2: a container's name); those of a shard come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def nodes(name: tuple, rows: list) -> pa.RecordBatch:
            out: list[list] = []
            sweep(rows, out)
            columns = list(zip(*out, strict=True))[:8]
            return pa.RecordBatch.from_arrays([pa.array([name[i]] * len(out), pa.int64()) for i in (0, 1)] + [pa.array(c, pa.int64()) for c in columns], schema=_SWEPT)

        for batch in batches:
            made = []
            for c1, c2, *row in zip(*[batch.column(n).to_pylist() for n in ("c1", "c2", "rep", "depth", "o1", "o2", "bytes", "n")], strict=True):
                if (c1, c2) != at:
                    if held:
                        made.append(nodes(at, held))
                    at, held = (c1, c2), []
                held.append(row)
            yield from made
        if held:
            yield nodes(at, held)
        give_back()

    dealt = rows.select("c1", "c2", "rep", "depth", "o1", "o2", "bytes", "n").repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    return dealt.mapInArrow(run, ", ".join(f"{f.name} long" for f in _SWEPT))


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` (a stored table) to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def trie(turns: DataFrame, conversations: DataFrame, limit: int = LIMIT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, place, turn_id, bytes); ``conversations`` names all ids, turnless ones too."""
    rows = stored(prefixes(turns), "trie-prefixes")
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "k1", "k2", "sum_bytes"), "depth").alias("x")).select("conv_id", "x.*")
    whole = conversations.select("conv_id").distinct().join(last, "conv_id", "left").fillna(0, ["depth", "k1", "k2", "sum_bytes"])
    whole = stored(whole.withColumnsRenamed({"depth": "length", "sum_bytes": "all_bytes"}), "trie-whole")
    classes = whole.groupBy("length", "k1", "k2", "all_bytes").agg(F.min("conv_id").alias("rep"), F.max("conv_id").alias("last"), F.count("*").alias("n"))
    classes = stored(classes, "trie-classes")
    ends = ids_digest(whole, classes)

    of_class = rows.join(classes.select(F.col("rep").alias("conv_id"), "length", "all_bytes", "n"), "conv_id").withColumnRenamed("conv_id", "rep")
    top = classes.select("rep", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("o1", "o2", "bytes", "k1", "k2", "sum_bytes")], "length", "all_bytes", "n")
    below = stored(of_class.select(*top.columns), "trie-rows")

    # Containers: their classes, turns left, members; a container bursts by size, the root's always does.
    left = F.col("length") - F.col("depth") + 1
    sizes = below.groupBy("depth", "k1", "k2").agg(F.count("*").alias("classes"), F.sum(left).alias("turns"), F.min("rep").alias("first"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"), F.max(F.when(F.col("depth") == F.col("length"), F.col("rep"))).alias("end_rep"))
    heads = stored(sizes.where(f"classes > 1 and turns > {limit}"), "trie-heads")
    root = top.agg(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.min("rep").alias("first"), F.sum("n").alias("n_convs"), F.lit(0).cast("long").alias("bytes"), F.max(F.when(F.col("length") == 0, F.col("rep"))).alias("end_rep")).where("first is not null")
    known = _bounded(heads, most_broadcast)
    marked = below.join(known.select("depth", "k1", "k2", F.lit(True).alias("is_head")), ["depth", "k1", "k2"], "left")
    reach = marked.where("is_head").groupBy("rep").agg(F.max("depth").alias("reach"))
    placed = marked.join(reach, "rep", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))

    # A container's name is the prefix that ends with its first turn: the class's own row just below its deepest head.
    first_turn = placed.where("depth = reach + 1").select("rep", "reach", F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("k1").bitwiseXOR(F.col("o1")).alias("u1"), F.col("k2").bitwiseXOR(F.col("o2")).alias("u2"))
    sharing = first_turn.groupBy("c1", "c2", F.col("reach").alias("head_depth"), "u1", "u2").agg(F.count("*").alias("sharing"), F.min("rep").alias("container_first"))
    containers = stored(sharing.withColumn("top_depth", F.col("head_depth") + 1), "trie-containers")
    inside = first_turn.join(containers.select("c1", "c2", F.col("head_depth").alias("reach"), "sharing"), ["c1", "c2", "reach"]).select("rep", "c1", "c2", "sharing", "reach")
    held = below.join(inside, "rep").where("depth > reach")
    chain = held.where("sharing = 1").select("c1", "c2", F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("reach") + 1, F.col("rep")).alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("all_bytes") - F.col("sum_bytes") + F.col("bytes"))).alias("saved_tokens"), F.when(F.col("depth") == F.col("length"), F.col("rep")).alias("end_rep"))
    nodes = stored(chain.unionByName(swept(held.where("sharing > 1"))), "trie-nodes")

    # Heads: own counts, and what lies below, added up along each class from the deepest head to the root.
    tops = nodes.where("parent_conv_id is null").select("c1", "c2", F.col("depth").alias("top_depth"), "n_leaves", "saved_tokens")
    under = containers.join(tops, ["c1", "c2", "top_depth"]).select(F.col("container_first").alias("rep"), F.col("head_depth").alias("depth"), "n_leaves", "saved_tokens")
    every_head = heads.select("depth", "k1", "k2", "first", "n_convs", "bytes", "end_rep").unionByName(root)
    own = every_head.select(F.col("first").alias("rep"), "depth", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    worth = under.unionByName(own).groupBy("rep", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    lines = marked.where("is_head").select("rep", "depth", "k1", "k2", "o1", "o2").unionByName(top.select("rep", "depth", "k1", "k2", "o1", "o2"))
    lines = stored(lines.join(worth, ["rep", "depth"], "left").fillna(0, ["n_leaves", "saved_tokens"]), "trie-lines")
    upward = running(lines.withColumn("block", -F.floor(F.col("depth") / BLOCK)), "rep", "block", [F.desc("depth")], {"total_leaves": F.sum("n_leaves"), "total_saved": F.sum("saved_tokens")})
    summed = upward.groupBy("depth", "k1", "k2").agg(F.sum("total_leaves").alias("n_leaves"), F.sum("total_saved").alias("saved_tokens"), F.max(F.col("k1").bitwiseXOR(F.col("o1"))).alias("u1"), F.max(F.col("k2").bitwiseXOR(F.col("o2"))).alias("u2"))
    head_children = summed.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"))
    children = containers.select(F.col("head_depth").alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).unionByName(head_children).groupBy("depth", "k1", "k2").agg(F.count("*").alias("n_children"))
    name = ["depth", "k1", "k2"]
    parent_of_head = every_head.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("first").alias("parent_conv_id"))
    top_rows = every_head.join(summed, name).join(children, name, "left").join(parent_of_head, ["depth", "u1", "u2"], "left")
    head_nodes = top_rows.select(F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "end_rep")

    # A container's top hangs on its head.
    hooks = stored(parent_of_head.withColumnRenamed("depth", "top_depth"), "trie-hooks")
    above = containers.join(_bounded(hooks, most_broadcast), ["top_depth", "u1", "u2"]).select("c1", "c2", F.col("top_depth").alias("depth"), "parent_conv_id")
    hung = nodes.where("parent_conv_id is null").drop("parent_conv_id").join(above, ["c1", "c2", "depth"])
    every = nodes.where("parent_conv_id is not null").select(*head_nodes.columns).unionByName(hung.select(*head_nodes.columns)).unionByName(head_nodes)
    return every.join(ends, F.col("end_rep") == F.col("rep"), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_query(conversations: DataFrame) -> DataFrame:
    turns = stored(known_turns(conversations), "trie-turns")
    return trie(regrouped(turns), turns)
