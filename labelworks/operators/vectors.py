"""Similarity, top-k and few-shot selection (K1 to K10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers in a corpus that is sent to all tasks (64 MB); larger corpora are dealt out in blocks.
MOST_BROADCAST_NUMBERS = 8_000_000


#: Queries and corpus rows that are compared at once (8 MB of scores).
STEP, TILE = 256, 4_096
#: Numbers of a corpus block, and queries of a block of queries, that one task holds.
BLOCK_NUMBERS, BLOCK_QUERIES = 4_000_000, 20_000


#: Rows, and bytes of their text form, of a table of seeds, labels or prices that a join may broadcast; a larger one is joined by a
#: shuffle.
MOST_BROADCAST_ROWS, MOST_BROADCAST_BYTES = 100_000, 64_000_000


def is_small(df: DataFrame) -> bool:
    """Whether the frame is short enough for a broadcast."""
    if df.limit(MOST_BROADCAST_ROWS + 1).count() > MOST_BROADCAST_ROWS:
        return False
    return (df.agg(F.sum(F.octet_length(F.struct("*").cast("string")))).first()[0] or 0) <= MOST_BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if it is short enough for that, else for a sort-merge join."""
    return F.broadcast(df) if is_small(df) else df.hint("merge")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double; null where one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def _unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)


def _local(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, digits: int) -> pd.DataFrame:
    """Best k of a block for each query; ties to the lower id. Rows without a direction are never chosen.

    Tiles of the block in order of the ids keep a running best k, so that a stable sort leaves ties to the lower id.
    """
    order = np.argsort(cid, kind="stable")
    score, found = np.empty((len(qid), 0)), np.empty((len(qid), 0), np.int64)
    for a in range(0, len(cid), TILE):
        rows = order[a : a + TILE]
        s = np.round(q @ c[rows].T, digits)
        s[np.isnan(s)] = -np.inf
        s, at = np.concatenate([score, s], axis=1), np.concatenate([found, np.broadcast_to(cid[rows], s.shape)], axis=1)
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        score, found = np.take_along_axis(s, best, 1), np.take_along_axis(at, best, 1)
    out = pd.DataFrame({"qid": np.repeat(qid, score.shape[1]), "cid": found.ravel(), "score": score.ravel()})
    return out[np.isfinite(out["score"])]


def _local_of_each(qid: np.ndarray, q: np.ndarray, corpus: pd.DataFrame, unit: np.ndarray, k: int, digits: int, by: str | None) -> pd.DataFrame:
    """The same, or the best k of each value of a column."""
    cid = corpus["cid"].to_numpy(np.int64)
    if by is None:
        return _local(qid, q, cid, unit, k, digits)
    return pd.concat([_local(qid, q, cid[at], unit[at], k, digits).assign(**{by: value}) for value, at in corpus.reset_index(drop=True).groupby(by).indices.items()])


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "qid", corpus_id: str = "cid", vector: str = "v", block_rows: int = 100_000, digits: int = 6, by: str | None = None) -> DataFrame:
    """qid, cid, score and rank of the k corpus rows with the largest cosine, ties to the lower id; with ``by``, of each value
    of that corpus column (rows where it is null are left out).

    Scores are rounded to ``digits`` before ranking. Each batch or block keeps its own best k only; a window merges them.
    """
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vector).alias("v")).where("v is not null")
    extra = [by] if by else []
    c = corpus.select(F.col(corpus_id).cast("long").alias("cid"), F.col(vector).alias("v"), *extra).where("v is not null")
    schema = "qid long, cid long, score double"
    if by:
        c = c.where(F.col(by).isNotNull())
        schema += f", `{by}` {corpus.schema[by].dataType.simpleString()}"
    rows, numbers = c.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if numbers <= MOST_BROADCAST_NUMBERS:
        small = c.toPandas()
        shared = queries.sparkSession.sparkContext.broadcast((small.drop(columns="v"), _unit(list(small["v"])) if len(small) else np.empty((0, 0))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows_, c_unit = shared.value
            for pdf in batches:
                for a in range(0, len(pdf), STEP):
                    part = pdf.iloc[a : a + STEP]
                    if len(rows_):
                        yield _local_of_each(part["qid"].to_numpy(), _unit(list(part["v"])), rows_, c_unit, k, digits, by)

        found = q.mapInPandas(run, schema)
    else:
        # A grid: every block of queries meets every block of the corpus once.
        blocks = int(-(-rows // max(1, min(block_rows, BLOCK_NUMBERS * rows // numbers))))
        q_blocks = max(1, -(-q.count() // BLOCK_QUERIES))
        deal = lambda df, name, n, other, m: df.withColumn(name, F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        dealt_q, dealt_c = deal(q, "q_block", q_blocks, "block", blocks), deal(c, "block", blocks, "q_block", q_blocks)

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"qid": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")} | {n: pd.Series(dtype=object) for n in extra})
            unit = _unit(list(right["v"]))
            return pd.concat([_local_of_each(left["qid"].to_numpy()[a : a + STEP], _unit(list(left["v"][a : a + STEP])), right, unit, k, digits, by) for a in range(0, len(left), STEP)])

        found = dealt_q.groupBy("block", "q_block").cogroup(dealt_c.groupBy("block", "q_block")).applyInPandas(meet, schema)
    order = Window.partitionBy("qid", *extra).orderBy(F.desc("score"), "cid")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def chosen_examples(found: DataFrame, seeds: DataFrame, fields: list[str], corpus_id: str = "cid") -> DataFrame:
    """Per query an array of its examples' structs in rank order; the texts are attached last."""
    rows = found.join(small(seeds.select(F.col(corpus_id).alias("cid"), *fields)), "cid")
    return rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("ranked")).select("qid", F.transform("ranked", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("examples"))


def mmr(queries: DataFrame, corpus: DataFrame, k: int, fetch_k: int | None = None, weight: float = 0.5, query_id: str = "qid", corpus_id: str = "cid", vector: str = "v") -> DataFrame:
    """qid, cid and rank by maximal marginal relevance over the ``fetch_k`` (min(100, 5k)) nearest; the nearest comes first."""
    near = top_k(queries, corpus, fetch_k or min(100, 5 * k), query_id, corpus_id, vector)
    rows = near.join(corpus.select(F.col(corpus_id).cast("long").alias("cid"), F.col(vector).alias("v")), "cid")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        unit, score = _unit(list(pdf["v"])), pdf["score"].to_numpy()
        picked = [0]
        worst = unit @ unit[0]
        while len(picked) < min(k, len(pdf)):
            value = weight * score - (1 - weight) * worst
            value[picked] = -np.inf
            picked.append(int(value.argmax()))
            worst = np.maximum(worst, unit @ unit[picked[-1]])
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "cid": pdf["cid"].to_numpy()[picked], "rank": range(1, len(picked) + 1)})

    return rows.groupBy("qid").applyInPandas(greedy, "qid long, cid long, rank long")


def label_diverse(queries: DataFrame, corpus: DataFrame, k: int, labels: list, query_id: str = "qid", corpus_id: str = "cid", vector: str = "v", label: str = "label") -> DataFrame:
    """Top ceil(k / number of labels) of each label, ordered by label then score, cut to k."""
    each = -(-k // len(labels))
    own = corpus.where(F.col(label).isin(labels))
    found = top_k(queries, own, each, query_id, corpus_id, vector, by=label)
    order = Window.partitionBy("qid").orderBy(label, F.desc("score"), "cid")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def fixed_examples(seeds: DataFrame, k: int, position: str = "position") -> DataFrame:
    return seeds.orderBy(position).limit(k)


def label_diverse_fixed(seeds: DataFrame, k: int, labels: int, label: str = "label", position: str = "position") -> DataFrame:
    """The first ceil(k / labels) seeds of each label, in order of label and position, cut to k."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(position))
    return seeds.withColumn("_r", rank).where(F.col("_r") <= -(-k // labels)).orderBy(label, position).limit(k).drop("_r")


def fixed_with_labels(rows: DataFrame, seeds: DataFrame, k: int, row: str, selected: dict[str, str], position: str = "position") -> DataFrame:
    """First k seeds whose label is in the row's selected labels, for every attribute {seed label column: row array column}.

    An equi-join on the first attribute's label; the other attributes filter its matches.
    """
    first, *others = selected.items()
    wanted = rows.select(*rows.columns, F.explode(F.array_distinct(first[1])).alias("_label"))
    shot = small(seeds.select(F.struct(*seeds.columns).alias("seed"), F.col(first[0]).alias("_label")))
    paired = wanted.join(shot, "_label")
    for own, chosen in others:
        paired = paired.where(F.array_contains(F.col(chosen), F.col(f"seed.{own}")))
    rank = F.row_number().over(Window.partitionBy(row).orderBy(f"seed.{position}"))
    return paired.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select(row, "rank", "seed.*")


def select_labels(queries: DataFrame, labels: DataFrame, most: int, query_id: str = "qid", label_id: str = "cid", vector: str = "v", label: str = "label", description: str = "description") -> DataFrame:
    """qid, the nearest labels in order, and a map label to description."""
    found = top_k(queries, labels, most, query_id, label_id, vector).join(small(labels.select(F.col(label_id).cast("long").alias("cid"), F.col(label).cast("string").alias("label"), F.col(description).cast("string").alias("description"))), "cid")
    ranked = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "label", "description"))).alias("r"))
    return ranked.select("qid", F.transform("r", lambda x: x["label"]).alias("labels"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["label"], x["description"]))).alias("descriptions"))


def extend_labels(selected: Column, example_labels: Column, separator: str = ";") -> Column:
    """Selected labels, then labels of the chosen examples that are new, in order."""
    return F.array_union(selected, F.flatten(F.transform(example_labels, lambda x: F.transform(F.split(x, separator), lambda y: F.trim(y)))))
