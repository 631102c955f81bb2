"""Queries over embeddings: similarity, top-k and few-shot selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors
from .registry import query
from .stub import LAB, labelled, table


def _sides(spark, d):
    # Every 20th row against all rows; a query's own row is a row like the others.
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return q, e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v"), "label")


_SIM = """WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS cid, c.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM s)"""


@query("WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS cid, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 4) AS score FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1) SELECT * FROM s")
def k1_cosine(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("qid"), F.col("vec_id").alias("cid"), F.col("embedding").alias("w"))
    return e.select(F.col("vec_id").alias("qid"), "embedding").join(nxt, "qid").select("qid", "cid", F.round(vectors.cosine(F.col("embedding"), F.col("w")), 4).alias("score"))


@query(_SIM + " SELECT qid, cid, rank, round(score, 4) AS score FROM r WHERE rank <= 10")
def k2_topk(spark, d):
    q, c = _sides(spark, d)
    return vectors.top_k(q, c, 10).select("qid", "cid", "rank", F.round("score", 4).alias("score"))


@query(_SIM + " SELECT qid, string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank) AS labels FROM r WHERE rank <= 4 GROUP BY qid")
def k3_examples(spark, d):
    q, c = _sides(spark, d)
    found = vectors.chosen_examples(vectors.top_k(q, c, 4), c, ["label"])
    return found.select("qid", F.array_join(F.transform("examples", lambda x: x["label"].cast("string")), ",").alias("labels"))


# Five rounds: of the 25 nearest, the one with the best half score less half its closeness to what has been picked.
_MMR = _SIM + """, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT qid, cid, score, rank AS place FROM r WHERE rank <= 25), b AS (SELECT n.qid, n.cid, m.cid AS other, list_cosine_similarity(x.v, y.v) AS near FROM n JOIN n m ON m.qid = n.qid JOIN e x ON x.vec_id = n.cid JOIN e y ON y.vec_id = m.cid),
p1 AS (SELECT qid, cid, 1 AS rank FROM n WHERE place = 1)""" + "".join(f""", v{k} AS (SELECT n.qid, n.cid, 0.5 * max(n.score) - 0.5 * max(b.near) AS value, max(place) AS place FROM n JOIN b ON b.qid = n.qid AND b.cid = n.cid JOIN p{k - 1} p ON p.qid = n.qid AND p.cid = b.other LEFT JOIN p{k - 1} t ON t.qid = n.qid AND t.cid = n.cid WHERE t.cid IS NULL GROUP BY 1, 2),
p{k} AS (SELECT * FROM p{k - 1} UNION ALL SELECT qid, cid, {k} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value DESC, place) AS o FROM v{k}) WHERE o = 1)""" for k in range(2, 6))


@query(_MMR + " SELECT qid, cid, CAST(rank AS BIGINT) AS rank FROM p5")
def k4_mmr(spark, d):
    q, c = _sides(spark, d)
    return vectors.mmr(q, c, 5)


@query(_SIM + ", t AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, cid) AS k FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY label, score DESC, cid) AS n FROM t WHERE k <= 2) SELECT qid, cid, CAST(label AS BIGINT) AS label, n AS rank FROM u WHERE n <= 12")
def k5_label_diverse(spark, d):
    q, c = _sides(spark, d)
    return vectors.label_diverse(q, c, 12, list(range(10))).select("qid", "cid", F.col("label").cast("long").alias("label"), "rank")


@query("WITH s AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT vec_id, CAST(label AS BIGINT) AS label FROM s WHERE r <= 2 ORDER BY label, vec_id LIMIT 15")
def k6_label_diverse_fixed(spark, d):
    seeds = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return vectors.label_diverse_fixed(seeds, 15, 10, position="vec_id")


@query("SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8")
def k7_fixed(spark, d):
    return vectors.fixed_examples(table(spark, d, "embeddings").select("vec_id"), 8, "vec_id")


@query("WITH " + LAB + """, x AS (SELECT a.row_id, s.row_id AS seed_id, row_number() OVER (PARTITION BY a.row_id ORDER BY s.row_id) AS rank FROM lab a JOIN (SELECT * FROM lab ORDER BY row_id LIMIT 20) s ON (s.quality = a.quality OR s.quality = '0') AND s.lang = a.lang)
SELECT row_id, seed_id, rank FROM x WHERE rank <= 3""")
def k8_fixed_with_labels(spark, d):
    df = labelled(spark, d)
    seeds = df.orderBy("row_id").limit(20).select(F.col("row_id").alias("seed_id"), F.col("quality").alias("q"), F.col("lang").alias("l"))
    rows = df.select("row_id", F.array("quality", F.lit("0")).alias("qs"), F.array("lang").alias("ls"))
    return vectors.fixed_with_labels(rows, seeds, 3, "row_id", {"q": "qs", "l": "ls"}, "seed_id").select("row_id", "seed_id", "rank")


@query("""WITH l AS (SELECT label, min(vec_id) AS cid FROM embeddings GROUP BY 1), s AS (SELECT q.vec_id AS qid, l.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC, c.vec_id) AS rank FROM embeddings q, l JOIN embeddings c ON c.vec_id = l.cid WHERE q.vec_id % 20 = 0)
SELECT qid, string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank) AS labels, concat('label ', string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank)[1:1]) AS first_description FROM s WHERE rank <= 3 GROUP BY qid""")
def k9_select_labels(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("r")).select("label", F.col("r.vec_id").alias("cid"), F.col("r.embedding").alias("v"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("description"))
    found = vectors.select_labels(_sides(spark, d)[0], first, 3)
    return found.select("qid", F.array_join("labels", ",").alias("labels"), F.col("descriptions")[F.col("labels")[0]].alias("first_description"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN concat('en,', source, ',x') ELSE concat('en,', source, ',', lang, ',x') END AS labels FROM documents")
def k10_extend(spark, d):
    found = vectors.extend_labels(F.array(F.lit("en"), F.col("source")), F.array(F.concat("lang", F.lit("; "), "source"), F.lit("x;en")))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("labels"))
