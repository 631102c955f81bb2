"""Queries of the keyed store and of calls in rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import keyed_store, store
from ..sources.scratch import fresh_path
from .registry import query
from .stub import table


@query("""WITH r AS (SELECT md5(concat('k', CAST(doc_id AS VARCHAR))) AS key, doc_id, lang FROM documents), f AS (SELECT key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS response, CASE WHEN doc_id % 3 = 0 THEN 2000 ELSE 1000 END AS created_ms, doc_id FROM r)
SELECT key, response, CAST(created_ms AS BIGINT) AS created_ms FROM f WHERE doc_id % 20 = 0""")
def j8_keyed_look_up(spark, d):
    """A store of all documents, a merge of newer rows, and a look-up of every twentieth key among as many unknown ones."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5(F.concat(F.lit("k"), F.col("doc_id").cast("string"))).alias("key"))
    row = lambda value, ms: [F.col("key"), value.alias("response"), F.lit(ms).cast("long").alias("created_ms")]
    made = keyed_store.create(spark, fresh_path(spark, "keyed-store"), "key string, response string, created_ms long", 64)
    keyed_store.merge(made, docs.select(*row(F.col("lang"), 1000)))
    keyed_store.merge(made, docs.where("doc_id % 3 = 0").select(*row(F.lit("new"), 2000)))
    # Rows older than what the store holds change nothing.
    keyed_store.merge(made, docs.where("doc_id % 4 = 0").select(*row(F.lit("old"), 10)))
    asked = docs.where("doc_id % 20 = 0").select("key").unionByName(docs.where("doc_id % 20 = 1").select(F.concat("key", F.lit("x")).alias("key")))
    return keyed_store.look_up(made, asked)


def _flaky(prompts: pd.Series, turn: int) -> pd.DataFrame:
    """A stand-in for a model that fails for a while: the first digit of the prompt's md5 tells how."""
    import hashlib

    rows = []
    for p in prompts:
        h = hashlib.md5(p.encode()).hexdigest()
        if h[0] == "0" or h[0] == "1" and turn == 1 or h[0] == "2" and turn <= 2:
            rows.append((None, "slow down", "RateLimit"))
        elif h[0] == "3":
            rows.append((None, "too long", "context_length_exceeded"))
        else:
            rows.append((h[:6], None, None))
    return pd.DataFrame(rows, columns=["text", "error", "code"], index=prompts.index)


@query("""WITH p AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents), h AS (SELECT md5(text) AS key, md5(md5(text)) AS h FROM p)
SELECT key, CASE WHEN h[1] IN ('0', '3') THEN NULL ELSE substring(h, 1, 6) END AS response, CASE h[1] WHEN '0' THEN 'rate_limit_error' WHEN '3' THEN 'context_length_error' END AS error_type,
 CAST(CASE WHEN h[1] IN ('0', '2') THEN 3 WHEN h[1] = '1' THEN 2 ELSE 1 END AS BIGINT) AS rounds FROM h""")
def m1_calls_in_rounds(spark, d):
    """Every different text is a prompt; failures that may pass are asked again, up to three times in all."""
    docs = table(spark, d, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    got = store.call_in_rounds(docs.withColumn("prompt", F.col("key")), _flaky)
    return got.select("key", "response", "error_type", F.col("rounds").cast("long").alias("rounds"))
