"""A whole labelling run: chosen examples, prompts within a limit, the store and the model, parsing, confidence, evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import confidence, parse, templates
from ..operators import enrich, metrics, run, store, vectors
from ..sources.scratch import stored
from .registry import query
from .stub import LAB, labelled, table

_VALID = "error IS NULL AND pred IS NOT NULL AND truth IS NOT NULL AND truth <> 'nan'"
MOST_TOKENS = 150
OPTIONS = ["0", "1"]


def _answers(prompts: pd.Series) -> pd.DataFrame:
    """A stand-in for the model: the prompt's md5 decides about failure, labels and log-probabilities."""
    import hashlib

    rows = []
    for prompt in prompts:
        a = [int(c, 16) for c in hashlib.md5((prompt or "").encode()).hexdigest()[:5]]
        if a[0] == 0:
            rows.append((None, "too many calls", "RateLimit", None, None))
            continue
        quality, toxic = str(a[1] // 8), "7" if a[2] == 0 else str(a[2] // 8)
        tokens = [("{", -0.1), ('"quality":', -0.2), (f'"{quality}"', -a[3] / 10), (',"toxic":', -0.2), (f'"{toxic}"', -a[4] / 10), ("}", -0.05)]
        rows.append(("".join(t for t, _ in tokens), None, None, tokens, 0.25))
    return pd.DataFrame(rows, columns=["text", "error", "code", "logprobs", "cost"], index=prompts.index)


def labelling_run(spark, d):
    """All labelled rows: the two nearest of the first 20 rows as examples, trimmed prompts, each asked once, parsed and scored.

    A row's vector is the one whose id is the row's, modulo the number of vectors; rows without one have no examples.
    """
    e = table(spark, d, "embeddings")
    vectors_ = e.select(F.col("vec_id").alias("at"), F.col("embedding").alias("v"))
    rows = labelled(spark, d).select("row_id", "text", "quality", "toxic").withColumn("at", F.col("row_id") % e.count())
    placed = rows.join(vectors_, "at", "left")
    shot = F.concat(F.lit("Text: "), F.coalesce("text", F.lit("nan")), F.lit("\nAnswer: "), templates.answer_json(["quality", "toxic"]))
    seeds = placed.orderBy("row_id").limit(20).select(F.col("row_id").alias("cid"), "v", shot.alias("shot"))
    found = vectors.top_k(placed.select(F.col("row_id").alias("qid"), "v"), seeds, 2)
    chosen = vectors.chosen_examples(found, seeds, ["shot"]).select(F.col("qid").alias("row_id"), F.array_join(F.transform("examples", lambda x: x["shot"]), "\n\n").alias("examples"))
    cut = rows.drop("at").join(store.shuffled(chosen), "row_id", "left").withColumn("parts", templates.trimmed([F.coalesce("examples", F.lit("")), F.coalesce("text", F.lit("nan"))], MOST_TOKENS))
    output = templates.attribute_description("quality", "1 is good", OPTIONS)
    prompts = cut.withColumn("prompt", templates.prompt("Judge the text.", output, F.concat(F.lit("Text: "), F.col("parts")[1]), F.array(F.col("parts")[0])))
    prompts = prompts.drop("parts", "examples", "text").withColumn("key", store.generation_key("stub", "{}", F.col("prompt")))
    empty = spark.createDataFrame([], "key string, response string, created_ms long, ttl_ms long")
    answers, _ = store.label_prompts(prompts, empty, _answers, 1000)
    label, score = parse.parse_answer(F.col("response")), confidence.confidence_by_key(["quality", "toxic"])("logprobs")
    parsed = answers.withColumns({"label": label, "score": score})
    return parsed.withColumns({f"{a}_label": parse.keep_options(F.col("label")[a], OPTIONS) for a in ("quality", "toxic")} | {f"{a}_conf": confidence.or_zero(F.col("score"), a) for a in ("quality", "toxic")})


_COUNT = "len([x for x in string_split_regex(coalesce({}, ''), '\\s+') if x <> ''])"
_CUT = "CAST(floor(greatest(0.0, CAST(length({p}) AS DOUBLE) * ({o} - {v} - 1) / ({o} + 1))) AS BIGINT)"
_DIGIT = "(strpos('0123456789abcdef', substring(h, {}, 1)) - 1)"
_RUN = f"""WITH {LAB}, pl AS (SELECT l.row_id, l.text, l.quality, l.toxic, CAST(e.embedding AS DOUBLE[]) AS v FROM lab l LEFT JOIN embeddings e ON e.vec_id = l.row_id % (SELECT count(*) FROM embeddings)),
sd AS (SELECT row_id AS cid, v, concat('Text: ', coalesce(text, 'nan'), chr(10), 'Answer: ', '{{"quality":"', quality, '","toxic":"', toxic, '"}}') AS shot FROM pl ORDER BY row_id LIMIT 20),
nr AS (SELECT p.row_id, s.shot, row_number() OVER (PARTITION BY p.row_id ORDER BY round(list_cosine_similarity(p.v, s.v), 6) DESC, s.cid) AS rank FROM pl p, sd s),
ex AS (SELECT row_id, string_agg(shot, chr(10) || chr(10) ORDER BY rank) AS p1 FROM nr WHERE rank <= 2 GROUP BY 1),
pa AS (SELECT pl.row_id, quality, toxic, coalesce(p1, '') AS p1, coalesce(text, 'nan') AS p2 FROM pl LEFT JOIN ex ON pl.row_id = ex.row_id),
t0 AS (SELECT *, {_COUNT.format('p1')} AS t1, {_COUNT.format('p2')} AS t2 FROM pa), t1 AS (SELECT *, t1 + t2 - {MOST_TOKENS} AS v1 FROM t0),
t2 AS (SELECT *, CASE WHEN v1 > 0 THEN substring(p1, 1, {_CUT.format(p='p1', o='t1', v='v1')}) ELSE p1 END AS q1 FROM t1), t3 AS (SELECT *, {_COUNT.format('q1')} + t2 - {MOST_TOKENS} AS v2 FROM t2),
t4 AS (SELECT *, CASE WHEN v2 > 0 THEN substring(p2, 1, {_CUT.format(p='p2', o='t2', v='v2')}) ELSE p2 END AS q2 FROM t3),
pr AS (SELECT row_id, quality, toxic, md5(concat('Judge the text.', chr(10), chr(10), 'quality: 1 is good Options: 0,1', chr(10), chr(10), q1, chr(10), chr(10), 'Text: ', q2)) AS h FROM t4),
an AS (SELECT *, {_DIGIT.format(1)} = 0 AS failed, {_DIGIT.format(2)} // 8 AS ql, {_DIGIT.format(3)} AS tl, -{_DIGIT.format(4)} / 10.0::DOUBLE AS qp, -{_DIGIT.format(5)} / 10.0::DOUBLE AS tp FROM pr),
run AS (SELECT row_id, quality, toxic, h AS prompt_md5, CASE WHEN failed THEN 'rate_limit_error' END AS error_type, CASE WHEN NOT failed THEN CAST(ql AS VARCHAR) END AS quality_label,
 CASE WHEN NOT failed AND tl <> 0 THEN CAST(tl // 8 AS VARCHAR) END AS toxic_label, CASE WHEN failed THEN 0 ELSE exp(qp) END AS quality_conf, CASE WHEN failed THEN 0 ELSE exp((tp - 0.05) / 2) END AS toxic_conf, CASE WHEN NOT failed THEN 0.25::DOUBLE END AS cost FROM an)"""


@query(_RUN + " SELECT row_id, prompt_md5, error_type, quality_label, toxic_label, round(quality_conf, 6) AS quality_conf, round(toxic_conf, 6) AS toxic_conf, cost FROM run")
def run_rows(spark, d):
    """The run's rows under their output columns."""
    found = labelling_run(spark, d)
    return found.select("row_id", F.md5("prompt").alias("prompt_md5"), "error_type", "quality_label", "toxic_label", *[F.round(c, 6).alias(c) for c in ("quality_conf", "toxic_conf")], "cost")


@query(_RUN + """, lg AS (SELECT 'quality' AS attribute, quality_label AS pred, quality AS truth, error_type FROM run UNION ALL SELECT 'toxic', toxic_label, toxic, error_type FROM run)
SELECT attribute, count(pred) AS support, round(avg(CASE WHEN error_type IS NULL THEN 1.0 ELSE 0.0 END), 6) AS completion_rate, round(coalesce(avg(CASE WHEN pred IS NOT NULL AND truth IS NOT NULL THEN CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END END), 0), 6) AS accuracy FROM lg GROUP BY 1""")
def run_eval(spark, d):
    """The run against the ground truth, per attribute."""
    long = metrics.long_table(labelling_run(spark, d), {a: (f"{a}_label", a, f"{a}_conf") for a in ("quality", "toxic")})
    return metrics.scalar_metrics(long).select("attribute", "support", *[F.round(c, 6).alias(c) for c in ("completion_rate", "accuracy")])


# A run with the user's hooks, a filled store, several generations and a vote.


def _one_line(df):
    return df.withColumn("line", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))


def _two_of_a_source(rows, seeds):
    """The first two seeds of the row's source; at most two rows for each source are joined."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("row_id"))
    first = seeds.withColumn("rank", rank).where("rank <= 2").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "shot"))).alias("r"))
    return rows.select("row_id", "source").join(vectors.small(first), "source").select("row_id", F.transform("r", lambda x: x["shot"]).alias("examples"))


def _brier(long):
    hit = (F.col("pred") == F.col("truth")).cast("double")
    return long.where(metrics.valid()).groupBy("attribute").agg(F.avg((F.col("conf") - hit) * (F.col("conf") - hit)).alias("value"))


enrich.register_stage("one_line", _one_line)
enrich.register_selector("two_of_a_source", _two_of_a_source)
enrich.register_metric("brier", _brier)
PLAN = run.Plan("Judge the text.", {"quality": OPTIONS, "toxic": OPTIONS}, "Text: {line}", "two_of_a_source", ("one_line",), ("brier",), generations=3, rounds=2, model="stub")


def _sampled(prompts: pd.Series, turn: int, generation: int) -> pd.DataFrame:
    """A stand-in for a model that answers differently each time, is busy at first and cannot take some prompts."""
    import hashlib

    rows = []
    for prompt in prompts:
        a = [int(c, 16) for c in hashlib.md5(f"{prompt}|{generation}".encode()).hexdigest()[:5]]
        if a[0] == 1 or a[0] == 0 and turn == 1:
            rows.append((None, "no", "context" if a[0] else "rate", None))
            continue
        quality, toxic = str(a[1] // 8), "7" if a[2] == 0 else str(a[2] // 8)
        tokens = [("{", -0.1), ('"quality":', -0.2), (f'"{quality}"', -a[3] / 10), (',"toxic":', -0.2), (f'"{toxic}"', -a[4] / 10), ("}", -0.05)]
        rows.append(("".join(t for t, _ in tokens), None, None, tokens))
    return pd.DataFrame(rows, columns=["text", "error", "code", "logprobs"], index=prompts.index)


def _hooked_run(spark, d):
    """All labelled rows; every fourth is a seed. The store knows the first answer of every fifth row, and another fifth too late."""
    rows = stored(labelled(spark, d).select("row_id", "text", "source", "quality", "toxic"), "run-rows")
    seeds = rows.where("row_id % 4 = 0")
    prompts = run.prompts_of(rows, seeds, PLAN).withColumn("key", run.key_of(PLAN, 0))
    kept = prompts.where("row_id % 5 < 2").select("key", F.lit('{"quality": "1", "toxic": "0"}').alias("response"), F.when(F.col("row_id") % 5 == 0, 900).otherwise(0).cast("long").alias("created_ms"), F.lit(500).cast("long").alias("ttl_ms"))
    return rows, run.label(rows, seeds, PLAN, _sampled, stored(kept.dropDuplicates(["key", "created_ms"]), "run-store"), 1000)


_HOOKED = f"""WITH {LAB}, ln AS (SELECT row_id, source, quality, toxic, concat('Text: ', replace(coalesce(text, ''), chr(10), ' ')) AS line FROM lab),
sh AS (SELECT source, row_id, concat(line, chr(10), 'Answer: ', '{{"quality":"', quality, '","toxic":"', toxic, '"}}') AS shot, row_number() OVER (PARTITION BY source ORDER BY row_id) AS rank FROM ln WHERE row_id % 4 = 0),
ex AS (SELECT source, string_agg(shot, chr(10) || chr(10) ORDER BY rank) AS shots FROM sh WHERE rank <= 2 GROUP BY 1),
pr AS (SELECT row_id, quality, toxic, concat('Judge the text.', chr(10), chr(10), 'quality: Options: 0,1', chr(10), 'toxic: Options: 0,1', chr(10), chr(10), CASE WHEN shots IS NULL THEN '' ELSE shots || chr(10) || chr(10) END, line) AS p FROM ln LEFT JOIN ex ON ln.source = ex.source),
hit AS (SELECT DISTINCT md5(p) AS k FROM pr WHERE row_id % 5 = 0), ge AS (SELECT pr.*, g, md5(concat(p, '|', CAST(g AS VARCHAR))) AS h, g = 0 AND hit.k IS NOT NULL AS known FROM (SELECT *, unnest([0, 1, 2]) AS g FROM pr) pr LEFT JOIN hit ON hit.k = md5(p)),
an AS (SELECT row_id, g, known, NOT known AND {_DIGIT.format(1)} = 1 AS failed, {_DIGIT.format(2)} // 8 AS ql, {_DIGIT.format(3)} AS tl, -{_DIGIT.format(4)} / 10.0::DOUBLE AS qp, -{_DIGIT.format(5)} / 10.0::DOUBLE AS tp FROM ge),
la AS (SELECT row_id, 'quality' AS attribute, g, CASE WHEN known THEN '1' ELSE CAST(ql AS VARCHAR) END AS label, CASE WHEN known THEN 0 ELSE exp(qp) END AS conf FROM an WHERE NOT failed
 UNION ALL SELECT row_id, 'toxic', g, CASE WHEN known THEN '0' WHEN tl <> 0 THEN CAST(tl // 8 AS VARCHAR) END, CASE WHEN known THEN 0 ELSE exp((tp - 0.05) / 2) END FROM an WHERE NOT failed),
vo AS (SELECT row_id, attribute, label, count(*) AS votes, min(g) AS first, arg_min(conf, g) AS conf FROM la WHERE label IS NOT NULL GROUP BY 1, 2, 3), be AS (SELECT *, row_number() OVER (PARTITION BY row_id, attribute ORDER BY votes DESC, first) AS o FROM vo),
er AS (SELECT row_id, CASE WHEN count(*) FILTER (NOT failed) = 0 THEN 'context_length_error' END AS error FROM an GROUP BY 1), ru AS (SELECT er.row_id, a.attribute, be.label AS pred, coalesce(be.conf, 0) AS conf, coalesce(be.votes, 0) AS votes, error FROM er JOIN (SELECT unnest(['quality', 'toxic']) AS attribute) a ON true LEFT JOIN be ON be.row_id = er.row_id AND be.attribute = a.attribute AND o = 1)"""


@query(_HOOKED + " SELECT row_id, attribute, pred, round(conf, 6) AS conf, votes, error FROM ru")
def run_voted(spark, d):
    """Rows of a run with the user's stage and selector, a filled store, three generations in rounds, and a vote."""
    return _hooked_run(spark, d)[1].withColumn("conf", F.round("conf", 6))


@query(_HOOKED + f""", lg AS (SELECT ru.*, CASE WHEN attribute = 'quality' THEN quality ELSE toxic END AS truth FROM ru JOIN lab ON lab.row_id = ru.row_id),
m AS (SELECT attribute, CAST(count(*) FILTER (error IS NULL AND pred IS NOT NULL) AS DOUBLE) AS support, avg(CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END) AS completion_rate, coalesce(avg(CASE WHEN {_VALID} THEN CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END END), 0) AS accuracy FROM lg GROUP BY 1),
r AS (SELECT attribute, 'support' AS metric, support AS value FROM m UNION ALL SELECT attribute, 'completion_rate', completion_rate FROM m UNION ALL SELECT attribute, 'accuracy', accuracy FROM m)
SELECT attribute, metric, round(value, 6) AS value FROM r UNION ALL SELECT 'Macro', metric, round(avg(value), 6) FROM r GROUP BY metric
UNION ALL SELECT attribute, 'brier', round(avg((conf - CASE WHEN pred = truth THEN 1 ELSE 0 END) ** 2), 6) FROM lg WHERE {_VALID} GROUP BY attribute""")
def run_metrics(spark, d):
    """The library's metrics of that run and the user's own."""
    rows, found = _hooked_run(spark, d)
    truths = rows.select("row_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("attribute", "truth"))
    return run.evaluated(found, truths, PLAN).select("attribute", "metric", F.round("value", 6).alias("value"))
