"""Queries over labelled tables: parsing, confidence, metrics, cost; and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence, parse, templates
from ..functions.text import token_count
from ..operators import metrics
from .registry import query
from .stub import ATTRIBUTES, LAB, labelled, table

W = "WITH " + LAB
_VALID = "error IS NULL AND pred IS NOT NULL AND truth IS NOT NULL AND truth <> 'nan'"


def _long(spark, d):
    return metrics.long_table(labelled(spark, d), ATTRIBUTES, keys=["row_id"])


@query(W + f""", a AS (SELECT row_id, CASE WHEN error IS NULL AND row_id % 5 < 3 THEN pred_quality END AS quality_p, CASE WHEN error IS NULL AND row_id % 5 < 4 THEN pred_toxic END AS toxic_p, quality, toxic, error FROM lab),
l AS (SELECT 'quality' AS attribute, quality_p AS pred, quality AS truth, error FROM a UNION ALL SELECT 'toxic', toxic_p, toxic, error FROM a)
SELECT attribute, count(*) FILTER (error IS NULL AND pred IS NOT NULL) AS support, round(avg(CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END), 6) AS completion_rate, round(coalesce(avg(CASE WHEN {_VALID} THEN CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END END), 0), 6) AS accuracy FROM l GROUP BY 1""")
def flagship_label_eval(spark, d):
    """Documents to prompts, the stub's answers, parsed labels of a closed vocabulary, and metrics for each attribute."""
    df = labelled(spark, d)
    df = df.withColumn("prompt", templates.render("Judge this text: {text}", df.columns)).withColumn("label", parse.parse_answer(F.col("answer")))
    df = df.withColumns({f"{a}_label": parse.keep_options(F.col("label")[a], ["0", "1"]) for a in ATTRIBUTES})
    long = metrics.long_table(df, {a: (f"{a}_label", a, "conf") for a in ATTRIBUTES})
    m = metrics.scalar_metrics(long)
    return m.select("attribute", "support", F.round("completion_rate", 6).alias("completion_rate"), F.round("accuracy", 6).alias("accuracy"))


@query(W + " SELECT row_id, CASE WHEN error IS NULL AND row_id % 5 < 4 THEN CASE WHEN row_id % 5 = 3 THEN '9' ELSE pred_quality END END AS quality, CASE WHEN error IS NULL AND row_id % 5 < 4 THEN pred_toxic END AS toxic FROM lab")
def m3_parse(spark, d):
    return labelled(spark, d).withColumn("m", parse.parse_answer(F.col("answer"))).select("row_id", F.col("m")["quality"].alias("quality"), F.col("m")["toxic"].alias("toxic"))


@query(W + " SELECT row_id, CASE WHEN error IS NULL AND row_id % 5 < 3 THEN pred_quality END AS quality FROM lab")
def m4_closed(spark, d):
    return labelled(spark, d).select("row_id", parse.keep_options(parse.parse_answer(F.col("answer"))["quality"], ["0", "1"]).alias("quality"))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND source = 'src1' THEN concat(lang, '; ', source) WHEN lang = 'en' THEN lang WHEN source = 'src1' THEN concat(' ', source) END AS labels FROM documents")
def m5_closed_list(spark, d):
    value = F.concat("lang", F.lit("; "), "source")
    return table(spark, d, "documents").select("doc_id", parse.keep_options_of_list(value, ["en", "src1"]).alias("labels"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 4 = 1 THEN 'NO_LABEL' ELSE event_type END AS label, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'no idea' ELSE 'It is clear.' END AS explanation, CASE event_id % 4 WHEN 0 THEN 'empty_response_error' WHEN 1 THEN 'parsing_error' END AS error_type FROM events""")
def m6_chain_of_thought(spark, d):
    r = F.when(F.col("event_id") % 4 == 0, F.lit("")).when(F.col("event_id") % 4 == 1, F.lit("no idea")).otherwise(F.concat(F.lit('It is clear.\nSo:\n{"label": "'), "event_type", F.lit('"}')))
    return table(spark, d, "events").select("event_id", parse.chain_of_thought(r).alias("r")).select("event_id", "r.*")


@query(W + " SELECT row_id, CASE WHEN error IS NULL AND row_id % 5 < 4 THEN concat('{\"quality\": \"', CASE WHEN row_id % 5 = 3 THEN '9' ELSE pred_quality END, '\", \"toxic\": \"', pred_toxic, '\"}') END AS found FROM lab")
def m7_json_substring(spark, d):
    return labelled(spark, d).select("row_id", parse.json_substring("answer").alias("found"))


_LP = "(-0.1 - 0.2 - (row_id % 10) / 10.0::DOUBLE - 0.05)"


@query(W + f" SELECT row_id, CASE WHEN error IS NULL THEN round(exp({_LP} / 4), 6) ELSE 0.0 END AS c FROM lab")
def c1_mean_probability(spark, d):
    return labelled(spark, d).select("row_id", F.round(confidence.mean_probability(F.col("logprobs")), 6).alias("c"))


@query(W + " SELECT row_id, CASE WHEN error IS NULL THEN round(exp((-(row_id % 10) / 10.0::DOUBLE - 0.05) / 2), 6) END AS quality, CASE WHEN error IS NULL THEN 0.0 END AS other FROM lab")
def c2_by_key(spark, d):
    m = confidence.confidence_by_key(["quality", "other"])("logprobs")
    return labelled(spark, d).withColumn("m", m).select("row_id", F.round(F.col("m")["quality"], 6).alias("quality"), F.col("m")["other"].alias("other"))


@query("WITH " + LAB + """ SELECT row_id, round(CASE WHEN lang IS NULL OR source IS NULL THEN NULL WHEN lang = source THEN exp(-0.5) ELSE exp(-0.1) END, 6) AS lang_conf,
 round(CASE WHEN lang IS NOT NULL AND source IS NOT NULL THEN exp(-0.5) END, 6) AS source_conf FROM lab WHERE error IS NULL""")
def c3_by_label(spark, d):
    df = labelled(spark, d).where("error is null")
    tokens = F.array(*[F.struct(t.alias("token"), p.cast("double").alias("logprob")) for t, p in ((F.col("lang"), F.lit(-0.1)), (F.lit(";"), F.lit(-0.3)), (F.col("source"), F.lit(-0.7)))])
    m = confidence.confidence_by_label()(tokens, F.concat("lang", F.lit(";"), "source"))
    return df.withColumn("m", m).select("row_id", F.round(F.col("m")[F.col("lang")], 6).alias("lang_conf"), F.round(F.col("m")[F.col("source")], 6).alias("source_conf"))


@query("SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN exp(-0.5) WHEN 1 THEN -exp(-0.25) ELSE 0 END, 6) AS p FROM events")
def c4_p_true(spark, d):
    tok = F.when(F.col("event_id") % 3 == 0, F.lit(" Yes")).when(F.col("event_id") % 3 == 1, F.lit("no")).otherwise(F.lit("maybe"))
    lp = F.when(F.col("event_id") % 3 == 0, -0.5).otherwise(-0.25)
    logs = F.array(F.struct(F.lit("\n").alias("token"), F.lit(-0.1).alias("logprob")), F.struct(tok.alias("token"), lp.alias("logprob")))
    return table(spark, d, "events").select("event_id", F.round(confidence.p_true(logs), 6).alias("p"))


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0 WHEN -(event_id % 7) / 10.0::DOUBLE > -0.3::DOUBLE THEN exp(-(event_id % 7) / 10.0::DOUBLE) ELSE -exp(-0.3::DOUBLE) END, 6) AS p FROM events""")
def c4_p_true_of_two(spark, d):
    said = lambda word, p: F.array(F.struct(F.lit(word).alias("token"), p.cast("double").alias("logprob")))
    yes = F.when(F.col("event_id") % 5 != 0, said("Yes", -(F.col("event_id") % 7) / F.lit(10.0)))
    return table(spark, d, "events").select("event_id", F.round(confidence.p_true_of_two(yes, said("No", F.lit(-0.3))), 6).alias("p"))


@query(W + " SELECT row_id, CASE WHEN error IS NULL THEN conf ELSE 0.0 END AS quality, 0.0::DOUBLE AS other FROM lab")
def c5_defaults(spark, d):
    df = labelled(spark, d).withColumn("m", F.when(F.col("error").isNull(), F.create_map(F.lit("quality"), "conf")))
    return df.select("row_id", confidence.or_zero(F.col("m"), "quality").alias("quality"), confidence.or_zero(F.col("m"), "other").alias("other"))


_WORDS = "[x for x in string_split_regex(coalesce(text, ''), '\\s+') if x <> '']"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 50.0) AS BIGINT))) AS k FROM w)
SELECT doc_id, k AS chunk_no, md5(array_to_string(w[k * 50 + 1 : k * 50 + 50], ' ')) AS chunk_md5 FROM c""")
def c6_chunks(spark, d):
    c = confidence.text_chunks(table(spark, d, "documents"), "text", 50, ["doc_id"])
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


@query("SELECT conv_id, max(CAST(turn * 7 % 10 AS DOUBLE) / 10) AS confidence FROM conversations GROUP BY 1")
def c7_merge(spark, d):
    c = table(spark, d, "conversations").withColumn("confidence", F.col("turn") * 7 % 10 / F.lit(10.0))
    return confidence.merge_chunks(c, ["conv_id"])


@query(W + f""", m AS (SELECT attribute, CAST(count(*) FILTER (error IS NULL AND pred IS NOT NULL) AS DOUBLE) AS support, avg(CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END) AS completion_rate, coalesce(avg(CASE WHEN {_VALID} THEN CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END END), 0) AS accuracy FROM long GROUP BY 1),
r AS (SELECT attribute, 'support' AS metric, support AS value FROM m UNION ALL SELECT attribute, 'completion_rate', completion_rate FROM m UNION ALL SELECT attribute, 'accuracy', accuracy FROM m)
SELECT attribute, metric, round(value, 6) AS value FROM r UNION ALL SELECT 'Macro', metric, round(avg(value), 6) FROM r GROUP BY metric""")
def a1_a4_metrics(spark, d):
    return metrics.metric_rows(_long(spark, d)).select("attribute", "metric", F.round("value", 6).alias("value"))


_MATCH = f"m AS (SELECT attribute, coalesce(conf, 0) AS c, pred = truth AS hit FROM long WHERE {_VALID})"


@query(W + ", " + _MATCH + """ SELECT p.attribute, round(sum(CASE WHEN p.c > n.c THEN 1.0 WHEN p.c = n.c THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM m p JOIN m n ON p.attribute = n.attribute AND p.hit AND NOT n.hit GROUP BY 1""")
def a5_auroc(spark, d):
    return metrics.auroc(_long(spark, d)).select("attribute", F.round("auroc", 6).alias("auroc"))


@query(W + ", " + _MATCH + """, t AS (SELECT DISTINCT attribute, c AS threshold FROM m) SELECT t.attribute, t.threshold, round(sum(CASE WHEN hit AND c >= threshold THEN 1.0 ELSE 0 END) / sum(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS tpr, round(sum(CASE WHEN NOT hit AND c >= threshold THEN 1.0 ELSE 0 END) / sum(CASE WHEN NOT hit THEN 1.0 ELSE 0 END), 6) AS fpr, round(avg(CASE WHEN c > threshold THEN 1.0 ELSE 0 END), 6) AS completion FROM t JOIN m ON t.attribute = m.attribute GROUP BY 1, 2""")
def a6_a7_thresholds(spark, d):
    t = metrics.threshold_table(_long(spark, d))
    return t.select("attribute", "threshold", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "completion")])


@query(W + ", " + _MATCH + """, s AS (SELECT avg(c) AS mean, stddev_pop(c) AS std FROM m), z AS (SELECT hit, round((c - mean) / std, 9) AS z FROM m, s)
SELECT hit AS "match", CASE WHEN z = 1.0 THEN 98 ELSE CAST(floor((z + 3.0) / 4.0 * 98) AS BIGINT) + 1 END AS bin, count(*) AS rows FROM z WHERE z BETWEEN -3.0 AND 1.0 GROUP BY 1, 2""")
def a8_histogram(spark, d):
    return metrics.confidence_histogram(_long(spark, d))


_T = r"[x for x in string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+') if x NOT IN ('', 'a', 'an', 'the')]"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {_T.format('a.text')} AS x, {_T.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(list_intersect(x, y)) > 0 THEN 2.0 * len(list_distinct(list_intersect(x, y))) / (len(x) + len(y)) ELSE 0 END, 6) AS text_partial_match FROM p""")
def a9_token_f1(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    f = metrics.token_f1(c.join(nxt, ["conv_id", "turn"]), F.col("text"), F.col("after"), F.lit(True))
    return f.select("conv_id", "turn", F.round("text_partial_match", 6).alias("text_partial_match"))


@query("""WITH s AS (SELECT [lang, source] AS t, [CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END, 'src1', 'src1'] AS p FROM documents), k AS (SELECT unnest(['en', 'fr', 'src1', 'src2', 'zz']) AS label),
c AS (SELECT label, count(*) FILTER (list_contains(p, label) AND list_contains(t, label)) AS tp, count(*) FILTER (list_contains(p, label)) AS pp, count(*) FILTER (list_contains(t, label)) AS pt FROM k, s GROUP BY 1), f AS (SELECT *, CASE WHEN pp + pt > 0 THEN 2.0 * tp / (pp + pt) ELSE 0 END AS f1 FROM c)
SELECT round(2.0 * sum(tp) / (sum(pp) + sum(pt)), 6) AS micro, round(avg(f1), 6) AS macro, round(sum(f1 * pt) / sum(pt), 6) AS weighted FROM f""")
def a10_multilabel_f1(spark, d):
    df = table(spark, d, "documents").select(F.concat_ws(";", "lang", "source").alias("t"), F.concat_ws(";", F.when(F.col("doc_id") % 3 == 0, F.lit("en")).otherwise(F.col("lang")), F.lit("src1"), F.lit("src1")).alias("p"))
    m = metrics.multilabel_f1(df, "p", "t", ["en", "fr", "src1", "src2", "zz"])
    return m.select(*[F.round(c, 6).alias(c) for c in ("micro", "macro", "weighted")])


@query(W + f""", v AS (SELECT attribute, pred, truth FROM long WHERE {_VALID}), k AS (SELECT attribute, truth AS label FROM v UNION SELECT attribute, pred FROM v),
c AS (SELECT k.attribute, label, count(*) FILTER (pred = label AND truth = label) AS tp, count(*) FILTER (pred = label) AS pp, count(*) FILTER (truth = label) AS pt FROM k JOIN v ON k.attribute = v.attribute GROUP BY 1, 2),
r AS (SELECT attribute, label, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN pt > 0 THEN tp / pt ELSE 0 END AS recall, CASE WHEN pp + pt > 0 THEN 2.0 * tp / (pp + pt) ELSE 0 END AS f1, pt AS support, tp FROM c)
SELECT attribute, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r
UNION ALL SELECT attribute, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r GROUP BY 1
UNION ALL SELECT attribute, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r GROUP BY 1
UNION ALL SELECT attribute, 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r GROUP BY 1""")
def a11_report(spark, d):
    r = metrics.classification_report(_long(spark, d))
    return r.select("attribute", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(W + " SELECT row_id, CASE WHEN error IS NULL THEN CASE WHEN pred_quality = quality THEN 1.0 ELSE 0.0 END END::DOUBLE AS text_partial_match FROM lab")
def a12_row_metric(spark, d):
    df = labelled(spark, d)
    return metrics.token_f1(df, F.col("pred_quality"), F.col("quality"), F.col("error").isNull()).select("row_id", "text_partial_match")


@query(W + f""", b AS (SELECT attribute, row_id // 100 AS b, count(*) AS n, count(*) FILTER (error IS NULL) AS done, count(*) FILTER ({_VALID}) AS ok, count(*) FILTER ({_VALID} AND pred = truth) AS hit FROM long GROUP BY 1, 2),
w AS (SELECT attribute, sum(n) OVER x AS n, sum(done) OVER x AS done, sum(ok) OVER x AS ok, sum(hit) OVER x AS hit FROM b WINDOW x AS (PARTITION BY attribute ORDER BY b))
SELECT attribute, CAST(n AS BIGINT) AS first_rows, round(done / n, 6) AS completion_rate, round(CASE WHEN ok > 0 THEN hit / ok ELSE 0 END, 6) AS accuracy FROM w""")
def a13_running(spark, d):
    r = metrics.running_metrics(_long(spark, d), "row_id")
    return r.select("attribute", "first_rows", *[F.round(c, 6).alias(c) for c in ("completion_rate", "accuracy")])


_CUT = "[x for x in string_split_regex(array_to_string({}, ' '), '\\s+') if x <> '']"
_AT = "coalesce(list_position([contains(w[i], x) OR contains(x, w[i]) for x in {0}], true), 0)"
_LEFT = "CASE WHEN {0} > 0 THEN list_concat({1}[1 : {0} - 1], {1}[{0} + 1 : len({1})]) ELSE {1} END"


@query(f"""WITH RECURSIVE s AS (SELECT row_number() OVER () AS id, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL),
m(id, i, w, p, t, tp, fp, fn) AS (SELECT id, 1, {_CUT.format('w')}, {_CUT.format('w[1:3]')}, {_CUT.format('w[2:4]')}, 0, 0, 0 FROM s
 UNION ALL SELECT id, i + 1, w, {_LEFT.format('a', 'p')}, {_LEFT.format('b', 't')}, CAST(a > 0 AND b > 0 AS INT), CAST(a > 0 AND b = 0 AS INT), CAST(a = 0 AND b > 0 AS INT)
 FROM (SELECT *, {_AT.format('p')} AS a, {_AT.format('t')} AS b FROM m WHERE i <= len(w)))
SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM m""")
def a14_entity_f1(spark, d):
    words = F.split("text", " ")
    df = table(spark, d, "conversations").select("text", F.slice(words, 1, 3).alias("p"), F.slice(words, 2, 3).alias("t"))
    return metrics.entity_f1(df, "text", "p", "t")


@query()
def a15_text_similarity(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    pairs = c.join(nxt, ["conv_id", "turn"]).select("conv_id", F.col("text").alias("a"), F.col("after").alias("b"))
    return pairs.groupBy("conv_id").agg(F.round(F.avg(metrics.text_similarity(F.col("a"), F.col("b"))), 6).alias("similarity"))


_NTOK = f"CAST(len({_WORDS}) AS BIGINT)"
_COST = f"({_NTOK} + row_id % 3 * 765) * 0.001 + coalesce(CASE WHEN error IS NULL THEN 5 END, 1000) * CASE WHEN row_id % 2 = 0 THEN 0.002 ELSE 0.003 END"


def _costs(spark, d):
    df = labelled(spark, d).withColumns({"model": F.when(F.col("row_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")), "prompt_tokens": token_count(F.col("text")), "answer_tokens": F.when(F.col("error").isNull(), 5), "images": F.col("row_id") % 3, "cached": F.col("row_id") % 4 == 0})
    return metrics.run_cost(df, spark.createDataFrame([("even", 0.001, 0.002), ("odd", 0.001, 0.003)], "model string, prompt_price double, answer_price double"), images="images")


@query(W + f" SELECT CASE WHEN row_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, round(CAST(sum(CASE WHEN row_id % 4 = 0 THEN 0 ELSE {_COST} END) AS DOUBLE), 4) AS cost FROM lab GROUP BY 1")
def a16_cost(spark, d):
    return _costs(spark, d).groupBy("model").agg(F.round(F.sum("cost"), 4).alias("cost"))


@query(W + f", s AS (SELECT *, CASE WHEN row_id % 4 = 0 THEN 0 ELSE {_COST} END AS cost FROM lab ORDER BY row_id LIMIT 100) SELECT round(CAST(avg(cost) * (SELECT count(*) FROM lab) AS DOUBLE), 4) AS total_cost, (SELECT count(*) FROM lab) AS rows, round(CAST(avg(cost) AS DOUBLE), 6) AS average_cost FROM s")
def a17_dry_run(spark, d):
    rows = labelled(spark, d).count()
    plan = metrics.dry_run(_costs(spark, d).orderBy("row_id").limit(100), rows, "text")
    return plan.select(F.round("total_cost", 4).alias("total_cost"), "rows", F.round("average_cost", 6).alias("average_cost"))


@query(W + """ SELECT lang AS model, round(avg(CASE WHEN error IS NULL THEN CASE WHEN pred_quality = quality THEN 1.0 ELSE 0 END END), 6) AS quality_accuracy, round(avg(CASE WHEN error IS NULL THEN CASE WHEN pred_toxic = toxic THEN 1.0 ELSE 0 END END), 6) AS toxic_accuracy FROM lab GROUP BY 1""")
def a18_leaderboard(spark, d):
    long = metrics.long_table(labelled(spark, d), ATTRIBUTES, keys=["lang"])
    runs = long.where(metrics.valid()).groupBy(F.col("lang").alias("model"), F.col("attribute").alias("dataset")).agg(F.round(F.avg((F.col("pred") == F.col("truth")).cast("double")), 6).alias("value")).withColumn("metric", F.lit("accuracy"))
    return metrics.leaderboard(runs, ["quality_accuracy", "toxic_accuracy"])
