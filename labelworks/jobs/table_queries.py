"""Queries over tables: rows, filters, templates, text functions, stores, validation, shape, enrichment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import parse, templates, text
from ..operators import enrich, metrics, rows, scan, store, validate
from .registry import query
from .stub import LAB, labelled, table

W = "WITH "


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def s3_frame(spark, d):
    from ..sources.tables import load

    return load(spark, f"{d}/documents.parquet")


@query("""WITH t AS (SELECT doc_id, lang, concat('"', coalesce(text, ''), chr(10), ' said, "twice"', chr(13), chr(10), chr(10)) AS cell FROM documents) SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(cell) AS cell_md5, lang FROM t""")
def s1_split_csv(spark, d):
    """Whole texts with quotes and line ends, written as CSV and read back by many tasks a file."""
    from ..sources.scratch import fresh_path
    from ..sources.split_csv import read_split_csv
    from ..sources.tables import save

    cell = F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('\n said, "twice"\r\n\n'))
    path = fresh_path(spark, "csv") + ".csv"
    save(table(spark, d, "documents").select("doc_id", cell.alias("cell"), "lang"), path)
    back = read_split_csv(spark, path, ["doc_id", "cell", "lang"])
    return back.select("doc_id", F.md5("cell").alias("cell_md5"), "lang")


@query("SELECT doc_id, text, lang FROM documents")
def s5_seeds(spark, d):
    from ..sources.tables import seeds

    return seeds(spark, table(spark, d, "documents").select("doc_id", "text", "lang"))


@query("SELECT doc_id AS row_id, n_chars FROM documents WHERE doc_id >= 5 AND doc_id < 105")
def p1_slice(spark, d):
    return rows.slice_rows(table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "n_chars"), 5, 100)


@query("SELECT row_id, conf FROM (SELECT row_id, conf FROM lab ORDER BY row_id LIMIT 50 OFFSET 10)".join([W + LAB + " ", ""]))
def p1_slice_by_key(spark, d):
    return rows.slice_by_key(labelled(spark, d).select("row_id", "conf"), "row_id", 10, 50)


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 100 OFFSET 5)")
def p2_shuffle(spark, d):
    return rows.shuffle_rows(table(spark, d, "documents").select("doc_id", "source"), 42, "doc_id", 5, 100)


@query(W + LAB + " SELECT row_id, conf FROM (SELECT row_id, conf, row_number() OVER (ORDER BY conf, row_id) AS n FROM lab) WHERE n > 10")
def p1_rest_by_key(spark, d):
    """All rows but the first ten by confidence, by ranges of the order."""
    df = labelled(spark, d).select("row_id", "conf").withColumn("key", F.struct("conf", "row_id"))
    return rows.slice_by_key(df, "key", 10).drop("key")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id) AS n FROM documents) WHERE n > 5")
def p2_shuffle_rest(spark, d):
    return rows.shuffle_rows(table(spark, d, "documents").select("doc_id", "source"), 7, "doc_id", 5)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS row_id FROM lineitem")
def s3_row_ids(spark, d):
    """Dense row ids in the order of a date that many rows share."""
    df = table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return scan.dense_ids(df, [F.col(c) for c in df.columns]).drop("l_shipdate")


@query("SELECT doc_id, concat('Text: ', coalesce(text, 'nan'), ' [', coalesce(lang, 'nan'), '] ', '') AS rendered FROM documents")
def p3_template(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", templates.render("Text: {text} [{lang}] {unknown}", docs.columns).alias("rendered"))


@query("SELECT doc_id, concat_ws(' ', coalesce(lang, 'nan'), coalesce(source, 'nan'), coalesce(text, 'nan')) AS q FROM documents")
def p4_query_text(spark, d):
    return table(spark, d, "documents").select("doc_id", templates.query_text(["text", "source", "lang"]).alias("q"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, props FROM events")
def p5_strings(spark, d):
    return templates.safe_strings(table(spark, d, "events").select("event_id", "user_id", "event_type", "props"))


@query(W + LAB + """, seeds AS (SELECT string_agg(concat('Text: ', text, chr(10), 'Answer: ', '{"quality":"', quality, '","toxic":"', toxic, '"}'), chr(10) || chr(10) ORDER BY row_id) AS x FROM (SELECT * FROM lab ORDER BY row_id LIMIT 3))
SELECT row_id, md5(concat('Judge the text.', chr(10), chr(10), 'quality: 1 is good Options: 0,1', chr(10), chr(10), x, chr(10), chr(10), 'Text: ', text)) AS prompt_md5 FROM lab, seeds""")
def p6_prompt(spark, d):
    df = labelled(spark, d)
    seeds = df.orderBy("row_id").limit(3)
    shot = F.concat(templates.render("Text: {text}\nAnswer: ", df.columns), templates.answer_json(["quality", "toxic"]))
    examples = seeds.agg(F.transform(F.sort_array(F.collect_list(F.struct("row_id", shot.alias("x")))), lambda r: r["x"]).alias("examples"))
    whole = templates.prompt("Judge the text.", templates.attribute_description("quality", "1 is good", ["0", "1"]), templates.render("Text: {text}", df.columns), F.col("examples"))
    return df.join(F.broadcast(examples)).select("row_id", F.md5(whole).alias("prompt_md5"))


@query(W + LAB + """ SELECT row_id, concat('{"pred_quality":"', pred_quality, '","quality":"', quality, '"}') AS answer FROM lab WHERE pred_quality IS NOT NULL""")
def p7_answer_json(spark, d):
    return labelled(spark, d).select("row_id", templates.answer_json(["pred_quality", "quality"]).alias("answer")).where("answer is not null")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('topic: of the text Options: ', lang, ',', source) ELSE 'topic: of the text Options: a,b' END AS description FROM documents")
def p8_attribute(spark, d):
    chosen = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source"))
    return table(spark, d, "documents").select("doc_id", templates.attribute_description("topic", "of the text", ["a", "b"], selected=chosen).alias("description"))


_TOK = "len([x for x in string_split_regex(coalesce({}, ''), '\\s+') if x <> ''])"
_CUT = "CAST(floor(greatest(0.0, CAST(length({p}) AS DOUBLE) * ({o} - {v} - 1) / ({o} + 1))) AS BIGINT)"


@query(f"""WITH a AS (SELECT doc_id, text AS p1, 'guide the answer' AS p2, {_TOK.format('text')} AS t1, 3 AS t2 FROM documents),
b AS (SELECT *, t1 + t2 - 120 AS over1 FROM a), c AS (SELECT *, CASE WHEN over1 > 0 THEN substring(p1, 1, {_CUT.format(p='p1', o='t1', v='over1')}) ELSE p1 END AS q1 FROM b),
e AS (SELECT *, {_TOK.format('q1')} + t2 - 120 AS over2 FROM c)
SELECT doc_id, q1 AS examples, CASE WHEN over2 > 0 THEN substring(p2, 1, {_CUT.format(p='p2', o='t2', v='over2')}) ELSE p2 END AS guidelines FROM e""")
def p9_trim(spark, d):
    cut = table(spark, d, "documents").select("doc_id", templates.trimmed([F.col("text"), F.lit("guide the answer")], 120).alias("parts"))
    return cut.select("doc_id", F.col("parts")[0].alias("examples"), F.col("parts")[1].alias("guidelines"))


@query("""SELECT page_id, concat('{"text":"Look","url":"', url, '"}') AS prompt FROM pages WHERE url IS NOT NULL""")
def p10_multimodal(spark, d):
    return table(spark, d, "pages").where("url is not null").select("page_id", templates.multimodal(F.lit("Look"), ["url"]).alias("prompt"))


@query(W + LAB + """ SELECT row_id, md5(concat('Judge.', chr(10), chr(10), 'Explain the answer of this example step by step.', chr(10), text, chr(10), 'Answer: ', coalesce(quality, 'nan'))) AS prompt_md5,
CASE WHEN row_id % 2 = 0 THEN concat('because ', lang) ELSE '' END AS explanation FROM lab""")
def p11_explanations(spark, d):
    seeds = labelled(spark, d).withColumn("prompt_md5", F.md5(templates.explanation_prompt("Judge.", F.col("text"), F.col("quality"))))
    answers = seeds.where("row_id % 2 = 0").select("row_id", F.concat(F.lit("because "), "lang").alias("response"))
    return templates.add_explanations(seeds, answers, "row_id", "explanation").select("row_id", "prompt_md5", "explanation")


@query(W + LAB + " SELECT row_id AS id, conf AS certainty, pred_quality AS quality FROM lab")
def p12_rename(spark, d):
    df = labelled(spark, d).select("row_id", "conf", F.create_map(F.lit("quality"), "pred_quality").alias("label"))
    return templates.rename_outputs(df, {"row_id": "id", "conf": "certainty"}, "label", ["quality"]).drop("label")


@query(W + LAB + " SELECT row_id, pred_quality, quality FROM lab WHERE pred_quality = '1' AND quality = '0' AND conf > 0.2")
def f1_filter(spark, d):
    return rows.filter_rows(labelled(spark, d), "pred_quality", "quality", "1", "0", F.col("conf") > 0.2).select("row_id", "pred_quality", "quality")


@query(W + LAB + " SELECT row_id FROM lab WHERE error IS NULL")
def f2_completed(spark, d):
    return rows.completed(labelled(spark, d)).select("row_id")


@query(W + LAB + " SELECT row_id, error FROM lab WHERE error IS NOT NULL")
def f3_non_completed(spark, d):
    return rows.non_completed(labelled(spark, d)).select("row_id", "error")


@query(W + LAB + " SELECT row_id, pred_quality, quality FROM lab WHERE NOT coalesce(pred_quality = quality, false)")
def f4_incorrect(spark, d):
    return rows.incorrect(labelled(spark, d), "pred_quality", "quality").select("row_id", "pred_quality", "quality")


@query(W + LAB + " SELECT row_id FROM lab WHERE coalesce(pred_toxic = toxic, false)")
def f5_correct(spark, d):
    return rows.correct(labelled(spark, d), "pred_toxic", "toxic").select("row_id")


@query(W + LAB + " SELECT row_id, conf FROM lab WHERE least(conf, 1 - conf / 2) >= 0.5")
def f6_confident(spark, d):
    df = labelled(spark, d).withColumn("m", F.create_map(F.lit("quality"), "conf", F.lit("toxic"), 1 - F.col("conf") / 2))
    return rows.by_confidence(df, 0.5, map_column="m").select("row_id", "conf")


@query(W + LAB + " SELECT row_id FROM lab WHERE pred_quality IS NOT NULL AND pred_quality <> 'nan'")
def f7_with_truth(spark, d):
    return rows.with_truth(labelled(spark, d), "pred_quality").select("row_id")


_NORM = r"array_to_string([x for x in string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+') if x NOT IN ('', 'a', 'an', 'the')], ' ')"


@query(f"SELECT doc_id, {_NORM.format('text')} AS normal FROM documents")
def x1_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query("SELECT doc_id, md5(concat(md5(coalesce(lang, '')), md5(coalesce(text, '')))) AS key FROM documents")
def x2_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", text.md5_of(F.col("lang"), F.col("text")).alias("key"))


@query()
def x3_common_substring(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", text.common_substring_length("text", "after").alias("common"))


_COMMON = """WITH p AS (SELECT a.page_id, a.url AS a, b.url AS b FROM pages a JOIN pages b ON b.page_id = a.page_id + 1), i AS (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM p), s AS (SELECT *, unnest(range(1, length(a) - i + 2)) AS n FROM i),
c AS (SELECT page_id, max(CASE WHEN contains(b, substring(a, i, n)) THEN n ELSE 0 END) AS common, max(greatest(length(a), length(b))) AS longer FROM s GROUP BY 1)"""


def _urls(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return p.join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("after")), "page_id")


@query(_COMMON + " SELECT page_id, common FROM c")
def x3_common_url(spark, d):
    return _urls(spark, d).select("page_id", text.common_substring_length("url", "after").alias("common"))


@query(_COMMON + " SELECT page_id, round(common / longer, 6) AS similarity FROM c")
def a15_url_similarity(spark, d):
    return _urls(spark, d).select("page_id", F.round(metrics.text_similarity(F.col("url"), F.col("after")), 6).alias("similarity"))


@query(f"SELECT doc_id, CAST({_TOK.format('text')} AS BIGINT) AS n FROM documents")
def x4_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("n"))


def _prompts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), store.generation_key("stub", "{}", F.col("text")).alias("key"), F.col("text").alias("prompt"))


def _store(prompts):
    return prompts.where("row_id % 3 = 0").groupBy("key").agg(F.max("row_id").alias("r")).select("key", F.concat(F.lit("old "), F.col("r").cast("string")).alias("response"), (F.col("r") % 2 * 1000).cast("long").alias("created_ms"), F.lit(500).cast("long").alias("ttl_ms"))


_P = """p AS (SELECT doc_id AS row_id, md5(concat(md5('stub'), md5('{}'), md5(coalesce(text, '')))) AS key, text FROM documents),
st AS (SELECT key, concat('old ', CAST(r AS VARCHAR)) AS response, r % 2 * 1000 AS created_ms, 500 AS ttl_ms FROM (SELECT key, max(row_id) AS r FROM p WHERE row_id % 3 = 0 GROUP BY key))"""


@query(W + _P + " SELECT p.row_id, p.key, response FROM p JOIN st ON p.key = st.key")
def j1_hits(spark, d):
    p = _prompts(spark, d)
    return store.hits(p.select("row_id", "key"), _store(p)).select("row_id", "key", "response")


@query(W + _P + " SELECT row_id, key FROM p WHERE key NOT IN (SELECT key FROM st)")
def j1_misses(spark, d):
    p = _prompts(spark, d)
    return store.misses(p.select("row_id", "key"), _store(p))


@query("""SELECT event_id, md5(concat(md5('stage'), md5('{}'), md5(concat('{"event_type":"', event_type, '","user_id":', CAST(user_id AS VARCHAR), '}')))) AS key FROM events""")
def j2_keys(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", store.json_key(e, "stage", "{}", ["user_id", "event_type"]).alias("key"))


@query(W + _P + """, nw AS (SELECT key, concat('new ', CAST(max(row_id) AS VARCHAR)) AS response, 2000 AS created_ms, 500 AS ttl_ms FROM p WHERE row_id % 2 = 0 AND row_id % 23 <> 0 GROUP BY key)
SELECT key, response, CAST(created_ms AS BIGINT) AS created_ms FROM nw UNION ALL SELECT key, response, created_ms FROM st WHERE key NOT IN (SELECT key FROM nw)""")
def j3_upsert(spark, d):
    p = _prompts(spark, d)
    fresh = p.where("row_id % 2 = 0").withColumn("error", F.when(F.col("row_id") % 23 == 0, F.lit("failed")))
    new = fresh.groupBy("key", "error").agg(F.concat(F.lit("new "), F.max("row_id").cast("string")).alias("response")).withColumns({"created_ms": F.lit(2000).cast("long"), "ttl_ms": F.lit(500).cast("long")})
    return store.upsert(_store(p), new).select("key", "response", "created_ms")


@query(W + _P + " SELECT key, response FROM st WHERE 1000 - created_ms <= ttl_ms")
def j4_live(spark, d):
    return store.live(_store(_prompts(spark, d)), 1000).select("key", "response")


@query(W + LAB + " SELECT row_id, pred_quality AS pred, quality AS truth FROM lab WHERE error IS NULL")
def j5_pairs(spark, d):
    df = labelled(spark, d)
    return rows.paired(df.where("error is null").select("row_id", "pred_quality"), df.select("row_id", "quality"), "row_id", {"pred_quality": "quality"}).drop("attribute")


@query("SELECT doc_id, length(text) AS n, upper(lang) AS code FROM documents")
def j6_side_by_side(spark, d):
    docs = table(spark, d, "documents")
    made = docs.select("lang").distinct().select("lang", F.upper("lang").alias("code"))
    return rows.beside(docs, made, ["lang"]).select("doc_id", F.length("text").cast("long").alias("n"), "code")


@query("SELECT md5(text) AS text_md5, count(*) AS rows, CAST(coalesce(length(text), 0) AS FLOAT) AS first_number FROM conversations GROUP BY text")
def j7_embeddings(spark, d):
    texts = table(spark, d, "conversations").select("text")
    known = texts.sparkSession.createDataFrame([], "key string, embedding array<float>")
    found, _ = store.embeddings_for(texts, known, lambda s: s.map(lambda x: [float(len(x or "")), 1.0]), "stub")
    return found.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("rows"), F.first(F.col("embedding")[0]).alias("first_number"))


def _stub_model(prompts: pd.Series) -> pd.DataFrame:
    import hashlib

    digest = prompts.map(lambda x: hashlib.md5((x or "").encode()).hexdigest())
    failed = digest.str[0] == "0"
    return pd.DataFrame({"text": ("label " + digest.str[1:5]).where(~failed), "error": pd.Series("rate limit", index=prompts.index).where(failed)})


@query(W + _P + """, live AS (SELECT * FROM st WHERE 1000 - created_ms <= ttl_ms)
SELECT p.row_id, CASE WHEN live.key IS NOT NULL THEN live.response WHEN substring(md5(text), 1, 1) <> '0' THEN concat('label ', substring(md5(text), 2, 4)) END AS response,
CASE WHEN live.key IS NULL AND substring(md5(text), 1, 1) = '0' THEN 'rate limit' END AS error, live.key IS NOT NULL AS cached FROM p LEFT JOIN live ON p.key = live.key WHERE text IS NOT NULL""")
def m1_label_prompts(spark, d):
    p = _prompts(spark, d).where("prompt is not null")
    answers, _ = store.label_prompts(p, _store(p), _stub_model, 1000)
    return answers.select("row_id", "response", "error", "cached")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'rate_limit_error' WHEN 'click' THEN 'context_length_error' WHEN 'view' THEN 'llm_provider_error' END AS error_type FROM events")
def m2_error_type(spark, d):
    code = F.when(F.col("event_type") == "error", F.lit("RateLimit")).when(F.col("event_type") == "click", F.lit("context_window")).when(F.col("event_type") == "view", F.lit("boom"))
    return table(spark, d, "events").select("event_id", parse.error_type(code).alias("error_type"))


@query(W + """a AS (SELECT doc_id AS row_id, (doc_id + g * g) % 3 AS label, g AS pos, concat('raw ', CAST(g AS VARCHAR)) AS raw FROM documents, (VALUES (0), (1), (2), (3)) t(g)),
c AS (SELECT row_id, label, count(*) AS votes, min(pos) AS first FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, first) AS k FROM c)
SELECT row_id, CAST(label AS VARCHAR) AS label, votes, first, concat('raw ', CAST(first AS VARCHAR)) AS raw FROM r WHERE k = 1""")
def m8_majority(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("pos"))
    a = a.withColumn("label", ((F.col("row_id") + F.col("pos") * F.col("pos")) % 3).cast("string")).withColumn("raw", F.concat(F.lit("raw "), F.col("pos").cast("string")))
    return store.majority(a, payload=["raw"])


@query("""WITH g AS (SELECT DISTINCT lang AS label FROM documents WHERE lang <> 'de') SELECT label, CAST(n AS BIGINT) AS line_no, concat('text of ', label, ' ', CAST(n AS VARCHAR)) AS text, CAST(n * 2 AS VARCHAR) AS size FROM g, (VALUES (0), (1), (2)) t(n)""")
def m9_expand(spark, d):
    line = lambda n: F.concat(F.lit(f"\n{n * 2} , text of "), "label", F.lit(f" {n}"))
    answers = table(spark, d, "documents").select(F.col("lang").alias("label")).distinct().withColumn("response", F.when(F.col("label") != "de", F.concat(F.lit("size,text"), line(0), line(1), line(2))))
    return store.expand_answers(answers, ["text", "size"])


@query("""SELECT doc_id, concat(upper(lang), ' of ', source) AS note, CAST(NULL AS VARCHAR) AS note_error FROM documents WHERE source <> 'src3' UNION ALL SELECT doc_id, 'bad source', 'bad source' FROM documents WHERE source = 'src3'""")
def t1_user_stage(spark, d):
    def fn(pdf):
        bad = pdf["source"] == "src3"
        return pd.DataFrame({"note": (pdf["lang"].str.upper() + " of " + pdf["source"]).where(~bad), "unused": "x", "error": pd.Series("bad source", index=pdf.index).where(bad)})

    return enrich.user_stage(table(spark, d, "documents").select("doc_id", "lang", "source"), "note", ["lang", "source"], {"note": "note"}, fn)[0].select("doc_id", "note", "note_error")


@query("SELECT doc_id, upper(lang) AS code, length(text) AS n, 'size' AS enrich_task_transform FROM documents")
def t2_stages(spark, d):
    stages = [("code", lambda df: df.withColumns({"code": F.upper("lang"), "code_error": F.when(F.col("lang") == "fr", F.lit("failed"))}), ["code_error"]), ("size", lambda df: df.withColumns({"n": F.length("text").cast("long"), "n_error": F.lit(None).cast("string")}), ["n_error"])]
    return enrich.run_stages(table(spark, d, "documents"), "enrich", stages).select("doc_id", "code", "n", "enrich_task_transform")


_STRIP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"SELECT page_id, url, CAST(NULL AS VARCHAR) AS error, trim(regexp_replace(replace(replace(replace(replace(replace(replace({_STRIP}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages")
def t3_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", enrich.page_text(F.col("url"), F.col("html")).alias("r")).select("page_id", "r.url", "r.error", "r.text")


@query("SELECT conv_id, string_agg(concat('Page ', CAST(turn + 1 AS VARCHAR), ': ', text), chr(10) || chr(10) ORDER BY turn) AS content, count(*) AS num_pages FROM conversations GROUP BY conv_id")
def t4_join_pages(spark, d):
    return enrich.join_pages(table(spark, d, "conversations").withColumn("page_num", F.col("turn") + 1), "conv_id", "page_num", "text")


_SEARCH = """concat('{"', CASE WHEN event_id % 2 = 0 THEN 'knowledge_graph' ELSE 'knowledgeGraph' END, '":{"title":"', event_type, '"},"', CASE WHEN event_id % 2 = 0 THEN 'organic_results' ELSE 'organic' END, '":[{"position":1,"title":"t', CAST(user_id AS VARCHAR), '","link":"l","snippet":"s","rank":9}]', CASE WHEN event_id % 10 = 0 THEN ',"error":"limit"' ELSE '' END, '}')"""


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN concat('{"title":"', event_type, '"}') END AS knowledge_graph, CASE WHEN event_id % 10 <> 0 THEN concat('[{"position":1,"title":"t', CAST(user_id AS VARCHAR), '","link":"l","snippet":"s"}]') END AS organic_results, CASE WHEN event_id % 10 = 0 THEN 'limit' END AS error FROM events""")
def t5_search_results(spark, d):
    stored = table(spark, d, "events").select("event_id", F.expr(_SEARCH.replace("VARCHAR", "STRING")).alias("response"))
    return stored.select("event_id", enrich.search_results(F.col("response")).alias("r")).select("event_id", "r.*")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def t6_json_field(spark, d):
    return table(spark, d, "events").select("event_id", enrich.places(F.concat(F.lit('{"places":'), F.get_json_object("props", "$.k"), F.lit("}"))).alias("k"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN concat('find ', event_type, ' of ', CAST(user_id AS VARCHAR)) END AS query, CASE WHEN event_type = 'error' THEN 'INVALID_INPUT' END AS error FROM events")
def t7_query(spark, d):
    e = table(spark, d, "events").withColumn("q", F.when(F.col("event_type") == "error", F.lit("NO_TRANSFORM")).otherwise(F.concat(F.lit("find "), "event_type", F.lit(" of "), F.col("user_id").cast("string"))))
    return e.select("event_id", enrich.query_or_error("{q}", e.columns).alias("r")).select("event_id", "r.*")


@query("SELECT doc_id AS row_id, 'lang' AS loc, 'a value is required' AS msg, 'missing' AS type FROM documents WHERE doc_id % 9 = 0")
def v2_required(spark, d):
    df = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"))
    return validate.problems(df, [validate.required_text("lang")])


@query("SELECT doc_id AS row_id, 'lang' AS loc, concat('not in the label set: ', CASE WHEN doc_id % 4 = 0 THEN 'zz' ELSE lang END) AS msg, 'value_error' AS type FROM documents WHERE doc_id % 4 = 0 OR lang NOT IN ('en', 'de')")
def v3_single_label(spark, d):
    shown = F.when(F.col("doc_id") % 4 == 0, F.lit("['en', 'zz']")).otherwise(F.col("lang"))
    df = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), shown.alias("lang"))
    return validate.problems(df, [validate.single_label("lang", ["en", "de"])])


@query("SELECT event_id AS row_id, 'props' AS loc, CASE WHEN event_id % 5 = 0 THEN 'not a JSON object' ELSE 'not in the label set: k' END AS msg, CASE WHEN event_id % 5 = 0 THEN 'type_error' ELSE 'value_error' END AS type FROM events")
def v4_entity_map(spark, d):
    df = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 5 == 0, F.lit("oops")).otherwise(F.col("props")).alias("props"))
    return validate.problems(df, [validate.entity_map("props", ["Location"])])


@query("SELECT doc_id AS row_id, 'labels' AS loc, concat('not in the label set: ', source) AS msg, 'value_error' AS type FROM documents WHERE source NOT IN ('src1', 'src2')")
def v5_many_labels(spark, d):
    df = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.concat("lang", F.lit("; "), "source").alias("labels"))
    return validate.problems(df, [validate.many_labels("labels", ["en", "de", "fr", "es", "src1", "src2"])])


@query("SELECT loc, type, count(*) AS n FROM (SELECT 'lang' AS loc, 'missing' AS type FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'source', 'value_error' FROM documents WHERE source <> 'src1') GROUP BY 1, 2")
def v6_all_problems(spark, d):
    df = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"), "source")
    return validate.problems(df, [validate.required_text("lang"), validate.single_label("source", ["src1"])]).groupBy("loc", "type").agg(F.count("*").alias("n"))


@query(W + LAB + """ SELECT row_id, CASE WHEN error IS NULL THEN pred_quality ELSE 'NO_LABEL' END AS quality_label, CASE WHEN error IS NULL THEN '' ELSE 'NO_LABEL' END AS other_label, error IS NULL AS job_task_successfully_labeled,
error AS job_task_error, CASE WHEN error IS NULL THEN conf ELSE 0.0 END AS quality_confidence, 0.0::DOUBLE AS other_confidence FROM lab""")
def o1_shape(spark, d):
    df = labelled(spark, d).withColumns({"label": F.create_map(F.lit("quality"), "pred_quality"), "prompt": F.col("text"), "confidence": F.create_map(F.lit("quality"), "conf")})
    out = enrich.shape(df, "job", ["quality", "other"], confidence="confidence")
    return out.select("row_id", "quality_label", "other_label", "job_task_successfully_labeled", "job_task_error", "quality_confidence", "other_confidence")


@query("SELECT doc_id, length(text) * 2 AS twice FROM documents")
def o2_chain(spark, d):
    stages = {"twice": (lambda df: df.withColumn("twice", F.col("n") * 2), {"n"}), "n": (lambda df: df.withColumn("n", F.length("text").cast("long")), set())}
    return enrich.chain(table(spark, d, "documents"), stages).select("doc_id", "twice")


@query("SELECT doc_id, lang, CAST(NULL AS BIGINT) AS page_id FROM documents UNION ALL SELECT NULL, NULL, page_id FROM pages")
def u1_append(spark, d):
    return rows.appended(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "pages").select("page_id"))
