"""Hand-computed cases of operators, edge cases and properties."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelworks.functions import confidence, parse, templates, text
from labelworks.operators import enrich, metrics, rows, store, validate, vectors
from labelworks.sources import tables

from . import plain


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('a;b\n"x;1\n""y""";nan\nNA;2\n')
    df = tables.load(spark, str(p), delimiter=";")
    assert [tuple(r) for r in df.collect()] == [('x;1\n"y"', None), (None, "2")]
    tables.save(df.withColumn("m", F.create_map(F.lit("k"), F.lit("v"))), f"{tmp_path}/out.csv")
    back = tables.read_csv(spark, f"{tmp_path}/out.csv", ["a", "b", "m"])
    assert sorted(map(str, back.collect())) == sorted(["Row(a='x;1\\n\"y\"', b=None, m='{\"k\":\"v\"}')", "Row(a=None, b='2', m='{\"k\":\"v\"}')"])
    raw = tables.read_csv(spark, str(p), delimiter=";", quoting=False, multi_line=False).first()
    assert raw.a == '"x'


def test_jsonl_and_unknown_kind(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n{"a": null}\n')
    assert [tuple(r) for r in tables.load(spark, str(p), ["a", "b"]).collect()] == [("1", "x"), (None, None)]
    tables.save(spark.range(2), f"{tmp_path}/o.jsonl")
    assert spark.read.json(f"{tmp_path}/o.jsonl").count() == 2
    for bad in (lambda: tables.load(spark, "x.xls"), lambda: tables.save(spark.range(1), "x.xls")):
        with pytest.raises(ValueError):
            bad()


def test_seeds_and_file_pages(spark, tmp_path):
    s = tables.seeds(spark, [{"example": "e", "label": "l"}, {"example": "f", "label": None}])
    assert [tuple(r) for r in s.orderBy("position").collect()] == [("e", "l", 0), ("f", None, 1)]
    (tmp_path / "d.pdf").write_bytes(b"This is a test\x0ctwo")
    pages = tables.file_pages(spark, str(tmp_path), lambda b: b.decode().split("\x0c"))
    joined = enrich.join_pages(pages, "path", "page_num", "text").first()
    assert (joined.content, joined.num_pages) == ("Page 1: This is a test\n\nPage 2: two", 2)


def test_slice_and_shuffle_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "row_id")
    assert rows.slice_rows(df, 5, 5).agg(F.min("row_id"), F.count("*")).first() == (5, 5)
    orders = {tuple(r.row_id for r in rows.shuffle_rows(df.repartition(n), 7, "row_id", 0, 50).collect()) for n in (1, 4, 17)}
    assert len(orders) == 1


def test_filters_with_missing_values(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, "b"), (4, None, None), (5, "a", "nan")], "row_id long, l string, t string")
    ids = lambda d: sorted(r.row_id for r in d.collect())
    assert ids(rows.incorrect(df, "l", "t")) == [2, 3, 4, 5]
    assert ids(rows.correct(df, "l", "t")) == [1]
    assert ids(rows.with_truth(df, "t")) == [1, 2, 3]
    with pytest.raises(ValueError):
        rows.correct(df, "l", None)
    with pytest.raises(ValueError):
        rows.by_confidence(df)


def test_templates(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(templates.render("{a}-{b}-{c}", df.columns).alias("x")).first().x == "x-nan-"
    assert templates.placeholders("{a} {b}{a}") == ["a", "b", "a"]
    assert df.select(templates.answer_json(["a", "b"]).alias("x")).first().x is None
    p = one(spark, templates.prompt("G", "O", F.lit("C"), F.array().cast("array<string>")))
    assert p == "G\n\nO\n\nC"
    with pytest.raises(ValueError):
        templates.add_explanations(df, df, "a", "")


def test_trim_stops_when_it_fits(spark):
    parts = templates.trim_parts([F.lit("one two three four"), F.lit("five six")], 4)
    got = spark.range(1).select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
    # 6 tokens, 2 too many: 18 * (4 - 2 - 1) / 5 = 3.6, so 3 characters stay; then 3 tokens fit.
    assert tuple(got) == ("one", "five six")


def test_parse_answers(spark):
    cases = {
        '{"label": "x"}': {"label": "x"}, "": None, "no": None, '```json\n{"a": 1}\n```': {"a": "1"}, "So {'a': 'b',} done": {"a": "b"}, '{"a": "x\ny"}': {"a": "x\ny"},
        '{"a": null, "b": [1, 2]}': {"b": "[1,2]"}, '{"a": 1, "a": 2}': {"a": "2"},
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, r string")
    got = {r.i: r.m for r in df.select("i", parse.parse_answer(F.col("r")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


@pytest.mark.parametrize(("given", "found"), [("a {\"k\": {\"x\": 1}} b", {"k": {"x": 1}}), ("{ {\"a\": 2}", {"a": 2}), ("{oops}", None), ("", None), (None, None)])
def test_first_json(spark, given, found):
    got = one(spark, parse.json_substring(F.lit(given).cast("string")))
    assert got == plain.first_json(given)
    assert (json.loads(got) if got else None) == found


TOKENS = "array<struct<token:string,logprob:double>>"


def by_key(spark, tokens, logs, keys):
    df = spark.createDataFrame([(list(zip(tokens, logs, strict=True)),)], f"x {TOKENS}")
    return df.select(confidence.confidence_by_key(keys)("x").alias("m")).first().m


def by_label(spark, tokens, logs, label):
    df = spark.createDataFrame([(list(zip(tokens, logs, strict=True)), label)], f"x {TOKENS}, l string")
    return df.select(confidence.confidence_by_label()("x", "l").alias("m")).first().m


def test_scans_equal_plain_versions(spark):
    """Random inputs, most of them odd, through the column functions and through loops."""
    r = random.Random(4)
    some = lambda alphabet, most: "".join(r.choice(alphabet) for _ in range(r.randint(0, most)))
    texts = [None, "", "}", "{}", '}{"a": "}"}', '{"a": [1, {"b": NaN}]} {', "{'a': 1}", '{"a": 1,}', '{"a": 1]}', "é{ü{}", '{"a":\n1}', "x" * 50_000 + "{" * 50 + '{"k": 1}' + "y" * 50_000]
    texts += [some('{}":,a1 \u00e9\n', 14) for _ in range(400)] + ["".join(r.choice(["{", "}", '{"a": 1}', "{}", " ", "x"]) for _ in range(r.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.j for x in df.select("i", parse.json_substring("t").alias("j")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain.first_json(t) for t in texts]

    pieces = ['"a":', '"', "a", '":', '{"b":', "x", " ", "\n", "<unk>", "\\n", ";", " ; ", "ab", "b;a", ";;", "joy", "\u00e9", "b;c;ab", "", "\u00a0", '"a": "b":', ","]
    rows = [(0, None, None), (1, [], ""), (2, [], "a;b"), (3, None, "a"), (4, [("a", -0.1)], None)]
    for i in range(5, 400):
        x = [(r.choice(pieces), r.choice([None, -0.1, -0.5, -2.0, 0.0, 0.3])) for _ in range(r.randint(0, 9))]
        rows.append((i, x, ";".join(r.choice(["a", "b", " ab ", "joy", "", "\u00e9", "abc"]) for _ in range(r.randint(0, 4)))))
    df = spark.createDataFrame(rows, f"i int, x {TOKENS}, l string")
    keys = ["a", "b", "c", "a"]
    both = df.select("i", confidence.confidence_by_key(keys)("x").alias("k"), confidence.confidence_by_label()("x", "l").alias("l"))
    for found, (_, x, label) in zip(both.orderBy("i").collect(), rows, strict=True):
        split = None if x is None else ([t for t, _ in x], [p for _, p in x])
        assert found.k == (None if x is None else pytest.approx(plain.key_confidences(*split, keys)))
        assert found.l == (None if x is None or label is None else pytest.approx(plain.label_confidences(*split, label)))
    lengths = [(some("abc", 9), some("abcd", 12)) for _ in range(200)]
    df = spark.createDataFrame(lengths, "a string, b string")
    assert all(x.n == x.m for x in df.select(confidence.common_length(F.col("a"), F.col("b")).alias("n"), text.common_substring_length("a", "b").alias("m")).collect())

    names = lambda: r.choice([None, [], [some("ab", 3) for _ in range(r.randint(0, 4))], ["New York", "is"]])
    rows = [(i, r.choice([None, "", some("ab \u00a0\t", 30), "New York is new"]), names(), names()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, x string, p array<string>, t array<string>")
    split = lambda x: " ".join(x or ()).split()
    for found, (_, x, p, t) in zip(df.select("i", metrics.entity_marks(F.col("x"), F.col("p"), F.col("t")).alias("m")).orderBy("i").collect(), rows, strict=True):
        assert tuple(found.m) == plain.token_marks(split(p), split(t), (x or "").split())
    assert metrics.entity_f1(df.where("false"), "x", "p", "t").collect() == [(0, 0, 0, 0.0)]


def test_scans_need_no_python_worker(spark, capsys):
    df = spark.createDataFrame([], f"x {TOKENS}, l string, p array<string>")
    made = [parse.json_substring("l"), confidence.confidence_by_key(["a"])("x"), confidence.confidence_by_label()("x", "l"), metrics.entity_marks(F.col("l"), F.col("p"), F.col("p"))]
    df.select(*[c.alias(f"c{i}") for i, c in enumerate(made)]).explain()
    assert "Python" not in capsys.readouterr().out


def test_confidence(spark):
    tok = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(p).cast("double").alias("logprob")) for t, p in (("a", -1.0), ("<unk>", -9.0), ("b", 0.5), ("c", None))])
    assert one(spark, confidence.mean_probability(tok)) == pytest.approx(math.exp((-1 + math.log(0.5)) / 2))
    assert one(spark, confidence.mean_probability(F.array().cast("array<struct<token:string,logprob:double>>"))) == 0
    names = ["{", '"a":', "x", ",", '"b":', "y", "}"]
    got = by_key(spark, names, [-1.0, -1.0, -0.5, -0.1, -1.0, -0.2, -0.4], ["a", "b", "c"])
    assert got == pytest.approx({"a": math.exp(-0.3), "b": math.exp(-0.3), "c": 0})
    assert by_key(spark, [], [], ["a"]) == {}
    got = by_label(spark, ["joy", ";", " love"], [-0.1, -0.5, -0.3], "joy; love")
    assert got == pytest.approx({"joy": math.exp(-0.1), "love": math.exp(-0.4)})
    got = by_label(spark, ["cat", ";", "caterpillar"], [-0.1, -0.2, -0.9], "cat;caterpillar")
    assert got == pytest.approx({"cat": math.exp(-0.1), "caterpillar": math.exp(-0.55)})
    assert by_label(spark, ["q"], [-0.1], "a;b") == pytest.approx({"a": math.exp(-0.1), "b": math.exp(-0.1)})


def test_trimming_many_parts(spark):
    parts = [F.lit("one two three four five six"), F.lit(None).cast("string"), F.lit("a b c d e f g h"), F.lit("x y z"), F.lit("last")]
    assert one(spark, templates.trimmed([parts[0], parts[2], parts[3], parts[4]], 100)) == ["one two three four five six", "a b c d e f g h", "x y z", "last"]
    cut = one(spark, templates.trimmed([parts[0], parts[2], parts[3], parts[4]], 6))
    assert cut[0] == "" and cut[3] == "last" and len(cut[1]) < 8
    size = lambda n: len(spark.range(1).select(templates.trimmed([F.concat(F.lit(f"w{i} "), F.col("id").cast("string")) for i in range(n)], 3))._jdf.queryExecution().optimizedPlan().toString())
    assert size(4) < 2.5 * size(2)


def test_normalize(spark):
    cases = {"The  cat, a DOG!": "cat dog", "\u201ca\u201d éa the\u00a0an x": "\u201c \u201d éa x", "": "", "a an the": "", "A_b then": "ab then", "é the ça": "é ça"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, n string")
    assert [r.got for r in df.select(text.normalize(F.col("t")).alias("got")).collect()] == [*cases.values(), None]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None), (4, "x y")], "k long, t string")
    got = sorted(map(tuple, confidence.text_chunks(df, "t", 2, ["k"]).collect()))
    assert got == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"), (4, 0, "x y")]


def test_common_substring(spark):
    df = spark.createDataFrame([("abcdef", "zabcy", 3), ("", "a", 0), ("same", "same", 4), (None, "a", None), ("é1", "xé1", 2)], "a string, b string, n long")
    assert all(r.n == r.got for r in df.select("n", text.common_substring_length("a", "b").alias("got")).collect())
    pairs = spark.createDataFrame([("", "", False), ("a", "a", True), ("x" * 50, "x" * 49 + "y", True), ("ab", "ba", False), (None, "a", False)], "a string, b string, m boolean")
    assert all(r.m == r.got for r in pairs.select("m", text.similar_text(F.col("a"), F.col("b")).alias("got")).collect())


def test_auroc_equals_pair_count(spark):
    rng = np.random.default_rng(0)
    data = [(None, "a", "1", "1" if rng.random() < 0.6 else "0", float(rng.integers(0, 9)) / 8) for _ in range(200)] + [(None, "one", "1", "1", 0.5), ("e", "a", "1", "1", 0.9), (None, "none", "1", "0", 0.5)]
    long = spark.createDataFrame(data, "error string, attribute string, pred string, truth string, conf double")
    pos, neg = [[r[4] for r in data[:200] if (r[3] == "1") == m] for m in (True, False)]
    expected = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    got = {r.attribute: r.auroc for r in metrics.auroc(long).collect()}
    assert got == pytest.approx({"a": expected, "one": 1.0, "none": 0.0})


def test_entity_marks_and_empty_metrics(spark):
    lists = [F.array(*map(F.lit, x)) for x in (["New"], ["New", "York"])]
    assert tuple(one(spark, metrics.entity_marks(F.lit("New York is"), *lists))) == (1, 0, 1)
    long = spark.createDataFrame([], "error string, attribute string, pred string, truth string, conf double")
    assert metrics.scalar_metrics(long).count() == 0 and metrics.auroc(long).count() == 0


def test_majority_tie_goes_to_the_first(spark):
    a = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "row_id long, pos long, label string")
    assert store.majority(a).first().label == "b"


def test_second_run_makes_no_call(spark, tmp_path):
    p = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "row_id long, prompt string").withColumn("key", store.generation_key("m", "{}", F.col("prompt")))
    empty = spark.createDataFrame([], "key string, response string, created_ms long, ttl_ms long")

    def fn(prompts):
        assert prompts.is_unique
        return pd.DataFrame({"text": prompts.str.upper(), "error": None})

    _, made = store.label_prompts(p, empty, fn, 10, calls=1)
    made.write.parquet(f"{tmp_path}/store")
    kept = spark.read.parquet(f"{tmp_path}/store")
    assert kept.count() == 2

    def never(prompts):
        raise AssertionError("called")

    answers, more = store.label_prompts(p, kept.drop("error"), never, 20)
    assert more.count() == 0 and sorted((r.row_id, r.response, r.cached) for r in answers.collect()) == [(1, "X", True), (2, "X", True), (3, "Y", True)]
    late, _ = store.label_prompts(p, kept.drop("error"), never, 10 + store.WEEK_MS + 1)
    assert all(r.error.startswith("llm_provider_error") for r in late.collect())


def test_top_k_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows_ = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    c = spark.createDataFrame(rows_, "cid long, v array<double>")
    q = c.where("cid < 5 or cid = 60").withColumnRenamed("cid", "qid")
    small = sorted(map(tuple, vectors.top_k(q, c, 7).collect()))
    monkeypatch.setattr(vectors, "MOST_BROADCAST_NUMBERS", 0)
    assert small == sorted(map(tuple, vectors.top_k(q, c, 7, block_rows=9).collect())) and len(small) == 35
    own = c.withColumn("kind", F.when(F.col("cid") % 3 > 0, (F.col("cid") % 3).cast("string")))
    each = sorted(map(tuple, vectors.top_k(q, own, 2, by="kind", block_rows=9).collect()))
    monkeypatch.undo()
    assert each == sorted(map(tuple, vectors.top_k(q, own, 2, by="kind").collect())) and len(each) == 20
    assert vectors.mmr(q, c, 3).where("rank = 1").join(vectors.top_k(q, c, 1), ["qid", "cid"]).count() == 5


def test_user_stage(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")

    def fn(pdf):
        assert pdf["x"].is_unique
        return pd.DataFrame({"y": pdf["x"] * 2, "error": [None if v == "a" else "bad" for v in pdf["x"]]})

    out, new = enrich.user_stage(df, "s", ["x"], {"y": "z"}, fn)
    assert sorted(map(tuple, out.collect())) == [("a", "aa", None), ("a", "aa", None), ("b", "bad", "bad")]
    assert new.count() == 1
    failing, _ = enrich.user_stage(df, "s", ["x"], {"y": "z"}, lambda pdf: 1 / 0)
    assert {r.z_error for r in failing.collect()} == {"division by zero"}


def test_page_text(spark):
    df = spark.createDataFrame([("NO_TRANSFORM", "x"), (None, "x"), ("h.org/a", "<p>a &amp;lt; b</p><script>z</script>")], "url string, html string")
    got = [tuple(r.r) for r in df.select(enrich.page_text(F.col("url"), F.col("html")).alias("r")).collect()]
    assert got == [("INVALID_INPUT", "INVALID_INPUT", None), ("INVALID_INPUT", "INVALID_INPUT", None), ("a &lt; b", None, "https://h.org/a")]


def test_validation(spark):
    df = spark.createDataFrame([(1, "t", "Argument"), (2, None, "Other"), (3, "t", "['Argument', 'x']")], "row_id long, example string, label string")
    validate.check_columns(df, "{example} {label}", "label")
    with pytest.raises(ValueError, match="missing: other"):
        validate.check_columns(df, "{other}")
    found = validate.problems(df, [validate.required_text("example"), validate.single_label("label", ["Agreements", "Argument"])])
    assert sorted((r.row_id, r.loc, r.type) for r in found.collect()) == [(2, "example", "missing"), (2, "label", "value_error"), (3, "label", "value_error")]
    with pytest.raises(ValueError, match="3 problems"):
        validate.require_valid(found)
    validate.require_valid(found.where("false"))


def test_hooks_and_chain(spark):
    enrich.register_stage("upper", lambda df: df.withColumn("u", F.upper("x")))
    enrich.register_metric("rows", lambda df: df.agg(F.count("*").alias("rows")))
    enrich.register_selector("first", lambda q, s: q.join(F.broadcast(s.limit(1))))
    df = spark.createDataFrame([("a",)], "x string")
    assert enrich.STAGES["upper"](df).first().u == "A" and enrich.METRICS["rows"](df).first().rows == 1
    assert enrich.SELECTORS["first"](df, df.withColumnRenamed("x", "y")).first().y == "a"
    with pytest.raises(ValueError, match="circle"):
        enrich.chain(df, {"a": (lambda x: x, {"b"}), "b": (lambda x: x, {"a"})})


def test_columns_work_on_a_stream(spark, tmp_path):
    from labelworks.streaming.files import stream_labels

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"key": "1", "response": "{\\"a\\": \\"x\\"}"}\n{"key": "2", "response": "no"}\n')
    q = stream_labels(spark, str(tmp_path / "in"), ["a"]).writeStream.format("memory").queryName("labels_stream").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.sql("select key, a_label, error from labels_stream").collect())) == [("1", "x", None), ("2", "NO_LABEL", "invalid_llm_response_error")]


def test_top_k_grid_equals_the_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), i % 3) for i in range(300)]
    corpus = spark.createDataFrame(rows, "cid long, v array<double>, label int")
    queries = corpus.where("cid % 20 = 0").select(F.col("cid").alias("qid"), "v")
    whole = {tuple(r) for r in vectors.top_k(queries, corpus, 4).select("qid", "cid", "rank").collect()}
    each = {tuple(r) for r in vectors.top_k(queries, corpus, 2, by="label").select("qid", "cid", "label").collect()}
    for name, value in {"MOST_BROADCAST_NUMBERS": 10, "BLOCK_NUMBERS": 200, "BLOCK_QUERIES": 4, "STEP": 3, "TILE": 7}.items():
        monkeypatch.setattr(vectors, name, value)
    assert {tuple(r) for r in vectors.top_k(queries, corpus, 4).select("qid", "cid", "rank").collect()} == whole
    assert {tuple(r) for r in vectors.top_k(queries, corpus, 2, by="label").select("qid", "cid", "label").collect()} == each
