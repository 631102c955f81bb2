"""Each operator through Spark, on a table of edge cases: nulls, empty and long texts, copies, clashing columns, no rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelworks.llm import decontaminate, html_density, language, media, ngram_join, packing, quality, token_coder, toxicity, warc
from labelworks.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, n_words string, piece string, key string, start string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


BASE = words(1, 200)
TEXTS = [None, "", " \n ", "one", "one two three four", BASE, BASE, BASE.upper(), BASE + " tail", words(2, 200), words(3, 15_000), "x" * 30_000, "é ü. ß\n" * 40, words(4, 300), "ends <|endoftext|> here<|startoftext|>, \u00a0and\u2003there"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "s", "p", "n", "q", "k", "b") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, BASE, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_token_blocks(docs, empty):
    path = vocabulary_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(map(tuple, token_coder.op1_query(docs, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    ids = {t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in pairs_of(docs)}
    expected = sorted((-1 if d is None else d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in pairs_of(docs))
    assert sorted((-1 if d is None else d, n, c) for _, d, n, c in got) == expected
    assert [d for _, d, _, _ in got] == sorted((d for _, d, _, _ in got), key=lambda d: -1 if d is None else d)
    assert [s for s, *_ in got] == [0, *itertools.accumulate(n for _, _, n, _ in got)][:-1]
    assert token_coder.op1_query(empty, path).count() == 0


def test_small_blocks_and_ids(docs, tmp_path):
    path = vocabulary_path("byte_bpe_50k.json")
    blocks = token_coder.write_token_blocks(docs.where("doc_id < 10"), f"file://{tmp_path}/t", path, block_ids=100)
    assert blocks.count() > 3
    one = token_coder.read_token_documents(blocks, with_ids=True).where("doc_id = 3").first()
    assert one.ids == [*Tokenizer.from_file(path).encode("one", add_special_tokens=False).ids, 0]


def test_warc(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>", "c"), (2, None, "<p>a</p>", "c"), (3, "u\r\nX: y", None, "c"), (4, "u", "", "c"), (5, "u", "z" * 100_000, "c"), (None, "u", "q", "c"), (0, "u", "<p>a</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string").repartition(2)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.op2_query(pages).collect()}
    assert got == {0: (8, "response", None), 1: (8, "revisit", 0), 2: (8, "revisit", 0), 3: (0, "response", None), 4: (0, "revisit", 3), 5: (100_000, "response", None), None: (1, "response", None)}
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", min_revisit_bytes=9)
    back = warc.read_warc(manifest, range_bytes=50, with_payload=True).collect()
    assert {r.key: bytes(r.payload).decode() for r in back} == {"" if k is None else str(k): h or "" for k, _, h, _ in rows} and {r.record_type for r in back} == {"response"}
    assert warc.op2_query(pages.where("false")).count() == 0


def test_decontamination(spark, docs, empty):
    b = spark.createDataFrame([("i1", " ".join(BASE.split()[50:80])), ("i2", "one two"), ("i3", None), ("i4", ""), ("i1", "one two")], "item_id string, text string")
    one = decontaminate.find_contamination(docs, b)
    assert one.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    rows = sorted(map(tuple, one.select(*cols).collect()), key=str)
    by = {r[0]: r[1:] for r in rows}
    assert by[5][:3] == (200, 30, 1) and by[5][4] and by[4][:3] == (4, 2, 2) and by[4][3] == hashlib.sha256(b"i1,i2").hexdigest()
    assert by[0] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    many = decontaminate.find_contamination(docs, b, block_words=1)
    assert sorted(map(tuple, many.select(*cols).collect()), key=str) == rows
    assert decontaminate.op3_query(empty, b).count() == 0 and decontaminate.op3_query(docs, b.where("false")).where("n_hit > 0").count() == 0


def test_packing(docs, empty):
    path = vocabulary_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    expected = []
    for d, t in pairs_of(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(str(d), i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *itertools.accumulate(n for _, n in sorted(p))][:-1] and sum(n for _, n in p) <= 2048
    assert len(places) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack(empty, path).count() == 0


def labelled_texts(spark, n=400):
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, words(i + 10, 60) + (" rubbish fool " if bad else " kind friend ") * (3 if i % 2 else 1), ("WOW!! " * 30 if bad else "") + words(i + 10, 60), int(bad), "de" if i % 2 else "en"))
    return spark.createDataFrame(rows, "doc_id long, toxic_text string, quality_text string, bad int, lang string")


def test_toxicity_has_one_learner_at_every_size(spark):
    rows = [(i, f"w{i % 7} w{i % 11}" + (" bad" if i % 5 == 0 else "") + (" rare" if i % 1000 == 0 else ""), int(i % 5 == 0)) for i in range(33_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d.select("doc_id", "toxic"), epochs=1)
    turn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30))
    known = d.where(~toxicity.held_out("doc_id", 3, 1)).select(turn.alias("turn"), "text", F.col("toxic").alias("y")).toPandas()
    known["x"] = [np.unique(np.concatenate([b for b, _ in toxicity.features([t.encode()])])).astype(np.int32).tobytes() for t in known["text"]]
    known["times"] = 1.0
    once = toxicity._learn(known, 1, 1.0, 1.0, 4.0, 0.0).sort_values("bucket")
    assert len(known) > 21_000 and once["bucket"].tolist() == [-1, *model.at.tolist()]
    assert np.allclose(once["weight"], [model.intercept, *model.weight], rtol=1e-3, atol=1e-5)


def test_toxicity(spark, docs, empty):
    t = labelled_texts(spark)
    d = t.select("doc_id", F.col("toxic_text").alias("text"))
    labels = t.select("doc_id", F.col("bad").alias("toxic")).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    out = toxicity.op5_query(d, labels).join(t.select("doc_id", "bad"), "doc_id").where("held_out").collect()
    assert len(out) > 80 and np.mean([(r.predicted == r.bad) for r in out]) > 0.95
    model = toxicity.fit(d, labels)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in odd)
    none = toxicity.op5_query(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and toxicity.score(empty, model).count() == 0


def test_quality(spark, docs, empty):
    t = labelled_texts(spark)
    d = t.select("doc_id", F.col("quality_text").alias("text"))
    labels = t.select("doc_id", (1 - F.col("bad")).alias("quality")).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    out = quality.op8_query(d, labels).join(t.select("doc_id", "bad"), "doc_id").where("held_out").collect()
    assert len(out) > 50 and np.mean([r.predicted == 1 - r.bad for r in out]) > 0.95
    none = quality.op8_query(docs, labels.where("false")).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.5} and quality.op8_query(empty, labels).count() == 0
    model = quality.fit(quality.with_statistics(d, ["doc_id"]), labels)
    assert quality.score_texts(docs, model).count() == docs.count()


def test_language(spark, docs, empty):
    rows = [(i, words(i, 40) if i % 2 else " ".join(w[::-1].upper() + "zq" for w in words(i, 40).split()), "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (902, "zz", None), (None, "abc", "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.op9_query(d).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(200))
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")
    assert language.op9_query(empty).count() == 0
    assert {r.lang_pred for r in language.op9_query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_media(docs, empty):
    got = media.op6_query(docs).collect()
    expected = []
    for d, t in pairs_of(docs):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        expected.append((str(d), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(expected)
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (5, 6)}
    assert len(same) == 1 and media.op6_query(empty).count() == 0


def test_media_index_to_seek_by(spark):
    docs = spark.createDataFrame([(1, "a" * 30_000), (2, None)], "doc_id long, text string")
    streams = media.to_media(docs)
    raw = {r.doc_id: bytes(r.media) for r in streams.collect()}
    for r in media.read_media(streams).collect():
        units = -(-r.payload_bytes // media.UNIT_BYTES)
        assert len(r.stamps) == units and r.stamps == sorted(set(r.stamps)) and len(r.random_points) == -(-units // media.RANDOM_EVERY)
        for k, n in enumerate(r.random_points):
            packet = raw[r.doc_id][media.PACKET * n :][: media.PACKET]
            t = packet[5 + packet[4] :][9:14]
            assert packet[5] & 0x40 and (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1 == r.stamps[k * media.RANDOM_EVERY]


def test_main_text_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>a", "x"), (2, None, "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(str, html_density.op7_query(pages).collect())) == sorted(["Row(page_id=1, url='u', text='', n_chars=0)"] + ["Row(page_id=2, url=None, text='a', n_chars=1)"] * 2)
    assert html_density.extract_main_text(pages).columns == ["page_id", "url", "text", "n_chars"] and html_density.op7_query(pages.where("false")).count() == 0


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in (text or "").split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_components(rows):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        both = len(x & y)
        if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {(d, len(s), root(d)) for d, s in sets}


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    r = random.Random(5)
    rows = [(i, t) for i, t in pairs_of(docs) if i is not None]
    for c in range(6):  # chains of ever further copies, and a shared passage
        w = words(100 + c, 120).split()
        for k in range(12):
            w = list(w)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            rows.append((1000 + 100 * c + k, " ".join(w + BASE.split()[:30] * (k % 2))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(x) for x in ngram_join.jaccard_components(df).collect()}
    assert got == expected_components(rows)
    odd = {(x.doc_id, x.component_id) for x in ngram_join.jaccard_components(docs).collect()}
    assert (None, None) in odd and (8, 5) in odd and (7, 5) in odd and ngram_join.jaccard_components(empty).count() == 0
    kept = sorted(x.doc_id for x in ngram_join.first_of_groups(df).collect())
    assert set(kept) == {c for _, _, c in expected_components(rows)}


@pytest.mark.parametrize("bounds", [{}, {"LEAF": 4}, {"LEAF": 2, "FAN": 2, "MOST_MEMBERS": 3, "BLOCK": 5, "MOST_PAIRS": 4}, {"MOST_MEMBERS": 8, "BLOCK": 3, "COMMON_SHARE": 0.2}])
def test_large_cells_and_hubs(monkeypatch, spark, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(ngram_join, name, value)
    base, r = words(7, 60).split(), random.Random(3)
    rows = [(i, " ".join(base[:40] + words(50 + i // 3, 25).split() + ([f"x{i}"] if i % 3 else []))) for i in range(60)]
    for family in range(3):  # families around the threshold, sizes apart, with a passage that all share
        own = words(300 + family, 90 + 10 * family).split() + base[:20]
        for k in range(25):
            w = list(own)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"m{r.randrange(10**6)}"
            rows.append((1000 + 100 * family + k, " ".join(w[: len(w) - r.randint(0, 8)])))
    rows += [(1003, " ".join(base)), (1003, " ".join(base[:59])), (2000, " ".join(base)), rows[70], rows[70]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in ngram_join.jaccard_components(df).collect()}
    assert got == {(d, c) for d, _, c in expected_components(rows)}
