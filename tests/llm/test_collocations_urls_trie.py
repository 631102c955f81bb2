"""Operators 11 to 13 against brute force, on small tables and on odd ones."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelworks.llm import collocations, prefix_trie, url_rules

from ..compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_stream_layout", "op12_url_expressions", "op13_burst_trie"])
def test_sql(spark, name):
    import __spark_entry__ as e

    ours, theirs = both(spark, e.queries()[name], e.oracle_sql()[name], SF)
    assert ours == theirs and ours[1]


# -- phrases -------------------------------------------------------------------------------------------------------------

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrases_by_hand(rows, least):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UP, LOW))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {q for p, a in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if (q := p[i : i + k]) in good and 100 * a >= 80 * good[q]}
        for p, a in good.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                out.add((lang, " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score))
    return out


@pytest.mark.parametrize("most_filter", [0, 1000])
def test_phrases(spark, most_filter):
    draw = random.Random(1)
    words = ["a", "B", "b", "ä", "x y", "zz\t", "q.", "r,", "\n", "İ", "it's", "n\x00l", " "]
    rows = [(draw.choice(["en", "fr", None, ""]), " ".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randrange(60)))) for _ in range(80)]
    rows += [("en", None), (None, None), ("en", ""), ("de", "one two three four five. " * 40), ("de", "w" * 5000 + " end")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, a int, phrase int").repartition(3)
    found = {tuple(r) for r in collocations.phrases(df, least=5, most_filter=most_filter).select("lang", "phrase", "a", "l", "r", "n", "score").collect()}
    assert found == phrases_by_hand(rows, 5)
    assert found


def phrase_table(spark, n):
    """n different words; of one language."""
    from pyspark.sql import functions as F

    return spark.range(n).select(F.lit("en").alias("lang"), (F.col("id") * 7919).alias("w1"))


def test_filter_reaches_the_driver_as_bytes(spark):
    n, table = 200_000, phrase_table(spark, 200_000)
    tracemalloc.start()
    try:
        keys = collocations.filter_of(table, 1, n).value
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert keys.dtype == np.uint64 and len(keys) == n and (keys[1:] > keys[:-1]).all()
    assert most < 60 * n


def test_filter_of_more_numbers_still_rules_out(spark):
    table = phrase_table(spark, 5000)
    bits = collocations.filter_of(table, 1, 4999).value
    assert bits.nbytes == 2**collocations.LOG_BITS // 8
    keys = np.array([r.key for r in collocations.keyed(table, 1).collect()], np.int64).view(np.uint64)
    assert collocations.in_bits(keys, bits).all()
    assert collocations.in_bits(np.random.default_rng(1).integers(0, 1 << 64, 100_000, np.uint64), bits).mean() < 0.001
    twice = collocations.filter_of(table.unionByName(table), 1, 10_000).value
    assert (twice == bits).all()


def test_long_words_are_not_broadcast(spark, monkeypatch):
    rows = [("en", "a b c, b a. " * 9), ("fr", "a b. " * 6 + "c d")]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "MOST_BROADCAST_BYTES", 2)
    found = {tuple(r) for r in collocations.phrases(df, least=5).select("lang", "phrase", "a", "l", "r", "n", "score").collect()}
    assert found == phrases_by_hand(rows, 5) and found


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.op11_query(none).collect() == []
    few = spark.createDataFrame([("en", "one two"), ("en", None)], "lang string, text string")
    assert collocations.op11_query(few).collect() == []


def test_phrases_rank_ties_by_bytes(spark):
    rows = [("en", "b c. a c. é c. z z."), ("en", "B C, A C, É c, Z Z")] * 30
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [(r.rank, r.phrase, r.score) for r in collocations.op11_query(df).orderBy("rank").collect()]
    assert got == [(1, "a c", 500_000), (2, "b c", 500_000), (3, "z z", 500_000), (4, "É c", 285_714), (5, "é c", 285_714)]
    assert len(collocations.op11_query(df, 2).collect()) == 2


def test_score_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(1, 2, None, None, *[big] * 7)], "w1 long, w2 long, w3 long, w4 long, f long, f1 long, fn long, in2 long, in3 long, out2 long, out3 long")
    assert df.select(collocations.best_cut().alias("b")).first().b.score == 1_000_000


# -- URL rules -----------------------------------------------------------------------------------------------------------


def judged_by_hand(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(UP, LOW))
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for h, p, v in rules:
        h, p = (h or "").translate(str.maketrans(UP, LOW)), p or ""
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), h + p, v))
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [None, "", "no scheme.com/en/", "http://", "http:///en/", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://www.example.com/en", "http://xexample.com/en/", "a://b.net/es/?q#f", "a://b.net?/es/", "a://net/fr/a://x", "x://com", "x://com/", "x://a.b.c.d.e.com/" + "y/" * 300, "x://u:p@example.com:80/en/", "x://com./", "x://" + "l." * 500 + "net/fr/", "x://exa\nmple.com/e\nn/", "x://É.com/é/", "x://shop.net/path/prefixed/more"]


@pytest.mark.parametrize("block_rules", [1, 2, 100])
def test_urls(spark, block_rules):
    rules = [*url_rules.RULES, ("net", "/path/pre", "block"), ("NET", "/path/prefix", "allow"), ("net", "/path/prefix", "block"), ("c.d.e.com", "", "block"), (None, "/", "block"), ("", "/", "block"), ("d.e.com", "/y/y/y/", "allow"), ("exam", "ple.com/", "block"), ("shop.net", None, "allow")]
    rows = [(i, u, "k", "v") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id int, url string, host string, other string")
    got = url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), block_rules=block_rules).collect()
    assert len(got) == len(rows) and {r.other for r in got} == {"v"}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judged_by_hand(u, rules) for i, u, *_ in rows}


def test_urls_without_rules_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a://b.com/")], "page_id int, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in url_rules.judge(df, none, default="block").collect()] == [(None, "block")]
    assert url_rules.op12_query(df.where("false")).collect() == []


def test_urls_use_no_python(spark):
    plan = url_rules.op12_query(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan


# -- conversation trie -----------------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in sorted(made.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in members[p] if len(made[c]) == len(p))
        out.add((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(spark, rows, **limits):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, rep int").repartition(3)
    turns = prefix_trie.known_turns(df).cache()
    found = [tuple(r) for r in prefix_trie.trie(prefix_trie.regrouped(turns), turns, **limits).collect()]
    turns.unpersist()
    assert len(found) == len(set(found))
    return set(found)


def some_conversations(seed=3):
    draw, rows = random.Random(seed), []
    for c in draw.sample(range(300), 120):
        rows += [(c, t, draw.choice(["user", "user", "bot", None]), draw.choice(["hi", "hi", "hi", "ho", "", None, "é" * 3])) for t in draw.sample(range(-3, 12), draw.randrange(1, 9))]
    same = [("user", "hi"), ("bot", "long " * 9), ("user", "end")]
    rows += [(c, t, *x) for c in range(1000, 1060) for t, x in enumerate(same)]
    rows += [(c, t, "user", "deep") for c in (2000, 2001, 2005, 2010, 2015) for t in range(40 + c % 4)]
    rows += [(None, 1, "user", "lost"), (3000, None, "user", "first"), (3000, 0, "user", "then")]
    return rows


@pytest.mark.parametrize("limits", [{}, {"limit": 1}, {"limit": 7}, {"limit": 60, "most_broadcast": 0}])
def test_trie(spark, limits):
    rows = some_conversations()
    assert trie_of(spark, rows, **limits) == trie_by_hand(rows)


def test_trie_in_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)
    rows = some_conversations(8)
    assert trie_of(spark, rows, limit=20) == trie_by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(7, 1, "a", "b")], [(6, 1, "a", "b"), (5, 1, None, None)]])
def test_trie_of_little(spark, rows):
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_query(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    want = trie_by_hand([(r.conv_id, r.turn, r.role, r.text) for r in c.collect()])
    assert {tuple(r) for r in prefix_trie.op13_query(c).collect()} == want
