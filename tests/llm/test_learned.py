"""The learned operators against plain versions of their definitions, without the library's hashing, batches and sums."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelworks.llm import language, quality, toxicity
from labelworks.llm.common import held_out


def texts(seed, n, vocabulary):
    r = random.Random(seed)
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 12))) for _ in range(n)]


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """FTRL-proximal by dictionaries over words, pairs and skip-pairs themselves; rows of text, label, weight."""
    z, n = {}, {}

    def keys(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return {None, *w, *zip(w, w[1:]), *((a, "skip", b) for a, b in zip(w, w[2:]))}

    def weight(k):
        s = z.get(k, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n[k])) / alpha + l2)

    def score(text):
        return 1 / (1 + math.exp(-sum(map(weight, keys(text)))))

    for _ in range(epochs):
        for text, y, times in rows:
            g, now = times * (score(text) - y), {k: weight(k) for k in keys(text)}
            for k, w in now.items():
                was = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * w
                n[k] = was + g * g
    return score


def test_toxicity_equals_plain_ftrl(spark):
    own = texts(1, 120, ["bad", "Good", "so", "so", "it", "is", "rude", "kind"])
    rows = [(i, t, int("bad" in t or "rude it" in t)) for i, t in enumerate(own)]
    d = spark.createDataFrame([*rows, rows[4], rows[4], (None, "bad", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(rows, "doc_id long, t string, toxic int").select("doc_id", "toxic")
    how = dict(epochs=3, alpha=0.7, beta=1.0, l1=0.3, l2=0.1)
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, labels, **how)).collect()}
    turn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    order = [r.doc_id for r in labels.where(~held_out("doc_id", 3, 1)).orderBy(turn).collect()]
    score = plain_ftrl([(own[i], rows[i][2], 3 if i == 4 else 1) for i in order], **how)
    assert len(order) > 60 and max(got[i] for i in order) > 0.6 > 0.4 > min(got[i] for i in order)
    assert [got[i] for i in range(120)] == pytest.approx([score(t) for t in own], abs=1e-5)


def test_toxicity_bounds_rows_and_bytes(spark):
    d = spark.range(5000).select((F.col("id") % 50 * F.lit(20_000_000) + F.col("id") % 7).alias("place"), F.lit(10).cast("long").alias("size"))
    for most_rows, most_bytes in ((10**9, 10**9), (3000, 10**9), (10**9, 20_000), (150, 10**9), (20, 10**9), (1, 1)):
        got = toxicity.within(d, "place", "size", most_rows, most_bytes)
        n, places = got.count(), {r.place for r in got.collect()}
        fits = n <= most_rows and 10 * n <= most_bytes
        assert n > 0 and (fits or len(places) == 1)
        assert d.where(~F.col("place").isin(*places)).where(F.col("place") < max(places)).count() == 0
        assert n == 5000 or n + 5000 / 50 + 1 > min(most_rows, most_bytes / 10) or len(places) == 1
    assert toxicity.within(d.where("false"), "place", "size", 1, 1).count() == 0
    many = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit(1).alias("toxic"))
    model = toxicity.fit(many.union(many), many.select("doc_id", "toxic"), kept_out=9, most_rows=100, l1=0.0)
    assert 0 < len(model.at) <= 100


def plain_statistics(t):
    """The statistics of one text by their definitions."""
    if not t:
        return [0.0] * len(quality.STATS)
    b, w = t.encode(), re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
    share = lambda kind: sum(c in kind for c in b) / len(b)
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b".,;:'\"()?-", b"#$%&*@^~_=+<>{}[]\\/`", b"|", b"!", bytes(range(128, 256))]
    lines, sizes, ends = b.split(b"\n"), [len(x) for x in w], sum(c in b".?!" for c in b)
    same = lambda s: sum(x == y for x, y in zip(w, w[s:])) / (len(w) - s) if len(w) > s else 0.0
    return [
        math.log1p(len(b)), math.log1p(len(w)), np.mean(sizes) if w else 0, np.std(sizes) if w else 0, *map(share, kinds), len(set(w)) / len(w) ** 0.9 if w else 0,
        max(map(w.count, w)) / len(w) if w else 0, same(1), math.log1p(len(lines) - 1), len(set(lines)) / len(lines), math.log1p(len(w) / (1 + ends)) if w else 0,
        max(map(same, (2, 3, 4, 5, 6, 8))), np.mean([x[-1] in b"#$%&*!|" for x in w]) if w else 0,
    ]


def test_statistics_equal_their_definitions():
    own = ["", " \n ", "a", "Ab ab, ab! 12\nAb ab, ab! 12\n", "é ü É", "x y x y x y | {z} #1 #1"] + texts(3, 40, ["Ab", "c.", "\n", "d!", "1|2", "é", "ab", "ab"])
    assert np.allclose(quality.statistics([t.encode() for t in own]), [plain_statistics(t) for t in own])


def test_quality_solves_the_normal_equations_of_a_gaussian_kernel(spark):
    own = texts(5, 300, ["good", "Words.", "spam!!", "1|2", "\n", "a", "longer-words", "é"])
    rows = [(i, t, None if i % 9 == 0 else int("spam" not in t)) for i, t in enumerate(own)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(7)
    model = quality.fit(quality.with_statistics(d, ["doc_id"]), d.select("doc_id", "quality"), features=200, ridge=0.5)
    known = [i for i, in d.where("quality is not null").where(~held_out("doc_id", 5, 0)).select("doc_id").collect()]
    stats, y = np.array([plain_statistics(own[i]) for i in known]), np.array([rows[i][2] for i in known], float)
    x = np.clip((stats - stats.mean(0)) / np.maximum(stats.std(0), 1e-6), -6, 6)
    z = np.column_stack([np.sqrt(2 / 200) * np.cos(x @ model.omega + model.phase), np.ones(len(x))])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + 0.5 * np.eye(201), z.T @ y), atol=1e-6)
    distance = ((x[:, None] - x[None]) ** 2).sum(2)
    error = lambda bandwidth: np.abs(z[:, :-1] @ z[:, :-1].T - np.exp(-distance / bandwidth**2)).mean()
    assert error(6) < 0.1 and error(6) < min(error(4), error(9))  # 200 features are right to about 1 / sqrt(200)
    bins = np.clip(np.floor(z @ model.weights * 256), -256, 511)
    own_bins = np.unique(bins)
    n, s = (np.array([f(y[bins == b]) for b in own_bins]) for f in (len, np.sum))
    mean = lambda j, k: s[j : k + 1].sum() / n[j : k + 1].sum()
    levels = [max(min(mean(j, k) for k in range(i, len(n))) for j in range(i + 1)) for i in range(len(n))]
    assert np.allclose(model.knots, (own_bins + 0.5) / 256) and np.allclose(model.levels, levels)


def test_language_equals_plain_profiles(spark, monkeypatch):
    own = texts(7, 40, ["der", "und", "Haus"]) + texts(8, 40, ["the", "and", "house"]) + texts(9, 40, ["é", "ça", "маma", "日本 x", "1 2"])
    rows = [(i, t, ["de", "en", "xx"][i // 40]) for i, t in enumerate(own)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    e = language.Encoder()

    def vector(text):
        x = [e._class(ord(c.lower()[0])) if c.isalpha() else 0 for c in f" {text} "]
        x = [c for i, c in enumerate(x) if c or not i or x[i - 1]]
        if not any(x):
            return None
        grams = [np.prod([np.roll(e.letters[c].astype(float), 2 - k) for k, c in enumerate(x[i : i + 3])], axis=0) for i in range(len(x) - 2)]
        return np.sum(grams, axis=0)

    known = {r.doc_id for r in d.where(~held_out("doc_id", 5, 0)).collect()}
    sums = {k: np.sum([v for i, t, lang in rows if lang == k and i in known and (v := vector(t)) is not None], axis=0) for k in ("de", "en", "xx")}
    unit = lambda v: v / np.linalg.norm(v)
    expected = {}
    for i, t, _ in rows:
        v = vector(t)
        near = {} if v is None else {k: float(unit(v) @ unit(p)) for k, p in sums.items()}
        name = max(sorted(near), key=near.get, default="und")
        expected[i] = name, (near[name] + 1) / 2 if near else 0.0
    for most in (4096, 1):
        monkeypatch.setattr(language, "MOST_LANGUAGES", most)
        profiles = language.fit(d)
        got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(d, profiles).collect()}
        assert profiles.blocks == (1 if most > 1 else 3)
        assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in expected.items()}
        assert all(got[i][1] == pytest.approx(expected[i][1], abs=1e-6) for i in got)
