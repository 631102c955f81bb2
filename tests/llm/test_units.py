"""The operators' own code without Spark: codecs, planners, kernels, against brute force."""

import gzip
import math
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelworks.llm import decontaminate, html_density, language, media, ngram_join, packing, quality, token_coder, toxicity, warc
from labelworks.llm.common import WordHasher, rolling
from labelworks.llm.tokens import WordwiseTokenizer, vocabulary_path

ODD = [None, "", " ", "  a  b ", " a", "a ", "a\n b", "a \n b", "don't  stop\t x", "é ́a b", "1 234  5\r\n\r\n  z", "x " * 50, "ς Σ ΑΣ", "<|endoftext|> hi", "a<|startoftext|>b c", "so <|endoftext|>.", "a <|endof", "a.\nB, c.", "a.\n\nB", "x.,y., z.", "a\n", "\na", "\0 a\0b", "3. 4, a_. b_, ǅa. Σσς, ß.", "一二 三", "a\tb\n\tc", "Éa. É, Ä.\nÖ", "a\u00a0b", "\u00a0", "b\u2009 c", "sixteen-bytes-or-more and more-than-sixteen,", "a\tBELEDİYESİ. x", "a\xa0b Tİ. x", "İ. İ, İ.\tİ\nİ.", "Tİ. x Tİ, y İ"]
VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")
#: The files as a user would load them, none of their switches touched.
PLAIN = {name: Tokenizer.from_file(vocabulary_path(name)) for name in VOCABULARIES}


@pytest.fixture(scope="module", params=VOCABULARIES)
def wordwise(request):
    return request.param, WordwiseTokenizer(vocabulary_path(request.param), most=50)


def same_ids(name, own, texts):
    flat, counts = own.encode(pa.array(texts, pa.string()))
    whole = [e.ids for e in PLAIN[name].encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in whole] and flat.tolist() == [i for x in whole for i in x]


def test_wordwise_tokenizer_on_odd_texts(wordwise):
    name, own = wordwise
    assert own.direct and not own.whole
    same_ids(name, own, ODD)
    same_ids(name, own, [])
    same_ids(name, own, [f"w{i} {i * i}." for i in range(3000)] * 2)


def test_files_of_another_kind_encode_whole_texts(wordwise, monkeypatch):
    name, own = wordwise
    monkeypatch.setattr(own, "whole", True)
    same_ids(name, own, ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZé.,' \n\t ́ß1_#", max_size=30), max_size=5))
def test_wordwise_tokenizer_on_any_text(texts):
    for name in VOCABULARIES:
        same_ids(name, WordwiseTokenizer(vocabulary_path(name)), texts)


def test_large_alphabets():
    ids = np.random.default_rng(0).permutation(300_000).astype(np.uint32)
    assert np.array_equal(token_coder.unpack_block(token_coder.pack_block(np.array([1]), np.array([len(ids)]), ids))[2], ids)
    with pytest.raises(ValueError):
        token_coder._Models(token_coder.MOST_ALPHABET + 1)


@pytest.mark.parametrize(("n", "k"), [(0, 5), (1, 1), (3, 2), (1000, 50000), (5000, 3), (70000, 700)])
def test_token_block_round_trip(n, k):
    ids = (np.random.default_rng(n).zipf(1.3, n) % k).astype(np.uint32)
    block = token_coder.pack_block(np.array([5, token_coder.NO_ID, 7]), np.array([n, 0, 0]), ids)
    doc_ids, counts, back = token_coder.unpack_block(block)
    assert doc_ids.tolist() == [5, token_coder.NO_ID, 7] and counts.tolist() == [n, 0, 0] and back.tolist() == ids.tolist()


def test_token_block_beats_plain_ids_and_detects_damage():
    ids = np.tile(np.arange(300, dtype=np.uint32), 100)
    block = token_coder.pack_block(np.array([1]), np.array([len(ids)]), ids)
    assert len(block) < len(ids) * 2 // 3
    broken = bytearray(block)
    broken[-40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_coder.unpack_block(bytes(broken))
    with pytest.raises(ValueError, match="not a token block"):
        token_coder.unpack_block(b"x" * 100)


def test_warc_ranges_own_each_record_once(tmp_path):
    bodies = [os.urandom(n) for n in (0, 10, 5000, 70_000, 3, 200_000)] + [gzip.compress(b"WARC/1.0 inside" * 50), b"\x1f\x8b\x08" * 2000]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc._member(warc.record(str(i), "u", b, warc.payload_digest(b), None, "d"), 1) for i, b in enumerate(bodies)))
    size = path.stat().st_size
    for step in (1000, 7919, 65_536, size + 5):
        got = [(w["x-record-key"], body) for a in range(0, size, step) for _, w, _, body in warc.records_of_range(str(path), a, a + step)]
        assert got == [(str(i), b) for i, b in enumerate(bodies)]
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_of_range(str(path), 0, size))


def brute_hits(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    wins = {}
    for i, t in enumerate(items):
        w = low(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, own = low(t), set(), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                found = wins.get(tuple(w[j : j + n]))
                if found:
                    hit |= set(range(j, j + n))
                    own |= found
        out.append((len(w), sorted(hit), own))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60).map(" ".join), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("ab"), max_size=40).map(" ".join), max_size=4))
def test_winnowing_equals_brute_force(texts, items):
    matcher = decontaminate.Matcher([(str(i), t.encode()) for i, t in enumerate(items)])
    bounds, is_hit, found = matcher.match([t.encode() for t in texts])
    for i, (size, hit, own) in enumerate(brute_hits(texts, items)):
        a, b = bounds[i : i + 2].tolist()
        assert (b - a, np.flatnonzero(is_hit[a:b]).tolist(), {int(x) for k in found[i] for x in matcher.names[k]}) == (size, hit, own)


def test_winnowing_of_texts_that_repeat_themselves():
    """Ties at length: a time that grew with both lengths' product would take minutes here."""
    items = ["w " * 3000, "a b " * 900, "a b c " * 5, *["w " * k for k in range(1, 13)], "w " * 3000, "a b a c " * 400]
    texts = ["w " * 300_000, "a b " * 2000 + "x " + "a b c " * 4, "b " * 12, "w"]
    bounds, is_hit, found = (m := decontaminate.Matcher([(str(i), t.encode()) for i, t in enumerate(items)])).match([t.encode() for t in texts])
    own = [{int(x) for k in f for x in m.names[k]} for f in found]
    assert own == [{0, *range(3, 16)}, {1}, set(), {3}]
    assert [int(is_hit[a:b].sum()) for a, b in zip(bounds, bounds[1:])] == [300_000, 4000, 0, 1]
    small = ["a b " * 30 + "a b c " * 9, "a b a c " * 20, "w " * 40]
    for i, (size, hit, names) in enumerate(brute_hits(small, items)):
        bounds, is_hit, found = m.match([small[i].encode()])
        assert (int(bounds[1]), np.flatnonzero(is_hit).tolist(), {int(x) for k in found[0] for x in m.names[k]}) == (size, hit, names)


def test_winnowing_of_an_item_split_over_neighbours():
    words = [f"w{i}" for i in range(75)]
    texts = ["a b c " + " ".join(words[:30]), " ".join(words[30:60]), " ".join(words[60:]) + " d"]
    bounds, is_hit, found = decontaminate.Matcher([("i", " ".join(words).encode())]).match([t.encode() for t in texts])
    assert np.diff(bounds).tolist() == [33, 30, 16] and found == [[0], [0], [0]]
    assert np.flatnonzero(~is_hit).tolist() == [0, 1, 2, 78]


def test_word_hashes_depend_on_words_alone(monkeypatch):
    texts = [b"one two, ONE", b"", "é one".encode(), b"two"]
    h, owner, starts, ends = WordHasher(decontaminate.word_bytes())(texts)
    assert owner.tolist() == [0, 0, 0, 2, 2, 3] and h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3
    monkeypatch.setattr("labelworks.llm.common.STEP_BYTES", 4)
    assert WordHasher(decontaminate.word_bytes())(texts)[0].tolist() == h.tolist()
    assert len(rolling(h, 7)) == 0


def check_plan(histogram, runs, n):
    content = {}
    for length, first, count, offset in runs:
        for i in range(first, first + count):
            content.setdefault(i, []).append((offset, length))
    counts = {}
    for places in content.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
            counts[length] = counts.get(length, 0) + 1
        assert end <= 2048
    assert counts == {s: k for s, k in histogram.items() if k} and len(content) == n


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 30), max_size=25), st.sampled_from([(24, 1 / 6), (3, 1 / 3), (1, 1.0)]))
def test_plans_place_every_piece(histogram, how):
    check_plan(histogram, *packing.plan(histogram, 2048, *how)[:2])


def test_plan_is_near_the_floor():
    x = np.minimum(2048, np.random.default_rng(1).lognormal(6, 1, 20_000).astype(int) + 1)
    h = {int(a): int(b) for a, b in zip(*np.unique(x, return_counts=True), strict=True)}
    runs, n, opened = packing.best_plan(h)
    check_plan(h, runs, n)
    assert n <= -(-int(x.sum()) // 2048) + 2
    # Configurations of rounded lengths have made the plan: all but the whole pieces and a few for the small ones.
    large = sum(k for s, k in h.items() if 2048 / 3 < s < 2048)
    assert opened > large / 3 and len({s for s, first, _, _ in runs if h.get(2048, 0) <= first < h.get(2048, 0) + opened and s > 2048 / 3}) > 100


def test_groups_are_of_equal_cardinality():
    stock = {int(s): int(n) for s, n in zip(range(700, 2000), np.random.default_rng(0).integers(0, 9, 1300), strict=True)}
    sizes, demand = packing.group_sizes(stock, 12)
    assert len(sizes) == 12 and sizes[0] == max(s for s, n in stock.items() if n) and demand.sum() == sum(stock.values())
    assert demand[:-1].max() - demand[:-1].min() < 9


def test_configurations_fit_and_cover():
    sizes, demand = np.array([1000, 700, 400]), np.array([50, 60, 70])
    used = np.zeros(3, int)
    for column, times in packing.configurations(sizes, demand, 2048):
        assert (column * sizes).sum() <= 2048
        used += column * times
    assert (used <= demand).all() and used.sum() >= demand.sum() - 9


@pytest.mark.parametrize("n", [64, 128, 192, 4096, 4160, 8192, 100_032])
def test_transport_stream_round_trip(n):
    payload = os.urandom(n)
    stream = media.encode_stream(payload)
    got = media.decode_stream(stream)
    assert len(stream) % 188 == 0 and got.payload == payload and len(got.stamps) == -(-n // 4096) and got.stamps == sorted(got.stamps)
    assert len(got.random_points) == -(-len(got.stamps) // 4)
    assert media.encode_stream(payload) == stream


def test_transport_stream_damage():
    stream = media.encode_stream(os.urandom(8192))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    for broken in (packets[:5] + packets[6:], packets[:5] + packets[4:], [packets[0][:10] + b"\xee" + packets[0][11:], *packets[1:]], [b"\0" + packets[0][1:], *packets[1:]], packets[:1]):
        with pytest.raises(ValueError):
            media.decode_stream(b"".join(broken))
    with pytest.raises(ValueError):
        media.decode_stream(b"")


def page(body):
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(("given", "text"), [
    ("", ""), (None, ""), ("no tags &amp; all", "no tags & all"),
    (page("<nav><a href=/x>menu</a></nav><article><h1>A  b</h1><p>One <b>two</i> &lt;3.<p>Four<br>five</article><footer>f</footer>"), "A b\n\nOne two <3.\n\nFour five"),
    (page("<header>site</header><div class='side-bar'>s</div><main><h1>T</h1><p>Some text of an article that goes on.</p><div id=comments><p>rude</p></div></main><form>x</form>"), "T\n\nSome text of an article that goes on."),
    (page("<div class=ad>Buy</div><article><ul><li>a<li>b</ul><p>Long enough text for a paragraph.</p></article>"), "a\n\nb\n\nLong enough text for a paragraph."),
])
def test_main_text(given, text):
    assert html_density.main_text(given) == text


def words(n, of="abcd "):
    return (of * n)[:n].strip()


@pytest.mark.parametrize(("given", "lost", "kept"), [
    # Two wrappers side by side, of equal and of unequal size.
    ("<section>" + f"<p>{words(99, 'left ')}</p>" * 4 + "</section><section>" + f"<p>{words(99, 'right ')}</p>" * 4 + "</section>", (), ("left", "right")),
    ("<ul><li><a href=x>elsewhere</a></li><li><a href=y>elsewhere</a></li></ul><div>" + f"<p>{words(99, 'left ')}</p>" * 3 + "</div><div>" + f"<p>{words(120, 'right ')}</p>" * 7 + "</div>", ("elsewhere",), ("left", "right")),
    # A heading beside the content.
    ("<div><a href=x>elsewhere</a></div><article><h1>Title</h1><div>" + f"<p>{words(99, 'text ')}</p>" * 6 + "</div></article>", ("elsewhere",), ("Title", "text")),
    ("<div><a href=x>elsewhere</a></div><main><h1>Title</h1><div>" + f"<p>{words(99, 'text ')}</p>" * 6 + "</div></main>", ("elsewhere",), ("Title", "text")),
    # Names of furniture that main text goes by as well: density and links decide.
    (f"<article><section class=results><p>{words(60, 'found ')}</p></section><section class=discussion><p>{words(60, 'talk ')}</p><p>{words(70, 'talk ')}</p></section></article>", (), ("found", "talk")),
    (f"<div class=facts><p>{words(60, 'fact ')}</p></div><div class=legal><p>{words(60, 'law ')}</p></div>", (), ("fact", "law")),
    (f"<article><p>{words(99, 'text ')}</p><div class=share-price><p>{words(120, 'price ')}</p></div><div class='social share'>Press</div><div class='comments discussion'><p>{words(60, 'rude ')}</p></div></article>", ("rude", "Press"), ("text", "price")),
    # A chapter's id inside an article, and furniture of the same name outside.
    (f"<div id=discussion><p>{words(99, 'rude ')}</p></div><article><p>{words(99, 'text ')}</p><section id=discussion><p>{words(99, 'chapter ')}</p></section><div id=reader-comments><p>{words(99, 'rude ')}</p></div></article>", ("rude",), ("text", "chapter")),
])
def test_main_text_in_several_places(given, lost, kept):
    text, whole = html_density.main_text(page(given)), re.sub("<[^>]*>", " ", given)
    assert {w: text.count(w) for w in (*kept, *lost)} == {w: whole.count(w) for w in kept} | dict.fromkeys(lost, 0)


def cells_of(spark, members, probes):
    point = ngram_join.pack_points(np.bincount([1, 2, 3], minlength=64))
    df = spark.range(members).select(F.lit(1).alias("kind"), F.lit(7).cast("long").alias("token"), "id", F.lit(3).alias("n"), F.col("id").alias("component"), (F.col("id") < probes).alias("probe"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("before"))
    return df.withColumns({"members": F.lit(members).cast("long"), "probes": F.lit(probes).cast("long"), "points": F.lit(bytes(point))})


@pytest.mark.parametrize("members, probes, most", [(40_000, 1, 81_000), (40_000, 3000, 280_000), (2000, 1, 4000)])
def test_rows_of_a_large_cell(spark, members, probes, most):
    """A row is dealt for two classes of sizes; one probe costs the others no further rows."""
    assert ngram_join._dealt(cells_of(spark, members, probes)).count() <= most


@pytest.mark.parametrize("block", [3, 7, 100])
def test_probes_of_a_large_cell_meet_all(monkeypatch, spark, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    for probes in (1, 4, 20, 30):
        got = {(r.a, r.b) for r in ngram_join._tree_pairs(cells_of(spark, 30, probes)).collect()}
        assert got == {(i, j) for i in range(30) for j in range(i + 1, 30) if i < probes}


@pytest.mark.parametrize("low, high, n", [(1, 2048, 20_000), (900, 1200, 9000), (300, 1500, 400), (600, 800, 9000), (450, 600, 9000), (300, 420, 9000)])
def test_plans_need_no_more_sequences_than_best_fit(low, high, n):
    lengths, counts = np.unique(np.random.default_rng(0).integers(low, high + 1, n), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    plain = packing._Bins(2048)
    for s in sorted(histogram, reverse=True):
        plain.best_fit(s, histogram[s])
    runs, found, _ = packing.best_plan(histogram)
    check_plan(histogram, runs, found)
    assert found <= plain.count


def test_deep_pages_do_not_overflow():
    assert html_density.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"


@pytest.mark.parametrize("most", [1, 10_000])
def test_large_cells_meet_their_state_in_place(monkeypatch, spark, most):
    rows = spark.range(60).select(F.when(F.col("id") < 40, 1).otherwise(F.col("id")).cast("long").alias("token"), "id")
    state = rows.groupBy("token").agg(F.count("*").alias("rows"), F.max("id").alias("m"))
    monkeypatch.setattr(ngram_join, "MOST_CELL_ROWS", most)
    found = ngram_join._with_state(rows, state).select("token", "id", "rows", "m").collect()
    assert sorted(map(tuple, found)) == [(1, i, 40, 39) for i in range(40)] + [(i, i, 1, i) for i in range(40, 60)]


def test_common_shingles_are_bounded(spark):
    texts = [f"a b c d e{' f' if i < 100 else ''}{' g' if i < 40 else ''} {i}" for i in range(160)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    seen = [ngram_join.common_shingles(documents, most=m).tolist() for m in (10, 2, 1, 0)]
    # Seen 160, 100 and 40 times: the least count is 20, then 40, 80, 160 and beyond.
    assert [len(s) for s in seen] == [3, 2, 1, 0] and set(seen[2]) < set(seen[1]) < set(seen[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=40), min_size=2, max_size=60))
def test_count_tree_loses_no_link(token_lists):
    sets = [np.unique(np.array(t) * 7919 % 64) for t in token_lists]
    points = np.array([np.bincount(s % 64, minlength=64) for s in sets], np.int32)
    sizes = points.sum(1)
    found = {(min(p), max(p)) for i, j in ngram_join.CountTree(points, sizes).row_pairs() for p in zip(i.tolist(), j.tolist(), strict=True)}
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            both = len(np.intersect1d(s, t))
            if 100 * both >= 80 * (len(s) + len(t) - both):
                assert (j, i) in found


def test_fine_counts_bound_the_overlap():
    rng = np.random.default_rng(2)
    for n in (10, 600, 5000):
        a = np.unique(rng.integers(0, 1 << 40, n))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 40, n // 3)]))
        packed = [ngram_join.pack_points(np.bincount(s & (ngram_join.fine_groups(len(s)) - 1), minlength=ngram_join.fine_groups(len(s)))) for s in (a, b)]
        assert ngram_join.fine_overlap(packed[0], len(a), packed[1], len(b)) >= len(np.intersect1d(a, b))
    wide = [np.full(64, v) for v in (3, 300, 70_000)]
    assert ngram_join.unpack_points([ngram_join.pack_points(w) for w in wide]).tolist() == [w.tolist() for w in wide]


def test_isotonic_is_monotone():
    got = quality.isotonic(np.array([1.0, 0, 2, 1, 5]), np.array([2.0, 1, 2, 4, 5]))
    assert (np.diff(got) >= -1e-12).all() and got[-1] == 1 and len(got) == 5
    assert len(quality.isotonic(np.empty(0), np.empty(0))) == 0


def test_statistics_of_odd_texts():
    rows = quality.statistics([b"", b" \n ", b"a", b"word " * 30, "É!".encode()])
    assert np.isfinite(rows).all() and not rows[0].any()


def test_ngram_vectors_are_bound_and_permuted():
    e = language.Encoder()
    assert len(e.codes("12 !")) == 0 and e.codes("Ab").tolist() == e.codes(" ab. ").tolist()
    ab, ba = e.vectors(np.unique(e.codes("ab")))[0], e.vectors(np.unique(e.codes("ba")))[0]
    assert set(np.unique(ab)) == {-1.0, 1.0} and abs(float(ab @ ba)) < 0.3 * language.D
    assert np.array_equal(e.bundle(e.codes("abab")), e.bundle(e.codes("ABAB")))


def test_features_stay_inside_texts():
    one = {tuple(sorted(b.tolist())) for b, _ in toxicity.features([b"a b", b"c d"])}
    two = {tuple(sorted(b.tolist())) for b, _ in toxicity.features([b"c d", b"a b"])}
    assert one == two and sum(len(b) for b, _ in toxicity.features([b"a b", b"c d"])) == 6


STORY = "".join(f"<p>{'Plain words of a story that goes on. ' * 35}{i}</p>" for i in range(4))


@pytest.mark.parametrize("name", ["post comments-open", "legal-article", "layout no-sidebar", "story social", "notice-of-meeting", "has-menu"])
def test_names_are_no_more_than_a_weight(name):
    page = f'<div class="menu"><a href=x>Home</a></div><div class="{name}"><h1>Title</h1>{STORY}</div><div class="sidebar"><p>Short note aside.</p></div><div id=comments><p>{"I like this. " * 20}</p></div>'
    got = html_density.main_text(page)
    assert got.startswith("Title\n\nPlain words") and got.endswith("3") and "aside" not in got and "I like" not in got and "Home" not in got


def test_page_inside_a_form():
    got = html_density.main_text(f'<body><form action=x><div><a href=q>Log in</a></div><div>{STORY}</div><input name=q><button>Send</button></form><form class=f>Your mail <input></form></body>')
    assert got.count("\n\n") == 3 and "Send" not in got and "mail" not in got and "Log in" not in got


@pytest.mark.parametrize("bad", ['<a "', "<b>", "</i>", '<a "x>y" ', "<!", "<p>", "<li>", "<", "<a <", "<b><hr>"])
def test_hostile_pages_take_linear_time(bad):
    began = time.process_time()
    html_density.main_text(bad * 30_000 + "text")
    assert time.process_time() - began < 15
    assert "text" in html_density.main_text("<p>some text</p><a href=\"x>y</a> more text") and html_density.main_text("a < b <c") == "a < b <c"


TREES = st.recursive(st.text("ab ", max_size=12), lambda kids: st.tuples(st.sampled_from(["div", "p", "a", "span", "section"]), st.lists(kids, max_size=4)), max_leaves=12)


def slow_density(tree, share):
    """(chars, tags, link chars, link tags, density) of a node by the definition, one node at a time."""
    def text(t):
        return len(t.strip()) if isinstance(t, str) else sum(map(text, t[1]))

    def count(t, name=None):
        return 0 if isinstance(t, str) else sum((not isinstance(k, str) and name in (None, k[0])) + count(k, name) for k in t[1])

    def linked(t):
        return 0 if isinstance(t, str) else text(t) if t[0] == "a" else sum(map(linked, t[1]))

    chars, tags, link_chars = text(tree), count(tree), linked(tree)
    link_tags = count(tree, "a") + (tree[0] == "a")
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(math.e - 1 + ratio) / max(math.log(base), 1.0)


@settings(max_examples=150, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=4))
def test_densities_equal_the_definition(kids):
    def node(t, parent):
        if isinstance(t, str):
            return t
        n = html_density.Node(t[0], parent, False)
        n.kids = [node(k, n) for k in t[1]]
        return n

    def same(n, t):
        assert n.density == pytest.approx(slow_density(t, share))
        own = sum(k.density for k in n.kids if not isinstance(k, str))
        assert n.total == pytest.approx(own + (n.density if any(isinstance(k, str) and k.strip() for k in n.kids) else 0))
        for a, b in zip(n.kids, t[1], strict=True):
            if not isinstance(a, str):
                same(a, b)

    tree = ("body", kids)
    body = html_density.measure(node(tree, None))
    share = body.link_chars / body.chars if body.chars else 0.0
    same(body, tree)
