"""The pipeline against its stages' brute-force versions on a small table."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from labelworks.llm import entry
from tests.llm.test_operators import expected_components

SF = "/root/testdata/sf0.001"


def test_names_and_registration():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert names == list(entry.queries()) and len(names) == 13 and "pipeline" in e.queries()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns and 0 < out.count() <= docs.count()
        if name == "near_duplicates":
            found = expected_components([(r.doc_id, r.text) for r in docs.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in found})
        docs = out
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Documents with nulls, empty and long texts, repeated rows and columns named as the operators' results."""
    r = random.Random(1)
    texts = [None, "", " ", "42 !!", " ".join(f"word{r.randrange(3000)}" for _ in range(20_000))] + [" ".join(f"plain{r.randrange(900)}" for _ in range(90)) for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i}", "a", "b", "c", None, "d", "e", i, "g") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, texts[7], None, *["x"] * 7, None, "y"), (None, None, None, *[None] * 9)]
    schema = "doc_id long, text string, lang string, score string, predicted string, lang_pred string, n_words string, contaminated string, stats string, row string, n_hit long, component_id string"
    folder = tmp_path_factory.mktemp("clashing")
    spark.createDataFrame([(i, i % 2) for i in range(5, 17)], "doc_id long, quality int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame([("b1", texts[8]), ("b2", texts[8]), (None, None)], "item_id string, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return spark.createDataFrame(rows, schema), f"file://{folder}"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_rows_and_columns_as_they_are(spark, clashing, stage):
    docs, folder = clashing
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    given, kept = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
    assert kept and not kept - given
    if stage is corpus_pipeline.without_benchmark:
        assert given - kept == Counter({k: n for k, n in given.items() if k[0] == 8})
    if stage is corpus_pipeline.without_copies:  # the null id's text is another row's, but it has no id to go by
        assert kept == given
    if stage is corpus_pipeline.known_language:
        assert not {0, 1, 2, 3} & {k[0] for k in kept}
    assert stage(spark, docs.limit(0), folder).count() == 0
