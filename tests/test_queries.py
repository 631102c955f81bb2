"""Every registered query of the reference's own operators against its SQL, and without SQL at least its rows."""

import numpy as np
import pytest

from labelworks.jobs import registry

from .compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        ours, theirs = both(spark, query, sql, SF)
        assert ours == theirs


def test_mmr_searches_all_rows(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = registry.queries()["k4_mmr"](spark, SF).collect()
    assert {r.qid for r in found} == {r.vec_id for r in e if r.vec_id % 20 == 0}
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in e}
    for q in {r.qid for r in found}:
        near = sorted(unit, key=lambda c: (-round(float(unit[q] @ unit[c]), 6), c))[:25]
        score, chosen = {c: round(float(unit[q] @ unit[c]), 6) for c in near}, near[:1]
        while len(chosen) < 5:
            chosen.append(max((c for c in near if c not in chosen), key=lambda c: score[c] - max(float(unit[c] @ unit[x]) for x in chosen)))
        assert [r.cid for r in sorted(found, key=lambda r: r.rank) if r.qid == q] == chosen


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 2
