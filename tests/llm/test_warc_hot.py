"""Revisits are the same whether repeated payloads are looked up apart, joined by shuffle, or both."""

import pytest

from labelworks.llm import warc


@pytest.mark.parametrize("copies,most", [(10_000, 500_000), (1, 500_000), (5, 500_000), (1, 0)])
def test_hot_payloads(spark, monkeypatch, copies, most):
    rows = [(i, f"u{i}", "same") for i in range(20)] + [(i, "u", f"twice {i // 2}") for i in range(20, 30)] + [(i, "u", f"own {i}") for i in range(30, 40)] + [(None, None, None), (41, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {i: 0 if i < 20 else i // 2 * 2 for i in range(30)}
    expected = {i: first for i, first in expected.items() if i != first}
    monkeypatch.setattr(warc, "HOT_COPIES", copies)
    monkeypatch.setattr(warc, "MOST_HOT", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = warc.op2_query(pages).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 42
    found = {r.page_id: r.refers_to for r in got if r.record_type == "revisit" and r.page_id is not None and r.page_id < 40}
    assert found == expected
