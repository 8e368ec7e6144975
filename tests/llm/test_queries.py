"""The text queries against their SQL; those without SQL run."""

from pathlib import Path

import pytest

from tests.oracle import FOLDER, assert_same, connection

LARGE = "/root/testdata/sf0.1"
queries = pytest.importorskip("tripleloom.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name])


ROWS = {
    "p8_ids": "SELECT doc_id FROM documents",
    "p9_mixed": "SELECT DISTINCT doc_id FROM documents SEMI JOIN mix_targets USING (source)",  # at most
    "p9_shares": "SELECT source FROM mix_targets",
    "p9_larger_shares": "SELECT source FROM mix_targets",
    "p10_found": "SELECT doc_id FROM documents",  # at most
    "p10_shares": "SELECT doc_id FROM documents",
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows_are_those_of_the_tables(spark, name):
    """What SQL can say of the queries it can't express: which rows they may have, and which they must."""
    df = queries.QUERIES[name](spark, FOLDER)
    got, want = {r[0] for r in df.collect()}, {r[0] for r in connection().execute(ROWS[name]).fetchall()}
    assert got and (got < want if name in ("p9_mixed", "p10_found") else got == want)


def test_shares_are_near_their_targets(spark):
    """On the largest test tables, where single documents weigh little."""
    if not Path(LARGE).exists():
        pytest.skip("no larger test data")
    shares = [r.asDict() for r in queries.QUERIES["p9_shares"](spark, LARGE).collect()]
    there = sum(r["target_share"] for r in shares if r["source_tokens"])
    for r in shares:
        if r["source_tokens"]:
            assert r["actual_share"] == pytest.approx(r["target_share"] / there, rel=0.05)
            assert r["rate"] <= r["max_repeats"]
    larger = [r.asDict() for r in queries.QUERIES["p9_larger_shares"](spark, LARGE).collect()]
    assert any(r["capped"] and r["source_tokens"] for r in larger)
    assert all(r["mixed_tokens"] == r["max_repeats"] * r["source_tokens"] for r in larger if r["capped"])
