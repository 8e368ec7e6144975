"""Every query of the core against its SQL on the smallest tables."""

import pytest

from tests.oracle import FOLDER, assert_same
from tripleloom.plans import load_all
from tripleloom.plans.registry import QUERIES, SQL

load_all()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


def test_only_tree_search_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"t12_tree_search_paths"}


def test_searched_paths_are_paths_of_the_graph(spark):
    edges = {(r["qid"], f"{r['h']}-[{r['r']}]->{r['t']}") for r in QUERIES["g01_last_wins"](spark, FOLDER).collect()}
    rows = QUERIES["t12_tree_search_paths"](spark, FOLDER).collect()
    lengths = {(r["qid"], r["s"], r["t"]): r["hops"] for r in QUERIES["t12_tree_search_lengths"](spark, FOLDER).collect()}
    assert len(rows) == len(lengths) > 0
    for r in rows:
        steps = r["path"].split(" ; ")
        assert all((r["qid"], step) in edges for step in steps)
        assert steps[0].startswith(r["s"] + "-[") and steps[-1].endswith("]->" + r["t"])
        assert all(a.split("]->")[1] == b.split("-[")[0] for a, b in zip(steps, steps[1:]))
        assert len(steps) == lengths[r["qid"], r["s"], r["t"]]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
