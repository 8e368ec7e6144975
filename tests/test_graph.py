import pytest

from tripleloom.operators import graph as G
from tripleloom.operators import shortest, walks
from tripleloom.operators.walks import QuestionGraph

ROW = "row_id long, q_entity array<string>, a_entity array<string>, graph array<struct<h:string,r:string,t:string>>, path string, rule array<string>"


def rows(spark, *graphs, starts=("A",), ends=("D",), rule=None):
    return spark.createDataFrame([(i, list(starts), list(ends), g, "x", rule) for i, g in enumerate(graphs)], ROW)


def texts(df):
    return sorted(" ; ".join(f"{s['h']}-{s['r']}->{s['t']}" for s in r["path"]) for r in df.collect())


CHAIN = [("A", "r1", "B"), ("B", "r2", "C"), ("A", "r3", "C"), ("C", "r4", "D")]
DIAMOND = [("A", "a", "B"), ("A", "b", "C"), ("B", "c", "D"), ("C", "d", "D")]


def test_walks_of_chain_and_branch(spark):
    df = rows(spark, CHAIN)
    assert texts(walks.walks(df, 2)) == ["A-r1->B", "A-r1->B ; B-r2->C", "A-r3->C", "A-r3->C ; C-r4->D"]
    edges = G.last_wins(G.triples(df, "row_id"))
    starts = spark.createDataFrame([(0, "A")], "qid long, at string")
    assert texts(G.joined_walks(edges, starts, 2)) == texts(walks.walks(df, 2))


def test_last_wins_directed_and_undirected(spark):
    assert texts(walks.walks(rows(spark, [("A", "r1", "B"), ("A", "r9", "B")]), 1)) == ["A-r9->B"]
    both = rows(spark, [("A", "r1", "B"), ("B", "r2", "A")])
    assert sorted((r["h"], r["r"], r["t"]) for r in walks.edges(both, undirected=True).collect()) == [("A", "r2", "B"), ("B", "r2", "A")]
    assert sorted((r["h"], r["r"], r["t"]) for r in G.last_wins_undirected(G.triples(both, "row_id")).collect()) == [("A", "r2", "B"), ("B", "r2", "A")]


def test_cycles_loops_and_duplicate_starts(spark):
    cycle = [("A", "r", "B"), ("B", "r", "A")]
    assert walks.walks(rows(spark, cycle), 3).count() == 3
    assert walks.simple_paths(rows(spark, cycle, ends=("A", "B")), 3).count() == 1
    assert texts(walks.edges(rows(spark, [("A", "r", "A")])).selectExpr("array(struct(h, r, t)) AS path")) == ["A-r->A"]
    twice = walks.walks(rows(spark, CHAIN, starts=("A", "A")), 1)
    assert (twice.count(), twice.distinct().count()) == (4, 2)


def test_truth_paths(spark):
    found = walks.truth_paths(rows(spark, DIAMOND))
    assert texts(found) == ["A-a->B ; B-c->D", "A-b->C ; C-d->D"]
    assert texts(walks.truth_paths(rows(spark, CHAIN, ends=("A", "Z")))) == [""]
    assert walks.truth_paths(rows(spark, CHAIN, starts=("Z",))).count() == 0
    line = [(str(i), "r", str(i + 1)) for i in range(60)]
    assert len(walks.truth_paths(rows(spark, line, starts=("0",), ends=("60",))).first()["path"]) == 60


def test_malformed_and_missing_graphs(spark):
    df = rows(spark, [("A", None, "B"), ("A", " ", "B"), (" A ", "r", "B\n"), None], None, [], starts=("A ", "", None))
    assert texts(walks.walks(df, 2)) == ["A-r->B"]
    assert walks.walks(df.limit(0), 2).count() == 0
    assert sorted((r["seq"], r["h"]) for r in G.triples(df, "row_id").collect()) == [(2, "A")]


def test_rule_walks(spark):
    assert texts(walks.rule_walks(rows(spark, CHAIN, rule=["r3", "r4"]), "rule")) == ["A-r3->C ; C-r4->D"]
    assert texts(walks.rule_walks(rows(spark, CHAIN, rule=[]), "rule")) == [""]
    assert walks.rule_walks(rows(spark, CHAIN, rule=["r1", "r9"]), "rule").count() == 0


def test_random_and_searched_paths_are_reproducible_and_continuous(spark):
    df = rows(spark, DIAMOND, CHAIN)
    one, two = (sorted(map(str, walks.random_walks(df, 3, 2, "s").collect())) for _ in range(2))
    assert one == two
    found = walks.searched_paths(df, iterations=30).collect()
    assert len(found) == 2 and str(found) == str(walks.searched_paths(df, iterations=30).collect())
    for r in found:
        assert r["path"][0]["h"] == "A" and r["path"][-1]["t"] == "D"
        assert all(a["t"] == b["h"] for a, b in zip(r["path"], r["path"][1:]))


def test_leaf_paths():
    g = QuestionGraph([("A", "r", "B"), ("B", "s", "A"), ("B", "t", "C")])
    assert list(g.leaves(["A"], 6)) == [(("A", "r", "B"), ("B", "s", "A")), (("A", "r", "B"), ("B", "t", "C"))]
    assert list(g.leaves(["A"], 1)) == [(("A", "r", "B"),)]


def test_mediators_collapse(spark):
    kg = spark.createDataFrame([("X", "a", "m.1"), ("m.1", "b", "Y"), ("m.1", "c", "X"), ("m.1", "d", "m.2"), ("m.2", "e", "Z"), ("X", "f", "Y"), ("X", "a-b", "Y")], "h string, r string, t string")
    assert sorted(tuple(r) for r in G.knowledge_graph(kg.where("r <> 'a-b'")).collect()) == [("X", "a-b", "Y"), ("X", "f", "Y")]
    made = {tuple(r)[:3]: r["created"] for r in G.collapse_mediators(kg).collect()}
    assert made["X", "a-b", "Y"] is False and made["X", "a-c", "X"] is True
    stats = G.graph_stats(kg, G.knowledge_graph(kg)).first()
    assert tuple(stats) == (3, 2, 2)


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_shortest_paths_equal_brute_force(spark, depth):
    import random
    from itertools import product

    rng = random.Random(depth)
    edges = {(f"n{rng.randrange(9)}", f"r{rng.randrange(2)}", f"n{rng.randrange(9)}") for _ in range(22)}
    pairs = [(f"n{a}", f"n{b}") for a, b in product(range(9), range(9))] + [("", "n1"), (None, "n1"), ("n1", "nowhere")]
    want = set()
    for s, t in pairs:
        level = [((), s)]
        for _ in range(depth):
            level = [((*p, e), e[2]) for p, at in level for e in edges if e[0] == at]
            hits = {p for p, at in level if at == t}
            if hits and s != t:
                want |= {(s, t, p) for p in hits}
                break
    kg = spark.createDataFrame(sorted(edges), "h string, r string, t string")
    found = shortest.shortest_paths(kg, spark.createDataFrame(pairs, "s string, t string"), depth)
    assert {(r["s"], r["t"], tuple(tuple(x) for x in r["path"])) for r in found.collect()} == want


def test_lookups_with_another_direction(spark):
    kg = spark.createDataFrame([("A", "r", "B")], "h string, r string, t string")
    asked = spark.createDataFrame([("A", "r"), ("Z", "r")], "entity string, r string")
    assert [tuple(r) for r in G.target_entities(kg, asked).collect()] == [("A", "r", "B")]
    assert G.target_entities(kg, asked, "in").count() == 0
    assert G.related_relations(kg, asked, "both").count() == 0
