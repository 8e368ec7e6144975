import json

from tripleloom.llm.layout_copies import copy_counts, layout_copies
from tripleloom.llm.term_counts import marked_terms

ROWS = "row_id long, id string, run string, prediction string, predicted_paths string, key string, first int, h long"
HOW = {"row": "row_id", "exact": ["id", "run"], "text": ["prediction", "predicted_paths"], "objects": ["prediction"]}


def copies(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], ROWS).repartition(3)
    return sorted(tuple(r) for r in layout_copies(df, **HOW).collect()), sorted(tuple(r) for r in copy_counts(df, **HOW).collect())


def test_layouts(spark):
    got, counts = copies(spark, [
        (5, "a", "r", "Grimül, Tambam", "A -[r]-> B"),
        (2, "a", "r", " grimül\ntambam!", "a - r b"),
        (9, "a", "r", '"GRIMÜL Tambam"', "A-[r]->B"),
        (3, "a", "r", "Grimul Tambam", "A -[r]-> B"),
        (4, "a", "s", "Grimül Tambam", "A -[r]-> B"),
        (6, "a", "r", "Tambam Grimül", "A -[r]-> B"),
    ])
    assert got == [(2, 5), (2, 9)]
    assert counts == [(2, 3), (3, 1), (4, 1), (6, 1)]


def test_nulls_are_like_empty_and_null_ids_are_equal(spark):
    got, _ = copies(spark, [(1, None, None, None, ""), (2, None, None, "", None), (3, None, None, " ; ", "|"), (4, "", None, None, None), (None, None, None, None, None)])
    assert got == [(1, 2), (1, 3)]


def test_objects_by_member(spark):
    one = {"answer_entities": ["É, a", "b\nn"], "found": True, "n": 70}
    two = json.dumps({"n": 70, "found": True, "answer_entities": ["é a", "B N"]}, indent=2)
    got, _ = copies(spark, [
        (1, "a", "r", json.dumps(one), "p"), (2, "a", "r", two, "p"), (3, "a", "r", json.dumps(one, ensure_ascii=False), "p"),
        (4, "a", "r", json.dumps(one | {"n": 71}), "p"), (5, "a", "r", json.dumps({"x": "a", "y": "b"}), "p"), (6, "a", "r", json.dumps({"x": "b", "y": "a"}), "p"),
        (7, "a", "r", "{broken, a}", "p"), (8, "a", "r", "broken a", "p"), (9, "a", "r", "{}", "p"), (10, "a", "r", "{ }", "p"), (11, "a", "r", "", "p"),
        (12, "a", "r", '{"x": "a"} tail', "p"), (13, "a", "r", '{"x": "a"}', "p"), (14, "a", "r", '{"x": "a"}{"y": "b"}', "p"), (15, "a", "r", '{"x": "a"}, {"y": "c"}', "p"), (16, "a", "r", "x a tail", "p"),
    ])
    assert got == [(1, 2), (1, 3), (7, 8), (9, 10), (12, 16)]


def test_long_texts_and_empty_table(spark):
    long = "Wort " * 40_000
    got, _ = copies(spark, [(1, "a", "r", long, None), (2, "a", "r", long.upper(), None), (3, "a", "r", long + "x", None)])
    assert got == [(1, 2)]
    assert copies(spark, []) == ([], [])


GRAPHS = "row_id long, graph array<struct<h:string,r:string,t:string>>, term string, rows int, kind string"


def terms(spark, graphs, **how):
    df = spark.createDataFrame([(i, g, "x", 1, "y") for i, g in enumerate(graphs)], GRAPHS).repartition(3)
    return {(r["kind"], r["term"]): (r["occurrences"], r["rows"], r["mark"]) for r in marked_terms(df, **how).collect()}


def test_terms(spark):
    got = terms(spark, [[("A", "r", "A"), (" A", "r", "B\t"), ("A", "r", "B")], [("A", "s", None), ("A", " ", "C"), None], None, [], [("A", "r", "x" * 50_000)]], rare_rows=1, common_share=0.4)
    assert got == {("entity", "A"): (5, 2, "common"), ("entity", "B"): (2, 1, "rare"), ("entity", "x" * 50_000): (1, 1, "rare"), ("relation", "r"): (4, 2, "common")}
    assert terms(spark, []) == {}


def test_a_hot_term_over_many_partitions(spark):
    got = terms(spark, [[("hub", "r", f"n{i}")] for i in range(2000)])
    assert got["entity", "hub"] == (2000, 2000, "common") and got["entity", "n7"] == (1, 1, "rare") and len(got) == 2002
