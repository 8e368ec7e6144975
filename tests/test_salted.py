from collections import Counter

from pyspark.sql import functions as F

from tripleloom.operators import salted
from tripleloom.operators.salted import Merged, count_rows, entity_loads, heavy_entities, heavy_keys, salted_aggregate

SCHEMA = "row_id long, q_entity array<string>, graph array<struct<h:string,r:string,t:string>>, entity string, n string"


def test_counts_equal_plain_counts_with_a_key_that_holds_most_rows(spark):
    keys = ["hub"] * 700 + [f"k{i % 90}" for i in range(300)] + [None] * 50
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v long").repartition(5)
    out = salted_aggregate(df, ["k"], [count_rows(), Merged("top", F.max("v"), "max"), Merged("s", F.sum("v"))])
    got = {r["k"]: (r["n"], r["top"], r["s"]) for r in out.collect()}
    want = {k: (n, max(i for i, x in enumerate(keys) if x == k), sum(i for i, x in enumerate(keys) if x == k)) for k, n in Counter(keys).items()}
    assert got == want
    assert heavy_keys(df, "k", 0.3) == ["hub"]


def test_only_heavy_keys_are_salted(spark):
    df = spark.createDataFrame([("hub",)] * 1000 + [(f"k{i}",) for i in range(500)], "k string")
    heavy = salted_aggregate(df, ["k"], [count_rows()], heavy_share=0.3)._jdf.queryExecution().toString()
    assert "rand(17)" in heavy and "hub" in heavy and "k7" not in heavy


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert entity_loads(df).count() == 0
    assert heavy_entities(df).count() == 0


def test_entities_are_trimmed_counted_once_a_row_and_triples_must_be_valid(spark):
    rows = [
        (1, ["A", " A ", "", None, "\tB\n"], [("A", "r", "B"), ("A", "r", "B"), (" A", "r ", "C"), ("A", " ", "B"), (None, "r", "B")], "x", "y"),
        (2, None, None, None, None),
        (3, [], [], "A", "B"),
        (3, ["A"], [None, ("B", "r", "x" * 10000)], "A", "B"),
    ]
    got = {(r["field"], r["entity"]): (r["n"], r["total"]) for r in entity_loads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("q_entity", "A"): (2, 4), ("q_entity", "B"): (1, 4), ("graph", "A"): (3, 4), ("graph", "B"): (1, 4)}


def test_the_share_is_exact_at_its_border(spark):
    rows = [(i, ["E"] if i < 3 else ["F"] if i < 5 else [f"x{i}"], None, None, None) for i in range(100)]
    got = {(r["field"], r["entity"]) for r in heavy_entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("q_entity", "E")}


def test_clashing_column_names_do_no_harm(spark):
    df = spark.createDataFrame([("a", 1, 2, 3)], "k string, __salt int, n int, item int")
    assert [tuple(r) for r in salted_aggregate(df, ["k"], [count_rows("m")]).collect()] == [("a", 1)]
    assert salted.heavy_keys(df, "k", 0.5) == ["a"]
