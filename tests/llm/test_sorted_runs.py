import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tripleloom.llm.sorted_runs import run_counts, run_members, scanned_runs


@pytest.fixture
def many_partitions(spark):
    """So that the hot run is cut by the range partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_members_over_partition_borders(spark, many_partitions):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(150)}" if i % 7 else f"only{i}") for i in range(3000)]
    rng.shuffle(rows)
    least = {}
    for i, k in rows:
        least[k] = min(i, least.get(k, i))
    df = spark.createDataFrame(rows, "id long, k string").repartition(7)
    got = {r["row"]: r["first"] for r in run_members(df, F.col("k"), "id").collect()}
    assert got == {i: least[k] for i, k in rows}


def test_one_key_and_none(spark):
    df = spark.createDataFrame([(i, "k") for i in range(500)], "id long, k string").repartition(9)
    assert {r["first"] for r in run_members(df, F.col("k"), "id").collect()} == {0}
    assert run_members(df.limit(0), F.col("k"), "id").count() == 0


@pytest.mark.parametrize("batch", [10_000, 7])
def test_counts_over_partition_and_batch_borders(spark, many_partitions, batch):
    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.5 else None, rng.choice(["hot", "hot", f"k{rng.randrange(200)}", None]), rng.choice([None, rng.randrange(300)]), rng.randrange(1, 4)) for _ in range(3000)]
    amounts, records = Counter(), defaultdict(set)
    for a, k, i, n in rows:
        amounts[a, k] += n
        records[a, k].add(i)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "a string, k string, id long, n int").repartition(5)
        got = run_counts(df, ["a", "k"], "id", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(amounts)
    assert {(r["a"], r["k"]): (r["amount"], r["records"]) for r in got} == {k: (n, len(records[k])) for k, n in amounts.items()}
    assert run_counts(df.limit(0), ["a", "k"], "id", "n").count() == 0


def test_counts_come_from_a_sorted_scan(spark):
    df = spark.createDataFrame([("x", 1, 1)], "k string, id long, n int")
    plan = scanned_runs(df, ["k"], "id", "n")._jdf.queryExecution().optimizedPlan().toString()
    order = [plan.index(w) for w in ("MapInArrow", "Sort", "RepartitionByExpression")]
    assert order == sorted(order) and "Aggregate" not in plan
