import random
import time

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import analytics as I
from tripleloom.operators import evaluation as E
from tripleloom.operators import explore, training, trie, vectors

ITEMS = "id long, positive_paths array<string>, negative_paths array<string>"


def points(spark, pos, neg):
    items = spark.createDataFrame([(1, pos, neg)], ITEMS)
    return training.candidate_pool(training.decision_points(items, "id", "positive_paths", "negative_paths"))


def test_preference_rows_of_one_point(spark):
    p = points(spark, ["A-[r1]->B", "A-[r3]->C"], ["A-[r2]->D", "A-[r3]->E", "bad step"])
    assert p.first()["pool"] == ["r1", "r2", "r3"]
    v1 = training.preference_v1(p, 2).first()
    assert (v1["chosen"], v1["rejected"]) == ("r1\nr3", "r2")
    v2 = training.preference_v2(p).first()
    assert (v2["chosen"], v2["rejected"]) == (["[REL1] r1", "[REL3] r3"], ["[REL2] r2"])
    assert training.sft_completions(p, 2).first()["completion"] == "[REL_0] r1\n[REL_2] r3"
    assert training.preference_naive(p, 2).count() == 1


def test_without_negatives_no_row(spark):
    p = points(spark, ["A-[r1]->B"], None)
    assert training.preference_v1(p, 2).count() == training.preference_v2(p).count() == 0
    assert training.sft_completions(p, 2, tagged=False).first()["completion"] == "r1"


def test_histories_and_truncation(spark):
    p = points(spark, ["A-[r]->B ; B-[s]->C"], [])
    assert sorted((r["history"], r["entity"]) for r in p.collect()) == [("", "A"), ("A-[r]->B", "B")]
    path = spark.createDataFrame([(1, [("A", "r", "B"), ("B", "s", "C"), ("C", "t", "D")])], "id int, path array<struct<h:string,r:string,t:string>>")
    assert sorted(len(r["path"]) for r in training.truncated(path, "id", "path", 5).collect()) == [1, 2]


def test_perturbed_paths_avoid_answer_and_old_tail(spark):
    kg = spark.createDataFrame([("A", "r", "B"), ("A", "s", "B"), ("A", "s", "X"), ("A", "t", "Y")], "h string, r string, t string")
    ranked = spark.createDataFrame([("A", "r", 1), ("A", "s", 2), ("A", "t", 3)], "h string, r string, rank int")
    paths = spark.createDataFrame([(1, "Y", [("A", "r", "B")])], "id int, answer string, path array<struct<h:string,r:string,t:string>>")
    got = training.perturbed(paths, "id", "path", "answer", kg, ranked, "seed", 2).collect()
    assert [[tuple(s) for s in r["path"]] for r in got] == [[("A", "s", "X")]]


@pytest.mark.parametrize(
    ("found", "gold", "want"),
    [([], [], (1, 1, 1)), (["x"], [], (0, 0, 0)), ([], ["x"], (0, 0, 0)), (["The U.S.A."], ["usa"], (1, 1, 1)), (["a1", "b1"], ["a1", "c1"], (0.5, 0.5, 0.5)), (["New York City"], ["York"], (0, 0, 0)), (None, None, (1, 1, 1))],
)
def test_set_metrics(spark, found, gold, want):
    df = spark.createDataFrame([(found, gold)], "found array<string>, gold array<string>")
    r = E.evaluated(df, "found", "gold").first()
    assert (r["precision"], r["recall"], r["f1"]) == want


def test_substring_hit(spark):
    df = E.with_sets(spark.createDataFrame([(["New York City"], ["York"])], "found array<string>, gold array<string>"), "found", "gold")
    r = df.select(E.substring_metrics(F.array_join("found_set", " "), F.col("found_set"), F.col("gold_set")).alias("m")).first()["m"]
    assert (r["acc"], r["any_hit"], r["f1"]) == (1.0, 1, 1.0)


def test_label_metrics(spark):
    s = spark.createDataFrame([(1, 2.0, 0), (1, 1.0, 1), (1, -1.0, 0), (2, 3.0, 1)], "p int, score double, label int")
    r = E.label_metrics(s, "p", "score", "label").first()
    assert (r["precision"], r["recall"], r["exact_match"], r["mrr"]) == (0.75, 1.0, 0.5, 0.75)


def test_trie(spark):
    seqs = spark.createDataFrame([(["1", "2", "3"],), (["1", "2", "4"],), (["5"],), (["5"],), ([],), (None,)], "s array<string>")
    t = trie.build(seqs, "s")
    allowed = {}
    for r in trie.allowed(t, spark.createDataFrame([("",), ("1 2",), ("9",), ("5",)], "prefix string")).collect():
        allowed.setdefault(r["prefix"], set()).add(r["next"])
    assert allowed == {"": {"1", "5"}, "1 2": {"3", "4"}}
    assert tuple(trie.sizes(seqs.where("size(s) > 0"), "s").first()) == (4, 3)
    ids = spark.createDataFrame([(["<PATH>", "1"],), (["<PATH>", "1", "</PATH>"],), (["x"],)], "i array<string>")
    assert [r[0] for r in ids.select(trie.constrained_prefix(F.col("i"))).collect()] == ["<PATH> 1", None, None]


def test_nearest_by_either_metric(spark):
    keys = spark.createDataFrame([(1, [1.0, 0.0]), (2, [5.0, 5.0]), (3, None), (4, [1.0, 0.0])], "key long, v array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], "query long, v array<double>")
    top = lambda m: [(r["key"], r["rank"]) for r in vectors.top_k(keys, q, 2, m).orderBy("rank").collect()]
    assert top("ip") == [(2, 1), (1, 2)] and top("cosine") == [(1, 1), (4, 2)]
    many = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "query long, v array<double>")
    one, blocks = (sorted(map(tuple, vectors.top_k(keys, many, 1, "ip", block=b).collect())) for b in (1000, 7))
    assert one == blocks and len(one) == 50


def test_exploration_stops_at_the_answer(spark):
    kg = spark.createDataFrame([("A", "r", "B"), ("B", "s", "C"), ("C", "t", "A"), ("X", "r", "Y")], "h string, r string, t string")
    starts = spark.createDataFrame([(1, "A"), (2, "X")], "qid long, entity string")
    answers = spark.createDataFrame([(1, "C")], "qid long, t string")
    got = sorted(tuple(r) for r in explore.explore(starts, kg, answers, 5, 3).collect())
    assert got == [(1, 1, "A", "r", "B"), (1, 2, "B", "s", "C"), (2, 1, "X", "r", "Y")]


def test_joins_by_id(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "id int, v string, line int")
    assert sorted((r["id"], r["v"]) for r in I.last_by(rows, ["id"], "line").collect()) == [(1, "b"), (2, "c")]
    none = rows.select("id").limit(0)
    assert I.common_ids([rows.select("id"), rows.select("id")], "id", none).count() == 0
    assert I.unprocessed(rows, none, "id").count() == 3
    with pytest.raises(Exception, match="no row for key 2"):
        I.required(rows, rows.where("id = 1").select("id"), "id").collect()
    scores = spark.createDataFrame([("e", "1", 1), ("e", "3", 2), ("e", "x", 3), ("e", "3", 4)], "lid string, score string, line int")
    assert [(r["score"], r["line"]) for r in I.best_by(scores, ["lid"], "score", "line").collect()] == [("3", 2)]


def test_graph_tables(spark):
    entities = spark.createDataFrame([("a", "1", 1), ("a", "3", 2), ("b", "x", 3), ("c", "1", 4)], "lid string, score string, line int")
    labels = spark.createDataFrame([("1", "is", 1), ("1", "was", 2)], "label_id string, code string, line int")
    edges = spark.createDataFrame([(" a", "c ", "1"), ("a", "b", "1"), ("a", "c", "9")], "start_id string, end_id string, label_id string")
    kept, names, typed = I.clean_graph_tables(entities, labels, edges)
    assert sorted((r["lid"], r["score"]) for r in kept.collect()) == [("a", "3"), ("c", "1")]
    assert [r["code"] for r in names.collect()] == ["is"]
    assert [(r["start_id"], r["end_id"], r["type"]) for r in typed.collect()] == [("a", "c", "is")]


def test_states_at_the_root_do_not_meet_all_that_may_begin_there(spark, tmp_path):
    from tripleloom.plans.rows import constraint_gate

    n = 30_000  # as rows of states and tokens, 900 million
    graph = F.array(*(F.struct(F.concat(F.lit("h"), x).alias("h"), F.concat(F.lit("r"), x).alias("r"), F.lit("t").alias("t")) for x in ("id", F.lit("0"))))
    spark.range(n).select(F.col("id").alias("row_id"), graph.alias("graph")).write.parquet(f"{tmp_path}/rog_cwq.parquet")
    began = time.time()
    got = constraint_gate(spark, str(tmp_path)).groupBy("seq", "constrained", "n").count().collect()
    assert sorted(map(tuple, got)) == [(0, True, n, n), (1, True, 1, n)] and time.time() - began < 60


def test_gate_sizes_count_the_tokens_of_the_gate(spark):
    t = trie.build(spark.createDataFrame([(["<PATH>", "1", "2"],), (["<PATH>", "1", "3"],)], "s array<string>"), "s")
    rows = [(1, ["<PATH>"]), (2, ["<PATH>", "1"]), (3, ["<PATH>", "9"]), (4, ["x"]), (5, None), (6, []), (7, ["a", "<PATH>", "1"])]
    states = spark.createDataFrame(rows, "k int, i array<string>")
    want = trie.gate(states, "k", "i", t).groupBy("k", "constrained").agg(F.count("next").alias("n"))
    assert sorted(map(tuple, trie.gate_sizes(states, "k", "i", t).collect())) == sorted(map(tuple, want.collect()))
    twice = trie.gate_sizes(states.unionByName(states), "k", "i", t)
    assert {r["k"]: r["n"] for r in twice.collect()} == {1: 2, 2: 4, 3: 0, 4: 0, 5: 0, 6: 0, 7: 4}


def test_filled_pools_equal_limited_pools_of_the_graph(spark):
    rng = random.Random(3)
    some = lambda n: sorted(rng.sample([f"r{i}" for i in range(12)], rng.randrange(n)))
    rows = [(i, rng.choice(["", "A-[r1]->B", "é"]), rng.choice("ABCDX"), some(5) or ["r1"], some(7)) for i in range(300)]
    p = spark.createDataFrame(rows, "qid int, history string, entity string, pos array<string>, neg array<string>")
    kg = spark.createDataFrame([(h, f"r{rng.randrange(n)}", "t") for h, n in (("A", 40), ("B", 8), ("C", 6), ("D", 2)) for _ in range(90)], "h string, r string, t string")
    for threshold in (1, 6, 20):
        want = training.limited_pool(training.candidate_pool(p, "kg_allhop", kg), threshold, 2)
        got = training.filled_pool(p, kg, threshold)
        assert sorted((r["qid"], r["pool"]) for r in got.collect()) == sorted((r["qid"], r["pool"]) for r in want.collect())


def test_a_hub_is_put_in_order_once_for_all_its_points(spark, tmp_path):
    one = F.array(F.lit("r1"))
    p = spark.range(8_000).select(F.col("id").alias("qid"), F.lit("").alias("history"), F.lit("A").alias("entity"), one.alias("pos"), F.array().cast("array<string>").alias("neg"))
    p.write.parquet(f"{tmp_path}/p")
    kg = spark.range(8_000).select(F.lit("A").alias("h"), F.concat(F.lit("r"), "id").alias("r"), F.lit("t").alias("t"))
    began = time.time()
    got = training.filled_pool(spark.read.parquet(f"{tmp_path}/p"), kg, 6).groupBy("pool").count().collect()
    assert [(len(r["pool"]), r["count"]) for r in got] == [(6, 8_000)] and time.time() - began < 30  # 64 million relations, point by point
