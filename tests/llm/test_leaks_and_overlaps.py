import random
import re
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleloom.llm import split_overlap
from tripleloom.llm.leakage import ItemIndex, leaked_items, passage_words
from tripleloom.llm.split_overlap import cross_split_pairs


def brute(items, text, n):
    w = passage_words(text)
    runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for k, q in items:
        v = passage_words(q)
        if any(tuple(v[i : i + n]) in runs for i in range(len(v) - n + 1)):
            out.append(k)
    return sorted(out)


words = st.lists(st.sampled_from("a b c d e f g".split()), max_size=25).map(" ".join)


@given(st.lists(words, max_size=30), st.lists(words, min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_index_finds_what_brute_force_finds(questions, texts):
    items = list(enumerate(questions))
    index = ItemIndex(items, run_words=4)
    for t in texts:
        assert sorted(index.leaked(t)) == brute(items, t, 4)


def test_many_items_in_many_blocks():
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(6000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 30)))) for i in range(700)]
    index = ItemIndex(items, run_words=10)
    for _ in range(300):
        w = [rng.choice(vocabulary) for _ in range(60)]
        source = passage_words(items[rng.randrange(700)][1])
        cut = rng.randrange(0, max(1, len(source) - 8))
        w[20:20] = source[cut : cut + rng.choice([9, 10, 15])]
        assert sorted(index.leaked(" ".join(w))) == brute(items, " ".join(w), 10)


def test_leak_operator(spark):
    q = "One two three FOUR five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, q, "x"), (2, q, "x"), (3, None, "x"), (4, "too short", "x"), (5, "", None)], "item_id long, question string, prompt string")
    long = "word " * 50_000 + "two-three four\r\nfive, six seven eight nine ten (eleven) " + "word " * 1000
    rows = [("sft", 1, long, 1), ("sft", 2, None, 1), ("sft", 3, "", 1), ("sft", 4, "one two three four five six seven eight nine", 1), ("sft", 1, long, 1), (None, None, q, None)]
    df = spark.createDataFrame(rows, "corpus string, train_row long, prompt string, item_id int")
    want = sorted([("sft", 1, 1), ("sft", 1, 2)] * 2 + [(None, None, 1), (None, None, 2)], key=str)
    for block in (1 << 20, 60):
        got = leaked_items(df, ["corpus", "train_row"], "prompt", items, "item_id", "question", block_bytes=block)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert leaked_items(df.limit(0), ["corpus", "train_row"], "prompt", items, "item_id", "question").count() == 0
    assert leaked_items(df, ["corpus", "train_row"], "prompt", items.limit(0), "item_id", "question").count() == 0


def test_gold_answers_are_verified(spark):
    q = "one two three four five six seven eight nine ten eleven"
    gold = ["The  Red-Fox", "the red fox", None, "?!", "ten eleven", "fox"]
    items = spark.createDataFrame([(1, q, gold), (2, q, None), (3, None, gold), (4, q, [])], "item_id int, question string, gold array<string>")
    df = spark.createDataFrame([(1, f"{q}. It was THE RED FOX"), (2, q), (3, "the red fox"), (4, None), (5, f"{q} the red, foxes")], "k int, prompt string")
    for block in (1 << 20, 60):
        got = leaked_items(df, ["k"], "prompt", items, "item_id", "question", answers="gold", block_bytes=block)
        assert sorted(map(tuple, got.collect())) == sorted((k, i, n, m if i == 1 else 0) for k, m in ((1, 3), (2, 1), (5, 1)) for i, n in ((1, 3), (2, 0), (4, 0)))


QUESTIONS = "row_id long, split string, question string, key string, n int"


def pairs(spark, rows, t=Fraction(4, 5)):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], QUESTIONS).repartition(3)
    split = F.col("split")
    return sorted(tuple(r) for r in cross_split_pairs(df, "row_id", "question", split == "train", split.isin("validation", "test"), t).collect())


def brute_pairs(rows, t=Fraction(4, 5)):
    w = {i: set(re.findall(r"[^\W_]+", (q or "").lower())) for i, _, q in rows}
    return sorted((a, b) for a, s, _ in rows for b, u, _ in rows if s == "train" and u in ("validation", "test") and w[a] and w[b] and len(w[a] & w[b]) >= t * len(w[a] | w[b]))


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(1)) % 60}" for _ in range(400)]
    rows = []
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))]
        if rows and rng.random() < 0.6:
            w = passage_words(rng.choice(rows)[2])
            w = [x for x in w if rng.random() < 0.93] + [rng.choice(vocabulary)] * (rng.random() < 0.3)
        rows.append((i, rng.choice(["train", "train", "validation", "test", None]), ", ".join(w).upper() if rng.random() < 0.5 else " ".join(w)))
    for t in (Fraction(4, 5), Fraction(1, 2), Fraction(1)):
        assert pairs(spark, rows, t) == brute_pairs(rows, t)


def test_awkward_questions(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, "train", None), (2, "test", None), (3, "train", " "), (4, "test", "?!"), (5, "train", "Who is it?"), (6, "test", "who IS it"), (7, "train", "who is it"), (8, "train", long), (9, "test", long + " x"), (10, "dev", "who is it")]
    assert pairs(spark, rows) == [(5, 6), (7, 6), (8, 9)]
    assert pairs(spark, []) == []


def test_one_question_in_a_third_of_all_rows(spark):
    rows = [(i, "train" if i % 10 else "test", "the same question again") if i % 3 == 0 else (i, "train", f"other{i} words{i}") for i in range(600)]
    assert pairs(spark, rows) == brute_pairs(rows)


def test_pairs_that_only_share_words_are_dropped_in_the_join(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(15)) for _ in range(600)]
    texts += [t + " more" for t in texts[:50:3]]
    rows = [(i, "train" if i % 3 else "test", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id long, split string, question string")
    sets = split_overlap.word_sets(df, "row_id", "question", F.col("split") == "train", F.col("split") == "test")
    similar = {tuple(r) for r in split_overlap.similar_sets(sets, Fraction(4, 5)).collect()}
    near = [tuple(map(bytes, r)) for r in split_overlap._near(split_overlap._ranked(sets), Fraction(4, 5)).collect()]
    assert {tuple(map(bytes, r)) for r in similar} <= set(near)
    assert len(near) <= len(similar) + 50  # thousands share a word of their prefixes
    assert pairs(spark, rows) == brute_pairs(rows)
