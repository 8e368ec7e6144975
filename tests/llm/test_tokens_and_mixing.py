from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import connection
from tripleloom.llm.byte_bpe import TOKENIZER, encode_texts, tokenizer
from tripleloom.llm.mixing import Mix, repetition_rates


@pytest.fixture(scope="module")
def reference():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="abe ntirs'\n\tüé界<|>0", max_size=80)))
@settings(max_examples=500, deadline=None)
def test_ids_equal_those_of_the_public_library(reference, text):
    bpe = tokenizer()
    ids = bpe.encode(text)
    assert ids == reference(text)
    assert bpe.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "ab" * 1500, "<|endoftext|> x", "́‍👍🏽", "don't I'LL we've", "\r\n\t 　x"])
def test_awkward_texts(reference, text):
    assert tokenizer().encode(text) == reference(text)


def test_documents(reference):
    for (text,) in connection().execute("SELECT text FROM documents").fetchall():
        assert tokenizer().encode(text) == (reference(text) if text else [])


def test_encode_operator(spark):
    rows = [(1, "hello world", 1), (2, None, 1), (3, "", 1), (4, " ", 1), (1, "hello world", 1), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in encode_texts(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, [31373, 995]), (2, []), (3, []), (4, [220]), (1, [31373, 995]), (None, [87])], key=str)
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_rates():
    rates = {r.source: r.rate for r in repetition_rates([("a", 0.5, 1), ("b", 0.5, 4), ("none", 0.0, 3), ("gone", 0.1, 2), (None, 0.3, 1)], {"a": 1000, "b": 300})}
    assert rates == {"a": 1.0, "b": pytest.approx(1000 / 300), "none": 0.0, "gone": 0.0}
    capped = {r.source: r.rate for r in repetition_rates([("a", 0.5, 1), ("b", 0.5, 4)], {"a": 1000, "b": 10}, total=2000)}
    assert capped == {"a": 1.0, "b": 4.0}
    assert repetition_rates([("a", 0.2, 1), ("a", 0.5, 3)], {"a": 10})[0].rate == 3.0
    assert repetition_rates([("a", None, None)], {}) [0].rate == 0.0


def test_mix(spark):
    docs = [(i, f"word number {i} of a text", "big" if i % 3 else "small", 9) for i in range(3000)] + [(5000, None, "big", 9), (5001, "x", None, 9), (5002, "y", "other", 9), (5003, "", "small", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rate int")
    targets = spark.createDataFrame([("big", 0.4, 2), ("small", 0.6, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = Mix(df, targets)
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert shares["big"]["actual_share"] == pytest.approx(0.4, abs=0.01) and shares["small"]["actual_share"] == pytest.approx(0.6, abs=0.01)
    assert shares["none"]["mixed_rows"] == 0 and shares["none"]["actual_share"] == 0
    rows = mix.documents().collect()
    assert max(r["copy"] for r in rows) <= 1 and not {5001, 5002} & {r["doc_id"] for r in rows}
    assert sum(r["tokens"] for r in rows) == sum(r["mixed_tokens"] for r in shares.values())
    assert sorted(map(str, rows)) == sorted(map(str, Mix(df, targets).documents().collect()))
    checks = {r["source"]: tuple(r)[1:] for r in mix.checks().collect()}
    assert checks == {c: (True, True, True) for c in ("big", "small", "none")}
    mix.rates = [replace(r, max_repeats=0, rate=r.rate + 0.5) if r.source == "big" else r for r in mix.rates]
    assert {r["source"]: r["within_cap"] for r in mix.checks().collect()} == {"big": False, "small": True, "none": True}
    larger = {r["source"]: r for r in Mix(df, targets, of_all=3.0).shares().collect()}
    assert larger["small"]["capped"] and larger["small"]["rate"] == 2 and larger["small"]["actual_share"] < 0.6
    empty = Mix(df.limit(0), targets)
    assert empty.documents().count() == 0 and {r["actual_share"] for r in empty.shares().collect()} == {0.0}
    assert Mix(df, targets.limit(0)).shares().count() == 0
