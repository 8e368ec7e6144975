import random
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tripleloom.llm.stuffed_pages import BORDER, ClassReader, ProseModel, StuffedModel, exact_quantiles, fitted, stuffed_pages, stuffed_shares, units

BIG, LARGE = "/root/testdata/sf0.1", "/root/testdata/check_l"


@pytest.fixture(scope="module")
def labelled():
    if not Path(BIG).exists():
        pytest.skip("no test data")
    return duckdb.sql(f"SELECT text, is_stuffed FROM '{BIG}/documents.parquet' JOIN '{BIG}/page_labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()


def held_out(labelled, parts):
    """Precision and recall on pages that the model wasn't fitted on."""
    found = right = 0
    for part in range(parts):
        model = StuffedModel([x for i, x in enumerate(labelled) if i % parts != part])
        rest = [x for i, x in enumerate(labelled) if i % parts == part]
        flagged = model.scores([t for t, _ in rest])[0] > BORDER
        found += int(flagged.sum())
        right += sum(int(f) for f, (_, y) in zip(flagged, rest) if y)
    return right / found, right / sum(y for _, y in labelled)


def test_held_out_accuracy(labelled):
    precision, recall = held_out(labelled, 2)
    assert precision >= 0.9 and recall >= 0.9


def test_held_out_accuracy_with_more_labels():
    if not Path(LARGE).exists():
        pytest.skip("no larger test data")
    rows = duckdb.sql(f"SELECT text, is_stuffed FROM '{LARGE}/documents.parquet/*.parquet' JOIN '{LARGE}/page_labels.parquet/*.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    precision, recall = held_out(rows, 2)
    assert precision >= 0.97 and recall >= 0.97


def test_labels_of_stuffed_pages_only_choose_the_quantiles(labelled):
    prose = [x for x in labelled if not x[1]]
    alone, both = StuffedModel(prose), StuffedModel(labelled)
    texts = [t for t, _ in labelled]
    assert list(alone.scores(texts)[1]) == pytest.approx(list(both.scores(texts)[1]), rel=0.1, nan_ok=True)
    flagged = alone.scores(texts)[0] > BORDER
    assert sum(f and y for f, (_, y) in zip(flagged, labelled)) >= 0.8 * sum(y for _, y in labelled)


def test_leaving_a_page_out_equals_a_model_without_it():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("the cat sat , on a mat . it saw www.x.example/y x".split()) for _ in range(rng.randrange(3, 40))) for _ in range(40)]
    reader = ClassReader(texts)
    pages = reader.read(texts)
    every = np.ones(len(pages.cls), dtype=bool)
    got = ProseModel(len(reader.number), pages, every).surprise(pages, np.ones(len(pages.cls)))
    for i in range(0, 40, 7):
        want = ProseModel(len(reader.number), pages, pages.page != i).surprise(pages)
        assert np.allclose(got[pages.page == i], want[pages.page == i])


@pytest.mark.parametrize("text", ["x" * 300_000, "<a " * 100_000, "a.b-" * 100_000, "[x](" * 100_000, "1a" * 100_000, "字" * 200_000, "www." * 100_000, "graph poster " * 100_000])
def test_a_long_page_takes_time_in_proportion(labelled, text):
    model = StuffedModel(labelled[:100])
    began = time.process_time()
    model.share(text)
    assert time.process_time() - began < 5


def test_share_follows_the_stuffed_part(labelled):
    model = StuffedModel(labelled)
    prose = next(t for t, y in labelled if not y and t and len(t) > 600 and "\n" not in t and " the " in t)
    spam = "cheap graph data, fact finder, cheap graph data, cheap graph data, fact finder, "
    assert model.share(prose) < 0.1
    assert model.share(spam * 20) > 0.9
    assert model.share(prose + " " + spam * (len(prose) * 3 // len(spam))) > 0.5 > model.share(prose * 3 + " " + spam * (len(prose) // len(spam)))


def test_units():
    kinds = [k for k, _ in units("See www.a.example/x a.b_c.d #tag 12.50 12,50 0.871 SKU99 7 图 word shop.x-y.test [x](http://a.test/b)\n\n<b class=" + "c" * 900 + ">")]
    assert kinds == ["word", "link", "relation", "hash", "price", "price", "decimal", "code", "number", "han", "word", "host", "sign", "word", "target", "lines", "tag"]


def test_operator_on_awkward_rows(spark, labelled):
    rows = [(i, t, 1) for i, (t, _) in enumerate(labelled[:200])] + [(900, None, 1), (901, "", 1), (902, " \n", 1), (903, "graph poster " * 20_000, 1), (903, "graph poster " * 20_000, 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, share int")
    labels = spark.createDataFrame([(i, y, "x") for i, (_, y) in enumerate(labelled[:200])] + [(None, 1, "x"), (5000, 1, "x")], "doc_id long, is_stuffed int, text string")
    shares = {r["doc_id"]: r["share"] for r in stuffed_shares(df, labels).collect()}
    assert shares[900] == shares[901] == shares[902] == 0.0 and shares[903] > 0.9 and len(shares) == 205
    assert stuffed_pages(df, labels).where("doc_id = 903").count() == 2
    assert stuffed_pages(df, labels.limit(0)).count() == 0
    assert stuffed_pages(df.limit(0), labels).count() == 0
    again = {r["doc_id"]: r["share"] for r in stuffed_shares(df.repartition(5), labels).collect()}
    assert again == shares


def test_only_prose_labels():
    rng = random.Random(2)
    prose = [(" ".join(rng.choice("the cat sat on a mat and saw it".split()) for _ in range(30)) + ".", 0) for _ in range(60)]
    model = StuffedModel(prose)
    assert model.share(prose[0][0]) < 0.5
    assert StuffedModel([]).share("anything at all") == 0.0


def test_the_model_is_fitted_on_every_label(spark, labelled):
    rows = [(i, t, y) for i, (t, y) in enumerate(labelled)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_stuffed int").repartition(4)
    local, spread_out = StuffedModel(labelled), fitted(df.select("doc_id", "text"), df.select("doc_id", "is_stuffed"), "doc_id", "text", "is_stuffed")
    assert (spread_out.low, spread_out.high) == pytest.approx((local.low, local.high))
    texts = [t for t, _ in labelled]
    for got, want in zip(spread_out.scores(texts), local.scores(texts)):
        assert np.allclose(got, want, equal_nan=True)


def test_labels_beyond_thousands_count(spark):
    prose = [(i, f"The cat sat on mat {i}.", 0) for i in range(7_000)]
    df = spark.createDataFrame(prose, "doc_id long, text string, is_stuffed int")
    model = fitted(df, df, "doc_id", "text", "is_stuffed")
    unigrams = model.model.tables[0][0]
    assert unigrams.counts.max() == 7_000


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    v = np.round(np.concatenate([rng.exponential(2, 5_000), np.full(900, 1.25)]), 3)
    shares = [0.0, 0.0001, 0.3, 0.98, 0.9997, 1.0]
    df = spark.createDataFrame([(float(x), 1) for x in v], "v double, n long")
    assert exact_quantiles(df, shares) == pytest.approx(list(np.quantile(v, shares)))
    assert exact_quantiles(df.limit(0), shares) == []
