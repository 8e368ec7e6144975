"""Comparing prediction runs, joining by id, cleaning graph tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.text import approximate_tokens


def last_by(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, as a load into a dictionary keeps it; one aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def first_by(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def best_by(rows: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """The row of each key with the largest number in ``score``; rows whose score is no number are dropped."""
    number = F.expr(f"try_cast(`{score}` AS double)")
    rest = [c for c in rows.columns if c not in keys]
    good = rows.where(number.isNotNull())
    return good.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(number, -F.col(tie))).alias("__r")).select(*keys, "__r.*")


def common_ids(runs: Sequence[DataFrame], key: str, only: DataFrame | None = None) -> DataFrame:
    """The runs joined on the keys that all of them hold; a given ``only``, even an empty one, restricts them."""
    out = reduce(lambda a, b: a.join(b, key), runs)
    return out if only is None else out.join(only.select(key).distinct(), key, "left_semi")


def with_fallback(rows: DataFrame, known: DataFrame, key: str, column: str, computed: DataFrame) -> DataFrame:
    """``column`` of ``known`` by key, and of ``computed`` where the key is not known."""
    a = known.select(key, F.col(column).alias("__known"))
    b = computed.select(key, F.col(column).alias("__computed"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(column, F.coalesce("__known", "__computed")).drop("__known", "__computed")


def required(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """An inner join that is an error if a key of ``rows`` is missing: the offending task raises."""
    joined = rows.join(known.withColumn("__there", F.lit(True)), key, "left")
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no row for key "), F.col(key).cast("string")))).otherwise(F.col(key))
    return joined.withColumn(key, checked).drop("__there")


def unprocessed(rows: DataFrame, done: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """The rows still to do: wanted, if a set is given, and not done."""
    rows = rows if wanted is None else rows.join(wanted.select(key).distinct(), key, "left_semi")
    return rows.join(done.select(key).distinct(), key, "left_anti")


def linked_edges(edges: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges ``(start_id, end_id, label_id)`` whose ends and label, stripped, are kept rows."""
    e = edges.withColumns({c: F.trim(c) for c in ("start_id", "end_id", "label_id")})
    for c in ("start_id", "end_id"):
        e = e.join(nodes.select(F.col("lid").alias(c)).distinct(), c, "left_semi")
    return e.join(labels.select("label_id").distinct(), "label_id", "left_semi")


UNKNOWN, EMPTY = "UNKNOWN_REL_TYPE_CODE", "EMPTY_REL_ID_FOR_TYPE"


def typed_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges with the label's ``code`` as type: one sentinel for an unknown id, one for an empty id."""
    empty = F.coalesce(F.trim("label_id"), F.lit("")) == ""
    joined = edges.join(labels.select("label_id", "code"), "label_id", "left")
    return joined.withColumn("type", F.when(empty, EMPTY).otherwise(F.coalesce("code", F.lit(UNKNOWN)))).drop("code")


def clean_graph_tables(entities: DataFrame, labels: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities with their best score, labels each once, edges whose ends and label exist, typed.

    ``entities(lid, score, line, ...)``, ``labels(label_id, code, line)``, ``edges(start_id, end_id, label_id)``."""
    kept = best_by(entities, ["lid"], "score", "line")
    names = first_by(labels, ["label_id"], "line")
    return kept, names, typed_edges(linked_edges(edges, kept, names), names)


def distribution(values: DataFrame, value: str, top: int = 20) -> DataFrame:
    """``(value, n, percent, cumulative)``: the most frequent values with running shares.

    The window runs over the counted values only, of which there are few."""
    counts = values.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.orderBy(F.desc("n"), "value")
    total = counts.agg(F.sum("n").alias("total"))
    c = counts.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "value").limit(top)  # one row; a top-k report
    return c.select("value", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"), F.round(100 * F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total"), 6).alias("cumulative"))


def correct(text: Column, gold: Column) -> Column:
    """Whether any gold answer, in lower case, stands in the text in lower case."""
    return F.exists(F.coalesce(gold, F.array().cast("array<string>")), lambda g: F.instr(F.lower(F.coalesce(text, F.lit(""))), F.lower(g)) > 0)


def failure_reason(text: Column, gold: Column) -> Column:
    """Why an answer is wrong: empty, a mediator code, a part of the gold answer, or another answer."""
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(plain == "", "empty")
        .when(plain.rlike(r"m\.[0-9a-z_]+"), "mediator_code")
        .when(F.exists(F.coalesce(gold, F.array().cast("array<string>")), lambda g: F.instr(F.lower(g), plain) > 0), "partial")
        .otherwise("other")
    )


def call_counters(calls: DataFrame, keys: list[str], prompt: str, answer: str, measure: str = "words") -> DataFrame:
    """``(<keys>, calls, prompt_tokens, answer_tokens, tokens)``: what a model was asked and what it said, counted as
    columns, so that a task that runs again counts once; null texts have no tokens."""
    size = lambda c: approximate_tokens(F.coalesce(c, F.lit("")), measure).cast("long")
    counted = calls.select(*keys, size(prompt).alias("__p"), size(answer).alias("__a"))
    return counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("__p").alias("prompt_tokens"), F.sum("__a").alias("answer_tokens"), F.sum(F.col("__p") + F.col("__a")).alias("tokens")
    )
