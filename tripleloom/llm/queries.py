"""Queries of the text problems, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm import byte_bpe, layout_copies, leakage, mixing, split_overlap, stuffed_pages, term_counts
from tripleloom.llm.sql import SQL
from tripleloom.tables import load

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


ANSWERS = {"row": "row_id", "exact": ["id", "run"], "text": ["prediction", "predicted_paths"], "objects": ["prediction"]}


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout_copies.layout_copies(load(spark, folder, "predictions"), **ANSWERS)


@query
def p2_copy_counts(spark: SparkSession, folder: str) -> DataFrame:
    return layout_copies.copy_counts(load(spark, folder, "predictions"), **ANSWERS)


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = term_counts.marked_terms(load(spark, folder, "rog_webqsp"))
    return marked.where(F.col("mark").isNotNull()).select("kind", "term", "mark")


@query
def p3_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts.marked_terms(load(spark, folder, "rog_webqsp"))


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda name, table, key: load(spark, folder, table).select(F.lit(name).alias("corpus"), F.col(key).alias("train_row"), "prompt")
    return one("sft", "sft_rows", "sft_row_id").unionByName(one("pref", "pref_rows", "pref_row_id"))


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(_prompts(spark, folder), ["corpus", "train_row"], "prompt", load(spark, folder, "heldout_items"), "item_id", "question")


@query
def p4_leaks_per_item(spark: SparkSession, folder: str) -> DataFrame:
    return p4_found(spark, folder).groupBy("corpus", "item_id").agg(F.count(F.lit(1)).alias("train_rows"))


@query
def p4_verified(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p4_found with the item's gold answers, as far as runs of predictions have them."""
    gold = load(spark, folder, "predictions").select(F.col("id").alias("qid"), F.explode("ground_truth").alias("a")).distinct()  # before lists are made
    gold = gold.groupBy("qid").agg(F.collect_list("a").alias("answers"))  # as many as a question has different answers
    items = load(spark, folder, "heldout_items").join(gold, "qid", "left")
    return leakage.leaked_items(_prompts(spark, folder), ["corpus", "train_row"], "prompt", items, "item_id", "question", answers="answers")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda name, table: load(spark, folder, table).select("row_id", "split", "question", F.lit(name).alias("source"))
    return one("webqsp", "rog_webqsp").unionByName(one("cwq", "rog_cwq"))


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    split = F.col("split")
    return split_overlap.cross_split_pairs(_questions(spark, folder), "row_id", "question", split == "train", split.isin("validation", "test"))


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select(F.least("row_train", "row_held").alias("row_a"), F.greatest("row_train", "row_held").alias("row_b"))


@query
def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    tags = _questions(spark, folder).select("row_id", "split", "source")
    held = tags.select(F.col("row_id").alias("row_held"), F.col("split").alias("held_split"), F.col("source").alias("held_source"))
    train = tags.select(F.col("row_id").alias("row_train"), F.col("source").alias("train_source"))
    return (
        _overlaps(spark, folder)
        .join(held, "row_held")
        .join(train, "row_train")
        .groupBy("held_source", "held_split", "train_source")
        .agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("row_held").alias("held_rows"), F.countDistinct("row_train").alias("train_rows"))
    )


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_texts(load(spark, folder, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, folder: str, of_all: float | None = None) -> mixing.Mix:
    return mixing.Mix(load(spark, folder, "documents"), load(spark, folder, "mix_targets"), of_all=of_all)


@query
def p9_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).documents()


@query
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).shares()


@query
def p9_larger_shares(spark: SparkSession, folder: str) -> DataFrame:
    """A mix twice as large as all its sources: scarce ones stop at their caps and fall short of their targets."""
    return _mix(spark, folder, 2.0).shares()


@query
def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every source in both mixes, read off their rows."""
    one = lambda size, of_all: _mix(spark, folder, of_all).checks().select(F.lit(size).alias("size"), "*")
    return one("all shares met", None).unionByName(one("twice all", 2.0))


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages.stuffed_pages(load(spark, folder, "documents"), load(spark, folder, "page_labels"))


@query
def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages.stuffed_shares(load(spark, folder, "documents"), load(spark, folder, "page_labels"))
