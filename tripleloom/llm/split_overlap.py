"""The same or nearly the same question in the evaluation and the training split.

An exact prefix-filter join of word sets.  Words are ordered from rare to frequent; two sets
whose Jaccard similarity reaches the threshold must share a word among the first few of each.
Length and position filters drop many pairs before the exact check, and signatures of 64 bits nearly
all that are left: each word not shared turns at most one bit.  Equal sets are joined once, however
many rows hold them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.words import words
from tripleloom.session import cut_lineage

#: Word counts are gathered in this many buckets, so what is broadcast never grows beyond them.
BUCKETS = 65_536


def word_sets(rows: DataFrame, row: str, question: str, train: Column, held_out: Column) -> DataFrame:
    """``(row, sid, key, train, held_out)``: rows of either side; ``key`` is the sorted set of words,
    ``sid`` its digest, which stands for it wherever the words themselves aren't needed."""
    key = F.array_join(F.sort_array(F.array_distinct(words(F.col(question)))), " ")
    narrow = rows.select(F.col(row).alias("row"), key.alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return narrow.where((F.col("key") != "") & (F.col("train") | F.col("held_out"))).withColumn("sid", F.unhex(F.md5("key")))


def _ranked(rows: DataFrame) -> DataFrame:
    """``(sid, train, held_out, n, ws, sig)``: the distinct sets, their words from rare to frequent, and their
    signature: the exclusive or of one bit a word."""
    sets = rows.groupBy("sid").agg(F.max("train").alias("train"), F.max("held_out").alias("held_out"), F.any_value("key").alias("key"))
    apart = sets.select("sid", "train", "held_out", F.explode(F.split("key", " ")).alias("w")).withColumn("b", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int"))
    counts = apart.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    # at most BUCKETS rows are broadcast; grouping by sid needs no further shuffle
    return (
        apart.join(F.broadcast(counts), "b")
        .groupBy("sid", "train", "held_out")
        .agg(F.sort_array(F.collect_list(F.struct("c", "b", "w"))).alias("o"), F.bit_xor(F.expr("shiftleft(1L, b % 64)")).alias("sig"))
        .select("sid", "train", "held_out", F.size("o").alias("n"), F.col("o.w").alias("ws"), "sig")
    )


def _near(ranked: DataFrame, threshold: Fraction) -> DataFrame:
    """``(t_sid, h_sid)``: the pairs that the filters leave, all similar ones among them.

    The signature is compared in the join, before a pair is moved: pairs that only share a word
    grow with the square of the rows, those that pass hardly more than the similar ones."""
    num, den = threshold.numerator, threshold.denominator
    prefix = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1  # at least one word is looked at

    def index(name: str) -> DataFrame:
        s = name[0]
        return ranked.where(F.col(name)).select(F.col("sid").alias(f"{s}_sid"), F.col("n").alias(f"{s}_n"), F.col("sig").alias(f"{s}_sig"), F.posexplode(F.slice("ws", 1, prefix)).alias(f"{s}_i", "w"))

    t_n, h_n, t_i, h_i = (F.col(c) for c in ("t_n", "h_n", "t_i", "h_i"))
    lengths = (h_n * den >= t_n * num) & (t_n * den >= h_n * num)
    most = F.least(t_i, h_i) + F.least(t_n - t_i, h_n - h_i)
    position = most * (num + den) >= (t_n + h_n) * num
    apart = F.bit_count(F.col("t_sig").bitwiseXOR(F.col("h_sig"))) * (num + den) <= (t_n + h_n) * (den - num)
    return index("train").join(index("held_out"), "w").where(lengths & apart & position).select("t_sid", "h_sid").distinct()


def similar_sets(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """``(t_sid, h_sid)``: pairs of word sets, one of each side, that reach the threshold.

    The index holds digests, signatures and places only; the words come back for the pairs that are
    left, so a text of any length adds as much as it is long."""
    num, den = threshold.numerator, threshold.denominator
    ranked = cut_lineage(_ranked(rows))  # read four times below

    def content(name: str) -> DataFrame:
        s = name[0]
        return ranked.where(F.col(name)).select(F.col("sid").alias(f"{s}_sid"), F.col("ws").alias(f"{s}_ws"))

    both = _near(ranked, threshold).join(content("train"), "t_sid").join(content("held_out"), "h_sid")
    overlap = F.size(F.array_intersect("t_ws", "h_ws"))
    return both.where(overlap * (num + den) >= (F.size("t_ws") + F.size("h_ws")) * num).select("t_sid", "h_sid")


def cross_split_pairs(rows: DataFrame, row: str, question: str, train: Column, held_out: Column, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``(row_train, row_held)``: every pair of a training and a held-out row whose questions, as sets
    of words, have at least ``threshold`` of their joint words in common.

    Null and blank questions, and those without a letter or digit, never count.  Rows that hold
    the same question come out each with each, as every pair is asked for; a row in neither
    split is left out.  Other columns are ignored.
    """
    sets = word_sets(rows, row, question, train, held_out)
    pairs = similar_sets(sets, threshold)
    t = sets.where("train").select(F.col("sid").alias("t_sid"), F.col("row").alias("row_train"))
    h = sets.where("held_out").select(F.col("sid").alias("h_sid"), F.col("row").alias("row_held"))
    return pairs.join(t, "t_sid").join(h, "h_sid").select("row_train", "row_held")
