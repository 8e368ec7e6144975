"""Token prefixes: which tokens may follow a prefix of the allowed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.binding import let

#: The marks around a path, the end of a sequence, the separator of prefix tokens.
OPEN, CLOSE, END, JOIN = "<PATH>", "</PATH>", "</s>", " "


def tokens(text: Column, marked: bool = False) -> Column:
    """White-space tokens of a text with the end mark; ``marked``: between the path marks."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.concat(F.array(F.lit(OPEN)), words, F.array(F.lit(CLOSE), F.lit(END))) if marked else F.concat(words, F.array(F.lit(END)))


def build(sequences: DataFrame, column: str) -> DataFrame:
    """``(prefix, next)``: each step of each sequence once, ``prefix`` being its tokens joined."""
    def steps(t: Column) -> Column:
        prefix = lambda i: F.when(i > 0, F.array_join(F.slice(t, F.lit(1), F.greatest(i, F.lit(1))), JOIN)).otherwise("")
        return F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.struct(prefix(i).alias("prefix"), F.get(t, i).alias("next")))

    return sequences.where(F.size(column) > 0).select(F.inline(let(F.col(column), steps))).distinct()


def allowed(trie: DataFrame, asked: DataFrame) -> DataFrame:
    """``(prefix, next)`` for the asked prefixes; an unknown one has no row."""
    return asked.select("prefix").distinct().join(trie, "prefix")


def appended(trie: DataFrame, other: DataFrame, begin: str) -> DataFrame:
    """``trie`` in which ``begin`` may also be followed by what ``other`` allows at its root."""
    below = F.when(F.col("prefix") == "", F.lit(begin)).otherwise(F.concat_ws(JOIN, F.lit(begin), F.col("prefix")))
    return trie.unionByName(other.select(below.alias("prefix"), "next")).distinct()


def sizes(sequences: DataFrame, column: str) -> DataFrame:
    """``(inserted, distinct)``: the sequences with repetitions and without."""
    return sequences.agg(F.count(F.lit(1)).alias("inserted"), F.count_distinct(column).alias("distinct"))


def constrained_prefix(ids: Column, start: str = OPEN, end: str = CLOSE) -> Column:
    """The tokens from the last ``start`` on if no ``end`` comes after it, else null: then all tokens are allowed."""
    back = F.reverse(ids)
    first = F.array_position(back, F.lit(start))
    stop = F.array_position(back, F.lit(end))
    return F.when((first > 0) & ((stop == 0) | (stop > first)), F.array_join(F.slice(ids, (F.size(ids) - first + 1).cast("int"), F.greatest(first.cast("int"), F.lit(1))), JOIN))


def gate(states: DataFrame, key: str, ids: str, trie: DataFrame) -> DataFrame:
    """``(<key>, constrained, next)``: what each state may emit; ``next`` is null where all tokens may come,
    unconstrained or because the prefix allows none."""
    s = states.select(key, constrained_prefix(F.col(ids)).alias("prefix"))
    return s.join(trie, "prefix", "left").select(key, F.col("prefix").isNotNull().alias("constrained"), "next")


def gate_sizes(states: DataFrame, key: str, ids: str, trie: DataFrame) -> DataFrame:
    """``(<key>, constrained, n)``: how many tokens gate gives each state; 0 where all may come.

    The tokens are counted once a prefix, so that a third of all states at the root don't meet all that may begin there."""
    s = states.select(key, constrained_prefix(F.col(ids)).alias("prefix")).groupBy(key, "prefix").agg(F.count(F.lit(1)).alias("c"))
    sizes = trie.groupBy("prefix").agg(F.count("next").alias("size"))
    n = F.coalesce("size", F.lit(0)) * F.col("c")
    return s.join(sizes, "prefix", "left").select(key, F.col("prefix").isNotNull().alias("constrained"), n.alias("n"))


def free(asked: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(prefix, next)``: the stand-in that allows the same given tokens after every asked prefix."""
    return asked.select("prefix").distinct().select("prefix", F.explode(F.array(*map(F.lit, sorted(set(vocabulary))))).alias("next"))


def staged(asked: DataFrame, tokens: str, vocabulary: list[str], end_mention: str, start_entity: str, end_entity: str, start_mention: str, end: str = END) -> DataFrame:
    """``(<tokens>, next)``: the stand-in for mentions with an entity: nothing said, the mention must end; one
    token, the entity must begin; after the entity's end the text ends; else any token but the three marks."""
    free_tokens = sorted(set(vocabulary) - {start_mention, end_mention, start_entity})
    n = F.size(tokens)
    only = F.when((n > 0) & (F.element_at(tokens, -1) == end_entity), end).when(n == 0, end_mention).when(n == 1, start_entity)
    return asked.select(tokens, F.explode(F.when(only.isNotNull(), F.array(only)).otherwise(F.array(*map(F.lit, free_tokens)))).alias("next"))


def fixed(spark: SparkSession, sequences: list[list[str]]) -> DataFrame:
    """A trie of a few given sequences, as stand-in for an index."""
    return build(spark.createDataFrame([(s,) for s in sequences], "s array<string>"), "s")
