"""Per-key aggregation when a few keys hold most of the rows.

Two stages: heavy keys get a random salt, partial results are computed per (key, salt), and
the partials are merged by key.  Light keys keep the one salt 0, so they cost nothing extra.
Which keys are heavy is found with a sketch of fixed size, never by collecting keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.words import stripped
from tripleloom.session import spread


@dataclass(frozen=True)
class Merged:
    """An aggregate that splits: ``part`` per salt, ``merge`` over the parts' column."""

    name: str
    part: Column
    merge: str = "sum"

    def merged(self) -> Column:
        return getattr(F, self.merge)(F.col(self.name)).alias(self.name)


def count_rows(name: str = "n") -> Merged:
    return Merged(name, F.count(F.lit(1)))


def heavy_keys(df: DataFrame, key: str, share: float, tracked: int = 10_000) -> list:
    """Keys that may hold ``share`` of the rows, at most ``2 / share`` of them.

    The sketch tracks ``tracked`` items whatever the input's size; its counts may be off by
    about ``3 / tracked`` of the rows, so keys are taken from half the share on.  The list
    only decides which keys get salted; results do not depend on it.
    """
    k = max(1, min(int(2 / share), tracked // 2))
    row = df.where(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("top")
    ).first()
    return [t["item"] for t in row["top"] or [] if t["count"] >= row["n"] * share / 2]


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Merged],
    heavy_on: str | None = None,
    heavy_share: float = 0.02,
    salts: int = 32,
) -> DataFrame:
    """``df.groupBy(keys).agg(aggregates)`` without one task getting a heavy key's rows.

    ``heavy_on`` is the key column whose heavy values are salted (the last of ``keys`` unless
    given).  Null keys form a group like any other; that group is salted too.  An empty table
    gives an empty result.  Columns other than the keys and those in ``aggregates`` are ignored,
    whatever their names.
    """
    heavy_on = heavy_on or keys[-1]
    heavy = heavy_keys(df, heavy_on, heavy_share)
    salted = F.col(heavy_on).isNull()
    if heavy:
        salted = salted | F.col(heavy_on).isin(heavy)
    salt = "__salt"
    while salt in df.columns:
        salt += "_"
    parts = (
        df.withColumn(salt, F.when(salted, F.floor(F.rand(17) * salts)).otherwise(F.lit(0)).cast("int"))
        .groupBy(*keys, salt)
        .agg(*(a.part.alias(a.name) for a in aggregates))
    )
    return parts.groupBy(*keys).agg(*(a.merged() for a in aggregates))


def entity_loads(rows: DataFrame, entities: str = "q_entity", graph: str = "graph") -> DataFrame:
    """``(field, entity, n, total)``: in how many rows an entity stands in ``entities`` (once a
    row), and of how many valid triples of ``graph`` it is the head.  ``total``: all rows, or all
    valid triples.

    Null and empty lists, null, blank and padded members are allowed: names are stripped and
    blanks left out.  A triple is valid if h, r and t are all non-blank; repeats count.
    """
    names = F.array_distinct(F.filter(F.transform(F.col(entities), stripped), lambda x: x != ""))
    heads = F.transform(
        F.filter(F.col(graph), lambda x: (stripped(x["h"]) != "") & (stripped(x["r"]) != "") & (stripped(x["t"]) != "")),
        lambda x: stripped(x["h"]),
    )
    narrow = spread(rows.select(entities, graph)).select(names.alias("names"), heads.alias("heads"))
    pairs = narrow.select(
        F.explode(
            F.concat(
                F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.struct(F.lit("q_entity").alias("field"), x.alias("entity"))),
                F.transform(F.coalesce("heads", F.array().cast("array<string>")), lambda x: F.struct(F.lit("graph").alias("field"), x.alias("entity"))),
            )
        ).alias("p")
    ).select("p.field", "p.entity")
    counts = salted_aggregate(pairs, ["field", "entity"], [count_rows()])
    # every valid triple has one head, so the triples follow from the counts, whose exchange is used again
    triples = counts.agg(F.coalesce(F.sum(F.when(F.col("field") == "graph", F.col("n"))), F.lit(0)).alias("triples"))
    totals = triples.crossJoin(rows.agg(F.count(F.lit(1)).alias("rows")))  # one row each
    return counts.crossJoin(F.broadcast(totals)).select(  # one row of totals
        "field", "entity", "n", F.when(F.col("field") == "graph", F.col("triples")).otherwise(F.col("rows")).alias("total")
    )


def heavy_entities(rows: DataFrame, share: float = 0.03, entities: str = "q_entity", graph: str = "graph") -> DataFrame:
    """``(field, entity)`` with at least ``share`` of the rows or valid triples; see entity_loads."""
    return entity_loads(rows, entities, graph).where(F.col("n") >= F.lit(Decimal(str(share))) * F.col("total")).select("field", "entity")
