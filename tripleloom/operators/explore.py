"""The relational part of iterative exploration: rounds over a frontier of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.session import cut_lineage

Selector = Callable[[DataFrame, int], DataFrame]


def first_by_name(options: DataFrame, k: int) -> DataFrame:
    """A selector that needs no model: the first ``k`` relations by name."""
    w = Window.partitionBy("qid", "entity").orderBy("r")
    return options.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


#: A selector that doesn't look at the question says so: then it is asked once for each node.
first_by_name.per_node = True


def chosen_relations(frontier: DataFrame, kg: DataFrame, k: int, selector: Selector = first_by_name) -> DataFrame:
    """``(qid, entity, r)``: the relations a round follows from ``frontier(qid, entity)``: all of a node that has
    at most ``k``, else those the selector takes.

    Relations are counted per node, not per question, and only nodes of the frontier are looked at.  A
    selector with ``per_node`` set gets each node once, with a null question; others get each node's
    relations for each question that stands there."""
    asked = frontier.select("qid", "entity").distinct()
    relations = kg.select(F.col("h").alias("entity"), "r").distinct().join(asked.select("entity").distinct(), "entity", "left_semi")
    counted = relations.join(relations.groupBy("entity").agg(F.count(F.lit(1)).alias("m")), "entity")
    few, many = counted.where(F.col("m") <= k).select("entity", "r"), counted.where(F.col("m") > k).select("entity", "r")
    if getattr(selector, "per_node", False):
        nobody = many.select(F.lit(None).cast(dict(asked.dtypes)["qid"]).alias("qid"), "entity", "r")
        return asked.join(few.unionByName(selector(nobody, k).select("entity", "r")), "entity").select("qid", "entity", "r")
    ask = lambda some: asked.join(some, "entity").select("qid", "entity", "r")
    return ask(few).unionByName(selector(ask(many), k).select("qid", "entity", "r"))


def round_targets(chosen: DataFrame, kg: DataFrame) -> DataFrame:
    """``(entity, r, t)``: what the chosen relations lead to, once for each node however many questions stand there."""
    edges = kg.select(F.col("h").alias("entity"), "r", "t").distinct()
    return edges.join(chosen.select("entity", "r").distinct(), ["entity", "r"], "left_semi")


def expansion_round(frontier: DataFrame, kg: DataFrame, k: int, selector: Selector = first_by_name) -> DataFrame:
    """``(qid, entity, r, t)``: chosen_relations with their targets for every question; relations without
    targets are skipped.  Where hubs are asked often, chosen_relations and round_targets say the same in
    fewer rows."""
    chosen = chosen_relations(frontier, kg, k, selector)
    return chosen.join(kg.select(F.col("h").alias("entity"), "r", "t").distinct(), ["entity", "r"]).select("qid", "entity", "r", "t")


def explore(starts: DataFrame, kg: DataFrame, answers: DataFrame, rounds: int, k: int, selector: Selector = first_by_name) -> DataFrame:
    """``(qid, round, entity, r, t)``: rounds until an answer ``(qid, t)`` is seen or ``rounds`` are over.

    The next frontier is what was seen and not visited.  The graph and each round are written once, so
    a lost executor costs one round at most."""
    kg = cut_lineage(kg.select("h", "r", "t").distinct())
    frontier, visited, trace = starts.select("qid", "entity").distinct(), None, None
    for n in range(1, rounds + 1):
        seen = cut_lineage(expansion_round(frontier, kg, k, selector).withColumn("round", F.lit(n)))
        trace = seen if trace is None else trace.unionByName(seen)
        if n == rounds:
            break
        visited = frontier if visited is None else visited.unionByName(frontier)
        answered = seen.join(answers, ["qid", "t"], "left_semi").select("qid").distinct()
        onward = seen.select("qid", F.col("t").alias("entity")).distinct()
        frontier = cut_lineage(onward.join(answered, "qid", "left_anti").join(visited, ["qid", "entity"], "left_anti"))
        if frontier.isEmpty():
            break
    return trace.select("qid", "round", "entity", "r", "t")


def selected_items(items: Column, candidates: Column, most: int, fallback: bool = False) -> Column:
    """The items that are candidates, each once in order, at most ``most``; with ``fallback`` the first
    candidates where none is left."""
    kept = F.slice(F.filter(F.array_distinct(items), lambda x: F.array_contains(candidates, x)), 1, most)
    return F.when((F.size(kept) == 0) & F.lit(fallback), F.slice(candidates, 1, most)).otherwise(kept)
