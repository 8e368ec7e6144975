"""Triples and graphs: a question's own graph (one relation per pair of nodes) and the global one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.words import stripped


def is_mediator(name: Column) -> Column:
    """Whether a node is a coded one (``m.`` or ``g.``) that only links others."""
    return name.startswith("m.") | name.startswith("g.")


def valid_steps(graph: Column) -> Column:
    """The valid triples of a graph column, stripped, in order; null for null."""
    steps = F.transform(graph, lambda x: F.struct(stripped(x["h"]).alias("h"), stripped(x["r"]).alias("r"), stripped(x["t"]).alias("t")))
    return F.filter(steps, lambda x: (x["h"] != "") & (x["r"] != "") & (x["t"] != ""))


def entity_list(names: Column) -> Column:
    """Names stripped, null and blank ones left out; an empty list for null."""
    return F.coalesce(F.filter(F.transform(names, stripped), lambda x: x != ""), F.array().cast("array<string>"))


def start_entities(names: Column) -> Column:
    """As entity_list, each name once, in order."""
    return F.array_distinct(entity_list(names))


def triples(rows: DataFrame, key: str, graph: str = "graph") -> DataFrame:
    """``(qid, seq, h, r, t)``: the valid triples with their place in the row's graph."""
    return (
        rows.select(F.col(key).alias("qid"), F.posexplode(graph).alias("seq", "g"))
        .select("qid", "seq", *(stripped(F.col("g")[c]).alias(c) for c in "hrt"))
        .where("h <> '' AND r <> '' AND t <> ''")
    )


def last_wins(steps: DataFrame) -> DataFrame:
    """``(qid, h, r, t)`` of a triples table: of triples with equal h and t the last one holds."""
    return steps.groupBy("qid", "h", "t").agg(F.max_by("r", "seq").alias("r")).select("qid", "h", "r", "t")


def last_wins_undirected(steps: DataFrame) -> DataFrame:
    """As last_wins per unordered pair, in both directions."""
    kept = steps.groupBy("qid", F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b")).agg(F.max_by(F.struct("h", "r", "t"), "seq").alias("s"))
    one = kept.select("qid", "s.h", "s.r", "s.t")
    return one.unionByName(one.where("h <> t").select("qid", F.col("t").alias("h"), "r", F.col("h").alias("t")))


def distinct_triples(*sources: DataFrame) -> DataFrame:
    """``(h, r, t)`` of all sources, each once."""
    out = sources[0].select("h", "r", "t")
    for s in sources[1:]:
        out = out.unionByName(s.select("h", "r", "t"))
    return out.distinct()


def collapse_mediators(kg: DataFrame) -> DataFrame:
    """``(h, r, t, created)``: for h -> mediator -> t an edge ``r1-r2`` besides what is there.

    ``kg`` holds each triple once (distinct_triples).  Both ends must be named.  ``created`` tells the
    edges that were not there before.  The join runs on mediators only, and those link few nodes
    each; a made edge can only be there already under a relation with a hyphen, so no more of the
    graph than that is compared."""
    into = kg.where(is_mediator(F.col("t")) & ~is_mediator(F.col("h"))).select(F.col("h"), F.col("r").alias("r1"), F.col("t").alias("m"))
    out_of = kg.where(is_mediator(F.col("h")) & ~is_mediator(F.col("t"))).select(F.col("h").alias("m"), F.col("r").alias("r2"), F.col("t"))
    made = into.join(out_of, "m").select("h", F.concat_ws("-", "r1", "r2").alias("r"), "t").distinct()
    fresh = made.join(kg.where(F.contains("r", F.lit("-"))).select("h", "r", "t"), ["h", "r", "t"], "left_anti")
    return kg.select("h", "r", "t", F.lit(False).alias("created")).unionByName(fresh.withColumn("created", F.lit(True)))


def named_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends are both named; chains of mediators are lost."""
    return edges.where(~is_mediator(F.col("h")) & ~is_mediator(F.col("t")))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("h <> t")


def clean_graph(kg: DataFrame) -> DataFrame:
    """``(h, r, t)``: distinct triples with mediators collapsed and removed, without self loops."""
    return without_loops(named_edges(collapse_mediators(kg))).select("h", "r", "t")


def knowledge_graph(*sources: DataFrame, collapse_per_source: bool = False) -> DataFrame:
    """``(h, r, t)``: the global graph: clean_graph of the distinct triples of all sources.

    ``collapse_per_source`` collapses each source by itself before the union, as a load of one
    data set after another does."""
    if collapse_per_source and len(sources) > 1:
        return distinct_triples(*(clean_graph(distinct_triples(s)) for s in sources))
    return clean_graph(distinct_triples(*sources))


def entities(kg: DataFrame) -> DataFrame:
    return kg.select(F.explode(F.array("h", "t")).alias("entity")).distinct()


def graph_stats(kg: DataFrame, clean: DataFrame) -> DataFrame:
    """``(n_entities, n_relations, n_edges)``: named nodes count even if they lost all their edges."""
    nodes = entities(kg).where(~is_mediator(F.col("entity"))).agg(F.count(F.lit(1)).alias("n_entities"))
    rest = clean.agg(F.count_distinct("r").alias("n_relations"), F.count(F.lit(1)).alias("n_edges"))
    return nodes.crossJoin(rest)  # one row each


def branching_edges(kg: DataFrame, least: int = 2) -> DataFrame:
    """``(h, r, t, degree)``: the edges of nodes with at least ``least`` of them."""
    degree = kg.groupBy("h").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)
    return kg.join(degree, "h").select("h", "r", "t", "degree")


def related_relations(kg: DataFrame, wanted: DataFrame, direction: str = "out") -> DataFrame:
    """``(entity, r)``: the distinct relations at each wanted entity; another direction gives none."""
    end = {"out": "h", "in": "t"}.get(direction)
    if end is None:
        return wanted.select("entity", F.lit(None).cast("string").alias("r")).limit(0)
    return wanted.select("entity").distinct().join(kg, F.col("entity") == kg[end]).select("entity", "r").distinct()


def target_entities(kg: DataFrame, wanted: DataFrame, direction: str = "out") -> DataFrame:
    """``(entity, r, target)`` for the wanted ``(entity, r)``; another direction gives none."""
    ends = {"out": ("h", "t"), "in": ("t", "h")}.get(direction)
    if ends is None:
        return wanted.select("entity", "r", F.lit(None).cast("string").alias("target")).limit(0)
    edges = kg.select(F.col(ends[0]).alias("entity"), "r", F.col(ends[1]).alias("target"))
    return wanted.select("entity", "r").distinct().join(edges, ["entity", "r"]).distinct()


def mediator_groups(steps: DataFrame) -> DataFrame:
    """``(qid, h, r, structure, members, representative)``: mediators that one relation of a node leads
    to and whose outgoing edges are the same, as one group with its smallest as representative."""
    out = steps.where(is_mediator(F.col("h"))).groupBy("qid", F.col("h").alias("m")).agg(
        F.array_join(F.sort_array(F.collect_set(F.concat_ws("=>", "r", "t"))), "; ").alias("structure")
    )
    reached = steps.where(is_mediator(F.col("t"))).select("qid", "h", "r", F.col("t").alias("m")).distinct()
    return (
        reached.join(out, ["qid", "m"], "left")
        .groupBy("qid", "h", "r", F.coalesce("structure", F.lit("")).alias("structure"))
        .agg(F.count(F.lit(1)).alias("members"), F.min("m").alias("representative"))
    )


def deduplicated_expansions(paths: DataFrame, keys: list[str], merged: str) -> DataFrame:
    """One row for each of ``keys`` with the sorted distinct values of the list column ``merged``."""
    return paths.select(*keys, F.explode_outer(merged).alias("x")).groupBy(*keys).agg(F.sort_array(F.collect_set("x")).alias(merged))


def numbered_nodes(steps: DataFrame) -> DataFrame:
    """``(qid, node, number)``: the nodes of a question's edges in the order they first stand there."""
    seen = steps.select("qid", F.posexplode(F.array("h", "t")).alias("side", "node"), "seq")
    first = seen.groupBy("qid", "node").agg(F.min(F.col("seq") * 2 + F.col("side")).alias("first"))
    return first.select("qid", "node", (F.row_number().over(Window.partitionBy("qid").orderBy("first")) - 1).alias("number"))


def joined_walks(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """``(qid, hops, path)``: the set of walks of 1 to ``hops`` steps from ``starts(qid, at)``, by one join a hop.

    For graphs too large for a row; small ones are searched in their row (:mod:`walks`)."""
    e = edges.select("qid", F.col("h").alias("at"), F.struct("h", "r", "t").alias("step"))
    level = starts.select("qid", "at").distinct().join(e, ["qid", "at"]).select("qid", F.array("step").alias("path"))
    out = level.withColumn("hops", F.lit(1))
    for k in range(2, hops + 1):
        level = level.withColumn("at", F.element_at("path", -1)["t"]).join(e, ["qid", "at"]).select("qid", F.concat("path", F.array("step")).alias("path"))
        out = out.unionByName(level.withColumn("hops", F.lit(k)))
    return out.select("qid", "hops", "path")
