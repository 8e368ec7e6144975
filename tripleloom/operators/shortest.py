"""All shortest paths between pairs of nodes of the global graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.paths import PATH_TYPE
from tripleloom.session import cut_lineage


def shortest_paths(kg: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """``(s, t, path)``: every shortest path of 1 to ``max_depth`` steps for each distinct pair ``(s, t)``.

    Level by level; a pair leaves once it is joined.  Each open trail is lengthened at the end
    where fewer edges stand, so a hub at one end is never expanded when the other end is
    small; the last step is a join on both ends.  Parallel relations give paths of their own.
    Equal, null or blank ends and a depth below 1 give none.
    """
    pairs = pairs.select("s", "t").where("s <> t AND s <> '' AND t <> ''").distinct()
    empty = F.array().cast(PATH_TYPE)
    found = None
    trails = pairs.select("s", "t", F.col("s").alias("a"), F.col("t").alias("b"), empty.alias("left"), empty.alias("right"))
    if max_depth < 1:
        return trails.select("s", "t", empty.alias("path")).limit(0)
    edges = cut_lineage(kg.select("h", "r", "t").distinct())  # read four times a level
    out_degree = edges.groupBy(F.col("h").alias("a")).agg(F.count(F.lit(1)).alias("out"))
    in_degree = edges.groupBy(F.col("t").alias("b")).agg(F.count(F.lit(1)).alias("into"))
    e = edges.select(F.col("h").alias("e_h"), F.col("r").alias("e_r"), F.col("t").alias("e_t"))
    step = F.array(F.struct(F.col("e_h").alias("h"), F.col("e_r").alias("r"), F.col("e_t").alias("t")))
    for depth in range(1, max_depth + 1):
        ended = trails.join(e, (F.col("a") == F.col("e_h")) & (F.col("b") == F.col("e_t"))).select("s", "t", F.concat("left", step, "right").alias("path"))
        if depth < max_depth:
            ended = cut_lineage(ended)
        found = ended if found is None else found.unionByName(ended)
        if depth == max_depth:
            break
        rest = trails.join(ended.select("s", "t").distinct(), ["s", "t"], "left_anti").join(out_degree, "a").join(in_degree, "b")
        rest = cut_lineage(rest)  # read twice below
        forward = rest.where("out <= into").join(e, F.col("a") == F.col("e_h")).select("s", "t", F.col("e_t").alias("a"), "b", F.concat("left", step).alias("left"), "right")
        backward = rest.where("out > into").join(e, F.col("b") == F.col("e_t")).select("s", "t", "a", F.col("e_h").alias("b"), "left", F.concat(step, "right").alias("right"))
        trails = forward.unionByName(backward)
    return found
