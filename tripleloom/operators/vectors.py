"""Nearest keys by inner product or cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.vectors import cosine


#: Each block of queries goes through the driver and over all keys once; more queries than this is an error.
MOST_QUERIES = 500_000


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """The stated queries in blocks of about ``block``: what is sent out stays bounded."""
    q = queries.where(F.col("v").isNotNull()).select("query", "v")
    n = q.count()
    if n > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    blocks = max(1, -(-n // block))
    for i in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)).collect()  # each block is run
        yield [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


class _Scores:
    """``(query, key, score)`` triples of one partition, kept as arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, key, score))

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*self.parts))

    def best(self, k: int) -> None:
        """Keeps the best ``k`` of each query; ties go to the smaller key."""
        if not self.parts:
            return
        query, key, score = self.joined()
        order = np.lexsort((np.unique(key, return_inverse=True)[1], -score, query))
        query = query[order]
        begins = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(query)]])))
        order = order[rank < k]
        self.parts = [(query[rank < k], key[order], score[order])]


#: Keys scored at a time, and triples held before a partition's best are picked again.
ROWS, HELD = 1000, 500_000


def _against(keys: DataFrame, queries: DataFrame, metric: str, block: int, k: int | None, least: float = -np.inf) -> DataFrame:
    """``(query, key, score)``: every block of queries against every key in matrix products.

    Of each product only scores that may be among the best ``k`` of their query so far, or are at
    least ``least``, leave the matrix."""
    kinds = dict(keys.dtypes)["key"], dict(queries.dtypes)["query"]

    def scorer(names: list, q: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        q = _unit(q) if metric == "cosine" and names else q

        def frame(found: _Scores) -> pd.DataFrame:
            query, key, score = found.joined()
            return pd.DataFrame({"query": np.array(names, dtype=object)[query], "key": key, "score": score})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found, held, border = _Scores(), 0, np.full(len(names), -np.inf)
            for b in batches:
                for start in range(0, len(b) if names else 0, ROWS):
                    part = b.iloc[start : start + ROWS]
                    m = np.array(part["v"].tolist(), dtype=np.float64)
                    s = np.nan_to_num(np.round((_unit(m) if metric == "cosine" else m) @ q.T, 9), nan=-np.inf)
                    if k is None:
                        row, query = np.nonzero(s >= least)
                    else:
                        if len(s) > k:
                            border = np.maximum(border, np.partition(s, len(s) - k, axis=0)[len(s) - k])
                        row, query = np.nonzero(s >= border)
                    found.add(query, part["key"].to_numpy()[row], s[row, query])
                    held += len(row)
                    if held > HELD:
                        if k is None:
                            yield frame(found)
                            found, held = _Scores(), 0
                        else:
                            found.best(k)
                            held = len(found.parts[0][0])
            if k is not None:
                found.best(k)
            if found.parts:
                yield frame(found)

        return run

    out = None
    narrow = keys.where(F.col("v").isNotNull()).select("key", "v")
    for names, q in _blocks(queries, block):
        found = narrow.mapInPandas(scorer(names, q), f"query {kinds[1]}, key {kinds[0]}, score double")
        out = found if out is None else out.unionByName(found)
    return out


def top_k(keys: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 2000) -> DataFrame:
    """``(query, key, score, rank)`` of ``queries(query, v)`` against all ``keys(key, v)``.

    A partition keeps its best ``k`` per query.  Scores are rounded to 9 places, ties go to the
    smaller key.  Null vectors take no part."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return _against(keys, queries, metric, block, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def alike(keys: DataFrame, queries: DataFrame, least: float, metric: str = "cosine", block: int = 2000) -> DataFrame:
    """``(query, key, score)`` of all pairs whose score is at least ``least``; see top_k."""
    return _against(keys, queries, metric, block, None, least)


def ranked_relations(edges: DataFrame, relations: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, h, r, score, rank)``: the ``k`` relations of each asked node nearest to the question.

    ``queries(qid, h, q)``, ``relations(r, v)``; only a node's own relations are scored."""
    own = queries.join(edges.select("h", "r").distinct(), "h").join(relations, "r")
    scored = own.select("qid", "h", "r", F.round(cosine(F.col("q"), F.col("v")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "h").orderBy(F.desc("score"), "r"))).where(F.col("rank") <= k)


def confusable_pairs(edges: DataFrame, relations: DataFrame, least: float) -> DataFrame:
    """``(h, r1, r2, score)``: pairs of relations of one node, with different targets, whose vectors are
    at least ``least`` alike.

    Similar relations are paired once for the whole graph; nodes then only look their own
    pairs up, so a hub's edges are never paired with each other."""
    named = relations.select(F.col("r").alias("query"), "v")
    near = alike(named.withColumnRenamed("query", "key"), named, least, "ip")
    near = near.where("query < key").select(F.col("query").alias("r1"), F.col("key").alias("r2"), "score")
    span = edges.groupBy("h", "r").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    one, two = span.select("h", F.col("r").alias("r1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1")), span.select("h", F.col("r").alias("r2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # some pair of targets differs unless each side has the one same target
    return one.join(near, "r1").join(two, ["h", "r2"]).where(~((F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2")))).select("h", "r1", "r2", "score")


def encode(names: DataFrame, name: str, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``(key, v)``: every distinct, non-blank name once with its vector; ``encoder`` maps a list of names
    to a matrix and may be any model, loaded once per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["key"].tolist()
            if keys:
                yield pd.DataFrame({"key": keys, "v": [r.tolist() for r in np.asarray(encoder(keys), dtype=np.float32)]})

    keys = names.select(F.trim(name).alias("key")).where("key <> ''").distinct()
    return keys.mapInPandas(run, "key string, v array<float>")


def hashed_words(names: list[str], size: int = 64) -> np.ndarray:
    """An encoder that needs no model: words hashed into a vector of unit length."""
    import hashlib

    out = np.zeros((len(names), size))
    for row, n in zip(out, names):
        for w in n.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            row[h % size] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
