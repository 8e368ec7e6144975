"""Mixing sources to target shares of all tokens, with capped repetition.

Tokens are counted per source; a source's rate is its share of the mix's size over its tokens,
and never above its cap.  Each document comes out ``floor(rate)`` times, and once more if a hash
of its id falls below the rate's fraction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.byte_bpe import TOKENIZER, count_tokens
from tripleloom.session import cut_lineage

#: The targets are a setting, not data; more of them than this is an error.
MOST_TARGETS = 10_000
STEPS = 1 << 40


@dataclass(frozen=True)
class Rate:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    rate: float


def repetition_rates(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: float | None = None) -> list[Rate]:
    """The rate of every target's source.

    ``total`` is the mix's size in tokens; unless given, the largest at which every source that
    has tokens reaches its share within its cap.  With a larger ``total`` a source stops at its
    cap and its share falls short.  Repeated targets of one source count once, the largest share
    first; null or negative shares and caps are 0; a source without tokens has rate 0.
    """
    wanted: dict[str, tuple[float, int]] = {}
    for source, share, cap in targets:
        if source is not None:
            wanted[source] = max(wanted.get(source, (0.0, 0)), (max(share or 0.0, 0.0), max(cap or 0, 0)))
    reach = [cap * tokens[s] / share for s, (share, cap) in wanted.items() if share > 0 and cap > 0 and tokens.get(s)]
    size = total if total is not None else min(reach, default=0.0)
    out = []
    for s, (share, cap) in sorted(wanted.items()):
        n = tokens.get(s) or 0
        out.append(Rate(s, share, cap, n, min(float(cap), share * size / n) if n else 0.0))
    return out


class Mix:
    """A mix of ``documents`` by ``targets(source, target_share, max_repeats)``.

    Documents whose source is null or has no target are no part of it.  Null and empty texts
    have no tokens but are copied at their source's rate like any other document.  Documents
    with equal ids share their hash and so the number of copies.  Other columns are ignored.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        total: float | None = None, seed: int = 11, tokenizer_path: str = TOKENIZER, of_all: float | None = None,
    ) -> None:
        """``total``: the mix's size in tokens; ``of_all``: the same as a multiple of all tokens of the sources."""
        rows = targets.select("source", "target_share", "max_repeats").distinct().limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        spark = documents.sparkSession
        names = spark.createDataFrame([(r["source"],) for r in rows if r["source"] is not None], "source string").distinct()
        part = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
        part = part.join(F.broadcast(names), "source", "left_semi")  # at most MOST_TARGETS names
        self.counted = cut_lineage(count_tokens(part, ["doc_id", "source"], "text", tokenizer_path))
        sums = {r["source"]: r["n"] for r in self.counted.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
        if of_all is not None:
            total = of_all * sum(sums.values())
        self.rates = repetition_rates([tuple(r) for r in rows], sums, total)
        self.seed = seed

    def documents(self) -> DataFrame:
        """``(doc_id, source, copy, tokens)``: a row for each copy in the mix, ``copy`` from 0."""
        spark = self.counted.sparkSession
        rates = spark.createDataFrame([(r.source, r.rate) for r in self.rates], "source string, rate double")
        draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(self.seed)), F.lit(STEPS)) / F.lit(float(STEPS))
        copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
        return (
            self.counted.join(F.broadcast(rates), "source")
            .withColumn("copies", copies)
            .where("copies > 0")
            .select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "tokens")
        )

    def shares(self) -> DataFrame:
        """``(source, target_share, max_repeats, source_tokens, rate, capped, mixed_tokens, mixed_rows, actual_share)`` of
        every target; ``capped``: the source is used as often as it may be."""
        spark = self.counted.sparkSession
        wanted = spark.createDataFrame(
            [(r.source, r.target_share, r.max_repeats, r.tokens, r.rate) for r in self.rates],
            "source string, target_share double, max_repeats int, source_tokens long, rate double",
        )
        got = self.documents().groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_rows"))
        whole = got.agg(F.sum("mixed_tokens").alias("whole"))
        return (
            wanted.join(got, "source", "left")
            .crossJoin(F.broadcast(whole))  # one row
            .na.fill(0, ["mixed_tokens", "mixed_rows"])
            .withColumn("capped", F.col("rate") >= F.col("max_repeats"))
            .withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", "whole"), F.lit(0.0)))
            .drop("whole")
        )

    def checks(self) -> DataFrame:
        """``(source, within_cap, even, reached)`` of every target, from the mix's rows: no document is used more
        often than ``max_repeats``; each as often as the rate's whole part or once more; the source's tokens are
        those of its rate, as near as drawing each document's last copy by itself lets them (five deviations)."""
        spark = self.counted.sparkSession
        wanted = spark.createDataFrame([(r.source, r.max_repeats, r.rate) for r in self.rates], "source string, max_repeats int, rate double")
        used = self.documents().groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
        each = self.counted.join(F.broadcast(wanted), "source").join(used, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
        fraction = F.col("rate") - F.floor("rate")
        found = each.groupBy("source").agg(
            F.bool_and(F.col("copies") <= F.col("max_repeats")).alias("within_cap"),
            F.bool_and((F.col("copies") == F.floor("rate")) | (F.col("copies") == F.floor("rate") + 1)).alias("even"),
            (F.abs(F.sum(F.col("tokens") * (F.col("copies") - F.col("rate")))) <= 1e-6 * (1 + F.sum("tokens")) + 5 * F.sqrt(F.sum(F.pow("tokens", F.lit(2)) * fraction * (1 - fraction)))).alias("reached"),
        )
        return wanted.select("source").join(found, "source", "left").na.fill(True)
