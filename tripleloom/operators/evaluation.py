"""Metrics of predictions against gold answers, ranks, rules and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.binding import let
from tripleloom.functions.text import normalize


def normal_set(items: Column) -> Column:
    """The distinct normalised items."""
    return F.array_distinct(F.transform(F.coalesce(items, F.array().cast("array<string>")), normalize))


def set_metrics(found: Column, gold: Column) -> Column:
    """Precision, recall, F1, hit and partial accuracy of two sets; without gold all are 1 if
    nothing was found either, else 0."""
    both = F.size(F.array_intersect(found, gold)).cast("double")
    p = F.coalesce(F.try_divide(both, F.size(found)), F.lit(0.0))
    r = F.coalesce(F.try_divide(both, F.size(gold)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    empty = F.when(F.size(found) == 0, 1.0).otherwise(0.0)
    of = lambda x, name: F.when(F.size(gold) == 0, empty).otherwise(x).alias(name)
    return F.struct(of(p, "precision"), of(r, "recall"), of(f1, "f1"), of((both > 0).cast("double"), "hit"), of(r, "accuracy_partial"))


def with_sets(rows: DataFrame, found: str, gold: str) -> DataFrame:
    """Adds the normalised sets ``found_set`` and ``gold_set``."""
    return rows.withColumn("found_set", normal_set(F.col(found))).withColumn("gold_set", normal_set(F.col(gold)))


def evaluated(rows: DataFrame, found: str, gold: str) -> DataFrame:
    """The rows with the five metrics of :func:`set_metrics` after normalisation."""
    m = with_sets(rows, found, gold).withColumn("m", set_metrics(F.col("found_set"), F.col("gold_set")))
    return m.select(*rows.columns, "m.*")


def substring_metrics(text: Column, found: Column, gold: Column) -> Column:
    """Accuracy (share of gold that stands in ``text``), hit, and the F1 of substrings: recall on the
    joined text, precision by prediction; 0 where either side is empty.  All inputs are normalised."""
    return let(F.struct(text.alias("t"), found.alias("f"), gold.alias("g")), lambda x: _substring_metrics(x["t"], x["f"], x["g"]))


def _substring_metrics(text: Column, found: Column, gold: Column) -> Column:
    there = lambda g: (F.contains(text, g)) | (g == "")
    held = F.size(F.filter(gold, there)).cast("double")
    acc = F.coalesce(F.try_divide(held, F.size(gold)), F.lit(0.0))
    right = F.size(F.filter(found, lambda p: F.exists(gold, lambda g: F.contains(p, g) | (g == "")))).cast("double")
    precision = F.coalesce(F.try_divide(right, F.size(found)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * acc, precision + acc), F.lit(0.0))
    empty = (F.size(gold) == 0) | (F.size(found) == 0)
    of = lambda x, name: F.when(empty, 0.0).otherwise(x).alias(name)
    return F.struct(acc.alias("acc"), (held > 0).cast("int").alias("any_hit"), of(f1, "f1"), of(precision, "precision"), of(acc, "recall"))


def most_frequent(items: DataFrame, key: str, item: str, pos: str, k: int) -> DataFrame:
    """``(<key>, item, n, rank)``: the ``k`` most frequent items of each key, ties by first appearance."""
    counted = items.groupBy(key, F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("rank") <= k).select(key, "item", "n", "rank")


def rank_metrics(rows: DataFrame, key: str, ranked: str, gold: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``(<key>, k, acc, any_hit, f1, precision, recall)`` of the first ``k`` of a ranked, normalised list."""
    c = rows.select(key, F.explode(F.array(*map(F.lit, ks))).alias("k"), F.col(ranked).alias("ranked"), F.col(gold).alias("gold"))
    c = c.withColumn("top", F.slice("ranked", F.lit(1), F.col("k")))
    return c.withColumn("m", substring_metrics(F.array_join("top", " "), F.col("top"), F.col("gold"))).select(key, "k", "m.*")


def rule_metrics(rows: DataFrame, key: str, rules: str, labels: str) -> DataFrame:
    """``(<key>, precision, recall, f1, hit)`` of rules written out, by exact match; rows without a
    label are skipped.  Precision is the number of labels found over that of the predictions."""
    held = F.size(F.array_intersect(labels, rules)).cast("double")
    p = F.coalesce(F.try_divide(held, F.size(rules)), F.lit(0.0))
    r = F.try_divide(held, F.size(labels))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.where(F.size(labels) > 0).select(key, p.alias("precision"), r.alias("recall"), f1.alias("f1"), (held > 0).cast("int").alias("hit"))


def label_metrics(scores: DataFrame, prompt: str, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row of means over prompts: precision, recall, F1, exact match and reciprocal rank of the
    candidates whose score's sigmoid is above ``threshold``."""
    s = scores.select(prompt, score, label, (1 / (1 + F.exp(-F.col(score))) > threshold).cast("int").alias("chosen"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy(prompt).orderBy(F.desc(score), F.desc(label))))
    per = s.groupBy(prompt).agg(
        F.sum(F.col("chosen") * F.col(label)).cast("double").alias("both"),
        F.sum("chosen").alias("found"),
        F.sum(label).alias("gold"),
        F.min((F.col("chosen") == F.col(label)).cast("int")).alias("exact"),
        F.min(F.when(F.col(label) == 1, F.col("rank"))).alias("first"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.try_divide("both", "found")), zero(F.try_divide("both", "gold"))
    per = per.select(p.alias("p"), r.alias("r"), zero(F.try_divide(2 * p * r, p + r)).alias("f"), "exact", zero(F.try_divide(F.lit(1.0), "first")).alias("rr"))
    return per.agg(*(F.avg(a).alias(b) for a, b in (("p", "precision"), ("r", "recall"), ("f", "f1"), ("exact", "exact_match"), ("rr", "mrr"))))


def hallucinated_share(paths: DataFrame, key: str, relation: str, known: DataFrame) -> DataFrame:
    """``(<key>, relations, unknown, ratio)``: the share of each key's relations that no dictionary row ``(r)`` holds."""
    marked = paths.join(known.select(F.col("r").alias(relation)).distinct().withColumn("__known", F.lit(1)), relation, "left")
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("relations"), F.count_if(F.col("__known").isNull()).alias("unknown")).withColumn("ratio", F.col("unknown") / F.col("relations"))


def path_metrics(rows: DataFrame, key: str, paths: str, gold_paths: str, ends: str, gold: str) -> DataFrame:
    """``(<key>, path_f1, answer_f1)``: set F1 of normalised paths against the true ones, and of the
    paths' last entities against the gold answers."""
    s = rows.select(key, *(normal_set(F.col(c)).alias(n) for n, c in (("p", paths), ("gp", gold_paths), ("e", ends), ("g", gold))))
    return s.select(key, set_metrics(F.col("p"), F.col("gp"))["f1"].alias("path_f1"), set_metrics(F.col("e"), F.col("g"))["f1"].alias("answer_f1"))
