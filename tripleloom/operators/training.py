"""Path pairs, decision points and the rows that models are trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.binding import let
from tripleloom.functions.paths import PATH_TYPE, history_key, parse_steps, steps_text
from tripleloom.functions.sampling import seeded, shuffled
from tripleloom.session import cut_lineage

LIST = "array<string>"


def capped_pairs(rows: DataFrame, key: str, starts: str, ends: str, most: int) -> DataFrame:
    """``(<key>, s, t)``: every start with the first ``most`` ends of its row."""
    s = rows.select(key, F.explode(starts).alias("s"), ends)
    return s.select(key, "s", F.posexplode(ends).alias("pos", "t")).where(F.col("pos") < most).select(key, "s", "t")


def truncated(paths: DataFrame, key: str, path: str, most: int) -> DataFrame:
    """``(<key>, origin, path)``: the proper prefixes of each path, at most ``most`` a path, the shortest first."""
    n = F.least(F.size(path) - 1, F.lit(most))
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(F.col(path), F.lit(1), i))
    return paths.where(F.size(path) > 1).select(key, F.col(path).alias("origin"), F.explode(prefixes).alias("path"))


def perturbed(paths: DataFrame, key: str, path: str, answer: str, kg: DataFrame, ranked: DataFrame, seed: str, top_k: int) -> DataFrame:
    """``(<key>, origin, path, n)``: each path ``origin`` with one hop replaced by another relation of the same node.

    ``ranked(h, r, rank)`` orders a node's relations; of the first ``2 * top_k`` the hop's own is
    left out and at most ``top_k`` are taken.  The new tail is the one with the smallest seeded
    md5 that is neither the answer nor the old tail; the path ends with it.  ``n`` counts the
    relations taken at the hop.
    """
    numbered = cut_lineage(paths.select(key, answer, F.col(path).alias("origin")).withColumn("pid", F.monotonically_increasing_id()))
    # only the number of a path goes through the joins; the path itself is joined again at the end
    hops = numbered.select("pid", F.col(answer).alias("answer"), F.posexplode("origin").alias("i", "s")).select("pid", "answer", "i", "s.h", "s.r", F.col("s.t").alias("old"))
    near = ranked.where(F.col("rank") <= 2 * top_k).select("h", F.col("r").alias("other"), "rank")
    w = Window.partitionBy("pid", "i").orderBy("rank")
    options = hops.join(near, "h").where("other <> r").withColumn("n", F.row_number().over(w)).where(F.col("n") <= top_k)
    tails = options.join(kg.select("h", F.col("r").alias("other"), F.col("t").alias("new")), ["h", "other"]).where("new <> answer AND new <> old")
    chosen = tails.groupBy("pid", "i", "h", "other", "n").agg(F.min_by("new", seeded(seed, F.col("h"), F.col("other"), F.col("new"))).alias("t"))
    prefix = F.when(F.col("i") > 0, F.slice("origin", F.lit(1), F.greatest("i", F.lit(1)))).otherwise(F.array().cast(PATH_TYPE))
    last = F.array(F.struct("h", F.col("other").alias("r"), "t"))
    return chosen.join(numbered, "pid").select(key, "origin", F.concat(prefix, last).alias("path"), "n")


def combined_negatives(perturbed_paths: DataFrame, truncated_paths: DataFrame, key: str, most: int, seed: str = "hop") -> DataFrame:
    """``(<key>, path, strategy)``: both kinds as texts, each once a key; each origin gives at most ``most``.

    An origin's perturbed paths come first, its hops in seeded order; its prefixes fill up what is left, the shortest first.
    """
    origin = steps_text(F.col("origin"))
    tag = lambda df, n, *order: df.select(key, origin.alias("origin"), steps_text(F.col("path")).alias("path"), F.lit(n).alias("strategy"), F.struct(*order).alias("turn"))
    hops = tag(perturbed_paths, 0, seeded(seed, origin, F.size("path")).alias("hop"), F.col("n").alias("n"))
    both = hops.unionByName(tag(truncated_paths, 1, F.lit("").alias("hop"), F.size("path").alias("n")))
    kept = both.withColumn("n", F.row_number().over(Window.partitionBy(key, "origin").orderBy("strategy", "turn"))).where(F.col("n") <= most)
    return kept.groupBy(key, "path").agg(F.min("strategy").alias("strategy"))


def path_items(pairs: DataFrame, key: str, shortest: DataFrame, negatives: DataFrame) -> DataFrame:
    """``(<key>, positive_paths, negative_paths)``; items with neither are left out."""
    lists = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_set("path")).alias(name))
    out = pairs.select(key).distinct().join(lists(shortest, "positive_paths"), key, "left").join(lists(negatives, "negative_paths"), key, "left")
    empty = F.array().cast(LIST)
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("positive_paths", "negative_paths")})
    return out.where((F.size("positive_paths") > 0) | (F.size("negative_paths") > 0))


def choices(items: DataFrame, key: str, paths: str) -> DataFrame:
    """``(<key>, path_no, step, history, entity, r)``: each step of each path text with what came before."""
    p = items.select(key, F.posexplode(paths).alias("path_no", "text")).select(key, "path_no", parse_steps(F.col("text")).alias("p"))
    return p.select(key, "path_no", "p", F.posexplode("p").alias("step", "s")).select(
        key, "path_no", "step", history_key(F.col("p"), F.col("step")).alias("history"), F.col("s.h").alias("entity"), F.col("s.r").alias("r")
    )


def decision_points(items: DataFrame, key: str, positive: str, negative: str) -> DataFrame:
    """``(<key>, history, entity, pos, neg)``: the sorted relations that lead on and astray from each
    point of the positive paths; a point that stands in several paths counts once."""
    pos, neg = choices(items, key, positive), choices(items, key, negative)
    at = [key, "history", "entity"]
    gather = lambda df, name: df.groupBy(*at).agg(F.sort_array(F.collect_set("r")).alias(name))
    return gather(pos, "pos").join(gather(neg, "neg"), at, "left").withColumn("neg", F.coalesce("neg", F.array().cast(LIST)))


def candidate_pool(points: DataFrame, strategy: str = "pn_only", kg: DataFrame | None = None, distractors: int = 0, seed: str = "pool") -> DataFrame:
    """Adds ``pool``: ``pn_only`` the known relations, ``kg_allhop`` all of the node's in the graph,
    ``pn_kg_supplement`` the known ones and ``distractors`` others of the node in seeded order."""
    known = F.array_union("pos", "neg")
    if strategy == "pn_only" or kg is None:
        return points.withColumn("pool", F.sort_array(known))
    of_node = kg.groupBy(F.col("h").alias("entity")).agg(F.sort_array(F.collect_set("r")).alias("kg_rs"))
    p = points.join(of_node, "entity", "left").withColumn("kg_rs", F.coalesce("kg_rs", F.array().cast(LIST)))
    if strategy == "kg_allhop":
        return p.withColumn("pool", F.sort_array(F.array_union(known, F.col("kg_rs")))).drop("kg_rs")
    other = F.slice(shuffled(F.array_except("kg_rs", known), seed, F.col("entity")), 1, max(1, distractors)) if distractors else F.array().cast(LIST)
    return p.withColumn("pool", F.sort_array(F.array_union(known, other))).drop("kg_rs")


def limited_pool(points: DataFrame, threshold: int, version: int, distractors: int = 10, seed: str = "cut") -> DataFrame:
    """Pools above ``threshold``: version 1 keeps the known relations and ``distractors`` others,
    version 2 fills up to the threshold; both in seeded order."""
    known = F.array_union("pos", "neg")
    others = shuffled(F.array_except("pool", known), seed, F.col("entity"), F.col("history"))
    room = F.lit(distractors) if version == 1 else F.greatest(F.lit(threshold) - F.size(known), F.lit(0))
    cut = F.sort_array(F.array_union(known, F.when(room > 0, F.slice(others, F.lit(1), F.greatest(room, F.lit(1)))).otherwise(F.array().cast(LIST))))
    return points.withColumn("pool", F.when(F.size("pool") > threshold, cut).otherwise(F.col("pool")))


def filled_pool(points: DataFrame, kg: DataFrame, threshold: int, seed: str = "cut", parts: int = 8) -> DataFrame:
    """Adds ``pool``: what version 2 of limited_pool makes of ``kg_allhop`` pools.

    A point needs no more of its node than the first ``threshold`` relations in seeded order, and these are the same
    for all points with its history; so a hub's relations are put in order once a history, and its histories are
    dealt out to ``parts`` tasks.  ``points`` is read twice."""
    p = points.withColumn("known", F.array_union("pos", "neg"))
    room = F.lit(threshold) - F.size("known")
    part = F.pmod(F.xxhash64("history"), F.lit(parts))
    asked = p.where(room > 0).groupBy("entity", part.alias("part")).agg(F.collect_set("history").alias("histories"))
    of_node = kg.groupBy(F.col("h").alias("entity")).agg(F.collect_set("r").alias("rs"))
    spark = points.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a given number isn't drawn together: few bytes, much work
    each = asked.join(of_node, "entity").repartition(tasks, "entity", "part").select("entity", F.explode("histories").alias("history"), "rs")
    first = each.select("entity", "history", F.slice(shuffled(F.col("rs"), seed, F.col("entity"), F.col("history")), 1, threshold).alias("first"))
    others = F.array_except(F.coalesce("first", F.array().cast(LIST)), F.col("known"))
    pool = F.when(room > 0, F.array_union("known", F.slice(others, F.lit(1), F.greatest(room, F.lit(1))))).otherwise(F.col("known"))
    return p.join(first, ["entity", "history"], "left").withColumn("pool", F.sort_array(pool)).drop("known", "first")


def preference_v1(points: DataFrame, most: int) -> DataFrame:
    """Adds newline-joined ``chosen`` and ``rejected``: the first gold relations of the pool; the wrong ones
    known, topped up with other options; rows where one is empty or both are equal are dropped."""
    chosen = F.slice(F.sort_array(F.array_intersect("pos", "pool")), 1, most)
    wrong = F.array_except(F.array_intersect("neg", "pool"), F.col("c"))
    others = F.sort_array(F.array_except(F.array_except("pool", F.col("c")), wrong))
    topped = F.slice(F.concat(F.slice(F.sort_array(wrong), 1, most), others), 1, most)
    out = points.withColumn("c", chosen).withColumn("w", F.sort_array(topped))
    out = out.where((F.size("c") > 0) & (F.size("w") > 0) & (F.col("c") != F.col("w")))
    return out.withColumn("chosen", F.array_join("c", "\n")).withColumn("rejected", F.array_join("w", "\n")).drop("c", "w")


def preference_v2(points: DataFrame, negatives: int = 3, seed: str = "v2") -> DataFrame:
    """Adds the lists ``chosen`` (all gold of the pool) and ``rejected`` (the rest), tagged ``[RELi] r`` by place
    in the pool, after the known wrong relations are cut to ``negatives`` in seeded order."""
    few = F.sort_array(F.slice(shuffled(F.array_except("neg", "pos"), seed, F.col("entity"), F.col("history")), 1, negatives))
    pool = F.sort_array(F.array_union(F.array_except("pool", F.array_except("neg", F.array_union("pos", few))), few))
    p = points.withColumn("opts", pool)
    tag = lambda keep: F.filter(F.transform("opts", lambda r, i: F.when(keep(r), F.concat(F.lit("[REL"), (i + 1).cast("string"), F.lit("] "), r))), lambda x: x.isNotNull())
    gold = lambda r: F.array_contains(F.col("pos"), r)
    out = p.withColumn("chosen", tag(gold)).withColumn("rejected", tag(lambda r: ~gold(r)))
    return out.where((F.size("chosen") > 0) & (F.size("rejected") > 0)).drop("opts")


def preference_naive(points: DataFrame, most: int, seed: str = "naive") -> DataFrame:
    """As version 1 without options in the prompt: topped up in seeded order rather than sorted."""
    chosen = F.slice(F.sort_array(F.array_intersect("pos", "pool")), 1, most)
    wrong = F.sort_array(F.array_except(F.array_intersect("neg", "pool"), F.col("c")))
    others = shuffled(F.array_except(F.array_except("pool", F.col("c")), wrong), seed, F.col("entity"), F.col("history"))
    out = points.withColumn("c", chosen).withColumn("w", F.slice(F.concat(wrong, others), 1, most))
    out = out.where((F.size("c") > 0) & (F.size("w") > 0) & (F.col("c") != F.col("w")))
    return out.withColumn("chosen", F.array_join("c", "\n")).withColumn("rejected", F.array_join("w", "\n")).drop("c", "w")


def sft_completions(points: DataFrame, most: int, tagged: bool = True) -> DataFrame:
    """Adds ``completion``: the first gold relations of the pool, tagged ``[REL_i] r`` from 0 by place in the pool or bare."""
    kept = F.slice(F.sort_array(F.array_intersect("pos", "pool")), 1, most)
    tag = lambda pool, r: F.concat(F.lit("[REL_"), (F.array_position(pool, r) - 1).cast("string"), F.lit("] "), r)
    lines = let(F.col("pool"), lambda pool: F.transform("k", lambda r: tag(pool, r))) if tagged else F.col("k")
    return points.withColumn("k", kept).where(F.size("k") > 0).withColumn("completion", F.array_join(lines, "\n")).drop("k")


def contrast_pairs(items: DataFrame, key: str, shortest: str, semantic: str, negative: str) -> DataFrame:
    """``(<key>, chosen, rejected)``: each negative path against each semantic and each shortest path."""
    good = F.concat(F.coalesce(semantic, F.array().cast(LIST)), F.coalesce(shortest, F.array().cast(LIST)))
    return items.select(key, F.explode(negative).alias("rejected"), good.alias("good")).select(key, F.explode("good").alias("chosen"), "rejected")


def flattened_candidates(rows: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``(<key>, pos, candidate, label)``: both lists as one, each candidate once, 1.0 for chosen ones."""
    both = F.array_distinct(F.concat(F.coalesce(chosen, F.array().cast(LIST)), F.coalesce(rejected, F.array().cast(LIST))))
    c = rows.select(key, F.col(chosen).alias("__c"), F.posexplode(both).alias("pos", "candidate"))
    return c.select(key, "pos", "candidate", F.when(F.array_contains(F.coalesce("__c", F.array().cast(LIST)), F.col("candidate")), 1.0).otherwise(0.0).alias("label"))


def prompt_responses(rows: DataFrame, key: str, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """``(<key>, prompt, pos, response, is_chosen)``: a row for every response of a prompt."""
    tag = lambda c, flag: F.transform(F.coalesce(c, F.array().cast(LIST)), lambda x: F.struct(x.alias("response"), F.lit(flag).alias("is_chosen")))
    return rows.select(key, prompt, F.posexplode(F.concat(tag(chosen, True), tag(rejected, False))).alias("pos", "x")).select(key, prompt, "pos", "x.*")


def pair_losses(scores: DataFrame, prompt: str, score: str, label: str, margin: float = 1.0) -> DataFrame:
    """``(<prompt>, pairs, margin_loss, contrast_loss)``: means over the pairs of a right and a wrong candidate."""
    good = scores.where(F.col(label) == 1).select(prompt, F.col(score).alias("g"))
    bad = scores.where(F.col(label) == 0).select(prompt, F.col(score).alias("b"))
    gap = F.col("g") - F.col("b")
    return good.join(bad, prompt).groupBy(prompt).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(F.greatest(F.lit(0.0), margin - gap)).alias("margin_loss"), F.avg(F.log1p(F.exp(-gap))).alias("contrast_loss")
    )


def classification_losses(scores: DataFrame, prompt: str, score: str, label: str, reference: str) -> DataFrame:
    """``(<prompt>, bce, positive_loss, kl)``: binary cross entropy of the scores' sigmoid, the part of the
    right candidates, and the penalty for leaving the reference scores."""
    p = 1 / (1 + F.exp(-F.col(score)))
    q = 1 / (1 + F.exp(-F.col(reference)))
    bce = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    kl = p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))
    return scores.groupBy(prompt).agg(F.avg(bce).alias("bce"), F.avg(F.when(F.col(label) == 1, -F.log(p))).alias("positive_loss"), F.avg(kl).alias("kl"))


def mpo_loss(scores: DataFrame, prompt: str, score: str, label: str, classification_weight: float = 1.0, contrast_weight: float = 1.0) -> DataFrame:
    """One row ``(classification_loss, contrast_loss, total_loss, classification_accuracy)``: the cross entropy of
    all candidates, the mean over prompts of the mean over their pairs of a right and a wrong one, and their
    weighted sum; a prompt without pairs takes no part in the second, which is 0 if there are none."""
    p = 1 / (1 + F.exp(-F.col(score)))
    bce = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    right = ((p > 0.5) == (F.col(label) == 1)).cast("int")
    one = scores.agg(F.avg(bce).alias("classification_loss"), F.avg(right).alias("classification_accuracy"))
    two = pair_losses(scores, prompt, score, label).agg(F.coalesce(F.avg("contrast_loss"), F.lit(0.0)).alias("contrast_loss"))
    total = classification_weight * F.col("classification_loss") + contrast_weight * F.col("contrast_loss")
    return one.crossJoin(two).select("classification_loss", "contrast_loss", total.alias("total_loss"), "classification_accuracy")  # one row each


def reward_summary(scores: DataFrame, prompt: str, score: str, label: str) -> DataFrame:
    """One row: mean reward of right and of wrong candidates, their margin, and the share of prompts in
    which the right ones' mean is larger."""
    per = scores.groupBy(prompt).agg(F.avg(F.when(F.col(label) == 1, F.col(score))).alias("c"), F.avg(F.when(F.col(label) == 0, F.col(score))).alias("r"))
    per = per.where("c IS NOT NULL AND r IS NOT NULL")
    return per.agg(F.avg("c").alias("chosen"), F.avg("r").alias("rejected"), F.avg(F.col("c") - F.col("r")).alias("margin"), F.avg((F.col("c") > F.col("r")).cast("int")).alias("accuracy"))


def row_id(prefix: str, item: Column, history: Column, entity: Column) -> Column:
    """``prefix_item_length_entity`` with blanks replaced; the length is that of the history's text."""
    return F.concat_ws("_", F.lit(prefix), item.cast("string"), F.length(history).cast("string"), F.replace(entity, F.lit(" "), F.lit("_")))
