"""Queries of evaluation, run comparison, joins by id and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions import text as T
from tripleloom.operators import analytics as I
from tripleloom.operators import evaluation as E
from tripleloom.plans.registry import query
from tripleloom.plans.text import norm
from tripleloom.tables import load

PARTS = r"[,;|\t\r\n]+"
METRICS = ("precision", "recall", "f1", "hit", "accuracy_partial")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """The predictions with ``found``: the parts of the prediction, stripped, non-empty."""
    parts = F.filter(F.transform(F.split(F.coalesce("prediction", F.lit("")), PARTS), lambda x: F.trim(x)), lambda x: x != "")
    return load(spark, folder, "predictions").withColumn("found", parts)


ANSWERS = rf"""ans AS (SELECT *, list_filter(list_transform(string_split_regex(coalesce(prediction, ''), '{PARTS}'), lambda x: trim(x, ' ')), lambda x: x <> '') AS found FROM predictions),
normed AS (SELECT row_id, id, run, ground_truth, prediction, found, list_transform(found, lambda x: {norm('x')}) AS f0,
         list_transform(coalesce(ground_truth, []::VARCHAR[]), lambda x: {norm('x')}) AS g0 FROM ans),
sets AS (SELECT row_id, id, run, ground_truth, prediction, found, list_filter(f0, lambda x, i: list_position(f0, x) = i) AS f, list_filter(g0, lambda x, i: list_position(g0, x) = i) AS g FROM normed),
both_ AS (SELECT *, len(list_intersect(f, g))::DOUBLE AS b, len(f) AS nf, len(g) AS ng FROM sets),
pr AS (SELECT *, CASE WHEN nf > 0 THEN b / nf ELSE 0 END AS p, CASE WHEN ng > 0 THEN b / ng ELSE 0 END AS r FROM both_),
m AS (SELECT *, CASE WHEN ng = 0 THEN (nf = 0)::INT::DOUBLE ELSE p END AS "precision", CASE WHEN ng = 0 THEN (nf = 0)::INT::DOUBLE ELSE r END AS recall,
      CASE WHEN ng = 0 THEN (nf = 0)::INT::DOUBLE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, CASE WHEN ng = 0 THEN (nf = 0)::INT::DOUBLE ELSE (b > 0)::INT::DOUBLE END AS hit FROM pr)"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("h01_set_metrics", f'WITH {ANSWERS} SELECT row_id, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, hit, round(recall, 6) AS accuracy_partial FROM m')
def set_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.evaluated(answers(spark, folder), "found", "ground_truth").select("row_id", *METRICS), *METRICS)


@query("h02_run_evaluation", f'WITH {ANSWERS} SELECT run, count(*) AS n, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(hit), 6) AS hit FROM m GROUP BY run')
def run_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    e = E.evaluated(answers(spark, folder), "found", "ground_truth")
    return e.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in METRICS[:4]))


@query("a07_mean_metrics_with_gold", f'WITH {ANSWERS} SELECT count(*) AS n, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM m WHERE ng > 0')
def mean_metrics(spark: SparkSession, folder: str) -> DataFrame:
    e = E.evaluated(answers(spark, folder).where(F.size("ground_truth") > 0), "found", "ground_truth")
    return e.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in METRICS[:3]))


SUB = f"""sub AS (SELECT row_id, id, f, g, array_to_string(f, ' ') AS j FROM sets),
s AS (SELECT row_id, id, len(list_filter(g, lambda x: contains(j, x)))::DOUBLE AS held, len(list_filter(f, lambda p: len(list_filter(g, lambda x: contains(p, x))) > 0))::DOUBLE AS ok, len(f) AS nf, len(g) AS ng FROM sub)"""
SUBOUT = """CASE WHEN ng > 0 THEN held / ng ELSE 0 END AS acc, (held > 0)::INT AS any_hit, CASE WHEN nf > 0 AND ng > 0 THEN ok / nf ELSE 0 END AS p"""


@query("h03_substring_metrics", f"""WITH {ANSWERS}, {SUB}, o AS (SELECT row_id, {SUBOUT}, nf, ng FROM s)
SELECT row_id, round(acc, 6) AS acc, any_hit, round(CASE WHEN nf = 0 OR ng = 0 OR p + acc = 0 THEN 0 ELSE 2 * p * acc / (p + acc) END, 6) AS f1, round(p, 6) AS "precision",
round(CASE WHEN nf = 0 OR ng = 0 THEN 0 ELSE acc END, 6) AS recall FROM o""")  # fmt: skip
def substring_metrics(spark: SparkSession, folder: str) -> DataFrame:
    s = E.with_sets(answers(spark, folder), "found", "ground_truth")
    m = E.substring_metrics(F.array_join("found_set", " "), F.col("found_set"), F.col("gold_set"))
    return rounded(s.select("row_id", m.alias("m")).select("row_id", "m.*"), "acc", "f1", "precision", "recall")


@query("h08_rank_metrics", f"""WITH {ANSWERS}, tops AS (SELECT row_id, k, f[1:k] AS f, g, array_to_string(f[1:k], ' ') AS j FROM sets CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k)),
s AS (SELECT row_id, k, len(list_filter(g, lambda x: contains(j, x)))::DOUBLE AS held, len(list_filter(f, lambda p: len(list_filter(g, lambda x: contains(p, x))) > 0))::DOUBLE AS ok, len(f) AS nf, len(g) AS ng FROM tops),
o AS (SELECT row_id, k, {SUBOUT}, nf, ng FROM s)
SELECT row_id, k::INT AS k, round(acc, 6) AS acc, any_hit, round(CASE WHEN nf = 0 OR ng = 0 OR p + acc = 0 THEN 0 ELSE 2 * p * acc / (p + acc) END, 6) AS f1, round(p, 6) AS "precision",
round(CASE WHEN nf = 0 OR ng = 0 THEN 0 ELSE acc END, 6) AS recall FROM o""")  # fmt: skip
def rank_metrics(spark: SparkSession, folder: str) -> DataFrame:
    s = E.with_sets(answers(spark, folder), "found", "ground_truth")
    return rounded(E.rank_metrics(s, "row_id", "found_set", "gold_set"), "acc", "f1", "precision", "recall")


TOP = f"""items AS (SELECT id, {norm('x')} AS item, row_id * 1000 + i AS p FROM (SELECT id, row_id, unnest(found) AS x, generate_subscripts(found, 1) AS i FROM ans)),
freq AS (SELECT id, item, count(*) AS n, min(p) AS p FROM items GROUP BY id, item),
top AS (SELECT id, item, n, (row_number() OVER (PARTITION BY id ORDER BY n DESC, p))::INT AS rank FROM freq QUALIFY rank <= 3)"""


def predicted_items(spark: SparkSession, folder: str) -> DataFrame:
    a = answers(spark, folder).select("id", "row_id", F.posexplode("found").alias("i", "x"))
    return a.select("id", T.normalize(F.col("x")).alias("item"), (F.col("row_id") * 1000 + F.col("i") + 1).alias("pos"))


@query("a11_most_frequent_answers", f"WITH {ANSWERS}, {TOP} SELECT id, item, n, rank FROM top")
def most_frequent_answers(spark: SparkSession, folder: str) -> DataFrame:
    return E.most_frequent(predicted_items(spark, folder), "id", "item", "pos", 3)


@query("h07_top_answers_evaluated", f"""WITH {ANSWERS}, {TOP}, t AS (SELECT id, list(item) AS f FROM top GROUP BY id), gold AS (SELECT id, list_distinct(flatten(list(g))) AS g FROM sets GROUP BY id),
c AS (SELECT id, len(list_intersect(f, g))::DOUBLE AS b, len(f) AS nf, len(g) AS ng FROM t JOIN gold USING (id) WHERE len(g) > 0)
SELECT id, round(b / ng, 6) AS recall, round(b / nf, 6) AS "precision", (b > 0)::INT::DOUBLE AS hit FROM c""")  # fmt: skip
def top_answers_evaluated(spark: SparkSession, folder: str) -> DataFrame:
    top = E.most_frequent(predicted_items(spark, folder), "id", "item", "pos", 3).groupBy("id").agg(F.collect_set("item").alias("f"))  # at most 3 a key
    gold = answers(spark, folder).select("id", F.explode(E.normal_set(F.col("ground_truth"))).alias("g")).groupBy("id").agg(F.collect_set("g").alias("g"))
    m = top.join(gold, "id").select("id", E.set_metrics(F.col("f"), F.col("g")).alias("m"))
    return rounded(m.select("id", "m.recall", "m.precision", "m.hit"), "recall", "precision")


@query("h12_exact_label_hits", "SELECT row_id, coalesce(list_contains(ground_truth, trim(string_split(prediction, ',')[1], ' ')), false) AS hit FROM predictions")
def exact_label_hits(spark: SparkSession, folder: str) -> DataFrame:
    hit = F.array_contains("ground_truth", F.trim(F.get(F.split("prediction", ","), F.lit(0))))
    return load(spark, folder, "predictions").select("row_id", F.coalesce(hit, F.lit(False)).alias("hit"))


RULES = r"""ruled AS (SELECT row_id, list_distinct(list_transform(list_filter(string_split_regex(coalesce(predicted_paths, ''), '[|\t\r\n]+'), lambda x: contains(x, '-[')), lambda x: array_to_string(regexp_extract_all(x, '-\[\s*(.+?)\s*\]-', 1), '<SEP>'))) AS rules,
list_distinct(list_transform(list_filter(coalesce(ground_truth_paths, []::VARCHAR[]), lambda x: x IS NOT NULL), lambda x: array_to_string(list_transform(regexp_extract_all(x, ' -> ([^ ]+) -> ', 1), lambda y: y), '<SEP>'))) AS labels FROM predictions)"""


@query("h11_rule_metrics", f"""WITH {RULES}, c AS (SELECT row_id, len(list_intersect(labels, rules))::DOUBLE AS b, len(rules) AS nf, len(labels) AS ng FROM ruled WHERE len(labels) > 0), o AS (SELECT row_id, CASE WHEN nf > 0 THEN b / nf ELSE 0 END AS p, b / ng AS r, b FROM c)
SELECT row_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, (b > 0)::INT AS hit FROM o""")  # fmt: skip
def rule_metrics(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.filter(F.split(F.coalesce("predicted_paths", F.lit("")), r"[|\t\r\n]+"), lambda x: x.contains("-["))
    rules = F.array_distinct(F.transform(texts, lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"-\[\s*(.+?)\s*\]-"), F.lit(1)), "<SEP>")))
    gold = F.filter(F.coalesce("ground_truth_paths", F.array().cast("array<string>")), lambda x: x.isNotNull())
    labels = F.array_distinct(F.transform(gold, lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r" -> ([^ ]+) -> "), F.lit(1)), "<SEP>")))
    rows = load(spark, folder, "predictions").select("row_id", rules.alias("rules"), labels.alias("labels"))
    return rounded(E.rule_metrics(rows, "row_id", "rules", "labels"), "precision", "recall", "f1")


SCORES = """scores AS (SELECT pref_row_id AS prompt_id, c AS candidate, label, ((('0x' || substr(md5(c || pref_row_id), 1, 6))::BIGINT) / 16777216.0::DOUBLE) * 4 - 2 AS score FROM (
  SELECT pref_row_id, unnest(chosen) AS c, 1 AS label FROM pref_rows UNION ALL SELECT pref_row_id, unnest(rejected), 0 FROM pref_rows) WHERE c IS NOT NULL)"""


def candidate_scores(spark: SparkSession, folder: str) -> DataFrame:
    """``(prompt_id, candidate, label, score)``: the candidates of the preference rows with a seeded score."""
    p = load(spark, folder, "pref_rows")
    both = F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("chosen").alias("cs")), F.struct(F.lit(0).alias("label"), F.col("rejected").alias("cs"))))
    c = p.select(F.col("pref_row_id").alias("prompt_id"), both.alias("x")).select("prompt_id", "x.label", F.explode("x.cs").alias("candidate")).where("candidate IS NOT NULL")
    number = F.conv(F.substring(F.md5(F.concat("candidate", F.col("prompt_id").cast("string"))), 1, 6), 16, 10).cast("double")
    return c.withColumn("score", number / 16777216 * 4 - 2)


@query("h10_label_metrics", f"""WITH {SCORES}, r AS (SELECT *, (1 / (1 + exp(-score)) > 0.5)::INT AS chosen, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, label DESC) AS rank FROM scores),
p AS (SELECT prompt_id, sum(chosen * label)::DOUBLE AS b, sum(chosen) AS nf, sum(label) AS ng, min((chosen = label)::INT) AS exact, min(CASE WHEN label = 1 THEN rank END) AS first FROM r GROUP BY prompt_id),
o AS (SELECT CASE WHEN nf > 0 THEN b / nf ELSE 0 END AS p, CASE WHEN ng > 0 THEN b / ng ELSE 0 END AS r, exact, CASE WHEN first IS NULL THEN 0 ELSE 1.0::DOUBLE / first END AS rr FROM p)
SELECT round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(exact), 6) AS exact_match, round(avg(rr), 6) AS mrr FROM o""")  # fmt: skip
def label_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.label_metrics(candidate_scores(spark, folder), "prompt_id", "score", "label"), "precision", "recall", "f1", "exact_match", "mrr")


@query("a14_hallucinated_relations", """WITH steps AS (SELECT row_id, unnest(regexp_extract_all(predicted_paths, '([a-z_]+\\.[a-z_]+\\.[a-z_]+)')) AS r FROM predictions WHERE predicted_paths IS NOT NULL),
known AS (SELECT DISTINCT r FROM (SELECT unnest(graph, recursive := true) FROM rog_cwq) WHERE r IS NOT NULL)
SELECT row_id, count(*) AS relations, count(*) FILTER (WHERE r NOT IN (SELECT r FROM known)) AS unknown, round(count(*) FILTER (WHERE r NOT IN (SELECT r FROM known)) / count(*), 6) AS ratio FROM steps GROUP BY row_id""".replace("\\\\", "\\"))  # fmt: skip
def hallucinated_relations(spark: SparkSession, folder: str) -> DataFrame:
    steps = load(spark, folder, "predictions").select("row_id", F.explode(F.regexp_extract_all("predicted_paths", F.lit(r"([a-z_]+\.[a-z_]+\.[a-z_]+)"), F.lit(1))).alias("r"))
    known = load(spark, folder, "rog_cwq").select(F.explode("graph").alias("g")).select("g.r").where("r IS NOT NULL").distinct()
    return rounded(E.hallucinated_share(steps, "row_id", "r", known), "ratio")


# -- comparing runs: the kinds of runs stand for methods, the last row of an id counts

METHOD = "string_split(run, '-')[1]"
METHODS = f"""kinds AS (SELECT *, {METHOD} AS method FROM m),
one AS (SELECT method, id, arg_max(struct_pack(t := prediction, g := ground_truth, f := f1, a := recall), row_id) AS x FROM kinds GROUP BY method, id)"""


def method_rows(spark: SparkSession, folder: str, method: str) -> DataFrame:
    """``(id, text, gold, f1, acc)`` of one method, the last row of each id."""
    rows = answers(spark, folder).where(F.get(F.split("run", "-"), F.lit(0)) == method)
    last = I.last_by(rows.select("id", "row_id", "prediction", "ground_truth", "found"), ["id"], "row_id")
    e = E.evaluated(last, "found", "ground_truth")
    return e.select("id", F.col("prediction").alias("text"), F.col("ground_truth").alias("gold"), "f1", F.col("recall").alias("acc"))


def methods(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """The named methods side by side on the ids that all of them hold."""
    runs = [method_rows(spark, folder, n).select("id", *(F.col(c).alias(f"{c}{i + 1}") for c in ("text", "gold", "f1", "acc"))) for i, n in enumerate(names)]
    return I.common_ids(runs, "id")


OK = "len(list_filter(coalesce({0}.x.g, []::VARCHAR[]), lambda v: contains(lower(coalesce({0}.x.t, '')), lower(v)))) > 0"
REASON = """CASE WHEN trim(coalesce(b.x.t, ''), ' ') = '' THEN 'empty' WHEN regexp_matches(lower(b.x.t), 'm\\.[0-9a-z_]+') THEN 'mediator_code'
WHEN len(list_filter(b.x.g, lambda v: contains(lower(v), lower(trim(b.x.t, ' '))))) > 0 THEN 'partial' ELSE 'other' END""".replace("\\\\", "\\")


@query("i01_regressions", f"""WITH {ANSWERS}, {METHODS} SELECT a.id, {REASON} AS reason FROM one a JOIN one b USING (id) WHERE a.method = 'trie' AND b.method = 'hop' AND {OK.format('a')} AND NOT {OK.format('b')}""")
def regressions(spark: SparkSession, folder: str) -> DataFrame:
    m = methods(spark, folder, "trie", "hop").where(I.correct(F.col("text1"), F.col("gold1")) & ~I.correct(F.col("text2"), F.col("gold2")))
    return m.select("id", I.failure_reason(F.col("text2"), F.col("gold2")).alias("reason"))


@query("a09_failure_categories", f"""WITH {ANSWERS}, {METHODS}, r AS (SELECT {REASON} AS reason FROM one a JOIN one b USING (id) WHERE a.method = 'trie' AND b.method = 'hop' AND {OK.format('a')} AND NOT {OK.format('b')})
SELECT reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 6) AS percent FROM r GROUP BY reason""")  # fmt: skip
def failure_categories(spark: SparkSession, folder: str) -> DataFrame:
    counts = regressions(spark, folder).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("reason", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))  # a few rows


@query("i02_perfect_against_failed", f"WITH {ANSWERS}, {METHODS} SELECT a.id FROM one a JOIN one b USING (id) WHERE a.method = 'trie' AND b.method = 'hop' AND b.x.f = 1 AND b.x.a = 1 AND a.x.f = 0 AND a.x.a = 0")
def perfect_against_failed(spark: SparkSession, folder: str) -> DataFrame:
    return methods(spark, folder, "trie", "hop").where("f12 = 1 AND acc2 = 1 AND f11 = 0 AND acc1 = 0").select("id")


@query("i03_outperforming", f"""WITH {ANSWERS}, {METHODS} SELECT a.id, round(b.x.f - a.x.f, 6) AS f1_gain, round(b.x.a - a.x.a, 6) AS acc_gain FROM one a JOIN one b USING (id) WHERE a.method = 'trie' AND b.method = 'hop' AND b.x.f - a.x.f >= 0.3 AND b.x.a - a.x.a >= 0.3""")
def outperforming(spark: SparkSession, folder: str) -> DataFrame:
    m = methods(spark, folder, "trie", "hop").withColumn("f1_gain", F.col("f12") - F.col("f11")).withColumn("acc_gain", F.col("acc2") - F.col("acc1"))
    return rounded(m.where("f1_gain >= 0.3 AND acc_gain >= 0.3").select("id", "f1_gain", "acc_gain"), "f1_gain", "acc_gain")


@query("o03_largest_gains", f"""WITH {ANSWERS}, {METHODS} SELECT a.id, round(b.x.f - a.x.f, 6) AS f1_gain FROM one a JOIN one b USING (id) WHERE a.method = 'trie' AND b.method = 'hop' ORDER BY f1_gain DESC, a.id LIMIT 10""")
def largest_gains(spark: SparkSession, folder: str) -> DataFrame:
    m = methods(spark, folder, "trie", "hop").select("id", F.round(F.col("f12") - F.col("f11"), 6).alias("f1_gain"))
    return m.orderBy(F.desc("f1_gain"), "id").limit(10)  # a top-k report


@query("i04_wins_over_two", f"""WITH {ANSWERS}, {METHODS} SELECT a.id FROM one a JOIN one b USING (id) JOIN one c USING (id) WHERE a.method = 'trie' AND b.method = 'hop' AND c.method = 'naive' AND {OK.format('a')} AND NOT {OK.format('b')} AND NOT {OK.format('c')}""")
def wins_over_two(spark: SparkSession, folder: str) -> DataFrame:
    m = methods(spark, folder, "trie", "hop", "naive")
    return m.where(I.correct(F.col("text1"), F.col("gold1")) & ~I.correct(F.col("text2"), F.col("gold2")) & ~I.correct(F.col("text3"), F.col("gold3"))).select("id")


@query("j05_common_ids", f"""WITH {ANSWERS}, {METHODS}, sets_ AS (SELECT id FROM one WHERE method IN ('trie', 'hop', 'naive', 'beam') GROUP BY id HAVING count(*) = 4) SELECT id FROM sets_ WHERE id IN (SELECT qid FROM heldout_items)""")
def common_ids(spark: SparkSession, folder: str) -> DataFrame:
    runs = [method_rows(spark, folder, n).select("id") for n in ("trie", "hop", "naive", "beam")]
    return I.common_ids(runs, "id", load(spark, folder, "heldout_items").select(F.col("qid").alias("id"))).select("id")


@query("u02_ids_in_all", f"SELECT id FROM predictions WHERE {METHOD} = 'trie' INTERSECT SELECT id FROM predictions WHERE {METHOD} = 'hop'")
def ids_in_all(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "predictions").select("id", F.get(F.split("run", "-"), F.lit(0)).alias("method"))
    return p.where("method = 'trie'").select("id").intersect(p.where("method = 'hop'").select("id"))


@query("i06_rows_without_perfect_hits", f"WITH {ANSWERS}, {METHODS}, p AS (SELECT a.id FROM one a JOIN one b USING (id) WHERE a.method = 'trie' AND b.method = 'hop' AND a.x.f = 1 AND b.x.f = 1) SELECT row_id FROM predictions WHERE id NOT IN (FROM p)")
def rows_without_perfect_hits(spark: SparkSession, folder: str) -> DataFrame:
    perfect = methods(spark, folder, "trie", "hop").where("f11 = 1 AND f12 = 1").select("id")
    return load(spark, folder, "predictions").join(perfect, "id", "left_anti").select("row_id")


@query("i08_ids", "SELECT DISTINCT id FROM rog_cwq WHERE id IS NOT NULL")
def ids(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "rog_cwq").select("id").where("id IS NOT NULL").distinct()


@query("a08_run_costs", """SELECT run, round(avg(runtime_s), 6) AS avg_s, min(runtime_s) AS min_s, max(runtime_s) AS max_s, round(avg(llm_calls), 6) AS avg_calls, sum(llm_tokens)::BIGINT AS tokens FROM predictions GROUP BY run""")
def run_costs(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "predictions").groupBy("run").agg(
        F.round(F.avg("runtime_s"), 6).alias("avg_s"), F.min("runtime_s").alias("min_s"), F.max("runtime_s").alias("max_s"), F.round(F.avg("llm_calls"), 6).alias("avg_calls"), F.sum("llm_tokens").alias("tokens")
    )


@query("a10_coded_gold_share", "SELECT round(avg((len(list_filter(answer, lambda x: contains(x, 'm.'))) > 0)::INT), 6) AS share FROM rog_webqsp WHERE answer IS NOT NULL")
def coded_gold_share(spark: SparkSession, folder: str) -> DataFrame:
    coded = F.exists(F.filter("answer", lambda x: x.isNotNull()), lambda x: x.contains("m."))
    return load(spark, folder, "rog_webqsp").where("answer IS NOT NULL").agg(F.round(F.avg(coded.cast("int")), 6).alias("share"))


@query("a12_best_event_per_user", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def best_event_per_user(spark: SparkSession, folder: str) -> DataFrame:
    return I.best_by(load(spark, folder, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id")


@query("a13_first_event_per_user", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_event_per_user(spark: SparkSession, folder: str) -> DataFrame:
    return I.first_by(load(spark, folder, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("a15_risky_rows", r"""WITH c AS (SELECT pref_row_id, chosen, rejected, len(list_filter(string_split_regex(coalesce(prompt, ''), '\s+'), lambda x: x <> '')) AS pl, list_concat(coalesce(chosen, []::VARCHAR[]), coalesce(rejected, []::VARCHAR[])) AS cs FROM pref_rows),
r AS (SELECT pref_row_id, len(cs) * pow(pl + list_aggregate(list_transform(cs, lambda x: len(string_split_regex(coalesce(x, ''), '\s+'))), 'avg'), 2) AS risk FROM c WHERE len(cs) > 0)
SELECT pref_row_id, round(risk, 4) AS risk FROM r ORDER BY round(risk, 4) DESC, pref_row_id LIMIT 50""")  # fmt: skip
def risky_rows(spark: SparkSession, folder: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    cs = F.concat(F.coalesce("chosen", empty), F.coalesce("rejected", empty))
    lengths = F.aggregate(F.transform("cs", lambda x: F.size(F.split(F.coalesce(x, F.lit("")), r"\s+"))), F.lit(0), lambda a, x: a + x)
    rows = load(spark, folder, "pref_rows").select("pref_row_id", T.approximate_tokens(F.coalesce("prompt", F.lit(""))).alias("pl"), cs.alias("cs")).where(F.size("cs") > 0)
    risk = F.size("cs") * F.pow(F.col("pl") + lengths / F.size("cs"), F.lit(2))
    return rows.select("pref_row_id", F.round(risk, 4).alias("risk")).orderBy(F.desc("risk"), "pref_row_id").limit(50)  # a top-k report


@query("proj05_unprocessed", "SELECT state_id FROM traversal_states WHERE id IN (SELECT id FROM rog_cwq) AND id NOT IN (SELECT id FROM traversal_states WHERE answer_found AND id IS NOT NULL)")
def unprocessed(spark: SparkSession, folder: str) -> DataFrame:
    s = load(spark, folder, "traversal_states")
    return I.unprocessed(s, s.where("answer_found"), "id", load(spark, folder, "rog_cwq")).select("state_id")


BAD = "(prediction IS NULL OR trim(prediction, ' ') = '' OR contains(lower(prediction), 'could not') OR NOT coalesce(answer_found, false))"


@query("proj08_clean_rows", f"SELECT row_id FROM predictions WHERE NOT {BAD}")
def clean_rows(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "predictions").where(~bad_record()).select("row_id")


@query("proj08_removed_ids", f"SELECT DISTINCT id FROM predictions WHERE {BAD}")
def removed_ids(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "predictions").where(bad_record()).select("id").distinct()


def bad_record() -> object:
    """A record to be removed: no prediction, a canned one, or one that was not verified."""
    p = F.col("prediction")
    return p.isNull() | (F.trim(p) == "") | F.lower(p).contains("could not") | ~F.coalesce("answer_found", F.lit(False))


@query("proj09_hits", f"""WITH {ANSWERS} SELECT row_id, CASE WHEN {METHOD} = 'hop' THEN hit = 1 ELSE len(list_filter(g, lambda x: contains(array_to_string(f, ' '), x))) > 0 END AS is_hit FROM m""")
def hits(spark: SparkSession, folder: str) -> DataFrame:
    s = E.with_sets(answers(spark, folder), "found", "ground_truth")
    new = F.when(F.col("run").startswith("hop-"), E.set_metrics(F.col("found_set"), F.col("gold_set"))["hit"] == 1)
    old = E.substring_metrics(F.array_join("found_set", " "), F.col("found_set"), F.col("gold_set"))["any_hit"] == 1
    return s.select("row_id", F.coalesce(new, old).alias("is_hit"))


@query("proj10_id_fallback", "SELECT row_id, coalesce(CASE WHEN starts_with(run, 'trie') THEN NULL ELSE id END, 'q:' || id) AS id FROM predictions")
def id_fallback(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "predictions").withColumn("q_id", F.concat(F.lit("q:"), "id")).withColumn("id", F.when(~F.col("run").startswith("trie"), F.col("id")))
    return rows.select("row_id", F.coalesce("id", "q_id").alias("id"))


@query("proj11_substring_counts", "SELECT count(*) FILTER (WHERE contains(completion, 'located_in')) AS n, count(*) AS rows FROM sft_rows")
def substring_counts(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "sft_rows").agg(F.count_if(F.col("completion").contains("located_in")).alias("n"), F.count(F.lit(1)).alias("rows"))


@query("proj12_long_paths", r"""WITH p AS (SELECT row_id, list_distinct(list_filter(string_split_regex(coalesce(predicted_paths, ''), '[|\n]+'), lambda x: contains(x, ']->'))) AS s, list_distinct(list_filter(coalesce(ground_truth_paths, []::VARCHAR[]), lambda x: x IS NOT NULL)) AS g FROM predictions)
SELECT row_id FROM p WHERE len(s) > 0 AND len(g) > 0 AND NOT (list_has_all(s, g) AND list_has_all(g, s))
AND list_min(list_transform(s, lambda x: len(string_split(x, ' ; ')))) > list_min(list_transform(g, lambda x: len(string_split(x, ' -> ')) // 2)) + 1""")  # fmt: skip
def long_paths(spark: SparkSession, folder: str, diff: int = 2) -> DataFrame:
    from tripleloom.functions.paths import path_length

    found = F.array_distinct(F.filter(F.split(F.coalesce("predicted_paths", F.lit("")), r"[|\n]+"), lambda x: x.contains("]->")))
    gold = F.array_distinct(F.filter(F.coalesce("ground_truth_paths", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    rows = load(spark, folder, "predictions").select("row_id", found.alias("s"), gold.alias("g")).where((F.size("s") > 0) & (F.size("g") > 0))
    differ = (F.size(F.array_except("s", "g")) > 0) | (F.size(F.array_except("g", "s")) > 0)
    short = F.array_min(F.transform("g", lambda x: F.floor(F.size(F.split(x, " -> ")) / 2).cast("int")))
    return rows.where(differ & (F.array_min(F.transform("s", lambda x: path_length(x))) > short + diff - 1)).select("row_id")


@query("proj13_converted", "SELECT row_id AS id, question, array_to_string(list_filter(list_transform(string_split(prediction, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS final_answer_entities FROM predictions WHERE prediction IS NOT NULL")
def converted(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("prediction", ","), lambda x: F.trim(x)), lambda x: x != "")
    return load(spark, folder, "predictions").where("prediction IS NOT NULL").select(F.col("row_id").alias("id"), "question", F.array_join(parts, "|").alias("final_answer_entities"))


SET_F1 = """CASE WHEN len({1}) = 0 THEN (len({0}) = 0)::INT::DOUBLE WHEN len(list_intersect({0}, {1})) = 0 THEN 0 ELSE 2 * (len(list_intersect({0}, {1}))::DOUBLE / len({0})) * (len(list_intersect({0}, {1}))::DOUBLE / len({1}))
/ (len(list_intersect({0}, {1}))::DOUBLE / len({0}) + len(list_intersect({0}, {1}))::DOUBLE / len({1})) END"""


@query("h09_path_metrics", rf"""WITH x AS (SELECT row_id, list_filter(string_split_regex(coalesce(predicted_paths, ''), '[|\t\r\n]+'), lambda v: v <> '') AS ps, list_filter(coalesce(ground_truth_paths, []::VARCHAR[]), lambda v: v IS NOT NULL) AS gs,
list_filter(coalesce(ground_truth, []::VARCHAR[]), lambda v: v IS NOT NULL) AS ga FROM predictions),
n AS (SELECT row_id, list_distinct(list_transform(ps, lambda v: {norm('v')})) AS p, list_distinct(list_transform(gs, lambda v: {norm('v')})) AS gp, list_distinct(list_transform(ps, lambda v: {norm("list_last(string_split(v, '> '))")})) AS e, list_distinct(list_transform(ga, lambda v: {norm('v')})) AS g FROM x)
SELECT row_id, round({SET_F1.format('p', 'gp')}, 6) AS path_f1, round({SET_F1.format('e', 'g')}, 6) AS answer_f1 FROM n""")  # fmt: skip
def path_metrics(spark: SparkSession, folder: str) -> DataFrame:
    known = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    paths = F.filter(F.split(F.coalesce("predicted_paths", F.lit("")), r"[|\t\r\n]+"), lambda x: x != "")
    ends = F.transform(paths, lambda x: F.element_at(F.split(x, "> "), -1))
    rows = load(spark, folder, "predictions").select("row_id", paths.alias("p"), known("ground_truth_paths").alias("gp"), ends.alias("e"), known("ground_truth").alias("g"))
    return rounded(E.path_metrics(rows, "row_id", "p", "gp", "e", "g"), "path_f1", "answer_f1")
