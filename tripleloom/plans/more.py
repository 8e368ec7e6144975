"""Queries of smaller operators: replies, budgets, chat styles, scores, losses, tries, joins, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.functions import text as T
from tripleloom.functions.vectors import cosine, dot
from tripleloom.operators import analytics as I
from tripleloom.operators import evaluation as E
from tripleloom.operators import training, trie, walks
from tripleloom.plans.evaluate import ANSWERS, SCORES, SUB, SUBOUT, answers, candidate_scores, rounded
from tripleloom.plans.graph import NODES, TRUTH, W, questions, triples_of
from tripleloom.plans.registry import QUERIES, SQL, query
from tripleloom.plans.rows import NEGATIVES, PERTURBED, items
from tripleloom.plans.sqlparts import KG, last_wins, triples
from tripleloom.tables import load

# -- texts


@query("c08_fallback_answers", f"""WITH p AS (SELECT row_id, prediction, starts_with(ltrim(prediction), '{{') AND json_valid(prediction) AS o FROM predictions WHERE prediction IS NOT NULL),
j AS (SELECT row_id, o, prediction, CASE WHEN o THEN prediction::JSON END AS j FROM p)
SELECT row_id, true AS can_answer, CASE WHEN trim(j->>'reasoning_path') <> '' THEN j->>'reasoning_path' ELSE '{T.NO_PATH}' END AS reasoning_path,
coalesce(array_to_string((j->'answer_entities')::VARCHAR[], '|'), '') AS answers,
CASE WHEN trim(j->>'reasoning_summary') <> '' THEN j->>'reasoning_summary' WHEN j IS NULL AND prediction <> '' THEN '{T.NO_OBJECT}' ELSE '{T.NO_ANSWER}' END AS reasoning_summary FROM j""")  # fmt: skip
def fallback_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "predictions").where("prediction IS NOT NULL").select("row_id", T.fallback_answer(F.col("prediction")).alias("x"))
    return rows.select("row_id", "x.can_answer", "x.reasoning_path", F.array_join("x.answer_entities", "|").alias("answers"), "x.reasoning_summary")


WORDS = r"len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))"


@query("c18_lines_within_budget", f"""WITH l AS (SELECT sft_row_id, unnest(string_split(prompt, chr(10))) AS x, generate_subscripts(string_split(prompt, chr(10)), 1) AS i FROM sft_rows WHERE prompt IS NOT NULL),
n AS (SELECT sft_row_id, x, i, sum({WORDS}) OVER (PARTITION BY sft_row_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS used FROM l),
cut AS (SELECT sft_row_id, min(i) FILTER (WHERE used > 20 AND i > 1) AS first_out FROM n GROUP BY sft_row_id)
SELECT sft_row_id, string_agg(x, chr(10) ORDER BY i) AS kept FROM n JOIN cut USING (sft_row_id) WHERE first_out IS NULL OR i < first_out GROUP BY sft_row_id""")  # fmt: skip
def lines_within_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "sft_rows").where("prompt IS NOT NULL")
    return rows.select("sft_row_id", T.head_lines(F.col("prompt"), 20).alias("kept"))


def _style_sql() -> str:
    """The 16 styles written out turn by turn: an asked and answered first turn, a second one left open."""
    p, c, n = "p", "c", "chr(10)"
    said = lambda mid, e0, e1: (f"'U' || {mid} || {p} || {e0}", f"'B' || {mid} || {c} || {e1}")
    both = lambda turns, last, before="''": f"{before} || {turns[0]} || {turns[1]} || {before} || {last}"
    styles = {
        "add_colon_single": "'S#' || " + both(said("': '", "'#'", "'#'"), "'U:'"),
        "add_colon_two": "'S#' || " + both(said("': '", "'#'", "'$'"), "'U:'"),
        "add_colon_space_single": "'S#' || " + both(said("': '", "'#'", "'#'"), "'U: '"),
        "no_colon_single": "'S' || " + both(said("''", "'#'", "'#'"), "'U'"),
        "no_colon_two": "'S' || " + both(said("''", "'#'", "'$'"), "'U'"),
        "add_new_line_single": "'S#' || " + both(said(n, "'#'", "'#'"), f"'U' || {n}"),
        "llama2": f"'S' || {p} || ' ' || 'B ' || {c} || '$' || 'U'",
        "chatglm": f"'S#' || '[Round 0]#' || 'U：' || {p} || '#' || 'B：' || {c} || '#' || '[Round 1]#' || 'U：'",
        "chatml": f"'S#' || {n} || " + both(said(n, f"'#' || {n}", f"'#' || {n}"), f"'U' || {n}"),
        "chatintern": "'S' || " + both(said("':'", f"'#' || {n}", f"'$' || {n}"), "'U:'", "'<s>'"),
        "dolly": "'S' || " + both(said(f"':' || {n}", "'#'", f"'$' || {n} || {n}"), f"'U:' || {n}"),
        "rwkv": "'S' || " + f"'U: ' || replace(replace({p}, chr(13) || {n}, {n}), {n} || {n}, {n}) || {n} || {n} || 'B: ' || replace(replace({c}, chr(13) || {n}, {n}), {n} || {n}, {n}) || {n} || {n} || 'U:'",
        "phoenix": "'S' || " + both(said("': <s>'", "'</s>'", "'</s>'"), "'U: <s>'"),
        "robin": "'S#' || " + both(said(f"':' || {n}", "'#'", "'#'"), f"'U:' || {n}"),
        "falcon_chat": "'S#' || " + both(said("': '", "'#'", "'#'"), "'U:'"),
        "chatglm3": "'S' || " + both(said(f"{n} || ' '", "''", "''"), "'U'"),
    }
    rows = "SELECT sft_row_id, prompt AS p, completion AS c FROM sft_rows WHERE prompt <> '' AND completion <> ''"
    return f"WITH t AS ({rows}) " + " UNION ALL ".join(f"SELECT sft_row_id, '{name}' AS style, md5({sql}) AS prompt_md5 FROM t" for name, sql in styles.items())


@query("c20_chat_styles", _style_sql())
def chat_styles(spark: SparkSession, folder: str) -> DataFrame:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    m = F.array(turn("U", F.col("prompt")), turn("B", F.col("completion")), turn("U", F.lit(None).cast("string")))
    styles = F.array(*(F.struct(F.lit(name).alias("style"), F.md5(T.chat_prompt(F.lit("S"), m, name, "#", "$")).alias("prompt_md5")) for name in T.SEPARATOR_STYLES))
    return load(spark, folder, "sft_rows").where("prompt <> '' AND completion <> ''").select("sft_row_id", F.inline(styles))


@query("c22_confidence_bounds", """SELECT row_id, round(CASE WHEN llm_calls > 0 THEN runtime_s / llm_calls + 1.5 * sqrt(ln(llm_tokens) / llm_calls) END, 6) AS bound FROM predictions WHERE llm_tokens > 0""")
def confidence_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The bound that tree search ranks by, on recorded figures as wins, tries and tries of the parent."""
    p = load(spark, folder, "predictions").where("llm_tokens > 0")
    bound = walks.bound_column(F.col("runtime_s"), F.col("llm_calls"), F.col("llm_tokens"), 1.5)
    return p.select("row_id", F.round(bound, 6).alias("bound"))


@query("c23_vector_products", """SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) AS dot,
round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")  # fmt: skip
def vector_products(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return both.select("vec_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("dot"), F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("a18_call_counters", rf"""WITH x AS (SELECT metadata.original_dataset_source AS source, {WORDS.replace('(x,', "(coalesce(prompt, ''),")} AS a, {WORDS.replace('(x,', "(coalesce(completion, ''),")} AS b FROM sft_rows)
SELECT source, count(*) AS calls, sum(a)::BIGINT AS prompt_tokens, sum(b)::BIGINT AS answer_tokens, sum(a + b)::BIGINT AS tokens FROM x GROUP BY source""")  # fmt: skip
def call_counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "sft_rows").select(F.col("metadata.original_dataset_source").alias("source"), "prompt", "completion")
    return I.call_counters(rows, ["source"], "prompt", "completion")


# -- scores and losses


@query("f15_combined_loss", f"""WITH {SCORES}, b AS (SELECT avg(-(label * ln(1 / (1 + exp(-score))) + (1 - label) * ln(1 - 1 / (1 + exp(-score))))) AS c, avg(((score > 0) = (label = 1))::INT) AS a FROM scores),
p AS (SELECT avg(x) AS d FROM (SELECT avg(ln(1 + exp(-(g.score - w.score)))) AS x FROM scores g JOIN scores w ON g.prompt_id = w.prompt_id AND g.label = 1 AND w.label = 0 GROUP BY g.prompt_id))
SELECT round(c, 6) AS classification_loss, round(coalesce(d, 0), 6) AS contrast_loss, round(c + 0.5 * coalesce(d, 0), 6) AS total_loss, round(a, 6) AS classification_accuracy FROM b, p""")  # fmt: skip
def combined_loss(spark: SparkSession, folder: str) -> DataFrame:
    found = training.mpo_loss(candidate_scores(spark, folder), "prompt_id", "score", "label", contrast_weight=0.5)
    return rounded(found, *found.columns)


@query("o02_best_candidates", f"WITH {SCORES} SELECT DISTINCT prompt_id, candidate, round(score, 6) AS score FROM (FROM scores QUALIFY dense_rank() OVER (PARTITION BY prompt_id ORDER BY score DESC, candidate) <= 2)")
def best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    s = candidate_scores(spark, folder).select("prompt_id", "candidate", "score").distinct()
    w = Window.partitionBy("prompt_id").orderBy(F.desc("score"), "candidate")
    return s.withColumn("n", F.row_number().over(w)).where("n <= 2").select("prompt_id", "candidate", F.round("score", 6).alias("score"))  # a top-k report


# -- evaluation


@query("h04_any_gold_hit", f"WITH {ANSWERS}, {SUB}, o AS (SELECT row_id, {SUBOUT} FROM s) SELECT row_id, any_hit FROM o")
def any_gold_hit(spark: SparkSession, folder: str) -> DataFrame:
    s = E.with_sets(answers(spark, folder), "found", "ground_truth")
    joined = F.array_join("found_set", " ")
    return s.select("row_id", F.exists("gold_set", lambda g: F.contains(joined, g)).cast("int").alias("any_hit"))


@query("h05_set_f1", f"WITH {ANSWERS} SELECT row_id, round(f1, 6) AS f1 FROM m")
def set_f1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.evaluated(answers(spark, folder), "found", "ground_truth").select("row_id", "f1"), "f1")


@query("h06_substring_f1", f"WITH {ANSWERS}, {SUB}, o AS (SELECT row_id, {SUBOUT}, nf, ng FROM s) SELECT row_id, round(CASE WHEN nf = 0 OR ng = 0 OR p + acc = 0 THEN 0 ELSE 2 * p * acc / (p + acc) END, 6) AS f1 FROM o")
def substring_f1(spark: SparkSession, folder: str) -> DataFrame:
    s = E.with_sets(answers(spark, folder), "found", "ground_truth")
    m = E.substring_metrics(F.array_join("found_set", " "), F.col("found_set"), F.col("gold_set"))
    return rounded(s.select("row_id", m["f1"].alias("f1")), "f1")


# -- paths, joins, sets


@query("t12_tree_search_lengths", f"WITH RECURSIVE {W}, {NODES}, {TRUTH} SELECT DISTINCT qid, s, t, hops::INT AS hops FROM truth WHERE hops > 0")
def tree_search_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """How long the paths are that tree search comes upon; in graphs of this size they are the shortest ones."""
    return walks.searched_paths(questions(spark, folder), key="qid").select("qid", "s", "t", F.size("path").alias("hops"))


@query("j01_two_hops", f"WITH {triples('rog_cwq')}, {last_wins()} SELECT a.qid, a.h, a.r AS r1, a.t AS middle, b.r AS r2, b.t FROM edges a JOIN edges b ON a.qid = b.qid AND a.t = b.h")
def two_hops(spark: SparkSession, folder: str) -> DataFrame:
    edges = walks.edges(questions(spark, folder, "rog_cwq"), key="qid")
    one = edges.select("qid", "h", F.col("r").alias("r1"), F.col("t").alias("middle"))
    return one.join(edges.select("qid", F.col("h").alias("middle"), F.col("r").alias("r2"), "t"), ["qid", "middle"]).select("qid", "h", "r1", "middle", "r2", "t")


@query("n05_items_kept", f"WITH RECURSIVE {W}, {NODES}, {TRUTH}, {KG}, {PERTURBED}, {NEGATIVES} SELECT DISTINCT qid FROM (SELECT qid FROM truth WHERE hops > 0 UNION ALL SELECT qid FROM negs)")
def items_kept(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("qid")


@query("u04_all_candidates", "SELECT DISTINCT pref_row_id, unnest(list_concat(coalesce(chosen, []), coalesce(rejected, []))) AS candidate FROM pref_rows")
def all_candidates(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("chosen", none), F.coalesce("rejected", none))
    return load(spark, folder, "pref_rows").select("pref_row_id", F.explode(both).alias("candidate")).distinct()


@query("u06_equal_lists", "SELECT row_id, list_sort(list_distinct(answer)) = list_sort(list_distinct(a_entity)) AS equal FROM rog_webqsp WHERE answer IS NOT NULL AND a_entity IS NOT NULL")
def equal_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "rog_webqsp").where("answer IS NOT NULL AND a_entity IS NOT NULL")
    members = lambda c: F.sort_array(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
    return rows.select("row_id", (members("answer") == members("a_entity")).alias("equal"))


VOCABULARY = ["a", "b", "[S]", "[M]", "[E]"]


@query("r07_free_trie", f"WITH {triples('rog_cwq')} SELECT DISTINCT h || ' ' || r AS prefix, v.next FROM trip, (SELECT unnest({VOCABULARY!r}) AS next) v")
def free_trie(spark: SparkSession, folder: str) -> DataFrame:
    asked = triples_of(spark, folder, "rog_cwq").select(F.concat_ws(" ", "h", "r").alias("prefix"))
    return trie.free(asked, VOCABULARY)


@query("r07_staged_trie", f"""WITH {triples('rog_cwq')}, a AS (SELECT DISTINCT CASE seq % 4 WHEN 0 THEN [] WHEN 1 THEN [h] WHEN 2 THEN [h, r] ELSE [h, r, '[/E]'] END AS tokens FROM trip)
SELECT array_to_string(tokens, ' ') AS prefix, unnest(CASE WHEN tokens[-1] = '[/E]' THEN ['</s>'] WHEN len(tokens) = 0 THEN ['[M]'] WHEN len(tokens) = 1 THEN ['[E]'] ELSE ['a', 'b'] END) AS next FROM a""")  # fmt: skip
def staged_trie(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("seq") % 4
    tokens = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("h")).when(k == 2, F.array("h", "r")).otherwise(F.array("h", "r", F.lit("[/E]")))
    asked = triples_of(spark, folder, "rog_cwq").select(tokens.alias("tokens")).distinct()
    found = trie.staged(asked, "tokens", VOCABULARY, end_mention="[M]", start_entity="[E]", end_entity="[/E]", start_mention="[S]")
    return found.select(F.array_join("tokens", " ").alias("prefix"), "next")


# the same operation under the inventory's second name for it
for _name, _same in (("i05_converted", "proj13_converted"), ("j10_alike_relations_of_a_node", "v05_confusable_relations"), ("j12_nearest_keys", "v01_top_ip")):
    query(_name, SQL[_same])(QUERIES[_same])
