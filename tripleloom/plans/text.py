"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions import paths as P
from tripleloom.functions import text as T
from tripleloom.operators import graph as G
from tripleloom.plans.registry import query
from tripleloom.plans.sqlparts import strip
from tripleloom.tables import load

SPACES = r"[\s\x0b\x85\x1c-\x1f\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PUNCT = """translate(lower({0}), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"""


def norm(x: str) -> str:
    """Normalised text in SQL, by splitting into tokens and leaving the articles out."""
    flat = f"regexp_replace({PUNCT.format(x)}, '{SPACES}', ' ', 'g')"
    return f"array_to_string(list_filter(string_split({flat}, ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query("c01_normalized", f"SELECT doc_id, {norm('text')} AS value FROM documents WHERE text IS NOT NULL")
def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.normalize(F.col("text")).alias("value"))


@query("c03_gold_in_prediction", f"""SELECT row_id, i::INT AS pos, contains({norm('prediction')}, {norm('g')}) AS there
FROM (SELECT row_id, prediction, unnest(ground_truth) AS g, generate_subscripts(ground_truth, 1) - 1 AS i FROM predictions WHERE prediction IS NOT NULL) WHERE g IS NOT NULL""")  # fmt: skip
def gold_in_prediction(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "predictions").where("prediction IS NOT NULL").select("row_id", "prediction", F.posexplode("ground_truth").alias("pos", "g")).where("g IS NOT NULL")
    return p.select("row_id", "pos", T.holds(F.col("prediction"), F.col("g")).alias("there"))


REPLIES = """replies AS (SELECT sft_row_id, '# Reasoning Path:' || chr(10) || coalesce(prompt, '') || chr(10) || '# Answer:' || chr(10) || completion || chr(10) || 'the answer is: ' || metadata.current_source_entity AS reply FROM sft_rows)"""


def replies(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.concat(F.lit("# Reasoning Path:\n"), F.coalesce("prompt", F.lit("")), F.lit("\n# Answer:\n"), "completion", F.lit("\nthe answer is: "), "metadata.current_source_entity")
    return load(spark, folder, "sft_rows").select("sft_row_id", reply.alias("reply"))


@query("c04_answer_lines", rf"""WITH {REPLIES}, l AS (SELECT sft_row_id, CASE WHEN contains(reply, e'# Answer:\n') THEN substr(reply, strpos(reply, e'# Answer:\n') + 10) ELSE reply END AS x FROM replies)
SELECT sft_row_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> ''), '|') AS answers FROM l WHERE x IS NOT NULL""")  # fmt: skip
def answer_lines(spark: SparkSession, folder: str) -> DataFrame:
    return replies(spark, folder).where("reply IS NOT NULL").select("sft_row_id", F.array_join(T.lines_after(F.col("reply")), "|").alias("answers"))


@query("c05_final_sentence", f"WITH {REPLIES} SELECT sft_row_id, list_last(string_split(reply, 'the answer is: ')) AS answer FROM replies WHERE reply IS NOT NULL")
def final_sentence(spark: SparkSession, folder: str) -> DataFrame:
    return replies(spark, folder).where("reply IS NOT NULL").select("sft_row_id", T.after_last(F.col("reply"), T.SENTENCE_MARK).alias("answer"))


@query("c06_indexed_selection", r"""WITH s AS (SELECT pref_row_id, list_transform(regexp_extract_all(array_to_string(chosen, ' '), '\[REL(\d+)\]', 1), lambda x: x::INT) AS picked, list_concat(chosen, rejected) AS options FROM pref_rows),
o AS (SELECT pref_row_id, picked, unnest(options) AS c, generate_subscripts(options, 1) AS i FROM s)
SELECT pref_row_id, string_agg(c, '|' ORDER BY i) AS selected FROM o WHERE list_contains(picked, i) AND c IS NOT NULL GROUP BY pref_row_id""")  # fmt: skip
def indexed_selection(spark: SparkSession, folder: str) -> DataFrame:
    s = load(spark, folder, "pref_rows").select("pref_row_id", F.array_join("chosen", " ").alias("reply"), F.concat("chosen", "rejected").alias("options"))
    s = s.select("pref_row_id", T.selected(F.col("reply"), F.col("options")).alias("x")).where(F.size("x") > 0)
    return s.select("pref_row_id", F.array_join("x", "|").alias("selected"))


@query("c09_mediator_codes", r"""SELECT row_id, array_to_string(regexp_extract_all(predicted_paths, 'm\.[0-9a-z_]+'), '|') AS codes FROM predictions WHERE predicted_paths IS NOT NULL""")
def mediator_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.regexp_extract_all("predicted_paths", F.lit(T.MEDIATOR), F.lit(0))
    return load(spark, folder, "predictions").where("predicted_paths IS NOT NULL").select("row_id", F.array_join(codes, "|").alias("codes"))


@query("c10_quoted_list", f"""SELECT row_id, array_to_string(list_transform(list_filter(list_transform(a_entity, lambda x: {strip('x')}), lambda x: x <> ''), lambda x: '"' || x || '"'), ', ') AS quoted FROM rog_webqsp WHERE a_entity IS NOT NULL""")
def quoted_list(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "rog_webqsp").where("a_entity IS NOT NULL").select("row_id", T.quoted_list(G.entity_list(F.col("a_entity"))).alias("quoted"))


@query("c11_rule_text", f"""WITH g AS (SELECT row_id, unnest(graph) AS g, generate_subscripts(graph, 1) AS i FROM rog_cwq)
SELECT row_id, '<PATH>' || string_agg({strip('g.r')}, '<SEP>' ORDER BY i) || '</PATH>' AS rule FROM g WHERE {strip('g.h')} <> '' AND {strip('g.r')} <> '' AND {strip('g.t')} <> '' GROUP BY row_id""")  # fmt: skip
def rule_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "rog_cwq").select("row_id", P.relations(G.valid_steps(F.col("graph"))).alias("rs")).where(F.size("rs") > 0)
    return rows.select("row_id", P.rule_text(F.col("rs")).alias("rule"))


@query("c12_question_marks", "SELECT row_id, CASE WHEN ends_with(question, '?') THEN question ELSE question || '?' END AS question FROM rog_cwq")
def question_marks(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "rog_cwq").select("row_id", T.with_question_mark(F.col("question")).alias("question"))


@query("c13_relation_words", "SELECT DISTINCT lower(replace(r, '_', ' ')) AS words FROM (SELECT unnest(graph, recursive := true) FROM rog_cwq) WHERE r IS NOT NULL")
def relation_words(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "rog_cwq").select(F.explode("graph").alias("g")).select("g.r").where("r IS NOT NULL")
    return r.select(T.relation_words(F.col("r")).alias("words")).distinct()


@query("c14_prompts", "SELECT row_id, 'Question: ' || coalesce(question, '') || chr(10) || 'From: ' || coalesce(array_to_string(list_filter(q_entity, lambda x: x IS NOT NULL), ', '), '') AS prompt FROM rog_cwq")
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    filled = T.fill_template("Question: {question}\nFrom: {start}", question=F.col("question"), start=F.array_join("q_entity", ", "))
    return load(spark, folder, "rog_cwq").select("row_id", filled.alias("prompt"))


PARSED = r"""texts AS (SELECT row_id, unnest(ground_truth_paths) AS x, generate_subscripts(ground_truth_paths, 1) - 1 AS p FROM predictions),
steptexts AS (SELECT row_id, p, x, string_split(x, ' -> ') AS w FROM texts WHERE x IS NOT NULL)"""


@query("c15_history_lines", rf"""WITH {PARSED}, s AS (SELECT row_id, p, unnest(range(0, (len(w) - 1) // 2)) AS i, w FROM steptexts)
SELECT row_id, p::INT AS p, string_agg('Step ' || (i + 1) || ': From ''' || w[2 * i + 1] || ''' explored relation ''' || w[2 * i + 2] || ''', leading to ''' || w[2 * i + 3] || '''.', chr(10) ORDER BY i) AS history FROM s GROUP BY row_id, p""")  # fmt: skip
def history_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "predictions").select("row_id", F.posexplode("ground_truth_paths").alias("p", "x")).where("x IS NOT NULL")
    w = F.split("x", " -> ")
    path = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 3) / 2).cast("int")), lambda i: F.struct(F.get("w", 2 * i).alias("h"), F.get("w", 2 * i + 1).alias("r"), F.get("w", 2 * i + 2).alias("t")))
    return rows.withColumn("w", w).where(F.size("w") >= 3).select("row_id", "p", T.history_lines(path).alias("history"))


@query("c16_short_names", "SELECT row_id, CASE WHEN length(question) > 64 THEN substr(question, 1, 64) || '_' || md5(question) ELSE question END AS name FROM rog_cwq")
def short_names(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "rog_cwq").select("row_id", T.short_name(F.col("question")).alias("name"))


@query("proj14_safe_names", r"""SELECT DISTINCT run, trim(regexp_replace(regexp_replace(regexp_replace(run || '/' || id || ' $1', '[/\\]', '_', 'g'), '[^\w\s_.-]', '', 'g'), '\s+', '_', 'g'), '_') AS name FROM predictions""")
def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "predictions").select("run", T.safe_file_name(F.concat("run", F.lit("/"), "id", F.lit(" $1"))).alias("name")).distinct()


@query("proj16_control_characters", r"""SELECT doc_id, len(regexp_extract_all(text, '[\x00-\x1f\x7f]'))::INT AS n FROM documents WHERE regexp_matches(text, '[\x00-\x1f\x7f]')""")
def control_characters(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").where(F.col("text").rlike(r"[\x00-\x1f\x7f]"))
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"[\x00-\x1f\x7f]")).alias("n"))


BUDGET = """t AS (SELECT row_id, unnest(ground_truth_paths) AS x, generate_subscripts(ground_truth_paths, 1) - 1 AS p FROM predictions),
o AS (SELECT row_id, p, x, md5('pack|' || row_id || '|' || p) AS k FROM t WHERE x IS NOT NULL),
r AS (SELECT *, sum(length(x)) OVER (PARTITION BY row_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run, sum(length(x)) OVER (PARTITION BY row_id) AS whole FROM o)"""


@query("c17_packed_to_budget", f"WITH {BUDGET} SELECT row_id, p::INT AS p, x FROM r WHERE whole < 100 OR run <= 100")
def packed_to_budget(spark: SparkSession, folder: str) -> DataFrame:
    from tripleloom.functions.sampling import seeded

    rows = load(spark, folder, "predictions").select("row_id", F.posexplode("ground_truth_paths").alias("p", "x")).where("x IS NOT NULL")
    return T.packed_to_budget(rows, ["row_id"], "x", seeded("pack", F.col("row_id"), F.col("p")), 100)


@query("c19_approximate_tokens", r"""WITH w AS (SELECT sft_row_id, len(list_filter(string_split_regex(prompt, '\s+'), lambda x: x <> ''))::INT AS words, length(prompt)::INT AS chars FROM sft_rows WHERE prompt IS NOT NULL)
SELECT sft_row_id, words, floor(words * 1.5)::INT AS words15, chars FROM w""")  # fmt: skip
def approximate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "sft_rows").where("prompt IS NOT NULL")
    return rows.select("sft_row_id", *(T.approximate_tokens(F.col("prompt"), m).alias(m) for m in ("words", "words15", "chars")))


@query("c20_chat_texts", """SELECT sft_row_id, '<|im_start|>user' || chr(10) || coalesce(prompt, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || coalesce(completion, '') || '<|im_end|>' || chr(10) AS chatml,
'USER: ' || coalesce(prompt, '') || chr(10) || 'ASSISTANT: ' || coalesce(completion, '') || chr(10) AS colon FROM sft_rows""")  # fmt: skip
def chat_texts(spark: SparkSession, folder: str) -> DataFrame:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    messages = F.array(turn("user", "prompt"), turn("assistant", "completion"))
    return load(spark, folder, "sft_rows").select("sft_row_id", T.chat_text(messages, "chatml").alias("chatml"), T.chat_text(messages, "add_colon_single").alias("colon"))


@query("t19_parsed_steps", r"""WITH x AS (SELECT row_id, unnest(string_split_regex(predicted_paths, '[|\t\r\n]+')) AS x FROM predictions WHERE predicted_paths IS NOT NULL AND contains(predicted_paths, ']->')),
parts AS (SELECT row_id, unnest(string_split(x, ' ; ')) AS p FROM x),
opened AS (SELECT row_id, substr(p, 1, strpos(p, '-[') - 1) AS h, substr(p, strpos(p, '-[') + 2) AS rest FROM parts WHERE strpos(p, '-[') > 1),
closed AS (SELECT row_id, h, substr(rest, 1, strpos(rest, ']->') - 1) AS r, substr(rest, strpos(rest, ']->') + 3) AS t FROM opened WHERE strpos(rest, ']->') > 1)
SELECT row_id, rtrim(h) AS h, trim(r) AS r, ltrim(t) AS t FROM closed WHERE trim(r) <> '' AND t <> ''""")  # fmt: skip
def parsed_steps(spark: SparkSession, folder: str) -> DataFrame:
    texts = load(spark, folder, "predictions").where(F.col("predicted_paths").contains("]->")).select("row_id", F.explode(F.split("predicted_paths", r"[|\t\r\n]+")).alias("x"))
    return texts.select("row_id", F.inline(P.parse_steps(F.col("x"))))


@query("t19_path_texts", f"""WITH g AS (SELECT row_id, unnest(graph) AS g FROM rog_cwq), v AS (SELECT row_id, {strip('g.h')} AS h, {strip('g.r')} AS r, {strip('g.t')} AS t FROM g)
SELECT row_id, h || ' -> ' || r || ' -> ' || t AS arrow, h || ' --[' || r || ']--> ' || t AS dashed, h || ' ' || r || ' ' || t AS plain, h || '-[' || r || ']->' || t AS steps FROM v WHERE h <> '' AND r <> '' AND t <> ''""")  # fmt: skip
def path_texts(spark: SparkSession, folder: str) -> DataFrame:
    path = load(spark, folder, "rog_cwq").select("row_id", F.explode(G.valid_steps(F.col("graph"))).alias("s")).select("row_id", F.array("s").alias("p"))
    return path.select("row_id", P.arrow_text(F.col("p")).alias("arrow"), P.dashed_text(F.col("p")).alias("dashed"), P.plain_text(F.col("p")).alias("plain"), P.steps_text(F.col("p")).alias("steps"))


@query("t21_path_lengths", r"""WITH x AS (SELECT row_id, unnest(string_split_regex(coalesce(predicted_paths, ''), '[|\n]+')) AS x FROM predictions)
SELECT row_id, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ; ')) END::INT AS steps FROM x""")  # fmt: skip
def path_lengths(spark: SparkSession, folder: str) -> DataFrame:
    texts = load(spark, folder, "predictions").select("row_id", F.explode(F.split(F.coalesce("predicted_paths", F.lit("")), r"[|\n]+")).alias("x"))
    return texts.select("row_id", P.path_length(F.col("x")).alias("steps"))


@query("c07_reply_objects", """SELECT row_id, (prediction::JSON->'answer_found')::BOOLEAN AS answer_found, array_to_string((prediction::JSON->'answer_entities')::VARCHAR[], '|') AS answers
FROM predictions WHERE starts_with(ltrim(prediction), '{') AND json_valid(prediction)""")  # fmt: skip
def reply_objects(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "predictions").where(F.ltrim("prediction").startswith("{"))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "prediction", F.lit("\n```\nDone."))
    rows = rows.select("row_id", T.read_reply(fenced).alias("x"))
    return rows.select("row_id", "x.answer_found", F.array_join("x.answer_entities", "|").alias("answers"))
