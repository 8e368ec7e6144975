"""Queries of the general training-data problems: heavy keys, nested records, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.operators import packed, salted, shred
from tripleloom.plans.registry import query
from tripleloom.tables import load

LOADS = r"""
ents AS (SELECT DISTINCT row_id, trim(e, e' \t\r\n') AS entity FROM (SELECT row_id, unnest(q_entity) AS e FROM rog_webqsp) WHERE trim(e, e' \t\r\n') <> ''),
trip AS (SELECT trim(g.h, e' \t\r\n') AS h FROM (SELECT unnest(graph) AS g FROM rog_webqsp)
         WHERE trim(g.h, e' \t\r\n') <> '' AND trim(g.r, e' \t\r\n') <> '' AND trim(g.t, e' \t\r\n') <> ''),
loads AS (SELECT 'q_entity' AS field, entity, count(*) AS n, (SELECT count(*) FROM rog_webqsp) AS total FROM ents GROUP BY entity
          UNION ALL SELECT 'graph', h, count(*), (SELECT count(*) FROM trip) FROM trip GROUP BY h)"""


@query("p1_found", f"WITH {LOADS} SELECT field, entity FROM loads WHERE n * 100 >= total * 3")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return salted.heavy_entities(load(spark, folder, "rog_webqsp"))


@query("p1_entity_loads", f"WITH {LOADS} SELECT field, entity, n, total FROM loads")
def p1_entity_loads(spark: SparkSession, folder: str) -> DataFrame:
    return salted.entity_loads(load(spark, folder, "rog_webqsp"))


ROUNDS = """
rounds AS (SELECT state_id, unnest(exploration_trace) AS d, generate_subscripts(exploration_trace, 1) - 1 AS pos1 FROM traversal_states),
rels AS (SELECT state_id, pos1, unnest(d.relations) AS l, generate_subscripts(d.relations, 1) - 1 AS pos2 FROM rounds),
targets AS (SELECT state_id, pos1, pos2, unnest(l.targets) AS item, generate_subscripts(l.targets, 1) - 1 AS pos3 FROM rels)"""
DECISIONS = """
texts AS (SELECT state_id, CASE WHEN json_valid(reasoning_trace) THEN reasoning_trace::JSON END AS j FROM traversal_states),
lists AS (SELECT state_id, CASE json_type(j) WHEN 'OBJECT' THEN json_array(j) WHEN 'ARRAY' THEN j END AS j FROM texts),
decisions AS (SELECT state_id, (p - 1)::INT AS pos1, j->(p - 1)::INT AS d
              FROM (SELECT state_id, j, unnest(range(1, json_array_length(j)::BIGINT + 1)) AS p FROM lists WHERE j IS NOT NULL)),
members AS (SELECT 'answer' AS trace, state_id, pos1, d->'answer_entities' AS m FROM decisions
            UNION ALL SELECT 'pruned', state_id, pos1, d->'pruned_reasoning_paths' FROM decisions),
elements AS (SELECT trace, state_id, pos1, (p - 1)::INT AS pos2, CASE WHEN json_type(m) = 'ARRAY' THEN m->(p - 1)::INT ELSE m END AS e
             FROM (SELECT *, unnest(range(1, CASE WHEN json_type(m) = 'ARRAY' THEN json_array_length(m)::BIGINT ELSE 1 END + 1)) AS p
                   FROM members WHERE m IS NOT NULL AND json_type(m) <> 'NULL'))"""


@query(
    "p5_found",
    f"""WITH {ROUNDS}, {DECISIONS}
SELECT 'exploration' AS trace, state_id, pos1::INT AS pos1, pos2::INT AS pos2, pos3::INT AS pos3, item FROM targets WHERE item IS NOT NULL
UNION ALL SELECT trace, state_id, pos1, pos2, 0, e->>'$' FROM elements WHERE json_type(e) <> 'NULL'
UNION ALL SELECT 'next', state_id, pos1, 0, 0, json_extract_string(d, '$.next_exploration_step.entity') FROM decisions
  WHERE json_extract_string(d, '$.next_exploration_step.entity') IS NOT NULL""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred.trace_items(load(spark, folder, "traversal_states"))


@query(
    "p5_parents",
    f"""WITH {ROUNDS} SELECT 'round' AS level, state_id, pos1::INT AS pos1, NULL::INT AS pos2 FROM rounds
UNION ALL SELECT 'relation', state_id, pos1::INT, pos2::INT FROM rels""",
)
def p5_parents(spark: SparkSession, folder: str) -> DataFrame:
    return shred.trace_parents(load(spark, folder, "traversal_states"))


@query("p5_rounds", f"""WITH {ROUNDS} SELECT state_id, pos1::INT AS pos1, d IS NULL AS is_null, d.round_num AS round_num, d.question AS question, d.entity AS entity,
len(d.relations)::INT AS n_relations FROM rounds""")  # fmt: skip
def p5_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return shred.trace_rounds(load(spark, folder, "traversal_states"))


@query("p5_relations", f"WITH {ROUNDS} SELECT state_id, pos1::INT AS pos1, pos2::INT AS pos2, l IS NULL AS is_null, l.name AS name, len(l.targets)::INT AS n_targets FROM rels")
def p5_relations(spark: SparkSession, folder: str) -> DataFrame:
    return shred.trace_relations(load(spark, folder, "traversal_states"))


@query("p5_decisions", f"""WITH {DECISIONS}, o AS (SELECT state_id, pos1, CASE WHEN json_type(d) = 'OBJECT' THEN d END AS d FROM decisions)
SELECT state_id, pos1, d IS NULL AS is_null, (d->>'answer_found')::BOOLEAN AS answer_found, d->>'reasoning_summary' AS reasoning_summary, d->>'error' AS error,
d->'next_exploration_step'->>'question' AS next_question, d->'next_exploration_step'->>'entity' AS next, len(list_filter(json_keys(d), lambda k: k NOT IN
  ('answer_found', 'answer_entities', 'reasoning_summary', 'error', 'pruned_reasoning_paths', 'next_exploration_step'))) > 0 AS has_more,
CASE json_type(d->'answer_entities') WHEN 'ARRAY' THEN json_array_length(d->'answer_entities')::INT WHEN 'NULL' THEN NULL ELSE CASE WHEN (d->'answer_entities') IS NOT NULL THEN 1 END END AS n_answers,
CASE json_type(d->'pruned_reasoning_paths') WHEN 'ARRAY' THEN json_array_length(d->'pruned_reasoning_paths')::INT WHEN 'NULL' THEN NULL ELSE CASE WHEN (d->'pruned_reasoning_paths') IS NOT NULL THEN 1 END END AS n_pruned FROM o""")  # fmt: skip
def p5_decisions(spark: SparkSession, folder: str) -> DataFrame:
    found = shred.trace_decisions(load(spark, folder, "traversal_states"))
    return found.withColumn("has_more", F.when(~F.col("is_null"), F.col("more").isNotNull())).drop("more")


#: A quoted value for each sign; one field as a list literal, else cut by a pattern of one value and the delimiter after it.
DOUBLE, SINGLE = r'"(?:\\.|""|[^"\\])*"', r"''(?:\\.|''''|[^''\\])*''"


def _unpacked(field: str, delimiters: str, skip: str) -> str:
    value = f"[ ]*({DOUBLE}[ ]*|{SINGLE}[ ]*|[^{delimiters}]*)[{delimiters}]"
    return f"""
{field}_in AS (SELECT row_id, trim({field}, e' \\t\\r\\n') AS x FROM predictions WHERE {field} IS NOT NULL AND NOT ({skip})),
{field}_values AS (SELECT row_id, CASE
    WHEN starts_with(x, '[') AND json_valid(x) THEN list_transform(json_extract(x, '$[*]'), lambda j: j->>'$')
    WHEN regexp_full_match(x, '\\[\\s*({DOUBLE}|{SINGLE})(\\s*,\\s*({DOUBLE}|{SINGLE}))*\\s*\\]')
      THEN list_transform(regexp_extract_all(x, '{DOUBLE}|{SINGLE}'), lambda v: regexp_replace(v[2:-2], '\\\\(.)', '\\1', 'g'))
    ELSE list_transform(list_transform(regexp_extract_all(x || '|', '{value}', 1), lambda v: trim(v)),
      lambda v: CASE WHEN len(v) > 1 AND v[1] IN ('"', '''') AND v[-1] = v[1] THEN replace(replace(v[2:-2], '\\' || v[1], v[1]), v[1] || v[1], v[1]) ELSE v END) END AS v FROM {field}_in),
{field}_items AS (SELECT row_id, '{field}' AS field, list_filter(list_transform(v, lambda y: trim(y)), lambda y: y <> '') AS v FROM {field}_values)"""


UNPACKED = f"""WITH {_unpacked("prediction", ",;|" + chr(9) + chr(13) + chr(10), "starts_with(ltrim(prediction), '{') AND json_valid(prediction)")},{_unpacked("predicted_paths", "|" + chr(9) + chr(13) + chr(10), "false")}
SELECT row_id, field, unnest(range(len(v)))::INT AS pos, unnest(v) AS item FROM (FROM prediction_items UNION ALL FROM predicted_paths_items)"""


@query("p6_found", UNPACKED)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed.unpack(
        load(spark, folder, "predictions"),
        "row_id",
        {"prediction": packed.ANSWER_DELIMITERS, "predicted_paths": packed.PATH_DELIMITERS},
        object_fields=("prediction",),
    )
