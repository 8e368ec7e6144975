"""Queries of triples, graphs, lookups, walks and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions import paths as P
from tripleloom.operators import graph as G
from tripleloom.operators import shortest, walks
from tripleloom.plans.registry import query
from tripleloom.plans.sqlparts import KG, STEP, last_wins, med, members, strip, triples
from tripleloom.session import cut_lineage
from tripleloom.tables import load


def triples_of(spark: SparkSession, folder: str, table: str = "rog_webqsp") -> DataFrame:
    return G.triples(load(spark, folder, table), "row_id")


def knowledge(spark: SparkSession, folder: str) -> DataFrame:
    return G.distinct_triples(triples_of(spark, folder), triples_of(spark, folder, "rog_cwq"))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return G.clean_graph(cut_lineage(knowledge(spark, folder)))  # the triples are read for their mediators and for the rest


def questions(spark: SparkSession, folder: str, table: str = "rog_webqsp") -> DataFrame:
    return load(spark, folder, table).withColumnRenamed("row_id", "qid")


def steps(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", *more, P.steps_text(F.col("path")).alias("path"))


W = f"{triples('rog_webqsp')}, {last_wins()}, {members('rog_webqsp', 'q_entity', 'starts')}, {members('rog_webqsp', 'a_entity', 'ends')}"
VISITS = """walk(qid, start, hops, here, path) AS (
  SELECT s.qid, s.pos, 1, e.t, e.h || '-[' || e.r || ']->' || e.t FROM starts s JOIN edges e ON e.qid = s.qid AND e.h = s.e
  UNION ALL SELECT w.qid, w.start, w.hops + 1, e.t, w.path || ' ; ' || e.h || '-[' || e.r || ']->' || e.t
  FROM walk w JOIN edges e ON e.qid = w.qid AND e.h = w.here WHERE w.hops < {k})"""


@query("proj01_valid_triples", f"WITH {triples('rog_webqsp')} SELECT qid, seq::INT AS seq, h, r, t FROM trip")
def valid_triples(spark: SparkSession, folder: str) -> DataFrame:
    return triples_of(spark, folder)


@query("proj02_entity_lists", f"""SELECT row_id, coalesce(array_to_string(list_filter(list_transform(q_entity, lambda x: {strip('x')}), lambda x: x <> ''), '|'), '') AS entities,
coalesce(len(list_filter(list_transform(q_entity, lambda x: {strip('x')}), lambda x: x <> '')), 0)::INT AS n FROM rog_webqsp""")  # fmt: skip
def entity_lists(spark: SparkSession, folder: str) -> DataFrame:
    e = G.entity_list(F.col("q_entity"))
    return load(spark, folder, "rog_webqsp").select("row_id", F.array_join(e, "|").alias("entities"), F.size(e).alias("n"))


@query("proj03_start_entities", f"""WITH {members('rog_webqsp', 'q_entity', 's')}, f AS (SELECT qid, e, min(pos) AS pos FROM s GROUP BY qid, e),
j AS (SELECT qid, string_agg(e, '|' ORDER BY pos) AS starts FROM f GROUP BY qid)
SELECT row_id, coalesce(starts, '') AS starts FROM rog_webqsp LEFT JOIN j ON qid = row_id""")  # fmt: skip
def start_entities(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "rog_webqsp").select("row_id", F.array_join(G.start_entities(F.col("q_entity")), "|").alias("starts"))


@query("proj04_entities_in_graph", f"""WITH {W}, nodes AS (SELECT qid, h AS e FROM trip UNION SELECT qid, t FROM trip),
a AS (SELECT qid, count(*) AS n FROM starts SEMI JOIN nodes USING (qid, e) GROUP BY qid), b AS (SELECT qid, count(*) AS n FROM ends SEMI JOIN nodes USING (qid, e) GROUP BY qid)
SELECT row_id AS qid, coalesce(a.n, 0)::INT AS valid_q_entities, coalesce(b.n, 0)::INT AS valid_a_entities FROM rog_webqsp LEFT JOIN a ON a.qid = row_id LEFT JOIN b ON b.qid = row_id""")  # fmt: skip
def entities_in_graph(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder)
    nodes = triples_of(spark, folder).select("qid", F.explode(F.array("h", "t")).alias("e")).distinct()
    asked = q.select("qid", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), G.entity_list(F.col(c)).alias("es")) for c in ("q_entity", "a_entity")))).alias("x"))
    asked = asked.select("qid", "x.side", F.explode_outer("x.es").alias("e")).join(nodes.withColumn("there", F.lit(1)), ["qid", "e"], "left")
    count = lambda side: F.sum(F.when(F.col("side") == side, F.col("there")).otherwise(0)).cast("int")
    return asked.groupBy("qid").agg(F.coalesce(count("q_entity"), F.lit(0)).alias("valid_q_entities"), F.coalesce(count("a_entity"), F.lit(0)).alias("valid_a_entities"))


@query("proj06_mediators", f"WITH {KG} SELECT DISTINCT e AS entity FROM (SELECT h AS e FROM kg UNION ALL SELECT t FROM kg) WHERE {med('e')}")
def mediators(spark: SparkSession, folder: str) -> DataFrame:
    return G.entities(knowledge(spark, folder)).where(G.is_mediator(F.col("entity")))


@query("proj07_named_and_coded", f"""WITH {triples('rog_webqsp')}, n AS (SELECT qid, h AS e FROM trip UNION SELECT qid, t FROM trip)
SELECT qid, {med('e')} AS is_coded, count(*) AS n, string_agg(e, '|' ORDER BY e) AS names FROM n GROUP BY ALL""")  # fmt: skip
def named_and_coded(spark: SparkSession, folder: str) -> DataFrame:
    nodes = triples_of(spark, folder).select("qid", F.explode(F.array("h", "t")).alias("e"))
    return nodes.groupBy("qid", G.is_mediator(F.col("e")).alias("is_coded")).agg(F.count_distinct("e").alias("n"), F.array_join(F.sort_array(F.collect_set("e")), "|").alias("names"))


@query("proj15_options", f"""WITH {triples('rog_webqsp')}, d AS (SELECT DISTINCT qid, r FROM trip), n AS (SELECT qid, r, row_number() OVER (PARTITION BY qid ORDER BY r) AS i FROM d)
SELECT qid, string_agg('[REL' || i || '] ' || r, chr(10) ORDER BY i) AS one, string_agg('[REL_' || (i - 1) || '] ' || r, chr(10) ORDER BY i) AS zero, string_agg(r, chr(10) ORDER BY i) AS bare FROM n GROUP BY qid""")  # fmt: skip
def options(spark: SparkSession, folder: str) -> DataFrame:
    from tripleloom.functions.text import rendered_options

    q = load(spark, folder, "rog_webqsp").select(F.col("row_id").alias("qid"), P.relations(G.valid_steps(F.col("graph"))).alias("rs")).where(F.size("rs") > 0)
    return q.select("qid", *(rendered_options(F.col("rs"), s).alias(s) for s in ("one", "zero", "bare")))


@query("s10_entities_and_relations", f"""WITH {KG} SELECT 'entity' AS kind, e AS name FROM (SELECT h AS e FROM kg UNION SELECT t FROM kg) UNION ALL SELECT DISTINCT 'relation', r FROM kg""")
def entities_and_relations(spark: SparkSession, folder: str) -> DataFrame:
    kg = knowledge(spark, folder)
    return kg.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("entity", "h"), ("entity", "t"), ("relation", "r"))))).alias("x")).select("x.*").distinct()


@query("g01_last_wins", f"WITH {triples('rog_webqsp')}, {last_wins()} SELECT qid, h, r, t FROM edges")
def last_wins_edges(spark: SparkSession, folder: str) -> DataFrame:
    return walks.edges(questions(spark, folder), key="qid")


@query("g01_last_wins_grouped", f"WITH {triples('rog_webqsp')}, {last_wins()} SELECT qid, h, r, t FROM edges")
def last_wins_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return G.last_wins(triples_of(spark, folder))


UNDIRECTED = """one AS (SELECT qid, arg_max({'h': h, 'r': r, 't': t}, seq) AS s FROM trip GROUP BY qid, least(h, t), greatest(h, t)),
und AS (SELECT qid, s.h AS h, s.r AS r, s.t AS t FROM one UNION ALL SELECT qid, s.t, s.r, s.h FROM one WHERE s.h <> s.t)"""


@query("g02_undirected", f"WITH {triples('rog_cwq')}, {UNDIRECTED} SELECT qid, h, r, t FROM und")
def undirected(spark: SparkSession, folder: str) -> DataFrame:
    return walks.edges(questions(spark, folder, "rog_cwq"), undirected=True, key="qid")


@query("g02_undirected_grouped", f"WITH {triples('rog_cwq')}, {UNDIRECTED} SELECT qid, h, r, t FROM und")
def undirected_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return G.last_wins_undirected(triples_of(spark, folder, "rog_cwq"))


@query("g03_kg_triples", f"WITH {KG} SELECT h, r, t FROM kg")
def kg_triples(spark: SparkSession, folder: str) -> DataFrame:
    return knowledge(spark, folder)


@query("g04_kg_collapsed", f"WITH {KG} SELECT h, r, t, created FROM collapsed")
def kg_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return G.collapse_mediators(knowledge(spark, folder))


@query("g05_kg_named", f"WITH {KG} SELECT h, r, t, created FROM collapsed WHERE NOT {med('h')} AND NOT {med('t')}")
def kg_named(spark: SparkSession, folder: str) -> DataFrame:
    return G.named_edges(G.collapse_mediators(knowledge(spark, folder)))


@query("g06_kg_clean", f"WITH {KG} SELECT h, r, t FROM clean")
def kg_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder)


@query("g06_kg_clean_per_source", f"""WITH {triples('rog_webqsp', 'ta')}, {triples('rog_cwq', 'tb')}, {", ".join(f'''
k{x} AS (SELECT DISTINCT h, r, t FROM t{x}), c{x} AS (SELECT h, r, t FROM k{x} UNION SELECT a.h, a.r || '-' || b.r, b.t FROM k{x} a JOIN k{x} b ON a.t = b.h WHERE {med('a.t')})''' for x in "ab")}
SELECT h, r, t FROM (SELECT * FROM ca UNION SELECT * FROM cb) WHERE NOT {med('h')} AND NOT {med('t')} AND h <> t""")  # fmt: skip
def kg_clean_per_source(spark: SparkSession, folder: str) -> DataFrame:
    return G.knowledge_graph(triples_of(spark, folder), triples_of(spark, folder, "rog_cwq"), collapse_per_source=True)


@query("g07_kg_stats", f"""WITH {KG} SELECT (SELECT count(*) FROM (SELECT h AS e FROM kg UNION SELECT t FROM kg) WHERE NOT {med('e')}) AS n_entities,
count(DISTINCT r) AS n_relations, count(*) AS n_edges FROM clean""")  # fmt: skip
def kg_stats(spark: SparkSession, folder: str) -> DataFrame:
    return G.graph_stats(knowledge(spark, folder), clean(spark, folder))


@query("g08_branching_edges", f"WITH {KG}, d AS (SELECT h, count(*) AS degree FROM clean GROUP BY h HAVING count(*) >= 2) SELECT h, r, t, degree FROM clean JOIN d USING (h)")
def branching_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.branching_edges(clean(spark, folder))


ASKED = f"{members('rog_cwq', 'q_entity', 'asked')}"


def asked_entities(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "rog_cwq").select(F.explode(G.entity_list(F.col("q_entity"))).alias("entity")).distinct()


for _direction, _end, _other in (("out", "h", "t"), ("in", "t", "h")):

    @query(f"t02_relations_{_direction}", f"WITH {KG}, {ASKED} SELECT DISTINCT {_end} AS entity, r FROM clean WHERE {_end} IN (SELECT e FROM asked)")
    def related_relations(spark: SparkSession, folder: str, direction: str = _direction) -> DataFrame:
        return G.related_relations(clean(spark, folder), asked_entities(spark, folder), direction)

    @query(f"t01_targets_{_direction}", f"WITH {KG}, {ASKED} SELECT DISTINCT {_end} AS entity, r, {_other} AS target FROM clean WHERE {_end} IN (SELECT e FROM asked)")
    def target_entities(spark: SparkSession, folder: str, direction: str = _direction) -> DataFrame:
        kg = clean(spark, folder)
        return G.target_entities(kg, G.related_relations(kg, asked_entities(spark, folder), direction), direction)


PAIRS = f"{members('rog_cwq', 'q_entity', 'qe')}, {members('rog_cwq', 'a_entity', 'ae')}, pairs AS (SELECT DISTINCT qe.e AS s, ae.e AS t FROM qe JOIN ae USING (qid) WHERE qe.e <> ae.e)"
DEPTH = 5
LEVELS = "".join(
    f"""
d{k} AS MATERIALIZED (SELECT DISTINCT d.s, c.t AS n FROM d{k - 1} d JOIN clean c ON c.h = d.n WHERE {" AND ".join(f"NOT EXISTS (FROM d{j} WHERE d{j}.s = d.s AND d{j}.n = c.t)" for j in range(k))}),"""
    for k in range(1, DEPTH + 1)
)
#: Nodes at each distance from each start, then back from the ends along edges that lead one step away.
SHORTEST = f"""d0 AS MATERIALIZED (SELECT DISTINCT s, s AS n FROM pairs),{LEVELS}
dist AS MATERIALIZED ({" UNION ALL ".join(f"SELECT s, n, {k} AS k FROM d{k}" for k in range(DEPTH + 1))}),
back(s, t, hops, k, here, path) AS (
  SELECT p.s, p.t, d.k, d.k, p.t, '' FROM pairs p JOIN dist d ON d.s = p.s AND d.n = p.t
  UNION ALL SELECT b.s, b.t, b.hops, b.k - 1, c.h, c.h || '-[' || c.r || ']->' || c.t || CASE WHEN b.k < b.hops THEN ' ; ' ELSE '' END || b.path
  FROM back b JOIN dist d ON d.s = b.s AND d.k = b.k - 1 JOIN clean c ON c.h = d.n AND c.t = b.here)"""


def question_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "rog_cwq")
    return rows.select(F.explode(G.entity_list(F.col("q_entity"))).alias("s"), "a_entity").select("s", F.explode(G.entity_list(F.col("a_entity"))).alias("t")).distinct()


@query("t03_shortest_paths", f"WITH RECURSIVE {KG.replace('clean AS (', 'clean AS MATERIALIZED (')}, {PAIRS}, {SHORTEST} SELECT s, t, hops::INT AS hops, path FROM back WHERE k = 0")
def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = shortest.shortest_paths(clean(spark, folder), question_pairs(spark, folder), DEPTH)
    return found.select("s", "t", F.size("path").alias("hops"), P.steps_text(F.col("path")).alias("path"))


for _k in (2, 3):

    @query(f"t04_walks_k{_k}", f"WITH RECURSIVE {W}, {VISITS.format(k=_k)} SELECT DISTINCT qid, hops, path FROM walk")
    def walks_k(spark: SparkSession, folder: str, k: int = _k) -> DataFrame:
        return steps(walks.walks(questions(spark, folder), k, key="qid").withColumn("hops", F.size("path")), "hops").distinct()


@query("t05_breadth_first_walks", f"WITH RECURSIVE {W}, {VISITS.format(k=2)} SELECT DISTINCT qid, hops, path FROM walk")
def breadth_first(spark: SparkSession, folder: str) -> DataFrame:
    edges = triples_of(spark, folder).transform(G.last_wins)
    starts = questions(spark, folder).select("qid", F.explode(G.start_entities(F.col("q_entity"))).alias("at"))
    return G.joined_walks(edges, starts, 2).select("qid", "hops", P.steps_text(F.col("path")).alias("path"))


@query("t06_walk_stats", f"WITH RECURSIVE {W}, {VISITS.format(k=2)} SELECT qid, count(*) AS visits, count(DISTINCT path) AS distinct_paths FROM walk GROUP BY qid")
def walk_stats(spark: SparkSession, folder: str) -> DataFrame:
    return walks.walks(questions(spark, folder), 2, key="qid").groupBy("qid").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("path").alias("distinct_paths"))


HISTOGRAM = """SELECT hops, count(*) AS n, round(count(*) / (SELECT count(*) FROM rog_webqsp), 6) AS per_question FROM walk GROUP BY hops"""


@query("a01_path_index", f"WITH RECURSIVE {W}, {VISITS.format(k=2)} {HISTOGRAM}")
def path_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = questions(spark, folder)
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    counts = walks.walks(rows, 2, key="qid").groupBy(F.size("path").alias("hops")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(n)).select("hops", "n", F.round(F.try_divide("n", "rows"), 6).alias("per_question"))  # one row


RULES = f"""rules AS (SELECT qid, list(r ORDER BY seq) AS rule FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seq) AS i FROM trip) WHERE i <= 2 GROUP BY qid),
ruled AS (SELECT qid, 1 AS k, e.t AS here, {STEP.replace('h', 'e.h', 1).replace('|| r', '|| e.r').replace('|| t', '|| e.t')} AS path FROM rules JOIN starts USING (qid) JOIN edges e USING (qid) WHERE e.h = starts.e AND e.r = rule[1]),
ruled2 AS (SELECT p.qid, e.t AS here, p.path || ' ; ' || e.h || '-[' || e.r || ']->' || e.t AS path FROM ruled p JOIN rules USING (qid) JOIN edges e ON e.qid = p.qid AND e.h = p.here AND e.r = rule[2]),
followed AS (SELECT qid, here, path FROM ruled JOIN rules USING (qid) WHERE len(rule) = 1 UNION ALL SELECT qid, here, path FROM ruled2)"""


def ruled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).withColumn("rule", F.slice(P.relations(G.valid_steps(F.col("graph"))), 1, 2)).where(F.size("rule") > 0)


@query("t07_rule_walks", f"WITH {W}, {RULES} SELECT qid, path FROM followed")
def rule_walks(spark: SparkSession, folder: str) -> DataFrame:
    return steps(walks.rule_walks(ruled_rows(spark, folder), "rule", key="qid"))


@query("t14_apply_rules", f"""WITH {W}, alone AS (SELECT DISTINCT qid, r FROM trip) SELECT s.qid, a.r AS rule, e.h || '-[' || e.r || ']->' || e.t AS path
FROM starts s JOIN alone a USING (qid) JOIN edges e ON e.qid = s.qid AND e.h = s.e AND e.r = a.r""")  # fmt: skip
def apply_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = F.transform(F.array_distinct(P.relations(G.valid_steps(F.col("graph")))), lambda r: F.array(r))
    return steps(walks.applied_rules(questions(spark, folder).withColumn("rules", rules), "rules", key="qid"), "rule")


@query("t15_direct_answers", f"WITH {W}, {RULES} SELECT qid, here AS answer FROM followed")
def direct_answers(spark: SparkSession, folder: str) -> DataFrame:
    return walks.rule_walks(ruled_rows(spark, folder), "rule", key="qid").select("qid", F.element_at("path", -1)["t"].alias("answer"))


TRUTH = """bfs(qid, s, here, hops, path, seen, steps) AS (
  SELECT DISTINCT s.qid, s.e, s.e, 0, '', [s.e], []::STRUCT(h VARCHAR, r VARCHAR, t VARCHAR)[] FROM starts s JOIN nodes n ON n.qid = s.qid AND n.e = s.e
  UNION ALL SELECT b.qid, b.s, e.t, b.hops + 1, b.path || CASE WHEN b.hops > 0 THEN ' ; ' ELSE '' END || e.h || '-[' || e.r || ']->' || e.t, list_append(b.seen, e.t), list_append(b.steps, {'h': e.h, 'r': e.r, 't': e.t})
  FROM bfs b JOIN edges e ON e.qid = b.qid AND e.h = b.here WHERE NOT list_contains(b.seen, e.t)),
hit AS (SELECT DISTINCT b.qid, b.s, b.here AS t, b.hops, b.path, b.steps FROM bfs b JOIN ends ON ends.qid = b.qid AND ends.e = b.here),
truth AS (SELECT * FROM hit QUALIFY hops = min(hops) OVER (PARTITION BY qid, s, t))"""
NODES = "nodes AS (SELECT qid, h AS e FROM edges UNION SELECT qid, t FROM edges)"


@query("t08_truth_paths", f"WITH RECURSIVE {W}, {NODES}, {TRUTH} SELECT qid, s, t, hops::INT AS hops, path FROM truth")
def truth_paths(spark: SparkSession, folder: str) -> DataFrame:
    return steps(walks.truth_paths(questions(spark, folder), key="qid").withColumn("hops", F.size("path")), "s", "t", "hops")


@query("a02_truth_path_index", f"""WITH RECURSIVE {W}, {NODES}, {TRUTH} SELECT hops::INT AS hops, count(*) AS n, count(DISTINCT qid) AS questions FROM truth GROUP BY hops""")
def truth_path_index(spark: SparkSession, folder: str) -> DataFrame:
    found = walks.truth_paths(questions(spark, folder), key="qid").select("qid", F.size("path").alias("hops"))
    return found.groupBy("hops").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("questions"))


U = f"{triples('rog_cwq')}, {UNDIRECTED}, {members('rog_cwq', 'q_entity', 'starts')}, {members('rog_cwq', 'a_entity', 'ends')}"


@query("t09_simple_paths", f"""WITH RECURSIVE {U}, p(qid, here, hops, path, seen) AS (
  SELECT DISTINCT s.qid, s.e, 0, '', [s.e] FROM starts s
  UNION ALL SELECT p.qid, e.t, p.hops + 1, p.path || CASE WHEN p.hops > 0 THEN ' ; ' ELSE '' END || e.h || '-[' || e.r || ']->' || e.t, list_append(p.seen, e.t)
  FROM p JOIN und e ON e.qid = p.qid AND e.h = p.here WHERE p.hops < 3 AND NOT list_contains(p.seen, e.t))
SELECT DISTINCT p.qid, hops::INT AS hops, path FROM p JOIN ends ON ends.qid = p.qid AND ends.e = p.here WHERE hops > 0""")  # fmt: skip
def simple_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = walks.simple_paths(questions(spark, folder, "rog_cwq"), 3, undirected=True, key="qid")
    return steps(found.withColumn("hops", F.size("path")), "hops")


RANDOM = """seedwalk(qid, start, walk, here, hops, path) AS (
  SELECT qid, e, w, e, 0, '' FROM (SELECT DISTINCT qid, e FROM starts) CROSS JOIN range(2) r(w)
  UNION ALL SELECT qid, start, walk, t, hops + 1, path || CASE WHEN hops > 0 THEN ' ; ' ELSE '' END || step FROM (
    SELECT w.qid, w.start, w.walk, w.hops, w.path, e.t, e.h || '-[' || e.r || ']->' || e.t AS step,
           row_number() OVER (PARTITION BY w.qid, w.start, w.walk ORDER BY md5(concat_ws('|', 'walk', w.qid, w.walk, w.hops, e.h, e.r, e.t))) AS i
    FROM seedwalk w JOIN edges e ON e.qid = w.qid AND e.h = w.here WHERE w.hops < 3) WHERE i = 1),
walked AS (SELECT qid, start, walk::INT AS walk, here, path FROM seedwalk WHERE hops > 0 QUALIFY hops = max(hops) OVER (PARTITION BY qid, start, walk))"""


@query("t11_random_walks", f"WITH RECURSIVE {W}, {RANDOM} SELECT qid, start, walk, path FROM walked")
def random_walks(spark: SparkSession, folder: str) -> DataFrame:
    return steps(walks.random_walks(questions(spark, folder), 3, 2, "walk", key="qid"), "start", "walk")


@query("t10_negative_walks", f"WITH RECURSIVE {W}, {RANDOM} SELECT qid, start, walk, path FROM walked w WHERE NOT EXISTS (FROM ends WHERE ends.qid = w.qid AND ends.e = w.here)")
def negative_walks(spark: SparkSession, folder: str) -> DataFrame:
    rows = questions(spark, folder)
    ends = rows.select("qid", F.explode(G.start_entities(F.col("a_entity"))).alias("end"))
    found = walks.random_walks(rows, 3, 2, "walk", key="qid").withColumn("end", F.element_at("path", -1)["t"])
    return steps(found.join(ends, ["qid", "end"], "left_anti"), "start", "walk")


@query("t12_tree_search_paths")
def tree_search_paths(spark: SparkSession, folder: str) -> DataFrame:
    return steps(walks.searched_paths(questions(spark, folder), key="qid"), "s", "t")


@query("t16_subgraph_triples", f"""WITH RECURSIVE {W}, {VISITS.format(k=2)}, touched AS (SELECT DISTINCT e.qid, e.h, e.r, e.t FROM edges e JOIN starts s ON s.qid = e.qid AND s.e = e.h
  UNION SELECT DISTINCT f.qid, f.h, f.r, f.t FROM starts s JOIN edges e ON s.qid = e.qid AND s.e = e.h JOIN edges f ON f.qid = e.qid AND f.h = e.t) SELECT qid, h, r, t FROM touched""")  # fmt: skip
def subgraph_triples(spark: SparkSession, folder: str) -> DataFrame:
    return walks.walks(questions(spark, folder), 2, key="qid").select("qid", F.inline("path")).distinct()


@query("t17_renumbered_nodes", f"""WITH {triples('rog_webqsp')}, s AS (SELECT qid, h AS node, seq * 2 AS p FROM trip UNION ALL SELECT qid, t, seq * 2 + 1 FROM trip),
f AS (SELECT qid, node, min(p) AS p FROM s GROUP BY qid, node) SELECT qid, node, (row_number() OVER (PARTITION BY qid ORDER BY p) - 1)::INT AS number FROM f""")  # fmt: skip
def renumbered_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return G.numbered_nodes(triples_of(spark, folder))


@query("t22_mediator_groups", f"""WITH {triples('rog_webqsp')}, o AS (SELECT qid, h AS m, string_agg(DISTINCT r || '=>' || t, '; ' ORDER BY r || '=>' || t) AS structure FROM trip WHERE {med('h')} GROUP BY qid, h),
i AS (SELECT DISTINCT qid, h, r, t AS m FROM trip WHERE {med('t')})
SELECT i.qid, h, r, coalesce(structure, '') AS structure, count(*) AS members, min(m) AS representative FROM i LEFT JOIN o USING (qid, m) GROUP BY ALL""")  # fmt: skip
def mediator_groups(spark: SparkSession, folder: str) -> DataFrame:
    return G.mediator_groups(triples_of(spark, folder))


TRACE = f"""rounds AS (SELECT state_id, unnest(exploration_trace) AS d FROM traversal_states),
edge AS (SELECT DISTINCT state_id, s, r, t FROM (
  SELECT state_id, {strip('entity')} AS s, {strip('l.name')} AS r, {strip('x')} AS t FROM (
    SELECT *, unnest(l.targets) AS x FROM (SELECT state_id, d.entity AS entity, unnest(d.relations) AS l FROM rounds)))
  WHERE s <> '' AND r <> '' AND t <> ''),
roots AS (SELECT DISTINCT state_id, {strip('d.entity')} AS s FROM rounds WHERE d.round_num = 1),
p(state_id, here, hops, path, seen, closed) AS (
  SELECT e.state_id, e.t, 1, e.s || ' -> ' || e.r || ' -> ' || e.t, [e.s, e.t], e.s = e.t FROM edge e JOIN roots USING (state_id, s)
  UNION ALL SELECT p.state_id, e.t, p.hops + 1, p.path || ' -> ' || e.r || ' -> ' || e.t, list_append(p.seen, e.t), list_contains(p.seen, e.t)
  FROM p JOIN edge e ON e.state_id = p.state_id AND e.s = p.here WHERE NOT p.closed)"""


def trace_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """``(qid, graph, starts)``: what each traversal explored, as triples, and the entities of its first round."""
    relation = lambda d: F.transform(d["relations"], lambda l: F.transform(l["targets"], lambda t: F.struct(d["entity"].alias("h"), l["name"].alias("r"), t.alias("t"))))
    flat = lambda lists: F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    graph = flat(F.transform("exploration_trace", lambda d: flat(relation(d))))
    starts = F.transform(F.filter("exploration_trace", lambda d: d["round_num"] == 1), lambda d: d["entity"])
    return load(spark, folder, "traversal_states").select(F.col("state_id").alias("qid"), graph.alias("graph"), starts.alias("starts"))


@query("t18_trace_leaf_paths", f"""WITH RECURSIVE {TRACE}
SELECT state_id, hops::INT AS hops, path FROM p WHERE closed OR NOT EXISTS (FROM edge e WHERE e.state_id = p.state_id AND e.s = p.here)""")
def trace_leaf_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = walks.leaf_paths(trace_graphs(spark, folder), "starts", key="qid")
    return found.select(F.col("qid").alias("state_id"), F.size("path").alias("hops"), P.arrow_text(F.col("path")).alias("path"))


@query("t23_merged_expansions", f"""WITH {triples('rog_webqsp')} SELECT h, t AS target, array_to_string(list_sort(list(DISTINCT r)), '|') AS relations FROM trip GROUP BY h, t""")
def merged_expansions(spark: SparkSession, folder: str) -> DataFrame:
    rows = triples_of(spark, folder).select("h", F.col("t").alias("target"), F.array("r").alias("relations"))
    return G.deduplicated_expansions(rows, ["h", "target"], "relations").withColumn("relations", F.array_join("relations", "|"))
