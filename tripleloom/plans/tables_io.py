"""Queries of sources and sinks: what is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.operators import graph as G
from tripleloom.plans.graph import KG, knowledge, triples_of
from tripleloom.plans.registry import query
from tripleloom.plans.sqlparts import triples
from tripleloom.session import scratch_folder
from tripleloom.sources import readers as R
from tripleloom.sources import writers as K
from tripleloom.tables import load

ITEM = "item_id bigint, qid string, question string, source string"
ITEMS = "SELECT item_id, qid, question, source FROM heldout_items"


def items(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "heldout_items").select("item_id", "qid", "question", "source")


@query("s02_json_array", ITEMS)
def json_array(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "list") + "/items.json"
    K.pretty_json(items(spark, folder), at)
    return R.json_array(spark, at, ITEM)


@query("s03_json_object", ITEMS)
def json_object(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "object")
    listed = items(spark, folder).agg(F.to_json(F.collect_list(F.struct("item_id", "qid", "question", "source"))).alias("x"))  # a setting's few items
    listed.select(F.concat(F.lit('{"name": "x", "train": '), "x", F.lit("}")).alias("value")).write.text(at)
    return R.json_object(spark, at, ITEM)


SFT = "sft_row_id bigint, prompt string, completion string"


@query("s04_json_lines", "SELECT sft_row_id, prompt, completion FROM sft_rows")
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "lines")
    K.json_lines(load(spark, folder, "sft_rows").select("sft_row_id", "prompt", "completion"), at)
    return R.json_lines(spark, at, SFT)


def _with_bad_lines(spark: SparkSession, folder: str) -> str:
    at = scratch_folder(spark, "bad")
    good = F.to_json(F.struct("item_id", "qid", "question", "source"))
    items(spark, folder).select(F.explode(F.array(good, F.concat(F.lit('{"item_id": '), F.col("item_id").cast("string"), F.lit(', "qid": "cut')))).alias("value")).write.text(at)
    return at


@query("s05_good_lines", ITEMS)
def good_lines(spark: SparkSession, folder: str) -> DataFrame:
    return R.json_lines(spark, _with_bad_lines(spark, folder), ITEM, strict=False)


@query("s05_bad_lines", """SELECT '{"item_id": ' || item_id || ', "qid": "cut' AS line FROM heldout_items""")
def bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = R.json_lines_with_rejects(spark, _with_bad_lines(spark, folder), ITEM)
    return lines.select(F.col(R.CORRUPT).alias("line")).where("line IS NOT NULL")


@query("s08_headerless_csv", "SELECT s_suppkey::VARCHAR AS s_suppkey, nullif(s_name, '') AS s_name, s_nationkey::VARCHAR AS s_nationkey, NULL::VARCHAR AS note FROM supplier")
def headerless_csv(spark: SparkSession, folder: str) -> DataFrame:
    at, head = scratch_folder(spark, "csv"), scratch_folder(spark, "header")
    load(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.lit("").alias("note")).write.option("emptyValue", "").csv(at)
    spark.range(1).select(F.lit("s_suppkey:ID,s_name:STRING,s_nationkey:LONG,:NOTE").alias("value")).write.text(head)
    return R.headerless_csv(spark, at, R.header_names(spark, head))


@query("s09_relation_dictionary", f"WITH {triples('rog_cwq')} SELECT DISTINCT md5(r) AS id, r FROM trip")
def relation_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "relations")
    triples_of(spark, folder, "rog_cwq").select("r").distinct().select(F.md5("r").alias("id"), "r").write.option("sep", "\t").csv(at)
    return R.relation_dictionary(spark, at)


@query("s11_id_lists", "SELECT 'file' AS place, qid AS id FROM heldout_items UNION ALL SELECT 'text', n_name FROM nation")
def id_lists(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "ids")
    items(spark, folder).select(F.explode(F.array(F.concat(F.lit("  "), "qid", F.lit(" ")), F.lit("   "))).alias("value")).write.text(at)
    named = ", ,".join(r["n_name"] for r in load(spark, folder, "nation").select("n_name").collect())  # 25 nations, as a setting would name them
    one = lambda place, df: df.select(F.lit(place).alias("place"), "id")
    return one("file", R.id_list(spark, at, True)).unionByName(one("text", R.id_list(spark, f" {named} ,")))


@query("s12_node_edge_tables", """SELECT 'node' AS kind, o_orderkey::VARCHAR AS a, o_orderstatus AS b FROM orders
UNION ALL SELECT DISTINCT 'edge', l_orderkey::VARCHAR, l_partkey::VARCHAR FROM lineitem""")  # fmt: skip
def node_edge_tables(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges, node_head, edge_head = (scratch_folder(spark, n) for n in ("nodes", "edges", "node-header", "edge-header"))
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    orders.unionByName(orders).write.csv(nodes)  # a node that comes again is the same node
    load(spark, folder, "lineitem").select("l_orderkey", "l_partkey").write.csv(edges)
    for head, text in ((node_head, "lid:ID,status"), (edge_head, ":START_ID,:END_ID")):
        spark.range(1).select(F.lit(text).alias("value")).write.text(head)
    n, e = R.node_edge_tables(spark, nodes, edges, node_head, edge_head)
    return n.select(F.lit("node").alias("kind"), F.col("lid").alias("a"), F.col("status").alias("b")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("start_id").alias("a"), F.col("end_id").alias("b"))
    )


@query("k01_json_lines", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND contains(text, 'ü')")
def written_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Letters stay letters: they are found in the file's bytes before it is parsed."""
    at = scratch_folder(spark, "letters")
    K.json_lines(load(spark, folder, "documents").select("doc_id", "text"), at)
    lines = spark.read.text(at).where(F.col("value").contains("ü"))
    return lines.select(F.from_json("value", "doc_id bigint, text string").alias("x")).select("x.*")


@query("k02_parquet_folder", "SELECT source, doc_id, n_chars FROM documents")
def parquet_folder(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "parquet")
    K.parquet(load(spark, folder, "documents").select("source", "doc_id", "n_chars"), at, partition_by=("source",))
    return spark.read.parquet(at)


@query("k03_pretty_json", "SELECT source, target_share, max_repeats FROM mix_targets")
def pretty_json(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "pretty") + "/targets.json"
    K.pretty_json(load(spark, folder, "mix_targets").select("source", "target_share", "max_repeats"), at)
    return R.json_array(spark, at, "source string, target_share double, max_repeats int")


@query("k06_replaced_with_backup", "SELECT 'new' AS state, item_id FROM heldout_items WHERE source = 'cwq' UNION ALL SELECT 'old', item_id FROM heldout_items")
def replaced_with_backup(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "replaced") + "/items"
    K.replace_with_backup(items(spark, folder), at)
    K.replace_with_backup(items(spark, folder).where("source = 'cwq'"), at)
    one = lambda state, path: spark.read.parquet(path).select(F.lit(state).alias("state"), "item_id")
    return one("new", at).unionByName(one("old", at + ".bak"))


@query("k07_id_list", "SELECT DISTINCT id AS value FROM predictions WHERE id IS NOT NULL")
def id_list(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "idlist")
    K.id_list(load(spark, folder, "predictions"), "id", at)
    return spark.read.text(at)


@query("k08_csv_with_header", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_with_header(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_folder(spark, "headed")
    K.csv_with_header(load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), at)
    return spark.read.option("header", True).schema("c_custkey bigint, c_name string, c_acctbal double").option("enforceSchema", False).csv(at)


@query("k09_cached_vectors", "SELECT vec_id, round(embedding[1], 4) AS first FROM embeddings")
def cached_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The second call finds the vectors and doesn't compute its own."""
    root, e = scratch_folder(spark, "vectors"), load(spark, folder, "embeddings").select("vec_id", "embedding")
    K.cached_vectors(e, root, folder, "m")
    again = K.cached_vectors(e.withColumn("embedding", F.array(F.lit(0.0).cast("float"))), root, folder, "m")
    return again.select("vec_id", F.round(F.get("embedding", F.lit(0)), 4).alias("first"))


@query("k10_summary_report", "SELECT 'predictions' || chr(10) || 'rows       ' || count(*) || chr(10) || 'questions  ' || count(DISTINCT id) || chr(10) || 'found      ' || printf('%.4f', avg(answer_found::INT)) || chr(10) AS report FROM predictions")
def summary_report(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "predictions")
    row = p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("questions"), F.avg(F.col("answer_found").cast("int")).alias("found")).first()
    return spark.createDataFrame([(K.summary("predictions", row.asDict()),)], "report string")


@query("k11_table_readme", """SELECT '# Targets' || chr(10) || chr(10) || '| column | type | may be null |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| `' || column_name || '` | ' ||
CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' END || ' | yes |', chr(10) ORDER BY column_index) || chr(10) AS readme FROM duckdb_columns() WHERE table_name = 'mix_targets'""")  # fmt: skip
def table_readme(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(K.table_readme(load(spark, folder, "mix_targets"), "Targets"),)], "readme string")


@query("k12_cleared_graph", "SELECT true AS cleared, false AS again, count(*) AS left_over FROM heldout_items WHERE false")
def cleared_graph(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_folder(spark, "cleared")
    K.parquet(knowledge(spark, folder), root + "/kg")
    K.parquet(items(spark, folder).limit(0), root + "/rest")
    cleared, again = K.clear(spark, root + "/kg"), K.clear(spark, root + "/kg")
    return spark.read.parquet(root + "/rest").agg(F.lit(cleared).alias("cleared"), F.lit(again).alias("again"), F.count(F.lit(1)).alias("left_over"))


@query("g09_bucketed_lookup", f"WITH {KG} SELECT h, r, t FROM kg WHERE h IN (SELECT DISTINCT trim(e, e' \\t\\r\\n') FROM (SELECT unnest(q_entity) AS e FROM rog_cwq))")
def bucketed_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The graph bucketed by head, which serves lookups in place of an index."""
    at = scratch_folder(spark, "bucketed")
    table = K.bucketed_table(knowledge(spark, folder), "kg_" + at.rsplit("-", 1)[-1], "h", 8, at)
    asked = load(spark, folder, "rog_cwq").select(F.explode(G.entity_list(F.col("q_entity"))).alias("h")).distinct()
    return table.join(asked, "h", "left_semi").select("h", "r", "t")


@query("f10_combined_sources", """SELECT 'pn_only' AS strategy, 'sft' AS source, sft_row_id AS row_id FROM sft_rows UNION ALL SELECT 'pn_only', 'pref', pref_row_id FROM pref_rows
UNION ALL SELECT 'pn_only', 'all', sft_row_id FROM sft_rows UNION ALL SELECT 'pn_only', 'all', pref_row_id FROM pref_rows""")  # fmt: skip
def combined_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every source's rows by themselves and all together, in folders named by strategy and source."""
    root = scratch_folder(spark, "combined")
    one = lambda table, key: load(spark, folder, table).select(F.col(key).alias("row_id"), "prompt")
    return K.combined_output({"sft": one("sft_rows", "sft_row_id"), "pref": one("pref_rows", "pref_row_id")}, root, "pn_only").select("strategy", "source", "row_id")
