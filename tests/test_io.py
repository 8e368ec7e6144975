import json

import pytest

from tripleloom.session import shared_folder, ship
from tripleloom.sources import readers as R
from tripleloom.sources import writers as K
from tripleloom.streaming import resume

SCHEMA = "id string, n int"


def test_json_sources(spark, tmp_path):
    records = [{"id": "a", "n": 1}, {"id": "é", "n": None}]
    (tmp_path / "list.json").write_text(json.dumps(records))
    (tmp_path / "object.json").write_text(json.dumps({"name": "x", "train": records}))
    (tmp_path / "lines.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n{"id": "b"}\n')
    want = [("a", 1), ("é", None)]
    assert [tuple(r) for r in R.json_array(spark, str(tmp_path / "list.json"), SCHEMA).collect()] == want
    assert [tuple(r) for r in R.json_object(spark, str(tmp_path / "object.json"), SCHEMA).collect()] == want
    lines = str(tmp_path / "lines.jsonl")
    assert R.json_lines(spark, lines, SCHEMA, strict=False).count() == 2
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        R.json_lines(spark, lines, SCHEMA).collect()
    rejects = R.json_lines_with_rejects(spark, lines, SCHEMA).cache()
    assert [r[0] for r in rejects.where("_corrupt_record IS NOT NULL").select("_corrupt_record").collect()] == ["not json"]
    both = R.tagged({"x": R.json_array(spark, str(tmp_path / "list.json"), SCHEMA), "y": R.json_lines(spark, lines, SCHEMA, False)})
    assert sorted({r["dataset_source_name"] for r in both.collect()}) == ["x", "y"]


def test_csv_and_ids(spark, tmp_path):
    (tmp_path / "head.csv").write_text("lid:ID,score:FLOAT,:TYPE\n")
    (tmp_path / "nodes.csv").write_text('a,1,"x, y"\na,2,z\nb,,\n')
    assert R.header_names(spark, str(tmp_path / "head.csv")) == ["lid", "score", "type"]
    nodes, edges = R.node_edge_tables(spark, *(str(tmp_path / f) for f in ("nodes.csv", "nodes.csv", "head.csv", "head.csv")))
    assert nodes.count() == 2 and edges.count() == 3 and edges.where("score IS NULL").count() == 1
    (tmp_path / "rel.tsv").write_text("1\tr.a\n2\tr.b\n")
    assert R.relation_dictionary(spark, str(tmp_path / "rel.tsv")).count() == 2
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(R.id_list(spark, str(tmp_path / "ids.txt"), True)) == ids(R.id_list(spark, " a,,b ")) == ["a", "b"]
    df = spark.createDataFrame([('["a", "b"]',), ("c",), (None,)], "v string")
    assert [r[0] for r in df.select(R.string_or_list("v")).collect()] == [["a", "b"], ["c"], []]
    rows = spark.createDataFrame([(i,) for i in range(9)], "id int")
    assert [R.head(rows, *a).count() for a in ((3, "id"), (-1, "id"), (0, "id"), (0, "id", True))] == [3, 9, 0, 9]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "ü"), ("a", None), ("b", "x")], "id string, v string")
    at = lambda name: str(tmp_path / name)
    K.json_lines(df, at("j"))
    assert "ü" in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    assert K.pretty_json(df, at("p.json")) == 3 and len(json.loads((tmp_path / "p.json").read_text())) == 3
    assert K.pretty_json(df.limit(0), at("e.json")) == 0 and json.loads((tmp_path / "e.json").read_text()) == []
    with pytest.raises(ValueError):
        K.pretty_json(df, at("many.json"), most=2)
    K.id_list(df, "id", at("ids"))
    assert [r[0] for r in spark.read.text(at("ids")).collect()] == ["a", "b"]
    K.csv_with_header(df, at("c"))
    assert spark.read.option("header", True).csv(at("c")).columns == ["id", "v"]
    K.parquet(df, at("t"), partition_by=("id",))
    assert spark.read.parquet(at("t")).count() == 3
    K.replace_with_backup(df, at("r"))
    K.replace_with_backup(df.limit(1), at("r"))
    assert (spark.read.parquet(at("r")).count(), spark.read.parquet(at("r.bak")).count()) == (1, 3)
    assert K.append_unseen(df, at("a"), "id").count() == 2
    assert K.append_unseen(df, at("o"), "id", order="v").where("id = 'b'").first()["v"] == "x"
    for parts in (None, 3):
        first = K.append_unseen(df, at(f"n{parts}"), "id", "v", parts)
        again = K.append_unseen(df.selectExpr("nullif(id, 'a') AS id", "v"), at(f"n{parts}"), "id", "v", parts)
        assert first.columns == again.columns == ["id", "v"] and sorted(map(str, (tuple(r) for r in again.collect()))) == ["('a', None)", "('b', 'x')", "(None, None)"]
        assert K.append_unseen(df.selectExpr("nullif(id, 'a') AS id", "v"), at(f"n{parts}"), "id", "v", parts).count() == 3
    assert K.append_unseen(df.selectExpr("concat(id, '2') AS id", "v").unionByName(df), at("a"), "id").count() == 4
    assert K.cached_vectors(df, at("v"), "uri", "m").count() == K.cached_vectors(df.limit(0), at("v"), "uri", "m").count() == 3
    assert "| `id` | string | yes |" in K.table_readme(df, "T") and "f1" in K.summary("S", {"f1": 0.5, "n": 3})
    assert K.clear(spark, at("t")) and not K.clear(spark, at("t"))


def test_package_is_shipped_whole(spark):
    target = ship(spark)
    fs, path, _ = K._files(spark, target)
    assert fs.exists(path) and target.startswith(shared_folder(spark))
    names = spark.read.format("binaryFile").load(target).select("content").first()[0]
    assert b"tripleloom/operators/walks.py" in bytes(names)


def test_stream_processes_each_id_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).write.parquet(source)
    run = lambda: resume.process_once(resume.stream_of(spark, source, SCHEMA), "id", out, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("b", 9), ("c", 3)], SCHEMA).write.mode("append").parquet(source)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_windowed_counts(spark, tmp_path):
    source = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2025-01-01 00:10:00' AS ts, 'x' AS kind UNION ALL SELECT timestamp'2025-01-01 00:50:00', 'x' UNION ALL SELECT timestamp'2025-01-01 05:00:00', 'x'").write.parquet(source)
    counts = resume.windowed_counts(resume.stream_of(spark, source, "ts timestamp, kind string"), "ts", "kind")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windowed").collect()) == [1, 2]
    assert resume.first_of_each(resume.stream_of(spark, source, "ts timestamp, kind string"), "kind", "ts").isStreaming
