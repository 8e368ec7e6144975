"""Sources.  Schemas are given, never inferred from the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The members under which an object may hold the list of records.
LIST_MEMBERS = ("data", "train", "test", "validation")
CORRUPT = "_corrupt_record"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file whose top level is a list of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An object that holds the records under the first of ``LIST_MEMBERS`` that is there."""
    lists = ", ".join(f"`{m}` array<struct<{_struct(schema)}>>" for m in LIST_MEMBERS)
    return spark.read.schema(lists).option("multiLine", True).json(path).select(F.inline(F.coalesce(*LIST_MEMBERS)))


def _struct(schema: str) -> str:
    parsed = T.StructType.fromDDL(schema)
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in parsed.fields)


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str, strict: bool = True) -> DataFrame:
    """One record a line; a bad line is an error, or left out if not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(list(paths) if not isinstance(paths, str) else paths)


def json_lines_with_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_lines with the bad lines' text in ``_corrupt_record``, so that they can be counted."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(read.alias("x")).select("x.*")


def tagged(sources: dict[str, DataFrame], column: str = "dataset_source_name") -> DataFrame:
    """Several sources as one, each row with its source's name."""
    out = None
    for name, df in sources.items():
        one = df.withColumn(column, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def head(df: DataFrame, n: int, order: str, zero_is_all: bool = False) -> DataFrame:
    """The first ``n`` rows in ``order``; all of them for -1, and for 0 if ``zero_is_all``."""
    return df if n < 0 or (n == 0 and zero_is_all) else df.orderBy(order).limit(n)


def header_names(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    """The column names of a header file; what follows a colon is a type and left out."""
    cells = spark.read.text(path).first()["value"].split(separator)
    return [c.split(":")[0] or c.strip(":").lower() for c in cells]


def headerless_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A CSV file without header, every column as text; only an empty cell is null."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("header", False).option("nullValue", "").option("quote", '"').option("escape", '"').csv(path)


def relation_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(id, r)`` of a file of tab-separated ids and relations."""
    return spark.read.schema("id string, r string").option("sep", "\t").csv(path)


def id_list(spark: SparkSession, text_or_path: str, from_file: bool = False) -> DataFrame:
    """``(id)`` from a file with one a line, or from a text parted by commas; stripped, blanks left out."""
    if from_file:
        df = spark.read.text(text_or_path).select(F.trim("value").alias("id"))
    else:
        df = spark.range(1).select(F.explode(F.split(F.lit(text_or_path), ",")).alias("v")).select(F.trim("v").alias("id"))
    return df.where("id <> ''")


def string_or_list(column: str) -> Column:
    """A column read as text that holds a string or a JSON list, as a list of strings."""
    c = F.col(column)
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def node_edge_tables(spark: SparkSession, nodes: str, edges: str, node_header: str, edge_header: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph's CSV files with headers of their own, each node and edge once."""
    n = headerless_csv(spark, nodes, header_names(spark, node_header))
    e = headerless_csv(spark, edges, header_names(spark, edge_header))
    return n.dropDuplicates([n.columns[0]]), e.dropDuplicates()
