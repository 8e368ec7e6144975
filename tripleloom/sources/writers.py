"""Sinks."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The partition column of tables that rows are appended to by key.
PART = "key_part"

def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One record a line; letters stay letters."""
    df.write.mode(mode).json(path)


def parquet(df: DataFrame, path: str, mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode(mode).parquet(path)


def csv_with_header(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def pretty_json(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """One indented JSON list in a single file, for results meant to be read; how many records it holds.

    A table of more than ``most`` rows is an error: write it as lines instead."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows; write them as lines")
    fs, p, jvm = _files(df.sparkSession, path)
    out = jvm.java.io.BufferedOutputStream(fs.create(p))
    try:
        for k, row in enumerate(df.toLocalIterator()):
            out.write(bytearray(("[\n" if k == 0 else ",\n") + json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str), "utf-8"))
        out.write(bytearray(b"\n]\n" if n else b"[]\n"))
    finally:
        out.close()
    return n


def id_list(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """The distinct ids, sorted, one a line."""
    df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct().orderBy("value").write.mode(mode).text(path)


def _files(spark: SparkSession, path: str) -> tuple[object, object, object]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def replace_with_backup(df: DataFrame, path: str, suffix: str = ".bak") -> None:
    """Writes beside ``path``, then swaps: the old table stays under ``path + suffix`` and no reader sees a half."""
    fs, old, jvm = _files(df.sparkSession, path)
    make = jvm.org.apache.hadoop.fs.Path
    fresh, kept = make(path + ".new"), make(path + suffix)
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(old):
        fs.delete(kept, True)
        fs.rename(old, kept)
    fs.rename(fresh, old)


def append_unseen(df: DataFrame, path: str, key: str, order: str | None = None, parts: int | None = None) -> DataFrame:
    """Appends the rows whose key the table at ``path`` does not hold yet; each key once, the row that is
    first in ``order`` (unless given, in the order of all columns' text).  Returns the table.

    With ``parts`` the table gets a partition column ``key_part``, a hash of the key, and a batch reads
    the keys of the parts it falls into instead of all; a table keeps the number of parts it began
    with.  Null keys count as one key."""
    spark = df.sparkSession
    fs, p, _ = _files(spark, path)
    first = F.struct(*([order] if order else []), F.to_json(F.struct(*df.columns)).alias("__whole"))  # never null itself
    rows = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), first).alias("x")).select("x.*")
    if parts:
        rows = rows.withColumn(PART, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    if fs.exists(p):
        written = spark.read.parquet(path)
        if parts:
            touched = [r[0] for r in rows.select(PART).distinct().collect()]  # at most ``parts``
            written = written.where(F.col(PART).isin(touched))
        written = written.select(F.col(key).alias("__key")).distinct()
        rows = rows.join(written, rows[key].eqNullSafe(written["__key"]), "left_anti")
    writer = rows.write.mode("append")
    (writer.partitionBy(PART) if parts else writer).parquet(path)
    return spark.read.parquet(path).select(*df.columns)


def combined_output(sources: dict[str, DataFrame], root: str, strategy: str) -> DataFrame:
    """Each source's rows in ``<root>/strategy=<strategy>/source=<name>``, and those of all of them under the name
    ``all``; returns the whole as a table with both names as columns."""
    for name, df in sources.items():
        df.write.mode("overwrite").parquet(f"{root}/strategy={strategy}/source={name}")
    together = None
    for df in sources.values():
        together = df if together is None else together.unionByName(df, allowMissingColumns=True)
    together.write.mode("overwrite").parquet(f"{root}/strategy={strategy}/source=all")
    return together.sparkSession.read.parquet(root)


def clear(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _files(spark, path)
    return bool(fs.delete(p, True))


def cached_vectors(df: DataFrame, root: str, source: str, model: str) -> DataFrame:
    """The vectors of a source under a model, computed once: a table by md5 of the source and model."""
    spark = df.sparkSession
    path = os.path.join(root, f"source_md5={hashlib.md5(source.encode()).hexdigest()[:8]}", f"model={model}")
    fs, p, _ = _files(spark, path)
    if not fs.exists(p):
        df.write.parquet(path)
    return spark.read.parquet(path)


def summary(title: str, row: dict[str, object]) -> str:
    """A short text report of one row of figures."""
    width = max((len(k) for k in row), default=0)
    return "\n".join([title, *(f"{k:<{width}}  {v:.4f}" if isinstance(v, float) else f"{k:<{width}}  {v}" for k, v in row.items())]) + "\n"


def table_readme(df: DataFrame, title: str) -> str:
    """A Markdown text that lists a table's columns."""
    rows = [f"| `{f.name}` | {f.dataType.simpleString()} | {'yes' if f.nullable else 'no'} |" for f in df.schema.fields]
    return "\n".join([f"# {title}", "", "| column | type | may be null |", "|---|---|---|", *rows]) + "\n"


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """A table bucketed and sorted by ``key``: lookups and joins on it need no shuffle, as an index would save a scan."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)
