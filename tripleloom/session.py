"""Session defaults and the two settings every operator reads from a session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a session of our own starts with; a cluster's own settings win over these.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "tripleloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests, benches and notebooks."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cpus), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, as in tests, may fall back to a temporary folder; a cluster without
    the setting is an error, for a machine's own folder is lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"tripleloom-{os.getuid()}")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, for tables that are written to be read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> str:
    """Puts this package into the shared folder and on the path of every worker; returns where it stands."""
    import shutil
    from pathlib import Path

    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as made:  # on the driver only, until it is copied
        archive = shutil.make_archive(os.path.join(made, "tripleloom"), "zip", home.parent, home.name)
        target = scratch_folder(spark, "package") + "/tripleloom.zip"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{archive}"), path)
    spark.sparkContext.addPyFile(target)
    return target


def cut_lineage(df: DataFrame, as_rows: bool = False) -> DataFrame:
    """``df`` computed once into the shared folder; a lost executor costs nothing already done.

    A compressed table of columns: it takes a fraction of a checkpoint's disk, and who reads it reads
    only the columns it needs.  The tables go when the program ends, or with clear_scratch.
    ``as_rows``: a checkpoint, which is cheaper to write where texts hardly repeat and all is read."""
    if as_rows:
        if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
        return df.checkpoint(eager=True)
    path = scratch_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    if not _written:
        atexit.register(clear_scratch, df.sparkSession)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the tables that cut_lineage wrote, how many: nothing made from them may be read any more."""
    n = 0
    try:
        for path in _written:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            n += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    except Exception:  # the session ended first; the folder is the cluster's to clean
        pass
    _written.clear()
    return n


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session has slots.

    For work on rows that costs far more than moving them, where a small table's few files would
    leave most cores idle.  A table with enough splits is not touched; nor is the result of a
    shuffle, whose partitions Spark sizes itself, nor anything of a session that doesn't show its plan."""
    if getattr(df, "_jdf", None) is None:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if plan.executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    return df.repartition(slots) if plan.toRdd().getNumPartitions() < slots else df
