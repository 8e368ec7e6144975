"""Processing a growing source: each id once, late rows within a bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleloom.sources.writers import append_unseen


def stream_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def process_once(stream: DataFrame, key: str, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = lambda df: df, parts: int | None = None) -> StreamingQuery:
    """Appends ``process(batch)`` to the table ``out``, each key once over all batches and restarts.

    A batch that is run again after a failure finds its keys written and adds nothing.  ``parts``: see append_unseen; for a table that grows
    for long, so that a batch needn't read all its keys."""

    def write(batch: DataFrame, _: int) -> None:
        append_unseen(process(batch), out, key, parts=parts)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(begin, <kind>, n)``: rows per window and kind, with rows up to ``late`` behind."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("begin"), kind, "n")


def first_of_each(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The stream without repeated keys, remembered for ``late`` behind the newest row."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
