"""Runs of equal keys in range-partitioned, externally sorted rows.

Rows are range-partitioned by (hash of key, key, row) and sorted within the partitions, so the
sort spills and a run of any length is cut into even parts.  A scan then compares each full key
with its neighbour's.  What the scan cannot see, a run that goes on in the next partition, is
settled from the first and the last run of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.session import cut_lineage


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null."""
    one, two = column.slice(1), column.slice(0, len(column) - 1)
    apart = pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        apart = apart | (one.is_null().to_numpy(zero_copy_only=False) != two.is_null().to_numpy(zero_copy_only=False))
    return apart


def _begins(columns: Sequence[pa.Array]) -> np.ndarray:
    """Where a run of equal values begins, the first row included."""
    n = len(columns[0])
    out = np.ones(n, dtype=bool)
    if n > 1:
        out[1:] = np.logical_or.reduce([_differs(c) for c in columns])
    return out


# -- the members of each run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(row, first)`` with the first row of their run in this partition; ``head`` marks the
    partition's first run.  One more record, with ``row`` null, tells how the partition begins and ends."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    names = ["part", "row", "first", "head", "first_key", "last_key"]
    first_key = last_key = None
    start, runs = 0, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        key, row = b.column(0), b.column(1).to_numpy()
        new = _begins([key])
        new[0] = not runs or key[0].as_py() != last_key
        if not runs:
            first_key = key[0].as_py()
        number = runs + np.cumsum(new)
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = np.where(at >= 0, row[np.maximum(at, 0)], start)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(row, pa.int64()), pa.array(first, pa.int64()), pa.array(number == 1), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
            names=names,
        )
        start, runs, last_key = int(first[-1]), int(number[-1]), key[n - 1].as_py()
    if runs:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([start], pa.int64()), pa.array([runs == 1]), pa.array([first_key], pa.string()), pa.array([last_key], pa.string())],
            names=names,
        )


def run_members(df: DataFrame, key: Column, row: str) -> DataFrame:
    """``(first, row)``: for every row of ``df`` the smallest ``row`` among those of equal ``key``.

    ``key`` is a string and must not be null; ``row`` is a whole number, unique and not null.
    Full keys are compared, at the partitions' borders too, where executors do it: the driver
    only gets four small fields for each partition.
    """
    spark = df.sparkSession
    keyed = df.select(key.alias("key"), F.col(row).cast("long").alias("row")).withColumn("h", F.xxhash64("key"))
    ordered = keyed.repartitionByRange("h", "key", "row").sortWithinPartitions("h", "key", "row").select("key", "row")
    scanned = cut_lineage(
        ordered.mapInArrow(_scan, "part int, row long, first long, head boolean, first_key string, last_key string")
    )
    ends = scanned.where(F.col("row").isNull())  # one record per partition, so one task is enough to hold each against the last
    goes_on = F.lag("last_key").over(Window.orderBy("part")) == F.col("first_key")
    fixed, open_start = [], None
    for e in ends.select("part", "first", "head", goes_on.alias("goes_on")).orderBy("part").collect():
        own = e["first"]
        if e["goes_on"]:
            fixed.append((e["part"], open_start))
            own = open_start if e["head"] else own
        open_start = own
    rows = scanned.where(F.col("row").isNotNull())
    if not fixed:
        return rows.select("first", "row")
    earlier = spark.createDataFrame(fixed, "part int, earlier long")
    return rows.join(F.broadcast(earlier), (rows["part"] == earlier["part"]) & F.col("head"), "left").select(  # at most a row per partition
        F.coalesce("earlier", "first").alias("first"), "row"
    )


# -- the size of each run


def _counter(keys: int) -> object:
    """A scan of sorted ``(*keys, record, amount)``: ``(*keys, amount, records, border)`` for each run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        held: tuple | None = None  # the run that may still go on: its keys as arrays of one, last record, amount, records
        first = True

        def out(values: list[pa.Array], amounts: np.ndarray, records: np.ndarray, border: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*values, pa.array(amounts, pa.int64()), pa.array(records, pa.int64()), pa.array(border)], schema=schema)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            values, record, amount = b.columns[:keys], b.column(keys), b.column(keys + 1).to_numpy()
            if schema is None:
                schema = pa.schema([*(pa.field(b.schema.names[i], b.schema.types[i]) for i in range(keys)), ("amount", pa.int64()), ("records", pa.int64()), ("border", pa.bool_())])
            new = _begins(values)
            new_record = new | _begins([record])
            starts = np.flatnonzero(new)
            amounts, records = np.add.reduceat(amount, starts), np.add.reduceat(new_record.astype(np.int64), starts)
            if held is not None:
                if all(v[0].as_py() == h[0].as_py() for v, h in zip(values, held[0])):
                    amounts[0] += held[2]
                    records[0] += held[3] - (record[0].as_py() == held[1])
                else:
                    yield out(held[0], np.array([held[2]]), np.array([held[3]]), np.array([first]))
                    first = False
            closed = len(starts) - 1
            if closed:
                at = pa.array(starts[:-1])
                border = np.zeros(closed, dtype=bool)
                border[0], first = first, False
                yield out([v.take(at) for v in values], amounts[:-1], records[:-1], border)
            last = int(starts[-1])
            held = ([v.slice(last, 1) for v in values], record[n - 1].as_py(), int(amounts[-1]), int(records[-1]))
        if held is not None:
            yield out(held[0], np.array([held[2]]), np.array([held[3]]), np.array([True]))

    return scan


def scanned_runs(pairs: DataFrame, keys: Sequence[str], record: str, amount: str) -> DataFrame:
    """``(<keys>, amount, records, border)``: the runs of each range partition; a ``border`` run is the first
    or the last of its partition and may be a part of one."""
    kinds = dict(pairs.dtypes)
    order = ["__h", *keys, record]
    ordered = pairs.select(*keys, record, F.col(amount).cast("long").alias("__n")).withColumn("__h", F.xxhash64(*keys))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, record, "__n")
    return ordered.mapInArrow(_counter(len(keys)), ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", amount long, records long, border boolean")


def run_counts(pairs: DataFrame, keys: Sequence[str], record: str, amount: str) -> DataFrame:
    """``(<keys>, amount, records)``: for each distinct key the sum of ``amount`` and the number of distinct
    records; equal records of a key count once, null is a record like any other.

    A key and record stand in one partition, so parts of a run are added up; they are two at
    most for each partition.
    """
    scanned = cut_lineage(scanned_runs(pairs, keys, record, amount), as_rows=True)
    parts = scanned.where("border").groupBy(*keys).agg(F.sum("amount").alias("amount"), F.sum("records").alias("records"))
    return scanned.where("NOT border").drop("border").unionByName(parts)
