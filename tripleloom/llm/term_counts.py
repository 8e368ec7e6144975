"""How often every distinct term occurs, and in how many records.

Pairs of term and record are range-partitioned and externally sorted; a scan of the sorted runs
counts occurrences and distinct records (:mod:`tripleloom.llm.sorted_runs`).  The range key ends
with the record, so the run of a term that stands in a third of all records is cut into even
parts; the parts of a run are then added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.words import BLANKS
from tripleloom.llm.sorted_runs import run_counts
from tripleloom.session import spread

KINDS = pa.array(["entity", "relation"])


def _terms(graph: pa.Array) -> pa.Table:
    """``(at, kind, term, occ)``: the terms of the valid triples of each graph, ``at`` its place."""
    steps = pc.list_flatten(graph)
    h, r, t = (pc.utf8_trim(pc.struct_field(steps, c), characters=BLANKS) for c in "hrt")
    filled = [pc.fill_null(pc.not_equal(x, ""), False) for x in (h, r, t)]
    valid = pc.and_(pc.and_(*filled[:2]), filled[2])
    at = pc.cast(pc.filter(pc.list_parent_indices(graph), valid), pa.int64())
    n = len(at)
    one = pa.table({
        "at": pa.chunked_array([at, at, at]),
        "kind": pa.array(np.repeat(np.array([0, 1], np.int8), [2 * n, n])),
        "term": pa.chunked_array([pc.filter(x, valid) for x in (h, t, r)], pa.string()),
    })
    return one.group_by(["at", "kind", "term"], use_threads=False).aggregate([([], "count_all")])


def triple_terms(rows: DataFrame, row: str = "row_id", graph: str = "graph") -> DataFrame:
    """``(kind, term, row, occ)``: the entities (h, t) and relations (r) of a row's valid triples.

    Triples with a null or blank member are not valid; members are read without the blanks
    around them.  Null and empty graphs have no terms.  Occurrences in one row are counted
    here, on whole Arrow batches, so a pair of term and row comes out once.
    """
    kind = dict(rows.dtypes)[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _terms(b.column(1)).combine_chunks()
            columns = [found.column(c).combine_chunks() for c in ("kind", "term", "at", "count_all")]
            yield pa.RecordBatch.from_arrays([KINDS.take(columns[0]), columns[1], b.column(0).take(columns[2]), columns[3]], names=["kind", "term", "row", "occ"])

    narrow = rows.select(F.col(row).alias("row"), F.col(graph).alias("graph"))
    return spread(narrow).mapInArrow(run, f"kind string, term string, row {kind}, occ long")


def term_counts(pairs: DataFrame) -> DataFrame:
    """``(kind, term, occurrences, rows)`` of pairs ``(kind, term, row, occ)``; rows with equal ids are one row."""
    return run_counts(pairs, ["kind", "term"], "row", "occ").withColumnsRenamed({"amount": "occurrences", "records": "rows"})


def marked_terms(rows: DataFrame, rare_rows: int = 2, common_share: float = 0.05, row: str = "row_id", graph: str = "graph") -> DataFrame:
    """``(kind, term, occurrences, rows, mark)``: ``rare`` if at most ``rare_rows`` rows hold the term,
    ``common`` if at least ``common_share`` of all rows do, else null.  Where both hold, as in tiny
    tables, the mark is ``rare``."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    mark = F.when(F.col("rows") <= rare_rows, "rare").when(F.col("rows") >= F.lit(Decimal(str(common_share))) * F.col("total"), "common")
    return term_counts(triple_terms(rows, row, graph)).crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("total")  # one row
