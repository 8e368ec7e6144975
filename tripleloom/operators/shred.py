"""Nested records to flat tables, by columnar shredding.

Every leaf path of a nested column becomes three streams: the values, a repetition level (at
which list of the path the value repeats) and a definition level (how far down the path is not
null).  The tables of the repeated ancestors are then rebuilt from the levels alone: a
position at depth d counts the entries whose repetition level is d since the last one below d.
Both steps work on whole Arrow buffers, not row by row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST = "[]"


@dataclass
class Levels:
    """One leaf's streams: ``record`` is the row an entry belongs to, ``depth`` the lists in the path."""

    record: np.ndarray
    repetition: np.ndarray
    definition: np.ndarray
    present: np.ndarray
    values: pa.Array
    depth: int
    #: The definition level from which on the entry stands in the list of that depth.
    defined_at: list[int]

    def positions(self) -> np.ndarray:
        """``(entries, depth)``: the position of each entry in each list of its path."""
        n = len(self.record)
        out = np.zeros((n, self.depth), dtype=np.int32)
        at = np.arange(n)
        for d in range(1, self.depth + 1):
            starts = self.repetition < d
            begins = np.maximum.accumulate(np.where(starts, at, 0)) if n else at
            steps = np.cumsum(self.repetition == d)
            out[:, d - 1] = steps - steps[begins]
        return out

    def entries(self, depth: int) -> np.ndarray:
        """Which entries begin an element of the list at ``depth`` (1 is the outermost)."""
        return (self.definition >= self.defined_at[depth - 1]) & (self.repetition <= depth)

    def sizes(self) -> pa.Array:
        """The size of each innermost list, in the order of the entries that begin one; null where there is none."""
        begins = np.flatnonzero(self.repetition < self.depth)
        there = self.definition >= self.defined_at[-1]
        n = np.add.reduceat(there.astype(np.int32), begins) if len(begins) else np.zeros(0, np.int32)
        return pa.array(n, pa.int32(), mask=self.definition[begins] < self.defined_at[-1] - 1)


def shred(column: pa.Array, path: Sequence[str]) -> Levels:
    """The levels of the leaf at ``path``; ``[]`` steps into a list, a name into a struct.

    Null or empty lists and null structs give one entry whose definition level tells where the
    path ended; so does a null leaf.  Nothing of the record is lost.
    """
    n = len(column)
    record = np.arange(n)
    repetition = np.zeros(n, dtype=np.int8)
    definition = np.zeros(n, dtype=np.int8)
    alive = np.ones(n, dtype=bool)
    index = np.arange(n)  # where an entry's value stands in ``column``
    level, depth, defined_at = 0, 0, []
    for step in [*path, None]:
        ok = alive.copy()
        if len(column):
            ok[alive] = column.is_valid().to_numpy(zero_copy_only=False)[index[alive]]
        level += 1
        definition[ok] = level
        alive = ok
        if step is None:
            break
        if step != LIST:
            column = pc.struct_field(column, step)
            continue
        depth += 1
        level += 1
        offsets = column.offsets.to_numpy().astype(np.int64)
        first, size = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        first[alive] = offsets[index[alive]]
        size[alive] = offsets[index[alive] + 1] - offsets[index[alive]]
        times = np.maximum(size, 1)
        source = np.repeat(np.arange(len(alive)), times)
        inner = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
        record, definition = record[source], definition[source].copy()
        repetition = np.where(inner == 0, repetition[source], depth).astype(np.int8)
        alive = size[source] > 0
        definition[alive] = level
        defined_at.append(level)
        index = first[source] + inner
        column = column.values
    values = column.take(pa.array(index[alive])) if alive.any() else column.slice(0, 0)
    return Levels(record, repetition, definition, alive, values, depth, defined_at)


def leaf_table(column: pa.Array, path: Sequence[str], key: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """``(keys, positions, values)`` of the leaf's values, null ones left out but counted."""
    levels = shred(column, path)
    keep = levels.present
    return key.take(pa.array(levels.record[keep])), levels.positions()[keep], levels.values


def ancestor_table(column: pa.Array, path: Sequence[str], key: pa.Array, depth: int) -> tuple[pa.Array, np.ndarray]:
    """``(keys, positions)`` of every element, null or not, of the list at ``depth`` of ``path``."""
    levels = shred(column, path)
    keep = levels.entries(depth)
    return key.take(pa.array(levels.record[keep])), levels.positions()[keep, :depth]


def member_table(column: pa.Array, path: Sequence[str], members: Sequence[str], lists: Sequence[str], key: pa.Array) -> tuple[pa.Array, np.ndarray, list[pa.Array]]:
    """``(keys, positions, columns)``: every element, null or not, of the innermost list of ``path``, which ends
    with it: whether it is null, its ``members``, and the size of each of its ``lists`` (null for a null one)."""
    columns: list[pa.Array] = []
    for name in members:
        levels = shred(column, (*path, name))
        keep = levels.entries(levels.depth)
        if not columns:
            columns.append(pa.array(levels.definition[keep] == levels.defined_at[-1]))
        at = np.cumsum(levels.present) - 1
        columns.append(levels.values.take(pa.array(at[keep], pa.int64(), mask=~levels.present[keep])))
        keys, positions = key.take(pa.array(levels.record[keep])), levels.positions()[keep]
    for name in lists:
        inner = shred(column, (*path, name, LIST))
        sizes = inner.sizes()
        begins = inner.repetition < inner.depth
        columns.append(sizes.filter(pa.array(inner.definition[begins] >= inner.defined_at[-2])))
    return keys, positions, columns


def _flat(kind: str, keys: pa.Array, positions: np.ndarray, values: pa.Array | None, names: Sequence[str]) -> pa.RecordBatch:
    n = len(keys)
    places = [pa.array(positions[:, i] if i < positions.shape[1] else np.zeros(n, np.int32), pa.int32()) for i in range(3)]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), keys, *places, values if values is not None else pa.nulls(n, pa.string())], names=list(names)
    )


#: The leaf paths of an exploration trace and of a list of decisions.
EXPLORATION = ("[]", "relations", "[]", "targets", "[]")
DECISIONS = {"answer": ("[]", "answer_entities", "[]"), "pruned": ("[]", "pruned_reasoning_paths", "[]"), "next": ("[]", "next")}
MEMBERS = {"answer_entities": pa.list_(pa.string()), "pruned_reasoning_paths": pa.list_(pa.string()), "next": pa.string()}
SCALARS = {"answer_found": pa.bool_(), "reasoning_summary": pa.string(), "error": pa.string(), "next_question": pa.string(), "more": pa.string()}
DECISION_TYPE = pa.list_(pa.struct(list(MEMBERS.items())))
WHOLE_DECISION_TYPE = pa.list_(pa.struct(list((MEMBERS | SCALARS).items())))


def _texts(value: object) -> list | None:
    """A member that may be a list, a bare value (a list of one) or missing."""
    if value is None:
        return None
    return [_text(v) for v in (value if isinstance(value, list) else [value])]


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _scalars(d: dict) -> dict:
    """The members of a decision that hold one value; ``more`` has those without a column, as JSON text."""
    step, found = d.get("next_exploration_step"), d.get("answer_found")
    more = {k: v for k, v in d.items() if k not in MEMBERS and k not in SCALARS and k != "next_exploration_step"}
    if isinstance(step, dict):
        if rest := {k: v for k, v in step.items() if k not in ("entity", "question")}:
            more["next_exploration_step"] = rest
    elif step is not None:
        more["next_exploration_step"] = step
    if found is not None and not isinstance(found, bool):
        more["answer_found"] = found
    return {
        "answer_found": found if isinstance(found, bool) else None,
        "reasoning_summary": _text(d.get("reasoning_summary")),
        "error": _text(d.get("error")),
        "next_question": _text(step.get("question")) if isinstance(step, dict) else None,
        "more": json.dumps(more, ensure_ascii=False) if more else None,
    }


def read_decisions(text: str | None, whole: bool = False) -> list | None:
    """The decisions in JSON text; one object is a list of one; text that is no JSON has none.

    ``whole``: with all members, not only those that hold the items."""
    try:
        read = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    if isinstance(read, dict):
        read = [read]
    if not isinstance(read, list):
        return None
    out = []
    for d in read:
        if not isinstance(d, dict):
            out.append(None)
            continue
        step = d.get("next_exploration_step")
        out.append({
            "answer_entities": _texts(d.get("answer_entities")),
            "pruned_reasoning_paths": _texts(d.get("pruned_reasoning_paths")),
            "next": _text(step.get("entity")) if isinstance(step, dict) else None,
        } | (_scalars(d) if whole else {}))
    return out


def trace_items(states: DataFrame, key: str = "state_id", exploration: str = "exploration_trace", reasoning: str = "reasoning_trace") -> DataFrame:
    """``(trace, <key>, pos1, pos2, pos3, item)``: every leaf value of both traces with the
    positions of its parents, counted from 0; null elements are counted but not put out.

    Any level may be null or empty.  ``reasoning`` is JSON text: one object is a list of one
    decision, a bare string a list of one element, text that is no JSON has no decisions; a
    member that is neither string nor list comes out as its JSON text.  Repeated rows come out
    as often as they occur.  Other columns are ignored, whatever their names.
    """
    kind = dict(states.dtypes)[key]
    names = ("trace", key, "pos1", "pos2", "pos3", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            k, pos, values = leaf_table(b.column(1), EXPLORATION, keys)
            yield _flat("exploration", k, pos, values, names)
            decisions = pa.array([read_decisions(t) for t in b.column(2).to_pylist()], DECISION_TYPE)
            for name, path in DECISIONS.items():
                k, pos, values = leaf_table(decisions, path, keys)
                yield _flat(name, k, pos, values, names)

    return states.select(key, exploration, reasoning).mapInArrow(
        run, f"trace string, `{key}` {kind}, pos1 int, pos2 int, pos3 int, item string"
    )


def trace_parents(states: DataFrame, key: str = "state_id", exploration: str = "exploration_trace") -> DataFrame:
    """``(level, <key>, pos1, pos2, pos3)``: a row for every round and relation of the exploration
    trace, empty and null ones too, so that the tables of :func:`trace_items` have their parents."""
    kind = dict(states.dtypes)[key]
    names = ("level", key, "pos1", "pos2", "pos3", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for depth, level in ((1, "round"), (2, "relation")):
                k, pos = ancestor_table(b.column(1), EXPLORATION, b.column(0), depth)
                yield _flat(level, k, pos, None, names)

    return (
        states.select(key, exploration)
        .mapInArrow(run, f"level string, `{key}` {kind}, pos1 int, pos2 int, pos3 int, item string")
        .select("level", key, "pos1", F.when(F.col("level") == "relation", F.col("pos2")).alias("pos2"))
    )


#: The flat tables of the parents: path, members and lists of each.
ROUND_PATH, RELATION_PATH = ("[]",), ("[]", "relations", "[]")


def _member_rows(states: DataFrame, key: str, column: str, path: Sequence[str], members: dict[str, str], lists: dict[str, str], kind: pa.DataType | None = None) -> DataFrame:
    """``(<key>, pos1 ..., is_null, <members>, <lists>)``; ``kind``: the column is JSON text of decisions."""
    kinds = dict(states.dtypes)
    places = [f"pos{i + 1}" for i in range(path.count(LIST))]
    schema = ", ".join([f"`{key}` {kinds[key]}", *(f"{p} int" for p in places), "is_null boolean", *(f"{n} {t}" for n, t in members.items()), *(f"{n} int" for n in lists.values())])
    names = [key, *places, "is_null", *members, *lists.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nested = b.column(1) if kind is None else pa.array([read_decisions(t, True) for t in b.column(1).to_pylist()], kind)
            keys, positions, columns = member_table(nested, path, list(members), list(lists), b.column(0))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(positions[:, i], pa.int32()) for i in range(len(places))), *columns], names=names)

    return states.select(key, column).mapInArrow(run, schema)


def trace_rounds(states: DataFrame, key: str = "state_id", exploration: str = "exploration_trace") -> DataFrame:
    """``(<key>, pos1, is_null, round_num, question, entity, n_relations)``: every round, null ones too."""
    return _member_rows(states, key, exploration, ROUND_PATH, {"round_num": "int", "question": "string", "entity": "string"}, {"relations": "n_relations"})


def trace_relations(states: DataFrame, key: str = "state_id", exploration: str = "exploration_trace") -> DataFrame:
    """``(<key>, pos1, pos2, is_null, name, n_targets)``: every relation of every round, null ones too."""
    return _member_rows(states, key, exploration, RELATION_PATH, {"name": "string"}, {"targets": "n_targets"})


def trace_decisions(states: DataFrame, key: str = "state_id", reasoning: str = "reasoning_trace") -> DataFrame:
    """``(<key>, pos1, is_null, answer_found, reasoning_summary, error, next_question, next, more, n_answers, n_pruned)``:
    every decision in the JSON text with the members that hold one value and the sizes of its lists;
    ``more`` has members without a column as JSON text.  What is no object is a null decision."""
    members = {"answer_found": "boolean", "reasoning_summary": "string", "error": "string", "next_question": "string", "next": "string", "more": "string"}
    return _member_rows(states, key, reasoning, ROUND_PATH, members, {"answer_entities": "n_answers", "pruned_reasoning_paths": "n_pruned"}, WHOLE_DECISION_TYPE)
