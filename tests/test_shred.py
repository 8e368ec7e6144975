import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleloom.operators.shred import EXPLORATION, ancestor_table, leaf_table, member_table, read_decisions, shred, trace_decisions, trace_items, trace_parents, trace_relations, trace_rounds

TARGETS = pa.list_(pa.string())
RELATION = pa.struct([("name", pa.string()), ("targets", TARGETS)])
ROUND = pa.struct([("round_num", pa.int32()), ("relations", pa.list_(RELATION))])
TRACE = pa.list_(ROUND)

maybe = lambda s: st.one_of(st.none(), s)
targets = st.lists(maybe(st.sampled_from(["a", "b", ""])), max_size=3)
relations = st.lists(maybe(st.fixed_dictionaries({"name": maybe(st.just("r")), "targets": maybe(targets)})), max_size=3)
rounds = st.lists(maybe(st.fixed_dictionaries({"round_num": maybe(st.just(1)), "relations": maybe(relations)})), max_size=3)


def plain(rows):
    out = []
    for k, trace in enumerate(rows):
        for i, d in enumerate(trace or []):
            for j, r in enumerate((d or {}).get("relations") or []):
                for m, t in enumerate((r or {}).get("targets") or []):
                    if t is not None:
                        out.append((k, i, j, m, t))
    return out


@given(st.lists(maybe(rounds), max_size=5), st.integers(0, 2))
@settings(max_examples=200, deadline=None)
def test_leaf_table_equals_nested_loops(rows, cut):
    column = pa.array(rows, TRACE)[min(cut, len(rows)) :]  # a slice has offsets of its own
    rows = rows[min(cut, len(rows)) :]
    keys, pos, values = leaf_table(column, EXPLORATION, pa.array(range(len(rows)), pa.int64()))
    assert [(k, *map(int, p), v) for k, p, v in zip(keys.to_pylist(), pos, values.to_pylist())] == plain(rows)
    keys, pos = ancestor_table(column, EXPLORATION, pa.array(range(len(rows)), pa.int64()), 2)
    want = [(k, i, j) for k, t in enumerate(rows) for i, d in enumerate(t or []) for j, _ in enumerate((d or {}).get("relations") or [])]
    assert [(k, *map(int, p)) for k, p in zip(keys.to_pylist(), pos)] == want


@given(st.lists(maybe(rounds), max_size=5), st.integers(0, 2))
@settings(max_examples=200, deadline=None)
def test_flat_tables_rebuild_the_records(rows, cut):
    cut = min(cut, len(rows))
    column, rows = pa.array(rows, TRACE)[cut:], rows[cut:]
    ids = pa.array(range(len(rows)), pa.int64())

    def table(path, members, lists):
        keys, pos, columns = member_table(column, path, members, lists, ids)
        return {(k, *map(int, p)): v for k, p, *v in zip(keys.to_pylist(), pos, *(c.to_pylist() for c in columns))}

    one, two = table(("[]",), ["round_num"], ["relations"]), table(("[]", "relations", "[]"), ["name"], ["targets"])
    keys, pos, values = leaf_table(column, EXPLORATION, ids)
    leaves = {(k, *map(int, p)): v for k, p, v in zip(keys.to_pylist(), pos, values.to_pylist())}

    def relation(at):
        null, name, n = two[at]
        return None if null else {"name": name, "targets": None if n is None else [leaves.get((*at, m)) for m in range(n)]}

    def round_(at):
        null, number, n = one[at]
        return None if null else {"round_num": number, "relations": None if n is None else [relation((*at, j)) for j in range(n)]}

    built = [[round_((k, i)) for i in range(sum(x[0] == k for x in one))] for k in range(len(rows))]
    assert built == [t or [] for t in rows]
    assert len(two) == sum(len((d or {}).get("relations") or []) for t in rows for d in t or [])


def test_levels_of_a_known_record():
    column = pa.array([[{"round_num": 1, "relations": [{"name": "r", "targets": ["a", None]}, {"name": "s", "targets": []}]}, None], None, []], TRACE)
    levels = shred(column, EXPLORATION)
    assert levels.record.tolist() == [0, 0, 0, 0, 1, 2]
    assert levels.repetition.tolist() == [0, 3, 2, 1, 0, 0]
    assert levels.present.tolist() == [True, False, False, False, False, False]
    assert levels.definition[0] == levels.definition[1] + 1 > levels.definition[2] > levels.definition[3] > levels.definition[5] > levels.definition[4]


def test_decisions():
    assert read_decisions(None) is None and read_decisions("") is None and read_decisions("no json") is None and read_decisions("3") is None
    assert read_decisions('{"answer_entities": "A"}') == [{"answer_entities": ["A"], "pruned_reasoning_paths": None, "next": None}]
    assert read_decisions('[null, {"answer_entities": [1, null], "next_exploration_step": {"entity": "B"}}]')[1] == {"answer_entities": ["1", None], "pruned_reasoning_paths": None, "next": "B"}
    assert read_decisions("[" * 100_000) is None


def test_operator_on_awkward_rows(spark):
    schema = "state_id long, exploration_trace array<struct<round_num:int,question:string,entity:string,relations:array<struct<name:string,targets:array<string>>>>>, reasoning_trace string, trace int, item int, pos1 int"
    long = "x" * 200_000
    rows = [
        (1, [(1, "q", "e", [("r", ["a", None, long]), None, ("s", None)]), None, (None, None, None, None)], json.dumps([{"answer_entities": ["A", None]}, {"next_exploration_step": {"entity": "B"}}]), 1, 2, 3),
        (1, None, json.dumps({"pruned_reasoning_paths": "p"}), 1, 2, 3),
        (None, [], "", None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in trace_items(df).collect())
    assert got == [("answer", 1, 0, 0, 0, "A"), ("exploration", 1, 0, 0, 0, "a"), ("exploration", 1, 0, 0, 2, long), ("next", 1, 1, 0, 0, "B"), ("pruned", 1, 0, 0, 0, "p")]
    parents = sorted((r["level"], r["pos1"], -1 if r["pos2"] is None else r["pos2"]) for r in trace_parents(df).collect())
    assert parents == [("relation", 0, 0), ("relation", 0, 1), ("relation", 0, 2), ("round", 0, -1), ("round", 1, -1), ("round", 2, -1)]
    assert trace_items(df.limit(0)).count() == 0
    assert sorted(map(tuple, trace_rounds(df).collect()), key=str) == sorted([(1, 0, False, 1, "q", "e", 3), (1, 1, True, None, None, None, None), (1, 2, False, None, None, None, None)], key=str)
    assert sorted(map(tuple, trace_relations(df).collect()), key=str) == sorted([(1, 0, 0, False, "r", 3), (1, 0, 1, True, None, None), (1, 0, 2, False, "s", None)], key=str)
    texts = [(7, '[{"answer_found": true, "error": "e", "extra": [1], "answer_entities": "A"}, 3, {"answer_found": "yes", "next_exploration_step": {"question": "q", "depth": 2}}]'), (8, "{}"), (9, None), (None, "x")]
    decisions = [tuple(r) for r in trace_decisions(spark.createDataFrame(texts, "state_id long, reasoning_trace string")).collect()]
    assert decisions == [
        (7, 0, False, True, None, "e", None, None, '{"extra": [1]}', 1, None),
        (7, 1, True, *[None] * 8),
        (7, 2, False, None, None, None, "q", None, '{"next_exploration_step": {"depth": 2}, "answer_found": "yes"}', None, None),
        (8, 0, False, *[None] * 8),
    ]
    for f in (trace_rounds, trace_relations, trace_decisions):
        assert f(df.limit(0)).count() == 0
