"""Queries of paths and negatives against the rules they follow, written out a second time."""

from collections import defaultdict
from hashlib import md5

import pyarrow.parquet as pq

from tests.oracle import FOLDER
from tripleloom.operators import training, walks
from tripleloom.operators.walks import QuestionGraph
from tripleloom.plans import load_all
from tripleloom.plans.graph import clean, question_pairs
from tripleloom.plans.registry import QUERIES
from tripleloom.plans.rows import truth

load_all()

BLANKS = " \t\r\n"


def digest(*parts):
    return md5("|".join(parts).encode()).hexdigest()


def text(path):
    return " ; ".join(f"{h}-[{r}]->{t}" for h, r, t in path)


def trace_paths(trace):
    """The reference's recursion from the entities of round 1, each path once."""
    view, starts, found = {}, set(), set()
    for d in trace or []:
        entity = ((d or {}).get("entity") or "").strip(BLANKS)
        if entity and d["round_num"] == 1:
            starts.add(entity)
        for l in (d or {}).get("relations") or []:
            for t in (l or {}).get("targets") or []:
                edge = (entity, (l["name"] or "").strip(BLANKS), (t or "").strip(BLANKS))
                if all(edge):
                    view.setdefault(entity, []).append(edge)

    def go(at, path, seen):
        for e in view[at]:
            if e[2] in seen or e[2] not in view:
                found.add((*path, e))
            else:
                go(e[2], (*path, e), seen | {e[2]})

    for s in starts & set(view):
        go(s, (), {s})
    return found


def test_leaf_paths_come_back_to_their_start_and_keep_every_relation(spark):
    graph = [("A", "r", "B"), ("A", "s", "B"), ("B", "t", "A")]
    df = spark.createDataFrame([(1, ["A"], graph)], "qid long, starts array<string>, graph array<struct<h:string,r:string,t:string>>")
    got = {tuple(tuple(s) for s in r["path"]) for r in walks.leaf_paths(df, "starts", key="qid").collect()}
    assert got == {(("A", "r", "B"), ("B", "t", "A")), (("A", "s", "B"), ("B", "t", "A"))}


def test_leaf_paths_have_no_bound():
    line = [(str(i), "r", str(i + 1)) for i in range(40)]
    assert [len(p) for p in QuestionGraph(line, parallel=True).leaves(["0"])] == [40]


def test_trace_leaf_paths_are_the_references(spark):
    want = {
        (r["state_id"], len(p), " -> ".join([p[0][0], *(x for s in p for x in s[1:])]))
        for r in pq.read_table(f"{FOLDER}/traversal_states.parquet", columns=["state_id", "exploration_trace"]).to_pylist()
        for p in trace_paths(r["exploration_trace"])
    }
    got = [(r["state_id"], r["hops"], r["path"]) for r in QUERIES["t18_trace_leaf_paths"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def replacements(spark):
    """``{(qid, positive path): [(hop, place, negative path)]}``: two other relations of every hop's node."""
    tails = defaultdict(lambda: defaultdict(set))
    for h, r, t in clean(spark, FOLDER).collect():
        tails[h][r].add(t)
    ranked = {h: sorted(rs, key=lambda r: (digest("rel", r), r))[:4] for h, rs in tails.items()}
    found = {}
    for row in truth(spark, FOLDER).collect():
        path = tuple(tuple(s) for s in row["path"])
        out = found[row["qid"], path] = []
        for i, (h, r, t) in enumerate(path):
            for n, other in enumerate([x for x in ranked.get(h, []) if x != r][:2]):
                if fit := tails[h][other] - {row["t"], t}:
                    out.append((i, n, (*path[:i], (h, other, min(fit, key=lambda x: digest("neg", h, other, x))))))
    return found


def test_every_hop_of_every_path_is_perturbed(spark):
    want = {(qid, text(p)) for (qid, _), found in replacements(spark).items() for _, _, p in found}
    got = [tuple(r) for r in QUERIES["n01_perturbed_paths"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(" ; " in p for _, p in got)


STEPS = "array<struct<h:string,r:string,t:string>>"


def test_each_positive_path_has_negatives_of_its_own(spark):
    a, b = ([(s, f"{s}{i}", f"{s}{i + 1}") for i in range(4)] for s in "ab")
    perturbed = [(1, p, [*p[:i], (p[i][0], f"x{n}", "y")], n) for p in (a, b) for i in range(len(p)) for n in (1, 2)]
    perturbed = spark.createDataFrame(perturbed, f"id int, origin {STEPS}, path {STEPS}, n int")
    positive = spark.createDataFrame([(1, a), (1, b)], f"id int, path {STEPS}")
    cut = training.truncated(positive, "id", "path", 5)
    got = [(r["strategy"], r["path"][0]) for r in training.combined_negatives(perturbed, cut, "id", 5).collect()]
    assert sorted(got) == [(0, "a")] * 5 + [(0, "b")] * 5
    few = training.combined_negatives(perturbed.where("n = 1 AND size(path) = 1"), cut, "id", 5).collect()
    assert sorted((r["strategy"], r["path"][0], r["path"].count(";")) for r in few) == sorted((k, s, n) for s in "ab" for k, n in [(0, 0), (1, 0), (1, 1), (1, 2)])


def wanted_negatives(spark):
    """``{qid: {negative path: strategy}}`` by the reference's limit of 5 for each positive path."""
    want = defaultdict(dict)
    for (qid, path), found in replacements(spark).items():
        found = sorted(found, key=lambda f: (digest("hop", text(path), str(len(f[2]))), f[1]))
        both = [(0, text(p)) for _, _, p in found] + [(1, text(path[:k])) for k in range(1, len(path))]
        for strategy, p in both[:5]:
            want[qid][p] = min(strategy, want[qid].get(p, 1))
    return want


def test_combined_negatives_are_capped_by_positive_path(spark):
    want = {(qid, p, k) for qid, found in wanted_negatives(spark).items() for p, k in found.items()}
    got = [(r["qid"], r["path"], r["strategy"]) for r in QUERIES["n03_combined_negatives"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_path_items_hold_all_negatives_of_their_positive_paths(spark):
    want = {qid: "|".join(sorted(found)) for qid, found in wanted_negatives(spark).items()}
    got = {r["qid"]: r["negative_paths"] for r in QUERIES["n04_path_items"](spark, FOLDER).collect()}
    assert {q: n for q, n in got.items() if n} == want


def test_shortest_paths_reach_the_references_depth(spark):
    out = defaultdict(list)
    for h, r, t in clean(spark, FOLDER).collect():
        out[h].append((h, r, t))
    ends = defaultdict(set)
    for s, t in question_pairs(spark, FOLDER).collect():
        if s != t:
            ends[s].add(t)
    want = set()
    for s, ts in ends.items():
        far, level = {s: 0}, [s]
        before = defaultdict(list)
        for depth in range(1, 6):
            for e in (e for at in level for e in out[at]):
                if far.setdefault(e[2], depth) == depth:
                    before[e[2]].append(e)
            level = [n for n, k in far.items() if k == depth]
        for t in ts & set(far):
            paths = [()]
            for _ in range(far[t]):
                paths = [(e, *p) for p in paths for e in before[p[0][0] if p else t]]
            want |= {(s, t, far[t], text(p)) for p in paths}
    got = [(r["s"], r["t"], r["hops"], r["path"]) for r in QUERIES["t03_shortest_paths"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(hops > 2 for _, _, hops, _ in got)


def test_tree_search_looks_as_long_as_the_reference(spark):
    wide = [("A", "r", f"n{i}") for i in range(300)] + [("n7", "s", "Z")]
    df = spark.createDataFrame([(i, ["A"], ["Z"], wide) for i in range(5)], "row_id long, q_entity array<string>, a_entity array<string>, graph array<struct<h:string,r:string,t:string>>")
    assert [len(r["path"]) for r in walks.searched_paths(df).collect()] == [2] * 5
