"""Walks and paths in a question's own graph.

A question's graph stands in one row, so it is searched there, a batch of Arrow rows at a time:
no hop shuffles, and a hop costs what it finds.  Triples are stripped, invalid ones left out, and
of triples with equal h and t the last one holds; ``undirected`` keeps one relation per pair of
nodes and goes both ways, ``parallel`` keeps every relation.  Null and empty graphs have no paths.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.paths import PATH_TYPE
from tripleloom.functions.words import BLANKS
from tripleloom.session import spread

Step = tuple[str, str, str]
Path = tuple[Step, ...]
Found = Iterable[tuple[Path, tuple]]


def confidence_bound(wins: float, tries: int, whole: int, weight: float = 1.0) -> float:
    """UCB1: the mean of what was won, and ``weight`` times more for what was tried less often."""
    return math.inf if not tries else wins / tries + weight * math.sqrt(math.log(whole) / tries)


def bound_column(wins: Column, tries: Column, whole: Column, weight: float = 1.0) -> Column:
    """confidence_bound of columns; null without tries."""
    return F.when(tries > 0, wins / tries + weight * F.sqrt(F.log(whole) / tries))


class QuestionGraph:
    """One row's graph in memory."""

    def __init__(self, steps: Iterable[Step], undirected: bool = False, parallel: bool = False) -> None:
        last: dict[tuple[str, ...], Step] = {}
        for s in steps:
            pair = (s[0], s[2]) if not undirected or s[0] <= s[2] else (s[2], s[0])
            if parallel:
                pair = (*pair, s[1])
            last.pop(pair, None)
            last[pair] = s
        self.edges = list(last.values())
        if undirected:
            self.edges += [(t, r, h) for h, r, t in self.edges if h != t]
        self.out: dict[str, list[Step]] = defaultdict(list)
        for s in self.edges:
            self.out[s[0]].append(s)

    @property
    def nodes(self) -> set[str]:
        return {n for h, _, t in self.edges for n in (h, t)}

    def walks(self, starts: Sequence[str], hops: int) -> Iterator[Path]:
        """Every visit of 1 to ``hops`` steps; a start that stands twice visits twice."""
        level: list[Path] = [(s,) for a in starts for s in self.out.get(a, ())]
        for k in range(hops):
            yield from level
            if k + 1 < hops:
                level = [(*w, s) for w in level for s in self.out.get(w[-1][2], ())]

    def ruled(self, starts: Sequence[str], rule: Sequence[str]) -> list[Path]:
        """The walks that follow a rule to its end; an empty rule gives one empty walk."""
        if not rule:
            return [()]
        level: list[Path] = [(s,) for a in starts for s in self.out.get(a, ()) if s[1] == rule[0]]
        for r in rule[1:]:
            level = [(*w, s) for w in level for s in self.out.get(w[-1][2], ()) if s[1] == r]
        return level

    def simple(self, starts: Sequence[str], ends: Sequence[str], hops: int) -> Iterator[Path]:
        """Paths of at most ``hops`` steps from a start to an end that visit no node twice."""
        wanted = set(ends)
        level = [((s,), frozenset(s[::2])) for a in dict.fromkeys(starts) for s in self.out.get(a, ()) if s[0] != s[2]]
        for _ in range(hops):
            yield from (p for p, _ in level if p[-1][2] in wanted)
            level = [((*p, s), seen | {s[2]}) for p, seen in level for s in self.out.get(p[-1][2], ()) if s[2] not in seen]

    def shortest(self, start: str, end: str) -> list[Path]:
        """All shortest paths of any length; from a node to itself the empty path."""
        nodes = self.nodes
        if start not in nodes or end not in nodes:
            return []
        far, before, queue = {start: 0}, defaultdict(list), deque([start])
        while queue:
            at = queue.popleft()
            if far[at] >= far.get(end, math.inf):
                break
            for s in self.out.get(at, ()):
                if s[2] not in far:
                    far[s[2]] = far[at] + 1
                    queue.append(s[2])
                if far[s[2]] == far[at] + 1:
                    before[s[2]].append(s)
        paths: list[Path] = [()] if end in far else []
        for _ in range(far.get(end, 0)):
            paths = [(s, *p) for p in paths for s in before[p[0][0] if p else end]]
        return paths

    def random(self, key: object, start: str, walk: int, length: int, seed: str) -> Path:
        """At each node the step with the smallest md5 of seed, key, walk, place and step."""
        path: list[Step] = []
        at = start
        while len(path) < length and (options := self.out.get(at)):
            rank = lambda s: hashlib.md5("|".join((seed, str(key), str(walk), str(len(path)), *s)).encode()).hexdigest()  # noqa: B023, E731
            path.append(min(options, key=rank))
            at = path[-1][2]
        return tuple(path)

    def leaves(self, starts: Sequence[str], longest: float = math.inf) -> Iterator[Path]:
        """Paths to where nothing goes on, back to a node of the path, or to the bound; depth first."""
        for a in dict.fromkeys(starts):
            path: list[Step] = []
            seen, line = {a}, [iter(self.out.get(a, ()))]
            while line:
                s = next(line[-1], None)
                if s is None:
                    line.pop()
                    if path:
                        seen.discard(path.pop()[2])
                elif s[2] in seen or not self.out.get(s[2]) or len(path) + 1 >= longest:
                    yield (*path, s)
                else:
                    path.append(s)
                    seen.add(s[2])
                    line.append(iter(self.out[s[2]]))

    def searched(self, start: str, end: str, rng: Random, iterations: int, rollout: int) -> Path:
        """The shortest path that Monte Carlo tree search (UCB1, random rollouts) comes upon; empty if none."""
        root, best = _Node((), start, frozenset([start])), ()
        if start == end:
            return ()
        for _ in range(iterations):
            line = [root]
            while line[-1].children:
                n = line[-1]
                fresh = [c for c in n.children if not c.tries]
                line.append(rng.choice(fresh) if fresh else max(n.children, key=lambda c, n=n: confidence_bound(c.wins, c.tries, n.tries)))
            leaf = line[-1]
            if leaf.children is None and leaf.at != end:
                leaf.children = [_Node((*leaf.path, s), s[2], leaf.seen | {s[2]}) for s in self.out.get(leaf.at, ()) if s[2] not in leaf.seen]
            at, path, seen = leaf.at, list(leaf.path), set(leaf.seen)
            for _ in range(rollout):
                options = [s for s in self.out.get(at, ()) if s[2] not in seen]
                if at == end or not options:
                    break
                path.append(rng.choice(options))
                at = path[-1][2]
                seen.add(at)
            if at == end and (not best or len(path) < len(best)):
                best = tuple(path)
            for n in line:
                n.tries += 1
                n.wins += (at == end) / max(1, len(path))
        return best


class _Node:
    __slots__ = ("at", "children", "path", "seen", "tries", "wins")

    def __init__(self, path: Path, at: str, seen: frozenset) -> None:
        self.path, self.at, self.seen, self.children, self.tries, self.wins = path, at, seen, None, 0, 0.0


def _steps(column: pa.Array) -> Iterator[list[Step]]:
    """The valid, stripped triples of each row of a graph column."""
    values = column.values
    present = column.is_valid().to_pylist()
    names = [[x.strip(BLANKS) if x is not None else "" for x in values.field(k).to_pylist()] for k in ("h", "r", "t")]
    if values.null_count:
        names = [[x if ok else "" for x, ok in zip(c, values.is_valid().to_pylist())] for c in names]
    offsets = column.offsets.to_pylist()
    for i, ok in enumerate(present):
        span = slice(offsets[i], offsets[i + 1])
        yield [s for s in zip(*(c[span] for c in names)) if s[0] and s[1] and s[2]] if ok else []


def _path_array(paths: list[Path]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
    fields = [pa.array([s[k] for p in paths for s in p], pa.string()) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["h", "r", "t"]))


def _names(items: Sequence[str | None] | None) -> list[str]:
    return [y for x in items or () if x is not None and (y := x.strip(BLANKS))]


def search(
    rows: DataFrame,
    find: Callable[..., Found],
    key: str = "row_id",
    graph: str = "graph",
    using: Sequence[str] = (),
    more: str = "",
    undirected: bool = False,
    parallel: bool = False,
) -> DataFrame:
    """``(<key>, path, <more>)``: what ``find(graph, key, *using)`` yields for each row, as ``(path, more values)``."""
    kind = dict(rows.dtypes)[key]
    extra = [c.strip().split(" ", 1) for c in more.split(",")] if more else []
    types = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, rest = [], [], [[] for _ in extra]

            def flush(b: pa.RecordBatch = b) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), _path_array(paths), *(pa.array(v, types[t]) for v, (_, t) in zip(rest, extra))],
                    names=["key", "path", *(n for n, _ in extra)],
                )

            inputs = zip(b.column(0).to_pylist(), *(b.column(2 + k).to_pylist() for k in range(len(using))))
            for i, (steps, row) in enumerate(zip(_steps(b.column(1)), inputs)):
                if not steps:
                    continue
                for path, values in find(QuestionGraph(steps, undirected, parallel), *row):
                    at.append(i)
                    paths.append(path)
                    for v, x in zip(rest, values):
                        v.append(x)
                    if len(at) >= 50_000:  # a row with many paths doesn't wait for its end
                        yield flush()
                        at, paths, rest = [], [], [[] for _ in extra]
            yield flush()

    schema = f"key {kind}, path {PATH_TYPE}" + (f", {more}" if more else "")
    narrow = rows.select(F.col(key).alias("key"), F.col(graph).alias("graph"), *(F.col(c).alias(f"using{k}") for k, c in enumerate(using)))
    return spread(narrow).mapInArrow(run, schema).withColumnRenamed("key", key)


def edges(rows: DataFrame, undirected: bool = False, **columns: str) -> DataFrame:
    """``(<key>, h, r, t)``: the edges of each question's graph."""
    found = search(rows, lambda g, _: (((s,), ()) for s in g.edges), undirected=undirected, **columns)
    return found.select(found.columns[0], F.inline("path"))


def walks(rows: DataFrame, hops: int, starts: str = "q_entity", **columns: str) -> DataFrame:
    """``(<key>, path)``: every visit of a walk of 1 to ``hops`` steps from the starts; walks may cross
    themselves.  Depth first and breadth first find the same; ``distinct`` gives the set of walks."""
    return search(rows, lambda g, _, s: ((w, ()) for w in g.walks(_names(s), hops)), using=[starts], **columns)


def rule_walks(rows: DataFrame, rule: str, starts: str = "q_entity", **columns: str) -> DataFrame:
    """``(<key>, path)``: the walks that follow the relations of the list column ``rule`` to its end."""
    return search(rows, lambda g, _, s, r: ((w, ()) for w in g.ruled(_names(s), r or [])), using=[starts, rule], **columns)


def applied_rules(rows: DataFrame, rules: str, starts: str = "q_entity", **columns: str) -> DataFrame:
    """``(<key>, path, rule)``: rule_walks for every rule of the list column ``rules``."""
    find = lambda g, _, s, rs: ((w, ("<SEP>".join(r),)) for r in rs or [] for w in g.ruled(_names(s), r))
    return search(rows, find, using=[starts, rules], more="rule string", **columns)


def simple_paths(rows: DataFrame, hops: int, starts: str = "q_entity", ends: str = "a_entity", undirected: bool = False, **columns: str) -> DataFrame:
    """``(<key>, path)``: paths of at most ``hops`` steps from a start to an end that visit no node twice."""
    find = lambda g, _, s, t: ((p, ()) for p in g.simple(_names(s), _names(t), hops))
    return search(rows, find, using=[starts, ends], undirected=undirected, **columns)


def truth_paths(rows: DataFrame, starts: str = "q_entity", ends: str = "a_entity", **columns: str) -> DataFrame:
    """``(<key>, path, s, t)``: all shortest paths from every start to every end; equal ones have an empty path."""
    find = lambda g, _, ss, ts: ((p, (s, t)) for s in dict.fromkeys(_names(ss)) for t in dict.fromkeys(_names(ts)) for p in g.shortest(s, t))
    return search(rows, find, using=[starts, ends], more="s string, t string", **columns)


def random_walks(rows: DataFrame, length: int, each: int, seed: str, starts: str = "q_entity", **columns: str) -> DataFrame:
    """``(<key>, path, start, walk)``: ``each`` seeded walks of up to ``length`` steps from each start; a
    walk that can't go on ends there, one that can't begin is left out."""

    def find(g: QuestionGraph, key: object, names: list) -> Iterator[tuple[Path, tuple]]:
        for s in dict.fromkeys(_names(names)):
            for w in range(each):
                if path := g.random(key, s, w, length, seed):
                    yield path, (s, w)

    return search(rows, find, using=[starts], more="start string, walk int", **columns)


def searched_paths(
    rows: DataFrame, seed: int = 5, iterations: int = 1000, rollout: int = 50, starts: str = "q_entity", ends: str = "a_entity", **columns: str
) -> DataFrame:
    """``(<key>, path, s, t)``: the best path tree search finds from each start to each end; seeded, so equal rows give equal paths."""

    def find(g: QuestionGraph, key: object, ss: list, ts: list) -> Iterator[tuple[Path, tuple]]:
        for s in dict.fromkeys(_names(ss)):
            for t in dict.fromkeys(_names(ts)):
                if path := g.searched(s, t, Random(f"{seed}|{key}|{s}|{t}"), iterations, rollout):
                    yield path, (s, t)

    return search(rows, find, using=[starts, ends], more="s string, t string", **columns)


def leaf_paths(rows: DataFrame, starts: str = "q_entity", **columns: str) -> DataFrame:
    """``(<key>, path)``: from each start over every relation, the paths to where nothing goes on; a path
    that comes back to one of its nodes ends there, so all end without a bound."""
    return search(rows, lambda g, _, s: ((p, ()) for p in g.leaves(_names(s))), using=[starts], parallel=True, **columns)
