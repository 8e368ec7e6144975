"""Held-out questions inside training prompts.

The held-out items are indexed once: for every word the items that hold it with their BM25
impact, in blocks that keep their largest impact.  Every training passage queries the index with
block-max WAND: blocks whose bounds can't reach the threshold are passed over, the others walked
pivot by pivot.  An item's impacts are divided by the least score that any of its runs of
``run_words`` words can have, so that the one threshold 1 loses no true case; what is retrieved is
then verified word by word.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tripleloom.session import spread

#: Fixed value: a word is an unbroken run of letters and digits.
find_words = re.compile(r"[^\W_]+").findall
K1, B, BLOCK = 1.2, 0.75, 32


def passage_words(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


class ItemIndex:
    """A block-max inverted index of the items, and its query.

    Items stand in the order of the score a run of theirs has at least, so that a block holds
    items of one scale and its largest impacts bound all of them closely.
    """

    def __init__(self, items: Sequence[tuple], run_words: int = 10) -> None:
        """``items``: id, question and, where answers are to be verified, a list of gold answers."""
        self.run_words = run_words
        texts = [(i, w, {f" {' '.join(a)} " for x in (rest[0] if rest else None) or () if (a := passage_words(x))}) for i, text, *rest in items if len(w := passage_words(text)) >= run_words]
        n, mean = len(texts), sum(len(w) for _, w, _ in texts) / max(1, len(texts))
        df = Counter(w for _, text, _ in texts for w in set(text))
        idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
        scored = []
        for i, text, gold in texts:
            norm = K1 * (1 - B + B * len(text) / mean)
            impact = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(text).items()}
            runs = {tuple(text[k : k + run_words]) for k in range(len(text) - run_words + 1)}
            scored.append((min(sum(impact[w] for w in set(run)) for run in runs), i, impact, runs, gold))
        scored.sort(key=lambda x: (x[0], str(x[1])))
        self.ids = [i for _, i, _, _, _ in scored]
        self.runs = [runs for _, _, _, runs, _ in scored]
        self.answers = [gold for *_, gold in scored]
        self.blocks = -(-n // BLOCK)
        places: dict[str, list[int]] = {w: [] for w in df}
        impacts: dict[str, list[float]] = {w: [] for w in df}
        for at, (least, _, impact, _, _) in enumerate(scored):
            for w, x in impact.items():
                places[w].append(at)
                impacts[w].append(x / least * (1 + 1e-9))
        #: word: places, impacts, the blocks that hold it, their largest impacts (as arrays and by block), the largest of all
        self.lists = {}
        for w, at in places.items():
            most: dict[int, float] = {}
            for a, x in zip(at, impacts[w]):
                most[a // BLOCK] = max(x, most.get(a // BLOCK, 0.0))
            self.lists[w] = (at, impacts[w], np.array([*most]), np.array([*most.values()]), most, max(most.values()))

    def above(self, terms: set[str]) -> list[int]:
        """The items (by place) whose score against the distinct ``terms`` is at least 1."""
        lists = [self.lists[w] for w in terms if w in self.lists]
        if sum(x[5] for x in lists) < 1:
            return []
        bound = np.zeros(self.blocks)
        for x in lists:
            bound[x[2]] += x[3]
        return [at for block in np.flatnonzero(bound >= 1).tolist() for at in self._in_block(lists, block)]

    @staticmethod
    def _in_block(lists: list, block: int) -> list[int]:
        """WAND over one block with the block's largest impacts as bounds."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        cursors = []  # item, place in the list, the list, the bound
        for x in lists:
            if (most := x[4].get(block)) is not None:
                k = bisect_left(x[0], low)
                cursors.append([x[0][k], k, x, most])
        out = []
        while True:
            cursors.sort(key=itemgetter(0))
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            if item >= high:
                return out
            if cursors[0][0] == item:
                score = 0.0
                for c in cursors:
                    if c[0] != item:
                        break
                    score += c[2][1][c[1]]
                if score >= 1:
                    out.append(item)
                item += 1
            for c in cursors:
                if c[0] >= item:
                    break
                places = c[2][0]
                c[1] = k = bisect_left(places, item, c[1])
                c[0] = places[k] if k < len(places) else high
            cursors = [c for c in cursors if c[0] < high]

    def leaked(self, text: str | None) -> list[int]:
        """The ids of the items of which the text holds ``run_words`` words one after another."""
        return [self.ids[at] for at in self._held(passage_words(text))]

    def verified(self, text: str | None) -> list[tuple[int, int, int]]:
        """As leaked, with how many gold answers the item has and how many of them stand in the text."""
        w = passage_words(text)
        held = self._held(w)
        whole = f" {' '.join(w)} " if held else ""
        return [(self.ids[at], len(self.answers[at]), sum(a in whole for a in self.answers[at])) for at in held]

    def _held(self, w: list[str]) -> list[int]:
        if len(w) < self.run_words:
            return []
        found = self.above(set(w))
        if not found:
            return []
        runs = {tuple(w[k : k + self.run_words]) for k in range(len(w) - self.run_words + 1)}
        return [at for at in found if not runs.isdisjoint(self.runs[at])]


def _blocks(items: DataFrame, block_bytes: int, run_words: int) -> Iterator[bytes]:
    """The indexes of the items, each of about ``block_bytes`` of text, built by the executors."""
    size = F.octet_length("question") + F.coalesce(F.aggregate("answers", F.lit(0), lambda n, a: n + F.coalesce(F.octet_length(a), F.lit(0))), F.lit(0))
    total = items.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_bytes))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ItemIndex(rows, run_words))], pa.binary())], names=["index"])

    for block in range(blocks):  # blocks of the query set; all are run
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        for r in part.coalesce(1).mapInArrow(build, "index binary").collect():  # one index of bounded size
            yield r["index"]


def leaked_items(
    passages: DataFrame, key: Sequence[str], text: str, items: DataFrame, item_id: str, question: str, run_words: int = 10, answers: str | None = None, block_bytes: int = 64 << 20
) -> DataFrame:
    """``(<key>, item_id)`` for every passage that holds ``run_words`` consecutive words of an item.

    The index is built and sent in blocks of about ``block_bytes`` of the items' texts, so what is
    broadcast is bounded in bytes; each block is held against all passages, in one pass unless the
    items have more text than that.  Items with fewer words than ``run_words`` or a null text
    can't leak; null and empty passages hold nothing.  Items with equal texts are all reported;
    repeated passages each.  Other columns are ignored.

    ``answers`` names a list column of the items; then ``gold_answers`` and ``answers_found`` come
    out as well: how many different gold answers with a word the item has, and how many of them
    stand in the passage word by word.
    """
    spark = passages.sparkSession
    kinds = dict(passages.dtypes)
    narrow = spread(passages.select(*key, text))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + f", item_id {dict(items.dtypes)[item_id]}"
    names = [*key, "item_id"]
    if answers:
        schema += ", gold_answers int, answers_found int"
        names += ["gold_answers", "answers_found"]
    id_type = to_arrow_type(items.schema[item_id].dataType)
    listed = F.col(answers) if answers else F.array().cast("array<string>")
    known = items.select(F.col(item_id).alias("item_id"), F.col(question).alias("question"), listed.alias("answers")).where(F.col("question").isNotNull())
    out = None
    for index in _blocks(known, block_bytes, run_words):
        shared = spark.sparkContext.broadcast(pickle.loads(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            verified = shared.value.verified
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(len(key)).to_pylist()):
                    for item in verified(t):
                        at.append(i)
                        found.append(item)
                columns = list(zip(*found)) or [(), (), ()]
                places = pa.array(at, pa.int64())
                more = [pa.array(columns[0], id_type), *(pa.array(c, pa.int32()) for c in columns[1 : len(names) - len(key)])]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(places) for k in range(len(key))), *more], names=names)

        found = narrow.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)
