"""Encoding of whole texts with a public byte-level BPE vocabulary.

A backtracking encoder: an Aho-Corasick automaton over the vocabulary gives, in one pass over a
piece of text, the longest token that begins at each byte; tokens are taken greedily and checked
against their left neighbour with a pair-compatibility table, going back to the next shorter
token where the merges would never have left that pair.  The result equals that of applying
the merges one by one, in linear time.  Decoding goes through one buffer and an offset table.

The vocabulary file is a parameter and is read on each executor; it is never shipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tripleloom.session import spread

#: Where the public tokenizers' files are; only a default.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pattern that splits text before the merges.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 signs stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBpe:
    """``encode(text)`` and ``decode(ids)`` for a vocabulary file with merges."""

    def __init__(self, path: str = TOKENIZER) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        self.token: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token[i] = as_bytes(token)
        self.id = {t: i for i, t in enumerate(self.token) if t}
        #: rank: the order in which the merges apply, the bytes first; halves: what a token was merged from
        self.rank = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for k, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = c
            if self.halves[c] is None:
                self.halves[c], self.rank[c] = (a, b), k
        self.shorter = [next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1) for t in self.token]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        sizes = np.fromiter((len(t) for t in self.token), np.int64, size)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.buffer = np.frombuffer(b"".join(self.token), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side: taking the two apart again,
        latest merge first, no pair across their border may have merged before either grew there."""
        known = self._fits.get((left, right))
        if known is not None:
            return known
        a, b, limit, good = left, right, len(self.rank), True
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and self.rank[joint] < limit:
                good = False
                break
            if self.halves[a] is None and self.halves[b] is None:
                break
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.halves[a][1]
            else:
                limit, b = self.rank[b] + 1, self.halves[b][0]
        self._fits[left, right] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.id.get(piece)
        if whole is not None and self.fits_alone(whole):
            return [whole]
        n = len(piece)
        longest, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, i) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, i
        open_at = bytearray(b"\x01") * (n + 1)  # places from which the rest can still be encoded
        out: list[int] = []
        at, candidate, token = 0, longest[0], self.token
        while at < n or candidate >= 0:
            end = at + len(token[candidate])
            if open_at[end] and (not out or self.fits(out[-1], candidate)):
                out.append(candidate)
                at, candidate = end, longest[end] if end < n else -1
            elif self.shorter[candidate] >= 0:
                candidate = self.shorter[candidate]
            else:
                open_at[at] = 0
                candidate = out.pop()
                at -= len(token[candidate])
        return out

    @lru_cache(maxsize=100_000)  # noqa: B019
    def fits_alone(self, i: int) -> bool:
        """Whether the merges make the token of its own bytes: its halves must stay side by side."""
        halves = self.halves[i]
        return halves is None or (self.fits_alone(halves[0]) and self.fits_alone(halves[1]) and self._first_merge(i))

    def _first_merge(self, i: int) -> bool:
        a, b = self.halves[i]
        own = self.merged.pop((a, b))
        self._fits.pop((a, b), None)
        good = self.fits(a, b)
        self._fits.pop((a, b), None)
        self.merged[a, b] = own
        return good

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, special tokens' strings being ordinary text; none for null and empty."""
        if not text:
            return []
        out: list[int] = []
        known = self._pieces
        for p in PIECES.findall(text):
            ids = known.get(p)
            if ids is None:
                if len(known) > REMEMBERED or len(self._fits) > 2 * REMEMBERED:
                    known.clear()
                    self._fits.clear()
                ids = tuple(self.encode_piece(p.encode("utf-8", "replace")))
                if len(p) < 64:
                    known[p] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        if not len(ids):
            return ""
        i = np.asarray(ids)
        starts, sizes = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.buffer[places].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str = TOKENIZER) -> ByteBpe:
    """One tokenizer for each file and worker process."""
    return ByteBpe(path)


def encode_texts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``(<key>, ids)``: the token ids of every text, whole; null, empty: an empty list.

    A blank text has the ids of its white space.  Repeated rows come out each, null keys as
    null; other columns are ignored, whatever their names.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return spread(df.select(df[key].alias("key"), df[text].alias("text"))).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids of ``text``; see encode_texts."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for b in batches:
            n = [len(encode(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return spread(df.select(*keep, df[text])).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens long")
