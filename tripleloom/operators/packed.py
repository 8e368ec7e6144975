"""Several values packed into one text: a quote-aware finite-state tokenizer.

States: between values, in a bare value, in a quoted value, after a quoted value.  A quote
opens only where a value begins, so the apostrophe of a name stays a letter; a doubled quote or
a backslash before a quote stands for the quote.  Delimiters part only outside quotes.  A field
that is a list literal is read with the list's own rules (quotes of either kind, comma only).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: What parts the values of an answer list and of a list of paths.
ANSWER_DELIMITERS = ",;|\t\r\n"
PATH_DELIMITERS = "|\t\r\n"
#: What a search for the end of a quoted value stops at.
SIGNS = {q: re.compile(rf"[\\{q}]").search for q in "\"'"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class PackedTokenizer:
    """``values(text)``: the values in order, without surrounding white space and enclosing quotes.

    ``quotes``: the signs that quote a value when they stand at its begin and a like one stands
    right before the next delimiter.  Depth of brackets counts only in list literals.  Each sign of
    a text is looked at a bounded number of times, however many quotes never close.
    """

    def __init__(self, delimiters: str, quotes: str = "\"'") -> None:
        self.delimiters = frozenset(delimiters)
        self.quotes = quotes
        self._split = re.compile(f"[{re.escape(delimiters)}]").split
        self._list_split = frozenset(",")

    def values(self, text: str | None) -> list[str]:
        if not text:
            return []
        body = text.strip()
        if body[:1] == "[" and body[-1:] == "]" and len(body) > 1:
            found = self._literal(body[1:-1])
            if found is not None:
                return found
        if '"' not in text and "'" not in text:  # no quotes: one pass of the splitter
            return [v for v in (p.strip() for p in self._split(text)) if v]
        return self._scan(text)

    def _literal(self, body: str) -> list[str] | None:
        """The elements of a list literal; None if it isn't one."""
        out: list[str] = []
        dead: set[tuple[str, int]] = set()
        i, n = 0, len(body)
        while i < n:
            while i < n and (body[i].isspace() or body[i] == ","):
                i += 1
            if i == n:
                break
            if body[i] in "\"'":
                end = self._closing(body, i, self._list_split, False, dead)
                if end < 0:
                    return None
                value, i = self._unescape(body[i + 1 : end], body[i], True), end + 1
            else:  # a bare element: to the next comma at this depth
                start, depth = i, 0
                while i < n and (depth or body[i] != ","):
                    depth += (body[i] in "[{") - (body[i] in "]}")
                    if depth < 0:
                        return None
                    i += 1
                value = body[start:i]
                if not _literal_word(value.strip()):
                    return None
                value = "" if value.strip() in ("null", "None") else value
            value = value.strip()
            if value:
                out.append(value)
            while i < n and body[i].isspace():
                i += 1
            if i < n and body[i] != ",":
                return None
        return out

    def _scan(self, text: str) -> list[str]:
        out: list[str] = []
        dead: set[tuple[str, int]] = set()
        i, n, start = 0, len(text), 0
        while i <= n:
            # between values: skip white space that isn't a delimiter
            while i < n and text[i] not in self.delimiters and text[i].isspace():
                i += 1
            start = i
            if i < n and text[i] in self.quotes and (end := self._closing(text, i, self.delimiters, True, dead)) >= 0:
                value = self._unescape(text[i + 1 : end], text[i], False).strip()
                i = end + 1
                while i < n and text[i] not in self.delimiters:  # only white space is left
                    i += 1
            else:
                while i < n and text[i] not in self.delimiters:
                    i += 1
                value = text[start:i].strip()
            if value:
                out.append(value)
            i += 1
        return out

    @staticmethod
    def _closing(text: str, at: int, delimiters: frozenset, doubled: bool, dead: set[tuple[str, int]]) -> int:
        """Where the quote opened at ``at`` closes: before a delimiter or the end; -1 if nowhere.

        ``dead`` holds the signs of this text from which on no quote of their kind closes; the way on
        from a sign doesn't depend on where it was come from, so each is looked at once."""
        quote, n, found = text[at], len(text), SIGNS[text[at]]
        passed, i = [], at + 1
        while m := found(text, i):
            i = m.start()
            if (quote, i) in dead:
                break
            passed.append((quote, i))
            if text[i] == "\\":
                i += 2
            elif doubled and i + 1 < n and text[i + 1] == quote:
                i += 2
            else:
                j = i + 1
                while j < n and text[j] not in delimiters and text[j].isspace():
                    j += 1
                if j == n or text[j] in delimiters:
                    return i
                i += 1
        dead.update(passed)
        return -1

    @staticmethod
    def _unescape(value: str, quote: str, literal: bool) -> str:
        if "\\" in value:
            if literal:
                value = re.sub(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", _escaped, value, flags=re.S)
                value = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            else:
                value = value.replace("\\" + quote, quote)
        return value if literal else value.replace(quote + quote, quote)


def _literal_word(value: str) -> bool:
    return value in ("null", "None", "true", "false", "True", "False") or re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", value) is not None


def _escaped(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else ESCAPES.get(m[3], m[3])


def is_object(text: str | None) -> bool:
    """Whether the field is a JSON object rather than a packed list."""
    import json

    body = (text or "").strip()
    if body[:1] != "{" or body[-1:] != "}":
        return False
    try:
        return isinstance(json.loads(body), dict)
    except (ValueError, RecursionError):
        return False


def unpack(df: DataFrame, key: str, fields: dict[str, str], object_fields: Sequence[str] = ()) -> DataFrame:
    """``(<key>, field, pos, item)``: a row for every value of ``fields`` (name to delimiters).

    ``pos`` counts the values of a field that are not empty from 0.  Null, empty and blank
    fields have no rows, nor has a JSON object in one of ``object_fields``.  A quote that never
    closes is an ordinary sign.  Rows with equal keys come out each; texts of any length are
    read whole; other columns are ignored, whatever their names.
    """
    kind = dict(df.dtypes)[key]
    readers = {name: PackedTokenizer(delimiters).values for name, delimiters in fields.items()}
    objects = frozenset(object_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (name, values) in enumerate(readers.items()):
                at, pos, items = [], [], []
                for i, text in enumerate(b.column(1 + k).to_pylist()):
                    if not text or (name in objects and text.lstrip()[:1] == "{" and is_object(text)):
                        continue
                    found = values(text)
                    at.extend([i] * len(found))
                    pos.extend(range(len(found)))
                    items.extend(found)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array([name] * len(at), pa.string()), pa.array(pos, pa.int32()), pa.array(items, pa.string())],
                    names=["key", "field", "pos", "item"],
                )

    return (
        df.select(df[key].alias("key"), *(df[name].alias(f"field{k}") for k, name in enumerate(fields)))
        .mapInArrow(run, f"key {kind}, field string, pos int, item string")
        .withColumnRenamed("key", key)
    )
