import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleloom.operators.packed import ANSWER_DELIMITERS, PATH_DELIMITERS, PackedTokenizer, is_object, unpack

answers = PackedTokenizer(ANSWER_DELIMITERS).values
paths = PackedTokenizer(PATH_DELIMITERS).values


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("", []),
        (" \n, ;|", []),
        ("a, b;c|d\te\r\nf", ["a", "b", "c", "d", "e", "f"]),
        ('"Braxar, Klomick", x', ["Braxar, Klomick", "x"]),
        ('"say ""hi"" now" | y', ['say "hi" now', "y"]),
        (r'"a \"b\" c", d', ['a "b" c', "d"]),
        ("O'Drixel, it's", ["O'Drixel", "it's"]),
        ('Dalmal "Lirdosh", b', ['Dalmal "Lirdosh"', "b"]),
        ('"never closed, b', ['"never closed', "b"]),
        ('["a, b", "c \\"d\\"", ""]', ["a, b", 'c "d"']),
        ("['O\\'Dravüs', \"it's\", 'x']", ["O'Dravüs", "it's", "x"]),
        ("[]", []),
        ("[1, null, 2.5]", ["1", "2.5"]),
        ("[not a list], b", ["[not a list]", "b"]),
        ('["\\u00fc", "\\ud83d\\ude00"]', ["ü", "😀"]),
        ('"", a', ["a"]),
    ],
)
def test_answers(text, want):
    assert answers(text) == want


def test_paths_keep_comma_and_semicolon():
    assert paths("A-[r]->B, C ; B, C-[s]->D || E -> t -> F\nG") == ["A-[r]->B, C ; B, C-[s]->D", "E -> t -> F", "G"]


words = st.text(alphabet="ab ,;|\"'\\\n", min_size=1, max_size=8).map(str.strip).filter(bool)


@given(st.lists(words, max_size=5), st.sampled_from([",", ";", "|", "\t", "\n", ", ", " | "]))
@settings(max_examples=300, deadline=None)
def test_quoted_values_come_back(values, delimiter):
    quoted = [v for v in values if "\\" not in v]
    text = delimiter.join('"' + v.replace('"', '""') + '"' for v in quoted)
    assert answers(text) == quoted


@given(st.lists(words, max_size=5))
@settings(max_examples=300, deadline=None)
def test_list_literals_come_back(values):
    assert answers(json.dumps(values)) == values
    assert answers(repr(values)) == values


@given(st.text(alphabet="ab,;| \t\n", max_size=30))
@settings(max_examples=300, deadline=None)
def test_without_quotes_it_is_a_split(text):
    parts, now = [], ""
    for c in text + ",":
        if c in ",;|\t\n":
            parts.append(now.strip())
            now = ""
        else:
            now += c
    assert answers(text) == [p for p in parts if p]


def closing(text, at, delimiters):
    """The rule of a closing quote, walked sign by sign for each quote."""
    i = at + 1
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            i += 2
        elif text[i : i + 2] == text[at] * 2:
            i += 2
        elif text[i] == text[at] and (not (rest := text[i + 1 :].lstrip(" ")) or rest[0] in delimiters):
            return i
        else:
            i += 1
    return -1


def brute(text, delimiters=",|\n"):
    out, i = [], 0
    while i <= len(text):
        while i < len(text) and text[i] == " ":
            i += 1
        start, quoted = i, None
        if i < len(text) and text[i] in "\"'" and (end := closing(text, i, delimiters)) >= 0:
            q = text[i]
            quoted, i = text[i + 1 : end].replace("\\" + q, q).replace(q + q, q), end + 1
        while i < len(text) and text[i] not in delimiters:
            i += 1
        out.append((text[start:i] if quoted is None else quoted).strip())
        i += 1
    return [v for v in out if v]


@given(st.text(alphabet="ab,|\"'\\ \n", max_size=40))
@settings(max_examples=1500, deadline=None)
def test_quotes_equal_brute_force(text):
    assert PackedTokenizer(",|\n").values("x," + text) == brute("x," + text)


@pytest.mark.parametrize("part", ["'x y,", "\"x'y,'", "'\\' ,'' x", "['a' 'b',", "''", "' "])
def test_a_long_field_takes_time_in_proportion(part):
    began = time.process_time()
    answers(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 2


def test_objects():
    assert is_object(' {"a": 1} ') and not is_object("{a}") and not is_object(None) and not is_object('["a"]')


def test_operator(spark):
    long = ",".join(["v"] * 50_000)
    rows = [(1, "a, b", "p | q", "x"), (2, None, "", "x"), (3, '{"a": 1}', '{"a": 1}', "x"), (4, "{broken", None, "x"), (5, long, None, "x"), (1, "a, b", "p | q", "x"), (None, "z", None, None)]
    df = spark.createDataFrame(rows, "row_id long, prediction string, predicted_paths string, pos string")
    out = unpack(df, "row_id", {"prediction": ANSWER_DELIMITERS, "predicted_paths": PATH_DELIMITERS}, ("prediction",))
    got = [tuple(r) for r in out.where("row_id <> 5 OR row_id IS NULL").collect()]
    twice = [(1, "prediction", 0, "a"), (1, "prediction", 1, "b"), (1, "predicted_paths", 0, "p"), (1, "predicted_paths", 1, "q")] * 2
    rest = [(3, "predicted_paths", 0, '{"a": 1}'), (4, "prediction", 0, "{broken"), (None, "prediction", 0, "z")]
    assert sorted(got, key=str) == sorted(twice + rest, key=str)
    assert out.where("row_id = 5").count() == 50_000
    assert unpack(df.limit(0), "row_id", {"prediction": ","}).count() == 0
    clash = df.selectExpr("row_id AS k", "prediction AS key", "predicted_paths AS field")
    assert unpack(clash, "k", {"key": ",", "field": "|"}).where("k = 4").count() == 1
