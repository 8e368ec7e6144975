"""Records that differ only in layout, collapsed into one each with an exact copy count.

Canonical records are range-partitioned and externally sorted; a scan of adjacent rows compares
the full keys (:mod:`tripleloom.llm.sorted_runs`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.words import letters_and_digits
from tripleloom.llm.sorted_runs import run_members
from tripleloom.session import spread

#: The escapes of a JSON string, of which no letter is part of the text; separators no text holds.
JSON_ESCAPE = r'\\(["\\/bfnrt]|u[0-9a-fA-F]{4})'
MEMBER, FIELD = "\x1e", "\x1f"


def canonical_object(text: Column) -> Column:
    """A JSON object as its members in the order of their names, each value in letters and digits; null if
    the text isn't one object and nothing else."""
    read = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})  # a list of it is malformed if anything follows
    members = F.sort_array(F.map_entries(F.when(F.ltrim(text).startswith("{") & (F.size(read) == 1), F.get(read, F.lit(0)))))
    value = lambda m: letters_and_digits(F.regexp_replace(m["value"], JSON_ESCAPE, " "))
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda m: F.concat(m["key"], F.lit("="), value(m))), MEMBER))


def canonical_key(exact: Sequence[str], text: Sequence[str], objects: Sequence[str] = ()) -> Column:
    """One string that is equal for two rows exactly if they are copies."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in exact]
    for c in text:
        plain = letters_and_digits(F.col(c))
        parts.append(F.coalesce(canonical_object(F.col(c)), plain) if c in objects else plain)
    return F.concat_ws(FIELD, *parts)


def copy_runs(df: DataFrame, row: str, exact: Sequence[str], text: Sequence[str], objects: Sequence[str] = ()) -> DataFrame:
    """``(keep_row, copy_row)`` for every row: the smallest ``row`` among its copies, and its own.

    Copies agree in the columns ``exact`` (null equals null) and, in the columns ``text``, in
    their letters and digits in order, ignoring case and all other characters; null is like
    empty.  A JSON object in one of ``objects`` is compared member by member by name, whatever
    their order; braces that are no JSON are plain text.  ``row`` is unique; rows where it is
    null can't be named in a pair and are left out.  Other columns are ignored.
    """
    known = spread(df.select(row, *exact, *text).where(F.col(row).isNotNull()))
    return run_members(known, canonical_key(exact, text, objects), row).select(F.col("first").alias("keep_row"), F.col("row").alias("copy_row"))


def layout_copies(df: DataFrame, row: str, exact: Sequence[str], text: Sequence[str], objects: Sequence[str] = ()) -> DataFrame:
    """``(keep_row, copy_row)`` for each row that has a copy with a smaller ``row``; see copy_runs."""
    return copy_runs(df, row, exact, text, objects).where("keep_row <> copy_row")


def copy_counts(df: DataFrame, row: str, exact: Sequence[str], text: Sequence[str], objects: Sequence[str] = ()) -> DataFrame:
    """``(keep_row, copies)``: one row for each distinct record with how many rows hold it; see copy_runs."""
    return copy_runs(df, row, exact, text, objects).groupBy("keep_row").agg(F.count(F.lit(1)).alias("copies"))
