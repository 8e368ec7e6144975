"""Paths as ``ARRAY<STRUCT<h,r,t>>`` columns, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs of the text forms.
STEP_SEPARATOR = " ; "
STEP = r"^(.+?)\s*-\[\s*(.+?)\s*\]->\s*(.+)"
PATH_TYPE = "array<struct<h:string,r:string,t:string>>"


def steps_text(path: Column) -> Column:
    """``h-[r]->t ; h2-[r2]->t2``."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["h"], F.lit("-["), s["r"], F.lit("]->"), s["t"])), STEP_SEPARATOR)


def arrow_text(path: Column) -> Column:
    """``h -> r -> t -> r2 -> t2``; empty for an empty path."""
    tail = F.array_join(F.transform(path, lambda s: F.concat(F.lit(" -> "), s["r"], F.lit(" -> "), s["t"])), "")
    return F.when(F.size(path) > 0, F.concat(F.element_at(path, 1)["h"], tail)).otherwise("")


def plain_text(path: Column) -> Column:
    """``h r t; h2 r2 t2``."""
    return F.array_join(F.transform(path, lambda s: F.concat_ws(" ", s["h"], s["r"], s["t"])), "; ")


def dashed_text(path: Column) -> Column:
    """``h --[r]--> t --[r2]--> t2``; empty for an empty path."""
    tail = F.array_join(F.transform(path, lambda s: F.concat(F.lit(" --["), s["r"], F.lit("]--> "), s["t"])), "")
    return F.when(F.size(path) > 0, F.concat(F.element_at(path, 1)["h"], tail)).otherwise("")


def parse_steps(text: Column) -> Column:
    """The steps of ``h-[r]->t ; ...``; parts that are no step are skipped; null and empty give none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), STEP_SEPARATOR), lambda p: p.rlike(STEP))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, STEP, 1).alias("h"), F.regexp_extract(p, STEP, 2).alias("r"), F.regexp_extract(p, STEP, 3).alias("t")
        ),
    )


def history_key(path: Column, steps: Column) -> Column:
    """The text of the first ``steps`` steps."""
    return F.when(steps > 0, steps_text(F.slice(path, F.lit(1), F.greatest(steps, F.lit(1))))).otherwise("")


def path_length(text: Column) -> Column:
    """The number of steps in a text of steps; 0 for an empty one."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, STEP_SEPARATOR)))


def relations(path: Column) -> Column:
    return F.transform(path, lambda s: s["r"])


def rule_text(rule: Column) -> Column:
    """``<PATH>r1<SEP>r2</PATH>``."""
    return F.concat(F.lit("<PATH>"), F.array_join(rule, "<SEP>"), F.lit("</PATH>"))
