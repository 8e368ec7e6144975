"""Reproducible choice instead of unseeded randomness: the order of md5(seed | key)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))


def shuffled(items: Column, seed: str, *keys: Column) -> Column:
    """A list in seeded order."""
    return F.transform(F.sort_array(F.transform(items, lambda x: F.struct(seeded(seed, *keys, x).alias("k"), x.alias("x")))), lambda s: s["x"])
