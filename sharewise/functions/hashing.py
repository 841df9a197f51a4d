"""Hash-keyed randomness: the same row gets the same draw on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int | str | Column, keys: tuple[str | Column, ...]) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", seed.cast("string"), *[p.cast("string") for p in parts]))


def hash32(seed: int | str | Column, *keys: str | Column) -> Column:
    """An integer in [0, 2^32): the first 8 hex digits of md5(seed|key|...)."""
    return F.conv(F.substring(_digest(seed, keys), 1, 8), 16, 10).cast("long")


def unit_hash(seed: int | str | Column, *keys: str | Column) -> Column:
    """A double in [0, 1) with 52 random bits: the first 13 hex digits of md5(seed|key|...)."""
    bits = F.conv(F.substring(_digest(seed, keys), 1, 13), 16, 10).cast("long")
    return bits / F.lit(float(2**52))
