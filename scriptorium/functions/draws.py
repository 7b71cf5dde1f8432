"""Seeded, partition-independent randomness.

``rand(seed)`` and ``shuffle(col, seed)`` change with the partitioning, so
every draw here is a function of md5(seed | key | item): the same rows get
the same draws on any cluster, and DuckDB reproduces them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(x) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x))


def draw_key(seed, *parts) -> Column:
    """Hex md5 of ``seed|part1|part2...``; sorts uniformly."""
    cols = [_s(seed)]
    for p in parts:
        cols += [F.lit("|"), _s(p).cast("string")]
    return F.md5(F.concat(*cols))


def hex_digit(h: Column, i: int) -> Column:
    """Value 0..15 of the i-th (1-based) hex digit."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(h, i, 1)) - 1


def hex4(h: Column) -> Column:
    """Value 0..65535 of the first four hex digits (digit arithmetic, so SQL engines agree)."""
    return hex_digit(h, 1) * 4096 + hex_digit(h, 2) * 256 + hex_digit(h, 3) * 16 + hex_digit(h, 4)


def uniform_int(seed, key, lo: int, hi: int, salt: str = "k") -> Column:
    """Integer in [lo, hi] from the first four hex digits of the draw key."""
    h = draw_key(seed, salt, key)
    return (F.lit(lo) + hex4(h) % (hi - lo + 1)).cast("int")


def coin(seed, key, salt: str) -> Column:
    """Fair boolean draw."""
    return hex_digit(draw_key(seed, salt, key), 1) % 2 == 1
