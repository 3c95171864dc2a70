"""Small column expressions used across the operator families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ramp(value: Column, zero: float, one: float) -> Column:
    """0 at ``zero``, 1 at ``one``, linear between and flat outside."""
    return clamp((value - F.lit(zero)) / F.lit(one - zero), 0.0, 1.0)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def first_by(order: list, value: str | Column) -> Column:
    """Aggregate: the value of the row that comes first in ``order`` (all ascending)."""
    return F.min_by(col(value), F.struct(*[col(c) for c in order]))


def last_by(order: list, value: str | Column) -> Column:
    return F.max_by(col(value), F.struct(*[col(c) for c in order]))


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def hash_distance(a: str | Column, b: str | Column) -> Column:
    """Hamming distance of two 64-bit picture hashes."""
    return F.bit_count(col(a).bitwiseXOR(col(b))).cast("bigint")


def r6(value: str | Column) -> Column:
    """Six decimals, the precision in which results are compared between engines.

    Sums taken in another order may differ in the last bits, on either side of a half; a billionth more puts
    both on the same side.
    """
    return F.round(col(value).cast("double") + 1e-9, 6)
