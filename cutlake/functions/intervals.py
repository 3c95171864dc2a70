"""Interval joins and unions, split into bins so that a hot key is spread over its time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.columns import col
from cutlake.functions.staging import settle


def _bins(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / F.lit(width)), F.floor(hi / F.lit(width)))


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str | Column, str | Column],
    right_span: tuple[str | Column, str | Column],
    width: float,
) -> DataFrame:
    """Pairs of rows with equal keys whose closed spans touch; callers narrow the condition with ``where``.

    Both sides are put into the bins they cover and meet on (keys, bin). A pair sharing several bins is
    kept in the first one only, so the width never changes the result. Column names of the two sides must
    differ apart from the keys; NULL spans drop out.
    """
    a0, a1 = (col(c) for c in left_span)
    b0, b1 = (col(c) for c in right_span)
    w = F.lit(width)
    lhs = left.withColumn("__left_bin", F.floor(a0 / w)).withColumn("__bin", F.explode(_bins(a0, a1, width)))
    rhs = right.withColumn("__right_bin", F.floor(b0 / w)).withColumn("__bin", F.explode(_bins(b0, b1, width)))
    first_shared = F.col("__bin") == F.greatest("__left_bin", "__right_bin")
    return lhs.join(rhs, [*keys, "__bin"]).where(first_shared & (a0 <= b1) & (b0 <= a1)).drop("__bin", "__left_bin", "__right_bin")


def union_intervals(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    width: float = 600.0,
    eps: float = 1e-6,
    first: dict[str, tuple[list, Column]] | None = None,
) -> DataFrame:
    """Merge overlapping or touching spans per key; spans not longer than ``eps`` drop out.

    Spans are cut at bin borders, merged inside each bin, and only the outermost pieces of a bin are merged
    again across borders. ``first`` adds columns holding the first non-null value by an order.
    """
    first = first or {}
    w = F.lit(width)
    spans = df.where(F.col(end) - F.col(start) > eps)
    pieces = spans.withColumn("__bin", F.explode(_bins(F.col(start), F.col(end), width)))
    s = F.greatest(F.col(start), F.col("__bin") * w)
    e = F.least(F.col(end), (F.col("__bin") + 1) * w)
    extra = [
        F.when(v.isNotNull(), F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)], v.alias("v"))).alias(f"__f_{n}")
        for n, (order, v) in first.items()
    ]
    # Spelled out, because rows that come from a join on the keys alone would count as clustered already.
    pieces = pieces.select(*keys, "__bin", s.alias("__s"), e.alias("__e"), *extra).repartition(*keys, "__bin")
    local = Window.partitionBy(*keys, "__bin").orderBy("__s", "__e")
    reach = F.max("__e").over(local.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("__s") > reach + eps)).cast("int")
    firsts = [F.min(f"__f_{n}").alias(f"__f_{n}") for n in first]
    # Written once: inner and outer runs are read apart, and their sorts then follow those of the bins instead of sharing their tasks.
    runs = settle(
        pieces.withColumn("__opens", opens)
        .withColumn("__run", F.sum("__opens").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__bin", "__run")
        .agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"), *firsts)
        .withColumn("__runs", F.max("__run").over(Window.partitionBy(*keys, "__bin")))
    )
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__runs"))
    out = [F.col("__s").alias(start), F.col("__e").alias(end)]
    done = [F.col(f"__f_{n}")["v"].alias(n) for n in first]
    across = Window.partitionBy(*keys).orderBy("__bin", "__run")
    back = F.lag("__e").over(across)
    outer = (
        runs.where(edge)
        .withColumn("__opens", (back.isNull() | (F.col("__s") > back + eps)).cast("int"))
        .withColumn("__group", F.sum("__opens").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__group")
        .agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"), *firsts)
    )
    return (
        runs.where(~edge).select(*keys, *out, *done)
        .unionByName(outer.select(*keys, *out, *done))
        .where(F.col(end) - F.col(start) > eps)
    )
