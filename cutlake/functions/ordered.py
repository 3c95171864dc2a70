"""Ordered computation per key when one key may hold a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task. Everything here works on
(key, chunk) instead, where the chunk is a coarse, monotone function of the order column (minutes of a
timeline, a block of slot numbers). A hot key is spread over its chunks; what has to cross a chunk border
travels through a small table with one row per (key, chunk), built with map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.columns import col
from cutlake.functions.staging import settle

CHUNK = "__chunk"


@dataclass(frozen=True)
class Running:
    """One running value of :func:`scan`."""

    kind: str
    value: Column


def running_sum(value: str | Column) -> Running:
    """Sum up to and including the row."""
    return Running("sum", col(value))


def row_index() -> Running:
    """1-based position of the row within its key."""
    return Running("sum", F.lit(1).cast("bigint"))


def total(value: str | Column) -> Running:
    """Sum over the whole key, on every row."""
    return Running("total", col(value))


def max_before(value: str | Column) -> Running:
    """Largest value over the rows before this one, NULL on the first."""
    return Running("max_before", col(value))


def previous(value: str | Column) -> Running:
    """Value of the row just before, NULL on the first row."""
    return Running("previous", F.struct(col(value).alias("v")))


def following(value: str | Column) -> Running:
    """Value of the row just after, NULL on the last row."""
    return Running("following", F.struct(col(value).alias("v")))


def carry_forward(value: str | Column) -> Running:
    """Latest non-null value up to and including the row."""
    return Running("carry", col(value))


def carry_backward(value: str | Column) -> Running:
    """Nearest non-null value after the row."""
    return Running("carry_back", col(value))


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column, **running: Running) -> DataFrame:
    """Add running values per key, in ``order`` (ascending, total within a key).

    ``chunk`` must not decrease along ``order``. Rows are shuffled once, on (keys, chunk); the carry table is
    as long as the number of chunks.
    """
    base = df.withColumn(CHUNK, chunk)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    # What follows a row is what precedes it in the reverse order: a frame that shrinks is built anew for every row.
    after = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    per_key = Window.partitionBy(*keys).orderBy(CHUNK)
    chunks_before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    chunks_after = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    local_cols, summary, carry, result = {}, [], [], {}
    for name, run in running.items():
        mine, theirs = f"__l_{name}", f"__c_{name}"
        here, there = F.col(mine), F.col(theirs)
        if run.kind == "sum":
            local_cols[mine] = F.sum(run.value).over(upto)
            summary.append(F.sum(run.value).alias(theirs))
            carry.append(F.sum(theirs).over(chunks_before).alias(theirs))
            result[name] = F.coalesce(there, F.lit(0)) + here
        elif run.kind == "total":
            summary.append(F.sum(run.value).alias(theirs))
            carry.append(F.sum(theirs).over(Window.partitionBy(*keys)).alias(theirs))
            result[name] = there
        elif run.kind == "max_before":
            local_cols[mine] = F.max(run.value).over(before)
            summary.append(F.max(run.value).alias(theirs))
            carry.append(F.max(theirs).over(chunks_before).alias(theirs))
            result[name] = F.greatest(here, there)
        elif run.kind == "previous":
            local_cols[mine] = F.lag(run.value).over(local)
            summary.append(F.max_by(run.value, position).alias(theirs))
            carry.append(F.lag(theirs).over(per_key).alias(theirs))
            result[name] = F.coalesce(here, there)["v"]
        elif run.kind == "following":
            local_cols[mine] = F.lead(run.value).over(local)
            summary.append(F.min_by(run.value, position).alias(theirs))
            carry.append(F.lead(theirs).over(per_key).alias(theirs))
            result[name] = F.coalesce(here, there)["v"]
        elif run.kind == "carry":
            local_cols[mine] = F.last(run.value, ignorenulls=True).over(upto)
            summary.append(F.max_by(run.value, F.when(run.value.isNotNull(), position)).alias(theirs))
            carry.append(F.last(theirs, ignorenulls=True).over(chunks_before).alias(theirs))
            result[name] = F.coalesce(here, there)
        elif run.kind == "carry_back":
            local_cols[mine] = F.last(run.value, ignorenulls=True).over(after)
            summary.append(F.min_by(run.value, F.when(run.value.isNotNull(), position)).alias(theirs))
            carry.append(F.last(theirs, ignorenulls=True).over(chunks_after).alias(theirs))
            result[name] = F.coalesce(here, there)
        else:
            raise ValueError(f"unknown running value {run.kind!r}")

    carried = base.groupBy(*keys, CHUNK).agg(*summary).select(*keys, CHUNK, *carry)
    kept = [c for c in df.columns if c not in result]
    # Spelled out, because rows that come from a join on the keys alone would count as clustered already and
    # leave a hot key in one task.
    spread = base.repartition(*keys, CHUNK) if local_cols else base
    return (
        spread.withColumns(local_cols)
        .join(carried, [*keys, CHUNK])
        .select(*kept, *[c.alias(n) for n, c in result.items()])
    )


def islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    breaks: Callable[[Column, Column], Column],
    state: list[str],
    **aggs: tuple[str, Column],
) -> DataFrame:
    """Merge runs of neighbouring rows; ``breaks(previous, current)`` says where a new run starts.

    ``previous`` and ``current`` are structs of the ``state`` columns of two adjacent rows. ``aggs`` maps an
    output column to (kind, expression) with kind sum, min, max, first or last. Runs are built inside each
    chunk first; only the first and last run of a chunk can continue elsewhere, so only those are looked at
    a second time.
    """
    st = F.struct(*state)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    base = df.withColumn(CHUNK, chunk).repartition(*keys, CHUNK).withColumn("__prev", F.lag(st).over(local))
    opens = F.col("__prev").isNull() | breaks(F.col("__prev"), st)
    numbered = base.withColumn("__run", F.sum(opens.cast("int")).over(local))
    pos = [F.col(c) for c in order]

    def build(kind: str, expr: Column) -> Column:
        if kind in ("first", "last"):
            pair = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(pos)], expr.alias("v"))
            return F.min(pair) if kind == "first" else F.max(pair)
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](expr)

    head = F.min(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(pos)], st.alias("v")))
    tail = F.max(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(pos)], st.alias("v")))
    runs = numbered.groupBy(*keys, CHUNK, "__run").agg(
        head.alias("__head"), tail.alias("__tail"), *[build(k, e).alias(n) for n, (k, e) in aggs.items()]
    )
    runs = runs.withColumn("__runs", F.max("__run").over(Window.partitionBy(*keys, CHUNK)))
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__runs"))
    names = list(aggs)

    def finish(name: str, kind: str) -> Column:
        return (F.col(name)["v"] if kind in ("first", "last") else F.col(name)).alias(name)

    # The edge runs of a key meet in one place, two of a chunk at most; inner runs stay with their chunk and are whole.
    placed = runs.withColumn("__edge", edge).withColumn("__part", F.when(~edge, F.col(CHUNK)))
    across = Window.partitionBy(*keys, "__part").orderBy(CHUNK, "__run")
    joined = placed.withColumn("__last", F.lag(F.struct("__tail", CHUNK)).over(across))
    fresh = (
        ~F.col("__edge")
        | F.col("__last").isNull()
        | (F.col(f"__last.{CHUNK}") == F.col(CHUNK))
        | breaks(F.col("__last.__tail.v"), F.col("__head.v"))
    )
    joined = joined.withColumn("__group", F.sum(fresh.cast("int")).over(across))
    merge = {"sum": F.sum, "min": F.min, "max": F.max, "first": F.min, "last": F.max}
    out = joined.groupBy(*keys, "__part", "__group").agg(*[merge[k](n).alias(n) for n, (k, _) in aggs.items()])
    return out.select(*keys, *[finish(n, k) for n, (k, _) in aggs.items()]).select(*keys, *names)


def halo(df: DataFrame, position: str | Column, width: float, before: float, after: float) -> DataFrame:
    """Copy each row into every chunk whose frame windows may need it.

    Adds ``__chunk`` and ``__core`` (true in the chunk the row belongs to). A frame reaching ``before`` back
    and ``after`` ahead of a row is complete inside (key, ``__chunk``) for the core rows.
    """
    p = col(position)
    own = F.floor(p / F.lit(width))
    lo, hi = F.floor((p - F.lit(after)) / F.lit(width)), F.floor((p + F.lit(before)) / F.lit(width))
    return (
        df.withColumn("__own", own)
        .withColumn(CHUNK, F.explode(F.sequence(lo, hi)))
        .withColumn("__core", F.col(CHUNK) == F.col("__own"))
        .drop("__own")
    )


def attach(df: DataFrame, stats: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Join one row per key to a large table whose keys may be hot.

    The stats ride on the (key, chunk) table, so the join key of the large side is (key, chunk) and later
    windows on it need no further shuffle. Spark broadcasts the small side itself when its measured size
    allows.
    """
    base = df.withColumn(CHUNK, chunk)
    per_chunk = base.select(*keys, CHUNK).distinct().join(stats, keys)
    return base.join(per_chunk, [*keys, CHUNK]).drop(CHUNK)


#: Up to so many rows a table is broadcast; copies of each row beyond that.
SMALL_ROWS, COPIES = 200_000, 64


def meet(rows: DataFrame, table: DataFrame, on: list[str], spread: str | Column) -> DataFrame:
    """Inner join of many rows with a table of one row per key, where many rows may have the same key.

    The table is counted: a small one is broadcast and the rows stay where they are. A larger one is copied, and rows are
    dealt to the copies by ``spread``, so that no key lands in one task.
    """
    if table.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(table), on)
    copies = table.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("__copy", F.pmod(F.xxhash64(col(spread)), F.lit(COPIES)).cast("int")).join(copies, [*on, "__copy"]).drop("__copy")


#: Cells for values from one power of two to the next.
CELLS = 1024


def cell_of(value: str | Column) -> Column:
    """A number that never falls as the value grows: cells are as wide as a share of the value, so neither another
    value of the key nor a far outlier changes one, and nothing about a key has to be known beforehand."""
    v = col(value).cast("double")
    size = F.floor((F.log2(F.abs(v)) + 1100) * CELLS)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("bigint")


def pick_ranks(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], dict[str, Column]], size: str | None = None) -> DataFrame:
    """Exact order statistics: the values at given 0-based ranks of each key's sorted list.

    ``ranks(n)`` returns name → rank expressions; ``size`` names a column for n itself. Values are counted per (key, value)
    first; the counts of cells (:func:`cell_of`) say in which one every rank lies, and only those cells are sorted. However
    the values are spread, no task holds a whole key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c")).withColumn("__cell", cell_of(value))
    cells = counts.groupBy(*keys, "__cell").agg(F.sum("__c").alias("__w"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({"__n": F.sum("__w").over(whole), "__end": F.sum("__w").over(upto)})
    wanted = ranks(F.col("__n"))
    base = F.col("__end") - F.col("__w")
    inside = [(r.cast("bigint") >= base) & (r.cast("bigint") < F.col("__end")) for r in wanted.values()]
    hits = cells.withColumns({f"__r_{n}": F.when(here, r.cast("bigint") - base) for here, (n, r) in zip(inside, wanted.items())})
    asked = [f"__r_{n}" for n in wanted]
    hits = hits.where(F.coalesce(*asked).isNotNull()).select(*keys, "__cell", "__n", *asked)
    order = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counts.join(hits, [*keys, "__cell"]).withColumn("__upto", F.sum("__c").over(order))
    here = lambda n: (F.col(f"__r_{n}") < F.col("__upto")) & (F.col(f"__r_{n}") >= F.col("__upto") - F.col("__c"))
    more = [F.max("__n").alias(size)] if size else []
    return found.groupBy(*keys).agg(*[F.max(F.when(here(n), F.col(value))).alias(n) for n in wanted], *more)


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Rank of the nearest-rank percentile: round(q·(n−1)), half to even."""
    return lambda n: F.least(n - 1, F.bround(F.lit(q) * (n - 1)).cast("bigint"))


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Interpolated median per key."""
    out = pick_ranks(df, keys, value, lambda n: {"__a": F.floor((n - 1) / 2), "__b": F.floor(n / 2)})
    return out.select(*keys, ((F.col("__a") + F.col("__b")) / 2).cast("double").alias(name))


def linear_percentiles(df: DataFrame, keys: list[str], value: str, **quantiles: float) -> DataFrame:
    """Linearly interpolated percentiles per key."""

    def ranks(n: Column) -> dict[str, Column]:
        out = {}
        for name, q in quantiles.items():
            out[f"__f_{name}"] = F.floor(F.lit(q) * (n - 1))
            out[f"__c_{name}"] = F.ceil(F.lit(q) * (n - 1))
        return out

    both = pick_ranks(df, keys, value, ranks, "__size")
    cols = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("__size") - 1)
        low, high = F.col(f"__f_{name}"), F.col(f"__c_{name}")
        cols.append((low + (high - low) * (at - F.floor(at))).cast("double").alias(name))
    return both.select(*keys, *cols)


def mid_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Average rank of ties scaled to 0..1; a key with a single row gets 0.5.

    The ranking runs over the distinct values of a key, cell by cell; the result joins back on (key, value).
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    ranked = scan(counts, keys, [value], cell_of(value), __upto=running_sum("__c"), __n=total("__c"))
    scaled = (F.col("__upto") - F.col("__c") + F.col("__upto") - 1) / 2 / (F.col("__n") - 1)
    table = ranked.select(*keys, value, F.when(F.col("__n") > 1, scaled).otherwise(0.5).alias(name))
    return df.join(table, [*keys, value])


def global_ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Position of every row in one order of the whole table, from 1: sorted ranges are numbered by themselves, and the
    sizes of the ranges before are added. Rows with equal order columns may change places between runs."""
    ranged = settle(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__rows")).withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(sizes, "__range").withColumn(name, F.col("__before") + inside).drop("__range", "__rows", "__before")


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole groups of equal ``keys`` of a partition that is sorted by them, with the place where each group begins.

    A frame holds all groups that end in one batch, so many small groups cost no frame each; a group may run over several batches.
    """
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        changes = _changes(batch, keys)
        if rest and tuple(rest[-1][keys].iloc[-1]) != tuple(batch[keys].iloc[0]):
            changes[0] = True
        cuts = np.flatnonzero(changes)
        if not len(cuts):
            rest.append(batch)
            continue
        if rest or cuts[-1]:
            whole = pd.concat([*rest, batch.iloc[: cuts[-1]]], ignore_index=True)
            yield whole, np.r_[0, np.flatnonzero(_changes(whole, keys))]
        rest = [batch.iloc[cuts[-1] :]]
    if rest:
        yield pd.concat(rest, ignore_index=True), np.zeros(1, np.int64)


def _changes(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k in keys:
        values = rows[k].to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out
