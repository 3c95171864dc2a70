"""Greedy selection along clashes: a row is taken unless an earlier row that it clashes with is."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.ordered import sorted_groups
from cutlake.functions.staging import settle


def first_free(rows: DataFrame, clashes: DataFrame, taken: DataFrame, keys: list[str], row_id: str = "mid") -> DataFrame:
    """The rows (keys, ``row_id``) a walk in order would take.

    ``clashes`` (keys, a, b) are pairs whose row ``a`` comes before ``b``; rows of ``taken`` are in already and come before
    all others. Rows without an open clash are in, rows that clash with one that is in are out, and so on:
    a round for every link of the longest chain of clashes. Nothing but clashing rows is looked at.
    """
    edges = settle(clashes.select(*keys, "a", "b"))
    later = edges.select(*keys, F.col("b").alias(row_id)).distinct()
    inside = rows.select(*keys, row_id).join(later, [*keys, row_id], "left_anti")
    fresh = taken.select(*keys, row_id).unionByName(inside)
    out = inside
    while not edges.isEmpty():
        gone = settle(edges.join(fresh.withColumnRenamed(row_id, "a"), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias(row_id)).distinct())
        rest = edges.join(gone.withColumnRenamed(row_id, "b"), [*keys, "b"], "left_anti").join(gone.withColumnRenamed(row_id, "a"), [*keys, "a"], "left_anti")
        rest = settle(rest)
        waiting = edges.select(*keys, F.col("b").alias(row_id)).distinct().join(gone, [*keys, row_id], "left_anti")
        fresh = settle(waiting.join(rest.select(*keys, F.col("b").alias(row_id)).distinct(), [*keys, row_id], "left_anti"))
        out = out.unionByName(fresh)
        edges = rest
    return out


def spaced_picks(rows: DataFrame, keys: list[str], place: Column, closed: tuple[Column, Column], order: Column, reach: float, n: int, row_id: str = "mid", given: DataFrame | None = None) -> DataFrame:
    """The first ``n`` rows (keys, ``row_id``) per key that a walk in ``order`` (a struct) takes, where a taken row closes the open span ``closed`` to later ones.

    ``reach`` is the greatest length of such a span. ``given`` (keys, c0, c1) are spans closed from the start, at most
    one per key. Time is cut into bins of a quarter of ``reach``, so a span touches six at most: of the bins in the order of their
    first rows, the walk takes its n rows from the first 6 n + 1, because among these one is always untouched and its first row comes
    before all rows of later bins. Only rows of those bins are sorted, and the walk remembers n spans.
    """
    width = reach / 4
    keyed = rows.select(*keys, row_id, place.alias("__t"), closed[0].alias("__c0"), closed[1].alias("__c1"), order.alias("__o"))
    keyed = keyed.withColumn("__bin", F.floor(F.col("__t") / width))
    heads = keyed.groupBy(*keys, "__bin").agg(F.min("__o").alias("__h"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))
    near = keyed.join(heads.withColumn("__r", first).where(F.col("__r") <= 6 * n + 1).select(*keys, "__bin"), [*keys, "__bin"], "left_semi")
    if given is None:
        near = near.withColumns({"__g0": F.lit(None).cast("double"), "__g1": F.lit(None).cast("double")})
    else:
        near = near.join(given.select(*keys, F.col("c0").alias("__g0"), F.col("c1").alias("__g1")), keys, "left")
    dealt = near.repartition(*keys).sortWithinPartitions(*keys, "__o").drop("__o", "__bin")
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in [*keys, row_id])
    return dealt.mapInPandas(_spaced(keys, row_id, n), schema)


def _spaced(keys: list[str], row_id: str, n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, spans, left = None, [], 0
        for batch in batches:
            kept = []
            for at, (*own, t, c0, c1, g0, g1) in enumerate(batch[[*keys, "__t", "__c0", "__c1", "__g0", "__g1"]].itertuples(index=False)):
                if own != key:
                    key, left = own, n
                    spans = [] if pd.isna(g0) else [(g0, g1)]
                if left and not any(a < t < b for a, b in spans):
                    spans.append((c0, c1))
                    left -= 1
                    kept.append(at)
            yield batch.iloc[kept][[*keys, row_id]]

    return run


#: Rounds of settling what is first on both sides before the rest is walked.
ROUNDS = 3


def best_partners(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, a, b): every ``a`` in order takes the free ``b`` of its edges with the largest ``value``, ties the smallest b.

    ``edges``: keys, a, b, value, each pair once. A pair is settled when b is the best that is left for a and no earlier a
    has an edge to b: whoever comes before cannot want it any more. After a few rounds most pairs are settled side by side; what still
    waits for each other goes through one walk along the edges per key, which remembers the taken b only.
    """
    edges = settle(edges.select(*keys, "a", "b", "value"))
    out = None
    for _ in range(ROUNDS):
        best = edges.groupBy(*keys, "a").agg(F.min(F.struct((-F.col("value")).alias("v"), "b")).alias("best")).select(*keys, "a", F.col("best.b").alias("b"))
        first = edges.groupBy(*keys, "b").agg(F.min("a").alias("a"))
        now = settle(best.join(first, [*keys, "a", "b"]))
        out = now if out is None else out.unionByName(now)
        left = edges.join(now.select(*keys, "a"), [*keys, "a"], "left_anti").join(now.select(*keys, "b"), [*keys, "b"], "left_anti")
        edges = settle(left)
        if edges.isEmpty():
            return out
    kind = dict(edges.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, taken = None, None, set()
        for batch in batches:
            kept = []
            for at, (*own, a, b) in enumerate(batch[[*keys, "a", "b"]].itertuples(index=False)):
                if own != key:
                    key, last, taken = own, None, set()
                if a != last and b not in taken:
                    last = a
                    taken.add(b)
                    kept.append(at)
            yield batch.iloc[kept][[*keys, "a", "b"]]

    rest = edges.withColumn("__v", -F.col("value")).repartition(*keys).sortWithinPartitions(*keys, "a", "__v", "b")
    rest = rest.select(*keys, "a", "b").mapInPandas(run, ", ".join(f"`{c}` {kind[c]}" for c in [*keys, "a", "b"]))
    return out.unionByName(rest)


#: Gaps of time that one task walks in :func:`spaced_in_time`.
STRIDE = 64


def spaced_in_time(rows: DataFrame, keys: list[str], time: str, row_id: str, gap: float) -> DataFrame:
    """Rows (keys, ``time``, ``row_id``) in order of time, each at least ``gap`` after the one taken before; the first is always taken.

    Time is cut into blocks of ``STRIDE`` gaps. Whatever was taken before a block, the walk enters it in its first
    gap; for every row where it may enter, the block's table says which row is taken last. The time taken last goes from block to
    block through these tables, and then all blocks are walked side by side.
    """
    block = [*keys, "__block"]
    kind = dict(rows.dtypes)
    placed = rows.select(*keys, time, row_id, F.floor(F.col(time) / (gap * STRIDE)).alias("__block"))
    dealt = placed.repartition(*block).sortWithinPartitions(*block, time, row_id)
    named = ", ".join([*[f"`{k}` {kind[k]}" for k in keys], "__block bigint"])
    tables = dealt.mapInPandas(_exits(block, time, gap), f"{named}, enter array<double>, leave array<double>")
    tables = tables.repartition(*keys).sortWithinPartitions(*block)
    before = tables.mapInPandas(_passed(keys, gap), f"{named}, __last double")
    walked = placed.join(before, block).repartition(*block).sortWithinPartitions(*block, time, row_id)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [*keys, time, row_id])
    return walked.mapInPandas(_spaced_block(block, [*keys, time, row_id], time, gap), schema)


def next_at(times: np.ndarray, last: float, gap: float) -> int:
    """Place of the first of the sorted ``times`` with time - last >= gap, as the subtraction rounds."""
    at = bisect.bisect_left(times, last + gap)
    while at < len(times) and times[at] - last < gap:
        at += 1
    while at > 0 and times[at - 1] - last >= gap:
        at -= 1
    return at


def _exits(block: list[str], time: str, gap: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in sorted_groups(batches, block):
            times, enter, leave = rows[time].to_numpy(np.float64), [], []
            for a, b in zip(begins, np.r_[begins[1:], len(rows)]):
                t = times[a:b]
                last = t.copy()
                for at in range(len(t) - 1, -1, -1):
                    then = next_at(t, t[at], gap)
                    if then < len(t):
                        last[at] = last[then]
                doors = min(len(t), int(np.searchsorted(t, t[0] + 2 * gap)) + 1)
                # A walk enters at the first row that is far enough from the last: rows at one time are one door.
                enter.append(t[:doors])
                leave.append(last[:doors])
            yield rows[block].iloc[begins].assign(enter=enter, leave=leave)

    return run


def _passed(keys: list[str], gap: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            out = []
            for *own, enter, leave in batch[[*keys, "enter", "leave"]].itertuples(index=False):
                if own != key:
                    key, last = own, None
                out.append(last)
                at = 0 if last is None else next_at(enter, last, gap)
                if at < len(enter):
                    last = float(leave[at])
            yield batch[[*keys, "__block"]].assign(__last=np.array(out, np.float64))

    return run


def _spaced_block(block: list[str], columns: list[str], time: str, gap: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in sorted_groups(batches, block):
            times, lasts, kept = rows[time].to_numpy(np.float64), rows["__last"].to_numpy(np.float64), []
            for a, b in zip(begins, np.r_[begins[1:], len(rows)]):
                t, last = times[a:b], lasts[a]
                at = 0 if np.isnan(last) else next_at(t, last, gap)
                while at < len(t):
                    kept.append(a + at)
                    at = next_at(t, t[at], gap)
            yield rows.iloc[kept][columns]

    return run
