"""Mixing takes of several sources to target weights, by thresholds on a hash of each take.

A take's place in its source is a hash of its id and text. Words are summed by (source, leading bits of the hash); in
that histogram the bucket in which a source's budget runs out is found, only that bucket is counted again by the next
bits, and so on until a bucket holds one hash value. Everything below the threshold is in the mix: a filter, no sort.
Smaller budgets have smaller thresholds, so their mixes are nested in the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.staging import settle
from cutlake.llm.common import attach, n_words, others

#: Bits of a take's hash, and bits told apart by one histogram.
HASH_BITS, LEVEL_BITS = 60, 10
LEVELS = HASH_BITS // LEVEL_BITS


def place(take_id: str | Column = "take_id", text: str | Column = "text") -> Column:
    """The take's hash, 60 bits: the first 15 hexadecimal digits of an MD5 (null id or text: as empty)."""
    seed = F.concat(F.coalesce(F.col(take_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(seed), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, most: int = 3) -> DataFrame:
    """``source_name``, ``source_size``, ``target`` (double): each source's share of ``budget`` times all words.

    ``sizes``: source_name, size. ``weights``: source_name, weight (sources without a row weigh nothing); without it
    sources weigh 1, 2, 3, repeating, by code point order of their names, null last. A target stops at ``most`` times
    its source's size and the excess goes to the others by weight until none is above. One row per source is ordered
    in one task; the takes themselves never are.
    """
    sources = sizes.groupBy("source_name").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if weights is None:
        nth = F.row_number().over(Window.orderBy(F.col("source_name").asc_nulls_last()))
        sources = sources.withColumn("weight", ((nth - 1) % 3 + 1).cast("double"))
    else:
        given = weights.select(F.col("source_name").alias("__n"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(given, F.col("source_name").eqNullSafe(F.col("__n")), "left").drop("__n").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    # In order of the level at which a source is full, the full ones are a prefix.
    full = F.col("source_size") * most
    ordered = Window.orderBy(F.when(F.col("weight") > 0, full / F.col("weight")).otherwise(F.lit(float("inf"))), F.col("source_name").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    words = F.floor(F.sum("source_size").over(everything) * F.lit(budget)) if budget != 1.0 else F.sum("source_size").over(everything)
    left = words - F.coalesce(F.sum(full).over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    sources = sources.withColumn("__level", F.when(open_weight > 0, left / open_weight)).withColumn("__full", F.col("weight") * F.col("__level") >= full)
    level = F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything)  # of the first that is not full
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("__full"), full.cast("double")).otherwise(F.col("weight") * level)
    return sources.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source_name", "source_size", "target")


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the words each take gives wholly (``rounds`` times) and the last hash that gives once more (``last``, -1: none)."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    need = targets.withColumn("rounds", rounds).withColumn("need", F.col("target") - F.col("rounds") * F.col("source_size"))
    need = settle(need)
    by = Window.partitionBy("source_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    open_ = need.where(F.col("need") > 0).select("source_name", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below"), "need")
    rows, done = sized.where(F.col("size") > 0).withColumn("prefix", F.lit(0).cast("bigint")), None
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        rows = rows.withColumn("bucket", F.shiftright("hash", shift))
        counted = rows.groupBy("source_name", "prefix", "bucket").agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # Joined by (source, prefix): after the first level only the boundary bucket of each source is left.
        here = open_.select(F.col("source_name").alias("__n"), F.col("prefix").alias("__p"), "below", "need")
        counted = counted.join(here, F.col("source_name").eqNullSafe(F.col("__n")) & (F.col("prefix") == F.col("__p")))
        counted = counted.withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(by), F.lit(0)))
        edge = settle(counted.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need"))))
        single = F.col("low") == F.col("high")
        # The last hash value is in if that brings the words nearer to the need.
        nearer = F.col("before") + F.col("words") - F.col("need") < F.col("need") - F.col("before")
        settled = edge.where(single).select("source_name", F.when(nearer, F.col("low")).otherwise(F.col("low") - 1).alias("last"))
        done = settled if done is None else done.unionByName(settled)
        open_ = edge.where(~single).select("source_name", F.col("bucket").alias("prefix"), F.col("before").alias("below"), "need")
        if open_.isEmpty():
            break
        inside = open_.select(F.col("source_name").alias("__n"), F.col("prefix").alias("__b"))
        rows = rows.join(inside, F.col("source_name").eqNullSafe(F.col("__n")) & (F.col("bucket") == F.col("__b")), "left_semi").drop("prefix").withColumnRenamed("bucket", "prefix")
    done = done.select(F.col("source_name").alias("__n"), "last")
    out = need.join(done, F.col("source_name").eqNullSafe(F.col("__n")), "left").drop("__n", "need")
    return settle(out.withColumn("last", F.coalesce("last", F.lit(-1))))


def mix_takes(takes: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, most: int = 3) -> DataFrame:
    """Every take with ``size`` (words), ``source_size``, ``target`` (words wanted of its source) and ``taken``.

    ``takes``: take_id, source_name, text, and any further columns, which pass through (unless named like a result).
    ``taken`` is 0 to ``most`` times the size: whole rounds of the source plus one for takes up to the threshold, which
    is put where the source's words come nearest to its target. Equal hashes (rows that repeat id and text) go
    together. The result depends on the rows alone, so reruns agree. Null and empty texts have size 0. No takes: no rows.
    """
    made = ["size", "source_size", "target", "taken"]
    rest = others(takes, ["take_id", "source_name", "text"], made)
    rows = takes.select("take_id", "source_name", "text", *rest, n_words("text").alias("size"), place().alias("__hash"))
    sized = settle(rows.select("source_name", "size", F.col("__hash").alias("hash")))
    cuts = _thresholds(sized, source_targets(sized, weights, budget, most)).withColumnsRenamed({"rounds": "__rounds", "last": "__last"})
    out = attach(rows, cuts, ["source_name"], F.col("__hash"))
    taken = F.col("size") * (F.col("__rounds") + (F.col("__hash") <= F.col("__last")).cast("bigint"))
    return out.withColumn("taken", taken).drop("__rounds", "__last", "__hash")


def repeated_takes(takes: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, most: int = 3) -> DataFrame:
    """The mix itself: every take's row as often as the mix takes it; takes without words are not in it."""
    mixed = mix_takes(takes, weights, budget, most).where((F.col("size") > 0) & (F.col("taken") > 0))
    times = (F.col("taken") / F.col("size")).cast("int")
    return mixed.withColumn("__r", F.explode(F.sequence(F.lit(1), times))).drop("__r", "size", "source_size", "target", "taken")
