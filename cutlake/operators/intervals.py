"""Interval algebra on cut plans: overlaps, free windows, unused material, beds, silences, splices."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.columns import basename, overlap
from cutlake.functions.intervals import range_join, union_intervals
from cutlake.functions.ordered import (
    carry_backward, carry_forward, following, global_ranks, islands, max_before, meet, previous, row_index, running_sum, scan,
)
from cutlake.functions.staging import settle

# Tolerances, merge rules, ducking and J/L constants, arc phases.
EPS = 1e-6
MIN_PIECE = 0.4
REPEAT_SHARE = 0.5
CONTINUITY_GAP, MAX_CUT = 3.0, 8.0
CARRIERS, CARRIER_TOLERANCE = ("sub-drop", "impact"), 0.5
DUCK_DB = {"impact": -6.0, "sub-drop": -6.0, "riser": -4.0}
DUCK_ACCENT_MAX, DUCK_FADE, SHELF_FADE, SHELF_DB = 1.5, 0.05, 0.25, -4.0
LIFT_DB, TRUE_PEAK_CEILING, MIX_LEVEL = 3.5, -1.0, 0.6
MIN_GAP = 0.01
JL_SECONDS, JL_TOLERANCE, JL_SOLO, JL_MAX = 0.2, 0.05, 0.4, 4
PHASE_ENERGY = {"opening": 0.35, "build": 0.65, "climax": 1.0, "outro": 0.3, "hook": 1.0, "punch": 0.85, "loop": 0.5}
BASE_SCORE, SCREEN_BONUS = 0.75, 0.2
STANDARD_ARC = [(0.15, "opening"), (0.35, "build"), (0.35, "climax"), (0.15, "outro")]
STYLE_ARCS = {
    "travel": STANDARD_ARC, "wedding": STANDARD_ARC, "music_video": STANDARD_ARC,
    "trailer": [(0.2, "opening"), (0.25, "build"), (0.25, "build"), (0.2, "climax"), (0.1, "outro")],
    "short": [(0.08, "hook"), (0.72, "punch"), (0.2, "loop")],
}
ARC_FLOOR, DROP_MARGIN = 0.05, 0.05
BIN = 16.0
SLOTS = 4096


def by_slot() -> Column:
    return F.floor(F.col("slot") / SLOTS)


def unique_material(moments: DataFrame, key: str = "clip_path") -> DataFrame:
    """Seconds of material per clip with overlaps counted once."""
    merged = union_intervals(moments, [key], "start_s", "end_s")
    return merged.groupBy(key).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("unique_s"), F.count("*").alias("spans"))


def free_gaps(moments: DataFrame, used: DataFrame, key: str = "clip_path") -> DataFrame:
    """Every stretch of a moment that no used window covers: (moment columns, gap_start, gap_end)."""
    taken = union_intervals(used, [key], "u0", "u1", eps=EPS)
    spans = moments.select(key, "start_s", "end_s").distinct()
    cut = range_join(spans, taken, [key], ("start_s", "end_s"), ("u0", "u1"), BIN).where(
        (F.col("u1") > F.col("start_s") + EPS) & (F.col("u0") < F.col("end_s") - EPS)
    )
    holes = cut.groupBy(key, "start_s", "end_s").agg(F.array_sort(F.collect_list(F.struct("u0", "u1"))).alias("u"))
    every = spans.join(holes, [key, "start_s", "end_s"], "left")
    # A moment is seconds long and the used windows are disjoint, so the array is short.
    edges = F.coalesce("u", F.array().cast("array<struct<u0:double,u1:double>>"))
    starts = F.concat(F.array("start_s"), F.transform(edges, lambda x: x["u1"]))
    ends = F.concat(F.transform(edges, lambda x: x["u0"]), F.array("end_s"))
    gaps = every.select(key, "start_s", "end_s", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("g"))
    gaps = gaps.select(key, "start_s", "end_s", F.col("g.a").alias("gap_start"), F.col("g.b").alias("gap_end"))
    return gaps.where(F.col("gap_end") > F.col("gap_start") + EPS)


def free_window(
    moments: DataFrame, used: DataFrame, needed: float, order: list[str] = ["clip_path", "mid"], key: str = "clip_path",
    group: list[str] = [], min_piece: float = MIN_PIECE,
) -> DataFrame:
    """Per group the first gap of at least ``needed`` seconds in moment order, else the longest one of ``min_piece``."""
    gaps = free_gaps(moments, used, key)
    length = F.col("gap_end") - F.col("gap_start")
    # Moments with the same span share their gaps; the first in order stands for them.
    firsts = moments.groupBy(*group, key, "start_s", "end_s").agg(F.min(F.struct(*order)).alias("__o"))
    rows = firsts.join(gaps, [key, "start_s", "end_s"]).withColumn("__len", length)
    pick = F.struct(F.col("__o").alias("o"), F.col("gap_start"), F.least(F.col("__len"), F.lit(needed)).alias("length"))
    fits, big = F.col("__len") >= needed - EPS, F.col("__len") >= min_piece - EPS
    at = F.struct("__o", "gap_start")
    agg = [
        F.min_by(pick, F.when(fits, at)).alias("__fit"),
        F.min_by(pick, F.when(big, F.struct((-F.round("__len", 6)).alias("l"), F.col("__o").alias("o"), F.col("gap_start").alias("g")))).alias("__big"),
    ]
    out = (rows.groupBy(*group) if group else rows).agg(*agg).withColumn("w", F.coalesce("__fit", "__big"))
    return out.where(F.col("w").isNotNull()).select(*group, "w.o.*", F.col("w.gap_start"), F.col("w.length"))


def trim_pool(moments: DataFrame, key: str = "clip_path", row_id: str = "mid") -> DataFrame:
    """Moments of a clip in time order without shared frames: starts move up, fully covered rows drop out."""
    marked = scan(moments, [key], ["start_s", "end_s", row_id], F.floor(F.col("start_s") / 64), __mark=max_before("end_s"))
    # A row that drops out ends at or before the mark, so the plain running maximum is the high-water mark.
    low = F.greatest(F.col("start_s"), F.col("__mark"))
    return marked.where(F.col("end_s") - low > EPS).withColumn("start_s", low).drop("__mark")


def best_overlap(
    entries: DataFrame, moments: DataFrame, order: list[str] = ["mid"], carried: list[str] = ["mid"],
    key: str = "clip_path", width: float = BIN,
) -> DataFrame:
    """For every entry the moment of its clip it overlaps most (ties: first in ``order``); NULLs when none.

    Entries that draw the same source range and moments with the same span are matched once, so copies never
    multiply.
    """
    ranges = entries.select(key, "source_start", "source_end").distinct()
    spans = moments.groupBy(key, "start_s", "end_s").agg(
        F.min(F.struct(*[F.col(o).alias(f"o_{o}") for o in order], *carried)).alias("__m")
    )
    pairs = range_join(ranges, spans, [key], ("source_start", "source_end"), ("start_s", "end_s"), width)
    shared = overlap(F.col("start_s"), F.col("end_s"), F.col("source_start"), F.col("source_end"))
    pairs = pairs.withColumn("overlap_s", shared).where(F.col("overlap_s") > EPS)
    best = F.struct((-F.round("overlap_s", 6)).alias("d"), F.col("__m"))
    found = pairs.groupBy(key, "source_start", "source_end").agg(F.min(F.struct(best.alias("b"), F.col("overlap_s").alias("v"))).alias("__b"))
    found = found.select(
        key, "source_start", "source_end", *[F.col(f"__b.b.__m.{c}").alias(c) for c in carried], F.col("__b.v").alias("overlap_s")
    )
    return entries.join(found, [key, "source_start", "source_end"], "left")


def on_material(entries: DataFrame, clips: DataFrame, key: str = "clip_path") -> DataFrame:
    """Replace entry paths by the catalogue's: the exact path, else the first clip with the same file name."""
    exact = clips.select(F.col(key).alias("__exact")).distinct()
    by_name = clips.groupBy(basename(key).alias("__name")).agg(F.min(key).alias("__by_name"))
    out = entries.join(exact, F.col(key) == F.col("__exact"), "left").withColumn("__name", basename(key))
    out = out.join(by_name, "__name", "left")
    return out.withColumn(key, F.coalesce("__exact", "__by_name", key)).drop("__exact", "__name", "__by_name")


def used_material(moments: DataFrame, entries: DataFrame, key: str = "clip_path", row_id: str = "mid") -> DataFrame:
    """Moments that overlap any range the entries draw."""
    drawn = entries.where(F.col("source_end") > F.col("source_start") + EPS).select(
        key, F.col("source_start").alias("u0"), F.col("source_end").alias("u1")
    )
    # Disjoint stretches: what counts is whether a moment reaches into any of them by more than a hair.
    spans = moments.select(key, "start_s", "end_s").distinct()
    ranges = drawn.distinct()
    meet = range_join(spans, ranges, [key], ("start_s", "end_s"), ("u0", "u1"), BIN)
    used = meet.where(overlap(F.col("start_s"), F.col("end_s"), F.col("u0"), F.col("u1")) > EPS).select(key, "start_s", "end_s").distinct()
    return moments.join(used, [key, "start_s", "end_s"], "left_semi")


def _pool_order() -> list[Column]:
    return [F.desc("score"), F.desc("hero"), F.asc("clip_path"), F.asc("start_s"), F.asc("mid")]


def bench(plans: DataFrame, entries: DataFrame, moments: DataFrame, k: int = 20, plan: str = "plan_id") -> DataFrame:
    """The ``k`` strongest moments no entry of a plan draws from, for every plan.

    The order of the pool is the same for all plans: the ranks a plan uses are sorted, the first ``k`` ranks between
    them are free. Ranks are looked at from the first on: 2 ``k`` of them, then eight times as many for the plans that have
    fewer than ``k`` free ones among these, to the end of the pool if need be. No row is written for a used moment beyond.
    """
    span = ["clip_path", "source_start", "source_end"]
    ranked = settle(global_ranks(moments, _pool_order(), "pool_rank"))
    size, upto, todo, parts = ranked.count(), 2 * k, plans.select(plan), []
    while True:
        upto = min(upto, size)
        first = ranked.where(F.col("pool_rank") <= upto).select("clip_path", "start_s", "end_s", "pool_rank")
        mine = entries.join(todo, plan, "left_semi").select(plan, *span)
        hits = range_join(mine.select(*span).distinct(), first, ["clip_path"], ("source_start", "source_end"), ("start_s", "end_s"), BIN)
        hits = hits.where(overlap(F.col("start_s"), F.col("end_s"), F.col("source_start"), F.col("source_end")) > EPS)
        used = settle(mine.join(hits.select(*span, "pool_rank"), span).select(plan, "pool_rank").distinct())
        last = F.lit(upto + 1).cast("bigint").alias("pool_rank")
        short = None if upto == size else settle(used.groupBy(plan).agg(F.count("*").alias("__n")).where(F.lit(upto) - F.col("__n") < k).select(plan))
        if short is None or short.isEmpty():
            parts += [used, todo.select(plan, last)]
            break
        parts += [used.join(short, plan, "left_anti"), todo.join(short, plan, "left_anti").select(plan, last)]
        todo, upto = short, 8 * upto
    stops = reduce(DataFrame.unionByName, parts)
    stops = scan(stops, [plan], ["pool_rank"], F.floor(F.col("pool_rank") / 4096), __i=row_index(), __back=previous("pool_rank"))
    start = F.coalesce("__back", F.lit(0)) + 1
    before = start - F.col("__i")  # free ranks before this gap
    want = F.least(F.col("pool_rank") - 1, start + (k - before) - 1)
    gaps = stops.where((F.col("pool_rank") > start) & (before < k)).select(
        plan, (before - start + 1).alias("__shift"), F.explode(F.sequence(start, want)).alias("pool_rank")
    )
    pool = settle(ranked.where(F.col("pool_rank") <= upto))
    return meet(gaps.withColumn("rank", F.col("pool_rank") + F.col("__shift")), pool, ["pool_rank"], plan).select(plan, "rank", *moments.columns)


def alternatives(benches: DataFrame, slots: DataFrame, k: int = 6, plan: str = "plan_id") -> DataFrame:
    """Bench of a slot's plan re-ordered: moments of the slot's clip or scene group first, then bench order.

    ``slots`` has (plan, slot, clip_path, grp); a bench has at most twenty rows per plan.
    """
    s = slots.select(plan, "slot", F.col("clip_path").alias("__clip"), F.col("grp").alias("__grp"))
    rows = s.join(benches, plan)
    kin = (F.col("clip_path") == F.col("__clip")) | ((F.col("__grp") != "") & (F.col("grp") == F.col("__grp")))
    rows = rows.withColumn("same_scene", F.coalesce(kin, F.lit(False)))
    order = Window.partitionBy(plan, "slot").orderBy(F.desc("same_scene"), "rank")
    return rows.withColumn("choice", F.row_number().over(order)).where(F.col("choice") <= k).withColumn(
        "choice", F.col("choice").cast("bigint")
    ).drop("__clip", "__grp")


def repeats(entries: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Pairs of slots of one plan that show (nearly) the same frames: half of the shorter range is shared."""
    a = entries.select(plan, "clip_path", F.col("slot").alias("slot_a"), F.col("source_start").alias("a0"), F.col("source_end").alias("a1"))
    b = entries.select(plan, "clip_path", F.col("slot").alias("slot_b"), F.col("source_start").alias("b0"), F.col("source_end").alias("b1"))
    pairs = range_join(a, b, [plan, "clip_path"], ("a0", "a1"), ("b0", "b1"), BIN).where(F.col("slot_a") < F.col("slot_b"))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    shorter = F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))
    pairs = pairs.withColumn("overlap_s", shared).where((shorter > EPS) & (shared >= REPEAT_SHARE * shorter - EPS))
    return pairs.select(plan, "clip_path", "slot_a", "slot_b", "overlap_s")


def continuity_runs(entries: DataFrame, context: str | None = None, plan: str = "plan_id", max_gap: float = CONTINUITY_GAP) -> DataFrame:
    """Adjacent slots that read as one take: same clip and context, small forward source gap, no record gap."""
    state = ["clip_path", "source_start", "source_end", "record_start", "record_end"] + ([context] if context else [])

    def breaks(a: Column, b: Column) -> Column:
        gap = b["source_start"] - a["source_end"]
        joins = (a["clip_path"] == b["clip_path"]) & (gap >= -EPS) & (gap <= max_gap + EPS) & (
            F.abs(b["record_start"] - a["record_end"]) <= EPS
        )
        if context:
            joins = joins & (a[context] == b[context])
        return ~joins

    return islands(
        entries, [plan], ["slot"], by_slot(), breaks, state,
        first_slot=("min", F.col("slot")), last_slot=("max", F.col("slot")), clip_path=("first", F.col("clip_path")),
        record_start=("min", F.col("record_start")), record_end=("max", F.col("record_end")),
        source_start=("first", F.col("source_start")), source_end=("last", F.col("source_end")),
    )


def music_window(plans: DataFrame) -> DataFrame:
    """Adds (w_in, w_end): the song window clamped into the cut, the whole cut when it is degenerate."""
    d = F.greatest(F.lit(0.0), F.col("duration"))
    w_in = F.least(F.greatest(F.coalesce("music_in", F.lit(0.0)), F.lit(0.0)), d)
    w_end = F.when(F.coalesce("music_out", F.lit(0.0)) > EPS, F.least(F.col("music_out"), d)).otherwise(d)
    empty = w_end <= w_in + EPS
    return plans.withColumn("w_in", F.when(empty, 0.0).otherwise(w_in)).withColumn("w_end", F.when(empty, d).otherwise(w_end))


def bed_gaps(plans: DataFrame, gaps: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Silences clipped to the song window and merged. ``gaps`` has (plan, gap_start, gap_end)."""
    window = music_window(plans).select(plan, "w_in", "w_end")
    cut = gaps.join(window, plan).select(
        plan, F.greatest("gap_start", "w_in").alias("gap_start"), F.least("gap_end", "w_end").alias("gap_end")
    )
    return union_intervals(cut, [plan], "gap_start", "gap_end", eps=EPS)


def bed_segments(plans: DataFrame, gaps: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Record windows in which the song is heard; a bed that would be silent throughout plays in full."""
    window = music_window(plans).select(plan, "w_in", "w_end")
    merged = settle(bed_gaps(plans, gaps, plan))
    stops = merged.unionByName(window.select(plan, F.col("w_end").alias("gap_start"), F.col("w_end").alias("gap_end")))
    paced = scan(stops, [plan], ["gap_start", "gap_end"], F.floor(F.col("gap_start") / 600), __back=previous("gap_end"))
    rows = paced.join(window, plan)
    found = rows.select(plan, F.coalesce("__back", "w_in").alias("bed_start"), F.col("gap_start").alias("bed_end")).where(
        F.col("bed_end") - F.col("bed_start") > EPS
    )
    silent = window.join(found, plan, "left_anti").select(plan, F.col("w_in").alias("bed_start"), F.col("w_end").alias("bed_end"))
    return found.unionByName(silent)


def plan_silences(
    plans: DataFrame, dips: DataFrame, sfx: DataFrame, downbeats: DataFrame, drops: DataFrame, plan: str = "plan_id",
) -> DataFrame:
    """Deliberate silences: under carried dips up to the next downbeat, and one beat before the first drop.

    ``plans`` needs (duration, music_in, music_out, style, beat, beats); ``dips`` (dip_start, dip_len); ``sfx``
    (kind, time, length); ``downbeats`` and ``drops`` (t).
    """
    window = music_window(plans).where(F.col("w_end") - F.col("w_in") > EPS)
    info = window.select(plan, "w_in", "w_end", "beat", "beats", "style")
    dip = dips.select(plan, "dip_start", (F.col("dip_start") + F.col("dip_len")).alias("dip_end"))
    reach = CARRIER_TOLERANCE + EPS
    cue = sfx.where(F.col("kind").isin(*CARRIERS)).select(
        plan, (F.col("time") - reach).alias("c0"), (F.col("time") + F.greatest("length", F.lit(0.0)) + reach).alias("c1")
    )
    carried = range_join(dip, cue, [plan], ("dip_start", "dip_end"), ("c0", "c1"), BIN).select(plan, "dip_start", "dip_end").distinct()
    held = carried.join(info, plan).withColumn("lo", F.greatest("dip_start", "w_in")).withColumn("hi", F.least("dip_end", "w_end"))
    held = settle(held.where(F.col("hi") - F.col("lo") > EPS))
    ahead = range_join(
        held.select(plan, "dip_start", "dip_end", "beat", "w_end", (F.col("dip_end") + F.col("beat") + EPS).alias("far")),
        downbeats.select(plan, "t"), [plan], ("dip_end", "far"), ("t", "t"), BIN,
    ).where((F.col("t") > F.col("dip_end") + EPS) & (F.col("t") <= F.col("w_end") + EPS))
    nxt = ahead.groupBy(plan, "dip_start").agg(F.min("t").alias("__t"))
    under = held.join(nxt, [plan, "dip_start"], "left").select(
        plan, F.col("lo").alias("gap_start"), F.coalesce(F.least("__t", "w_end"), "hi").alias("gap_end"), F.lit("dip").alias("reason")
    )
    inside = drops.join(info, plan).where((F.col("t") > F.col("w_in") + EPS) & (F.col("t") < F.col("w_end") - EPS))
    first = inside.where((F.col("style") != "short") & (F.col("beats") >= 2)).groupBy(plan).agg(
        F.min("t").alias("drop"), F.first("beat").alias("beat"), F.first("w_in").alias("w_in")
    )
    first = first.withColumn("lo", F.col("drop") - F.col("beat")).where((F.col("lo") >= F.col("w_in") + EPS) & (F.col("lo") > EPS))
    touched = range_join(
        first.select(plan, (F.col("lo") - EPS).alias("f0"), (F.col("drop") + EPS).alias("f1")), under.select(plan, "gap_start", "gap_end"),
        [plan], ("f0", "f1"), ("gap_start", "gap_end"), BIN,
    ).where((F.col("f0") < F.col("gap_end")) & (F.col("f1") > F.col("gap_start"))).select(plan).distinct()
    before = first.join(touched, plan, "left_anti").select(
        plan, F.col("lo").alias("gap_start"), F.col("drop").alias("gap_end"), F.lit("drop").alias("reason")
    )
    return under.unionByName(before)


def ducking_windows(sfx: DataFrame, plans: DataFrame, prominent: DataFrame | None = None, plan: str = "plan_id") -> DataFrame:
    """Windows in which the bed dips: under placed hits, risers and prominent original sound, as linear gains."""
    kind = F.col("kind")
    accent = kind.isin("impact", "sub-drop")
    raw = F.greatest(F.coalesce("length", F.lit(0.0)), F.lit(0.0))
    length = F.when(accent, F.when(raw > 0, F.least(raw, F.lit(DUCK_ACCENT_MAX))).otherwise(DUCK_ACCENT_MAX)).otherwise(raw)
    placed = sfx.where((F.coalesce("file", F.lit("")) != "") & (accent | (kind == "riser"))).select(
        plan, F.col("time").alias("s"), (F.col("time") + length).alias("e"), F.when(accent, DUCK_DB["impact"]).otherwise(DUCK_DB["riser"]).alias("db"),
        F.when(accent, DUCK_FADE).otherwise(SHELF_FADE).alias("fade"),
    )
    if prominent is not None:
        placed = placed.unionByName(prominent.select(plan, F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.lit(SHELF_DB).alias("db"), F.lit(SHELF_FADE).alias("fade")))
    return _in_cut(placed, plans, plan).select(
        plan, "duck_start", "duck_end", F.pow(F.lit(10.0), F.col("db") / 20).alias("gain"), "fade"
    )


def _in_cut(rows: DataFrame, plans: DataFrame, plan: str) -> DataFrame:
    d = plans.select(plan, F.greatest(F.lit(0.0), F.col("duration")).alias("__d"))
    out = rows.join(d, plan).withColumn("duck_start", F.greatest(F.lit(0.0), F.col("s"))).withColumn("duck_end", F.least("__d", "e"))
    return out.where(F.col("duck_end") - F.col("duck_start") > MIN_GAP)


def lift_windows(prominent: DataFrame, plans: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Lift of prominent original sound, limited by the headroom under the true-peak ceiling."""
    headroom = TRUE_PEAK_CEILING - (F.col("peak_db") + 20 * F.log10(F.lit(MIX_LEVEL)))
    rows = prominent.select(plan, F.col("start_s").alias("s"), F.col("end_s").alias("e"), headroom.alias("room"))
    rows = _in_cut(rows, plans, plan).withColumn(
        "db", F.when(F.col("room") + 1e-9 < LIFT_DB, F.greatest(F.lit(0.0), F.col("room"))).otherwise(LIFT_DB)
    )
    return rows.where(F.col("db") > 1e-9).select(
        plan, "duck_start", "duck_end", F.pow(F.lit(10.0), F.col("db") / 20).alias("gain"), F.lit(SHELF_FADE).alias("fade")
    )


def label_at(rows: DataFrame, spans: DataFrame, at: str, out: str, plan: str = "plan_id", value: str = "label") -> DataFrame:
    """Label of the span (span_start, span_end, label) holding ``at``; past the last span its label; else NULL.

    A plan has a handful of spans, so they are gathered once per plan and looked up in place. There are as many lists as
    plans: they are merged with the rows, never broadcast, however small they are when compressed.
    """
    packed = spans.groupBy(plan).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", F.col(value).alias("v")))).alias("__s"))
    t = F.col(at)
    inside = F.filter("__s", lambda x: (x["span_start"] - EPS <= t) & (t < x["span_end"] - EPS))
    last = F.element_at("__s", -1)
    found = F.when(F.size(inside) > 0, F.get(inside, F.lit(0))["v"]).when(t >= last["span_end"] - EPS, last["v"])
    return rows.join(packed.hint("merge"), plan, "left").withColumn(out, F.when(F.col("__s").isNotNull(), found)).drop("__s")


def jl_edits(
    entries: DataFrame, marks: DataFrame, phases: DataFrame, fps: float = 25.0, plan: str = "plan_id", k: int = JL_MAX,
) -> DataFrame:
    """Where sound and picture should part: J leads and L lags on quiet hard cuts, hand-set ones kept.

    ``entries`` needs clip_duration, audio_lead, audio_lag; ``marks`` (plan, t) are drop marks, silence edges
    and times of placed cues, none of which may be decoupled.
    """
    frame = 1.0 / fps
    base = max(frame, round(JL_SECONDS / frame) * frame)
    hand = (F.col("audio_lead") > EPS) | (F.col("audio_lag") > EPS)
    tagged = label_at(entries, phases, "record_start", "phase", plan)
    look = F.struct("slot", "clip_path", "record_start", "record_end", "source_start", "transition", "phase", "audio_lead", "audio_lag")
    seams = settle(scan(tagged, [plan], ["slot"], by_slot(), nxt=following(look), prv=previous(look)))
    kept = seams.where(hand).select(
        plan, "slot", F.greatest("audio_lead", F.lit(0.0)).alias("lead"), F.greatest("audio_lag", F.lit(0.0)).alias("lag"), F.lit("hand").alias("kind")
    )
    hand_next = (F.col("nxt.audio_lead") > EPS) | (F.col("nxt.audio_lag") > EPS)
    lag_before = F.coalesce(F.col("prv.audio_lag") > EPS, F.lit(False))
    # A hand-set lead also claims the slot before it, a hand-set lag the slot after it.
    far = seams.select(plan, (F.col("slot") - 1).alias("slot"), F.coalesce(F.col("nxt.audio_lead") > EPS, F.lit(False)).alias("__far"))
    seams = seams.join(far, [plan, "slot"], "left")
    claimed = hand | hand_next | lag_before | (F.coalesce(F.col("audio_lag") > EPS, F.lit(False))) | F.coalesce("__far", F.lit(False))
    cut = F.col("record_end")
    energy = lambda c: F.coalesce(*[F.when(F.col(c) == p, e) for p, e in PHASE_ENERGY.items()], F.lit(0.5))
    room = F.least(F.col("record_end") - F.col("record_start"), F.col("nxt.record_end") - F.col("nxt.record_start")) - JL_SOLO
    amount = F.least(F.lit(base), room)
    rise = energy("nxt.phase") - energy("phase")
    is_j = rise > EPS
    lead = F.least(amount, F.greatest(F.lit(0.0), F.col("nxt.source_start")))
    lag = F.when(F.col("clip_duration") > EPS, F.least(amount, F.greatest(F.lit(0.0), F.col("clip_duration") - F.col("source_end")))).otherwise(0.0)
    ok = seams.where(
        F.col("nxt").isNotNull() & ~claimed & (F.abs(F.col("nxt.record_start") - cut) <= JL_TOLERANCE) & (F.col("nxt.transition") <= EPS)
        & (F.col("clip_path") != F.col("nxt.clip_path")) & (room > EPS)
        & ~F.coalesce(F.col("phase") == "climax", F.lit(False)) & ~F.coalesce(F.col("nxt.phase") == "climax", F.lit(False))
    ).select(
        plan, "slot", cut.alias("cut"), F.when(is_j, "J").otherwise("L").alias("kind"), F.when(is_j, lead).otherwise(lag).alias("amount"),
        (-F.round(F.abs(rise), 9)).alias("rank_key"),
    ).where(F.col("amount") > EPS)
    reach = JL_TOLERANCE + EPS
    held = range_join(
        ok.select(plan, "slot", (F.col("cut") - reach).alias("c0"), (F.col("cut") + reach).alias("c1")), marks.select(plan, "t").distinct(),
        [plan], ("c0", "c1"), ("t", "t"), BIN,
    ).select(plan, "slot").distinct()
    ok = ok.join(held, [plan, "slot"], "left_anti")
    # A chosen seam rules out its two neighbours only, so the first 3k candidates settle the choice of k.
    order = Window.partitionBy(plan).orderBy("rank_key", "slot")
    top = ok.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 3 * k)
    row_type = "array<struct<r:int,slot:bigint,kind:string,amount:double>>"

    def step(chosen: Column, x: Column) -> Column:
        apart = F.forall(chosen, lambda o: F.abs(o["slot"] - x["slot"]) != 1)
        return F.when((F.size(chosen) < k) & apart, F.concat(chosen, F.array(x))).otherwise(chosen)

    rows = top.groupBy(plan).agg(F.array_sort(F.collect_list(F.struct("r", F.col("slot").cast("bigint").alias("slot"), "kind", "amount"))).alias("l"))
    rows = rows.select(plan, F.explode(F.aggregate(F.col("l").cast(row_type), F.array().cast(row_type), step)).alias("c"))
    j = F.col("c.kind") == "J"
    auto = rows.select(
        plan, (F.col("c.slot") + F.when(j, 1).otherwise(0)).alias("slot"), F.when(j, F.col("c.amount")).otherwise(0.0).alias("lead"),
        F.when(j, 0.0).otherwise(F.col("c.amount")).alias("lag"), F.col("c.kind").alias("kind"),
    )
    return kept.unionByName(auto)


def splice_region(original: DataFrame, revised: DataFrame, region: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Revised entries inside the region, originals outside; ``region`` has (plan, r0, r1).

    The window runs from the first to the last original entry fully inside; plans without one stay as revised.
    """
    inside = original.join(region, plan).where((F.col("record_start") >= F.col("r0") - EPS) & (F.col("record_end") <= F.col("r1") + EPS))
    # Written once: three branches read it, and would each sort the entries again to get it.
    window = settle(inside.groupBy(plan).agg(F.min("record_start").alias("win_lo"), F.max("record_end").alias("win_hi")))
    cols = original.columns
    outer = original.join(window, plan).where(
        (F.col("record_end") <= F.col("win_lo") + EPS) | (F.col("record_start") >= F.col("win_hi") - EPS)
    ).select(*cols)
    lo, hi = F.greatest("record_start", "win_lo"), F.least("record_end", "win_hi")
    clipped = revised.join(window, plan).where(hi - lo > EPS)
    fresh = {
        "record_start": lo, "record_end": hi,
        "source_start": F.least(F.col("source_end"), F.col("source_start") + (lo - F.col("record_start"))),
        "source_end": F.least(F.col("source_end"), F.col("source_start") + (hi - F.col("record_start"))),
    }
    inner = clipped.select(*[fresh.get(c, F.col(c)).alias(c) for c in cols])
    untouched = revised.join(window, plan, "left_anti").select(*cols)
    return outer.unionByName(inner).unionByName(untouched)


def splice_dips(original: DataFrame, revised: DataFrame, window: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Dips of a splice: the original's outside (win_lo, win_hi), the revision's inside."""
    end = F.col("dip_start") + F.col("dip_len")
    out = original.join(window, plan).where((end <= F.col("win_lo") + EPS) | (F.col("dip_start") >= F.col("win_hi") - EPS))
    inn = revised.join(window, plan).where((F.col("dip_start") >= F.col("win_lo") - EPS) & (end <= F.col("win_hi") + EPS))
    return out.select(*original.columns).unionByName(inn.select(*original.columns))


def merge_region(entries: DataFrame, region: DataFrame, scale: float, plan: str = "plan_id") -> DataFrame:
    """Calmer region: every max(2, round(scale)) contiguous unpinned slots inside become one longer slot.

    ``entries`` needs clip_duration and pinned; rows outside the region pass through.
    """
    group = max(2, round(scale))
    marked = entries.join(region, plan, "left")
    inside = (F.col("record_start") >= F.col("r0") - EPS) & (F.col("record_end") <= F.col("r1") + EPS) & ~F.col("pinned")
    marked = marked.withColumn("__in", F.coalesce(inside, F.lit(False)))
    marked = scan(marked, [plan], ["slot"], by_slot(), __back=previous(F.struct("record_end", "__in")))
    joins = F.col("__in") & F.coalesce(F.col("__back.__in"), F.lit(False)) & F.coalesce(
        F.abs(F.col("__back.record_end") - F.col("record_start")) <= EPS, F.lit(False)
    )
    marked = settle(marked.withColumn("__opens", (~joins).cast("bigint")).drop("__back"))
    runs = scan(marked, [plan], ["slot"], by_slot(), __run=running_sum("__opens"), __rn=row_index())
    # The position inside a run counts from the row that opened it.
    runs = scan(runs, [plan], ["slot"], by_slot(), __first=carry_forward(F.when(F.col("__opens") == 1, F.col("__rn"))))
    piece = F.floor((F.col("__rn") - F.col("__first")) / group)
    merged = runs.groupBy(plan, "__run", piece.alias("__piece")).agg(
        F.count("*").alias("slots"), F.min(F.struct("slot", "clip_path", "source_start", "source_end", "clip_duration", "record_start")).alias("f"),
        F.max("record_end").alias("record_end"),
    )
    span = F.col("record_end") - F.col("f.record_start")
    limit = F.when(F.col("f.clip_duration") > EPS, F.col("f.clip_duration")).otherwise(F.lit(float("inf")))
    end = F.when(F.col("slots") > 1, F.least(F.col("f.source_start") + span, limit)).otherwise(F.col("f.source_end"))
    return merged.select(
        plan, F.col("f.slot").alias("slot"), F.col("f.clip_path").alias("clip_path"), F.col("f.source_start").alias("source_start"),
        end.alias("source_end"), F.col("f.record_start").alias("record_start"), "record_end", "slots",
    )


def distill(clips: DataFrame, key: str = "timeline_id", label: str | None = None) -> DataFrame:
    """A finished cut as footage material: merged source spans per file with a screen-time score.

    ``clips`` has source_file, source_name and name, the first non-empty one names the material.
    """
    named = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("source_file", "source_name", "name") if c in clips.columns], F.lit("untitled"))
    lab = F.nullif(F.col(label), F.lit("")) if label else F.lit(None).cast("string")
    spans = clips.where(F.col("kind") == "video").select(
        key, named.alias("path"), (F.col("source_in") / F.col("fps")).alias("start_s"), (F.col("source_out") / F.col("fps")).alias("end_s"),
        lab.alias("__label"), "record_in",
    )
    merged = settle(union_intervals(spans, [key, "path"], "start_s", "end_s", eps=EPS, first={"label": (["start_s", "end_s", "record_in"], F.col("__label"))}))
    longest = merged.groupBy(key).agg(F.max(F.col("end_s") - F.col("start_s")).alias("__longest"))
    known = merged.groupBy(key, "path").agg(F.max("end_s").alias("duration"))
    out = merged.join(known, [key, "path"]).join(longest, key)
    score = F.least(F.lit(1.0), BASE_SCORE + SCREEN_BONUS * (F.col("end_s") - F.col("start_s")) / F.col("__longest"))
    return out.select(key, "path", "start_s", "end_s", F.coalesce("label", F.lit("")).alias("label"), score.alias("score"), "duration")


def phase_spans(plans: DataFrame, drops: DataFrame, grid: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Arc phases of every plan (plan, duration, style): shares of the length, climax pinned to the best drop.

    ``drops`` has (plan, t, weight); ``grid`` (plan, kind, t) with kind phrase, downbeat or beat. Inner borders
    snap to the nearest point of the best grid kind present.
    """
    # One row per style: its labels, and the sums of its shares up to each border.
    arcs = plans.sparkSession.createDataFrame(
        [(s, [lab for _, lab in arc], list(accumulate((sh for sh, _ in arc), initial=0.0))) for s, arc in STYLE_ARCS.items() if arc],
        "style string, arc array<string>, upto array<double>",
    )
    d = plans.select(plan, F.col("duration").alias("length"), "style")
    in_range = drops.join(d, plan).where(
        (F.col("t") >= DROP_MARGIN * F.col("length")) & (F.col("t") <= (1 - DROP_MARGIN) * F.col("length"))
    )
    best = in_range.groupBy(plan).agg(F.min(F.struct((-F.round("weight", 9)).alias("w"), F.col("t"))).alias("b")).select(plan, F.col("b.t").alias("drop"))
    base = d.join(best, plan, "left").join(F.broadcast(arcs), "style")
    total_share = F.element_at("upto", -1)
    bounds = F.transform("upto", lambda u, n: F.when(n == F.size("arc"), F.col("length")).otherwise(F.col("length") * u / total_share))
    base = base.withColumn("bounds", bounds).withColumn("ci", F.array_position("arc", "climax").cast("int") - 1).drop("upto")
    orig = F.get(F.col("bounds"), F.col("ci"))
    pinned = F.col("drop").isNotNull() & (F.col("ci") > 0) & (orig > EPS) & (orig < F.col("length") - EPS)
    base = base.withColumn("pin", F.coalesce(pinned, F.lit(False)))
    moved = F.transform(
        "bounds",
        lambda b, i: F.when(~F.col("pin") | (i == 0) | (i == F.size("arc")), b)
        .when(i < F.col("ci"), b * F.col("drop") / orig)
        .when(i == F.col("ci"), F.col("drop"))
        .otherwise(F.col("length") - (F.col("length") - b) * (F.col("length") - F.col("drop")) / (F.col("length") - orig)),
    )
    base = base.withColumn("bounds", moved)
    base = base.withColumn("bounds", F.when(F.col("pin"), _floored(F.col("bounds"), F.col("ci"), F.col("length"))).otherwise(F.col("bounds")))
    # The borders are costly and read twice below.
    base = settle(base)
    # Inner borders become rows, snap to the grid, and come back; a plan has at most four of them.
    inner = base.select(plan, "length", "pin", "ci", F.posexplode("bounds").alias("i", "b"), F.size("arc").alias("n")).where(
        (F.col("i") > 0) & (F.col("i") < F.col("n")) & ~(F.col("pin") & (F.col("i") == F.col("ci")))
    )
    points = grid.join(d, plan).where((F.col("t") > EPS) & (F.col("t") < F.col("length") - EPS))
    rank = F.when(F.col("kind") == "phrase", 0).when(F.col("kind") == "downbeat", 1).otherwise(2)
    points = settle(points.select(plan, rank.alias("k"), "t"))
    kind = points.groupBy(plan).agg(F.min("k").alias("k"))
    usable = points.join(kind, [plan, "k"], "left_semi").select(plan, "t").distinct()
    snapped = nearest_point(inner.select(plan, "i", "b"), usable, [plan], "b", "i").select(plan, "i", F.col("near").alias("s"))
    moved_to = snapped.groupBy(plan).agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("snap"))
    out = base.join(moved_to, plan, "left")
    final = F.transform("bounds", lambda b, i: F.coalesce(F.try_element_at("snap", i), b))
    # Borders never run backwards: running maximum, limited by the length.
    steady = F.transform(
        F.sequence(F.lit(1), F.size("arc") + 1), lambda n: F.least(F.array_max(F.slice("__b", 1, n)), F.col("length"))
    )
    out = out.withColumn("__b", final).withColumn("bounds", steady)
    spans = out.select(plan, "bounds", F.posexplode("arc").alias("phase_no", "a"))
    return spans.select(
        plan, F.col("phase_no").cast("bigint").alias("phase_no"), F.col("a").alias("label"),
        F.get("bounds", F.col("phase_no")).alias("span_start"), F.get("bounds", F.col("phase_no") + 1).alias("span_end"),
    )


def _bind(value: Column, use) -> Column:
    """Name an intermediate value inside an expression, so that it is written and computed once."""
    return F.transform(F.array(value), use)[0]


def _floored(bounds: Column, ci: Column, length: Column) -> Column:
    """Raise squeezed phases on each side of the pinned border to the floor, taken from the longer ones."""

    def side(b: Column, lo: Column, hi: Column) -> Column:
        given = F.struct(b.alias("b"), lo.alias("lo"), hi.alias("hi"), (ARC_FLOOR * length).alias("floor"))

        def measured(g: Column) -> Column:
            lens = F.transform(F.sequence(g["lo"], g["hi"] - 1), lambda i: F.get(g["b"], i + 1) - F.get(g["b"], i))
            return _bind(F.struct(g.alias("g"), lens.alias("lens")), raised)

        def raised(m: Column) -> Column:
            up = F.transform(m["lens"], lambda x: F.greatest(x, m["g"]["floor"]))
            spare = F.aggregate(up, F.lit(0.0), lambda a, x: a + x - m["g"]["floor"])
            return _bind(F.struct(m["g"].alias("g"), m["lens"].alias("lens"), up.alias("up"), spare.alias("spare")), placed)

        def placed(r: Column) -> Column:
            g, n = r["g"], r["g"]["hi"] - r["g"]["lo"]
            span = F.get(g["b"], g["hi"]) - F.get(g["b"], g["lo"])
            scale = F.when(r["spare"] > EPS, (span - n * g["floor"]) / F.when(r["spare"] > EPS, r["spare"])).otherwise(0.0)
            upto = lambda i: F.aggregate(
                F.slice(r["up"], 1, F.greatest(i - g["lo"], F.lit(0))), F.lit(0.0), lambda a, x: a + g["floor"] + (x - g["floor"]) * scale
            )
            fresh = F.transform(g["b"], lambda v, i: F.when((i > g["lo"]) & (i < g["hi"]), F.get(g["b"], g["lo"]) + upto(i)).otherwise(v))
            tight = F.exists(r["lens"], lambda x: x < g["floor"] - EPS)
            return F.when((n >= 2) & (span >= n * g["floor"] - EPS) & tight, fresh).otherwise(g["b"])

        return _bind(given, measured)

    return side(side(bounds, F.lit(0), ci), ci, F.size(bounds) - 1)


def nearest_point(
    rows: DataFrame, points: DataFrame, keys: list[str], at: str, row_id: str, tolerance: float | None = None,
) -> DataFrame:
    """Adds ``near``: the closest point (keys, t) to ``at``, ties to the earlier; NULL beyond ``tolerance``.

    Points and rows are merged into one series per key; the last point before and the first one after a row
    are carried to it, so no pairs are formed.
    """
    chunk = F.floor(F.col("__t") / 600)
    p = points.select(*keys, F.col("t").alias("__t"), F.lit(0).alias("__k"), F.col("t").alias("__p"), F.lit(None).cast("bigint").alias("__id"))
    r = rows.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast("double").alias("__p"), F.col(row_id).cast("bigint").alias("__id"))
    both = p.unionByName(r)
    seen = scan(both, keys, ["__t", "__k", "__id"], chunk, __before=carry_forward("__p"), __after=carry_backward("__p")).where("__k = 1")
    back, ahead = F.col("__t") - F.col("__before"), F.col("__after") - F.col("__t")
    near = F.when(F.col("__before").isNull(), F.col("__after")).when(F.col("__after").isNull(), F.col("__before")).when(
        back <= ahead, F.col("__before")
    ).otherwise(F.col("__after"))
    if tolerance is not None:
        near = F.when(F.abs(near - F.col("__t")) <= tolerance, near)
    found = seen.select(*keys, F.col("__id").alias(row_id), near.alias("near"))
    return rows.join(found, [*keys, row_id])
