"""Plan scoring, ranking, version diffs and publishing tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.columns import basename, clamp, col, first_by
from cutlake.functions.greedy import best_partners, spaced_in_time, spaced_picks
from cutlake.functions.intervals import range_join, union_intervals
from cutlake.functions.ordered import (
    attach, carry_backward, carry_forward, following, global_ranks, max_before, meet, pick_ranks, previous, row_index, scan,
)
from cutlake.functions.staging import settle
from cutlake.operators.intervals import BIN, CARRIERS, by_slot, label_at

# Weights, tolerances and word lists.
EPS = 1e-6
DROP_MATCH, DIP_MATCH = 0.25, 1e-3
ORDER_WEIGHT, MOTION_WEIGHT, ENERGY_WEIGHT, ROLE_WEIGHT, HERO_WEIGHT = 0.7, 0.3, 0.2, 0.2, 0.5
GROUP_PENALTY, DAYLIGHT_PENALTY, DAYLIGHT_BONUS = 0.25, 0.15, 0.1
EYE_WEIGHT, EYE_DIAGONAL = 0.12, math.sqrt(2.0)
GRAMMAR_BONUS, GRAMMAR_PENALTY = 0.12, 0.1
JUMP_GAP, JUMP_PENALTY, CONTINUITY_GAP, MAX_CUT = 8.0, 0.4, 3.0, 8.0
MOTION_FLOOR = 0.5
DAYLIGHT_ARC = ("day", "golden", "night")
ROLE_FOR_PHASE = {"opening": "opener", "build": "build", "climax": "climax", "outro": "closer"}
CALM_MOTION, CALM_HIGHLIGHT, CALM_SHARE, QUIET_ENERGY = 0.35, 0.3, 0.6, 0.35
COINCIDENCE_TOL, COINCIDENCE_MIN, DROP_TOL, CARRIER_TOL = 0.25, 0.8, 0.12, 0.5
MIN_SLOT, LOUDNESS, LOUDNESS_TOL = 0.3, -14.0, 1.0
CHANGE_EPS, LENGTH_CHANGE, TEMPO_CHANGE = 0.05, 0.25, 0.5
SNAPSHOTS = 50
CHAPTER_SECONDS = 10.0
TAG_STOPWORDS = (
    "the and with into onto from over under for its his her their a an "
    "der die das und ein eine einem einen mit dem den auf aus bei durch"
).split()
CUE_TO_ELEMENT = {"impact": "impact", "whoosh": "whoosh", "riser": "riser", "sub-drop": "braam"}
REUSE_GAP, REUSE_DEFAULT = {"impact": 2.5, "whoosh": 4.0, "braam": 5.0, "riser": 6.0}, 8.0
CUE_SECONDS, RISER_MAX, IMPACT_SECONDS, WHOOSH_SECONDS, WHOOSH_MAX, WHOOSH_CLEAR, AUTO_OPENING = 3.5, 2.0, 1.0, 0.6, 6, 1.0, 4.0
CENTRE_EPS = 0.5
HERO_MIN = 0.5
PLAN = "plan_id"


def near_any(rows: DataFrame, points: DataFrame, at: str, tolerance: float, flag: str, keys: list[str] = [PLAN], row: str = "slot") -> DataFrame:
    """Adds a boolean: is any point (keys, t) within ``tolerance`` of ``at``."""
    spans = rows.select(*keys, row, (F.col(at) - tolerance).alias("__a"), (F.col(at) + tolerance).alias("__b"))
    hits = range_join(spans, points.select(*keys, "t").distinct(), keys, ("__a", "__b"), ("t", "t"), BIN)
    hits = hits.select(*keys, row).distinct().withColumn(flag, F.lit(True))
    return rows.join(hits.hint("merge"), [*keys, row], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def slot_context(entries: DataFrame, phases: DataFrame, sections: DataFrame, drops: DataFrame, dips: DataFrame, plans: DataFrame) -> DataFrame:
    """Seconds, arc phase, music label, on-drop and after-dip per slot. Sections and drops are in song time."""
    shift = plans.select(PLAN, "music_start", "duration").hint("merge")  # one row per plan is too much for the driver
    rows = entries.select(PLAN, "slot", "record_start", "record_end").join(shift, PLAN)
    rows = rows.withColumn("__song", F.col("music_start") + F.col("record_start"))
    rows = label_at(label_at(rows, phases, "record_start", "phase"), sections, "__song", "music")
    ends = dips.select(PLAN, (F.col("dip_start") + F.col("dip_len")).alias("t"))
    lo, hi = F.col("music_start") - EPS, F.col("music_start") + F.col("duration") + EPS
    inside = drops.join(shift, PLAN).where((F.col("t") >= lo) & (F.col("t") <= hi)).select(PLAN, "t")
    rows = near_any(rows, inside, "__song", DROP_MATCH, "drop")
    rows = near_any(rows, ends, "record_start", DIP_MATCH, "after_dip")
    return rows.select(PLAN, "slot", (F.col("record_end") - F.col("record_start")).alias("seconds"), "phase", "music", "drop", "after_dip")


def motion_magnitude(m: str = "entry_motion", n: str = "exit_motion") -> Column:
    one = lambda c: F.sqrt(F.col(f"{c}.dx") ** 2 + F.col(f"{c}.dy") ** 2)
    return (one(m) + one(n)) / 2


def inventory(moments: DataFrame) -> DataFrame:
    """Usable moments with their file name and motion."""
    return moments.withColumn("clip", basename("clip_path")).withColumn("motion", motion_magnitude())


def pool_ranks(moments: DataFrame, project: str | None = None) -> DataFrame:
    """Position of every moment in the pool order (score desc, path, start), without one sorting task; per ``project`` where one is named."""
    order = [F.desc("score"), F.asc("clip_path"), F.asc("start_s"), F.asc("mid")]
    if project is None:
        return global_ranks(moments, order, "pool_rank")
    ranked = global_ranks(moments, [F.asc(project), *order], "pool_rank")
    first = ranked.groupBy(project).agg(F.min("pool_rank").alias("__first"))
    ranked = attach(ranked, first, [project], F.floor(F.col("pool_rank") / 4096))
    return ranked.withColumn("pool_rank", F.col("pool_rank") - F.col("__first") + 1).drop("__first")


def daylight_targets(slots: DataFrame, moments: DataFrame) -> DataFrame:
    """Class whose block of record time holds the slot's midpoint; blocks follow the pool's share of each class."""
    sec = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    shares = moments.agg(*[F.coalesce(F.sum(F.when(F.col("daylight") == c, sec)), F.lit(0.0)).alias(c) for c in DAYLIGHT_ARC])
    total = sum((F.col(c) for c in DAYLIGHT_ARC), F.lit(0.0))
    classes = sum((F.when(F.col(c) > EPS, 1).otherwise(0) for c in DAYLIGHT_ARC), F.lit(0))
    edge, bounds = F.lit(0.0), []
    for c in DAYLIGHT_ARC:
        edge = edge + F.col(c) / total
        bounds.append(F.when(F.col(c) > EPS, F.struct(edge.alias("to"), F.lit(c).alias("c"))))
    shares = shares.where(classes >= 2).select(F.array_compact(F.array(*bounds)).alias("__bounds"))
    span = slots.groupBy(PLAN).agg(first_by(["slot"], "record_start").alias("__origin"), F.max_by("record_end", "slot").alias("__end"))
    rows = slots.join(span, PLAN).join(F.broadcast(shares))  # one row, three classes
    length = F.col("__end") - F.col("__origin")
    mid = (F.col("record_start") + F.col("record_end")) / 2 - F.col("__origin")
    hit = F.filter("__bounds", lambda b: mid <= b["to"] * length + EPS)
    target = F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["c"]).otherwise(F.element_at("__bounds", -1)["c"])
    return rows.where(length > EPS).select(PLAN, "slot", target.alias("daylight_target"))


def slot_candidates(
    slots: DataFrame, moments: DataFrame, window: int = 4, k: int = 4, size_bonus: dict[tuple[str, str], float] | None = None, project: str | None = None,
) -> DataFrame:
    """Rank the moments of each slot's stretch of the pool order by the terms that need no earlier choice.

    Slot s looks at pool positions s+1 … s+window, as every slot before it takes one. ``slots`` needs
    (phase, energy, daylight_target, slots); ``moments`` needs a motion magnitude. ``project`` names a column of both: every
    project has its own pool. All plans look at the first positions and none beyond its length, so only positions
    within the longest plan's reach take part; they are broadcast while they are few, else copied, and the plans are dealt to the copies.
    """
    keys = [project] if project else []
    peak = moments.groupBy(*keys).agg(F.max("motion").alias("__peak"))
    deep = slots.groupBy(*keys).agg((F.max("slot") + window).alias("__deep"))
    if project:
        pool = attach(pool_ranks(moments, project), peak.join(deep, project), keys, F.floor(F.col("pool_rank") / 4096))
    else:
        pool = pool_ranks(moments).join(F.broadcast(peak)).join(F.broadcast(deep))  # one row each
    pool = pool.where(F.col("pool_rank") <= F.col("__deep")).drop("__deep")
    pool = settle(pool.withColumn("__norm", F.when(F.col("__peak") > EPS, F.col("motion") / F.col("__peak"))))
    looks = slots.withColumn("__pos", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("pool_rank", F.col("slot") + 1 + F.col("__pos"))
    rows = meet(looks, pool, [*keys, "pool_rank"], PLAN)
    wanted = F.array_compact(F.array(
        F.when((F.col("slot") == 0) & ~F.coalesce(F.col("phase") == "hook", F.lit(False)), F.lit("opener")),
        F.when(F.col("slot") == F.col("slots") - 1, F.lit("closer")),
        *[F.when(F.col("phase") == p, F.lit(r)) for p, r in ROLE_FOR_PHASE.items()],
    ))
    bonus = F.lit(0.0)
    for (phase, size), weight in (size_bonus or {}).items():
        here = F.lit(True) if phase == "*" else F.coalesce(F.col("phase") == phase, F.lit(False))
        bonus = bonus + F.when(here & (F.col("shot_size") == size), weight).otherwise(0.0)
    climax = F.coalesce(F.col("phase") == "climax", F.lit(False))
    value = (
        ORDER_WEIGHT * (1 - F.col("__pos") / window)
        + F.when(F.col("__norm").isNotNull(), ENERGY_WEIGHT * (1 - F.abs(F.col("energy") - F.col("__norm")))).otherwise(0.0)
        + F.when((F.col("role") != "") & F.array_contains(wanted, F.col("role")), ROLE_WEIGHT).otherwise(0.0)
        + F.when(climax, HERO_WEIGHT * F.col("hero")).otherwise(0.0)
        + F.when((F.col("daylight") != "") & (F.col("daylight") == F.col("daylight_target")), DAYLIGHT_BONUS).otherwise(0.0)
        + bonus
    )
    order = Window.partitionBy(PLAN, "slot").orderBy(F.round(value, 9).desc(), "__pos")
    rows = rows.withColumn("value", value).withColumn("choice", F.row_number().over(order)).where(F.col("choice") <= k)
    return rows.select(PLAN, "slot", F.col("choice").cast("bigint").alias("choice"), "mid", "value")


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)


def adjacency_scores(entries: DataFrame) -> DataFrame:
    """Every term of how well a slot follows the one before it.

    ``entries`` needs entry_motion, exit_motion (dx, dy), entry_focus, exit_focus (x, y or NULL), shot_size,
    daylight, grp, phase, on_drop and slots.
    """
    look = F.struct("exit_motion", "exit_focus", "shot_size", "daylight", "grp", "phase", "clip_path", "source_start", "source_end", "record_start")
    rows = scan(entries, [PLAN], ["slot"], by_slot(), __p=previous(look)).where(F.col("__p").isNotNull())
    a, b = F.col("__p.exit_motion"), F.col("entry_motion")
    ma, mb = F.sqrt(a["dx"] ** 2 + a["dy"] ** 2), F.sqrt(b["dx"] ** 2 + b["dy"] ** 2)
    moving = (ma > MOTION_FLOOR) & (mb > MOTION_FLOOR)
    cosine = F.when(moving, (a["dx"] * b["dx"] + a["dy"] * b["dy"]) / F.when(moving, ma * mb)).otherwise(0.0)
    same_phase = F.col("phase").eqNullSafe(F.col("__p.phase"))
    apart = _distance(F.col("__p.exit_focus"), F.col("entry_focus"))
    eye = F.when(same_phase & apart.isNotNull(), EYE_WEIGHT * (1 - 2 * apart / EYE_DIAGONAL)).otherwise(0.0)
    p, c = F.col("__p.shot_size"), F.col("shot_size")
    climax = F.coalesce(F.col("phase") == "climax", F.lit(False))
    step = ((p == "wide") & (c == "medium")) | ((p == "medium") & (c == "close"))
    grammar = (
        F.when((p == "") | (c == ""), 0.0).when(p == c, F.when((c == "close") & climax, 0.0).otherwise(-GRAMMAR_PENALTY))
        .when(step, GRAMMAR_BONUS).otherwise(0.0)
    )
    day = F.when((F.col("daylight") != "") & (F.col("__p.daylight") != "") & (F.col("daylight") != F.col("__p.daylight")), -DAYLIGHT_PENALTY).otherwise(0.0)
    group = F.when((F.col("grp") != "") & (F.col("grp") == F.col("__p.grp")), -GROUP_PENALTY).otherwise(0.0)
    gap = F.col("source_start") - F.col("__p.source_end")
    span = F.col("record_end") - F.col("__p.record_start")
    merges = (
        (gap >= -EPS) & (gap <= CONTINUITY_GAP + EPS) & ~F.col("on_drop") & (F.col("slot") != F.col("slots") - 1) & same_phase
        & (span <= MAX_CUT + EPS) & (F.col("__p.source_start") + span >= F.col("source_start") - EPS)
    )
    jump = F.when((F.col("clip_path") == F.col("__p.clip_path")) & (F.abs(gap) <= JUMP_GAP + EPS) & ~merges, -JUMP_PENALTY).otherwise(0.0)
    terms = {"motion": MOTION_WEIGHT * cosine, "eye_trace": eye, "grammar": grammar, "daylight_switch": day, "same_group": group, "jump_cut": jump}
    out = rows.select(PLAN, "slot", *[t.alias(n) for n, t in terms.items()])
    return out.withColumn("total", sum((F.col(n) for n in terms), F.lit(0.0)))


def kinship(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Visual kinship of two moments in structs (shot_size, entry_focus, exit_focus, daylight, motion), 0..1."""
    x, y = F.col(a), F.col(b)
    signal = lambda m: (m["shot_size"] != "") | m["entry_focus"].isNotNull() | m["exit_focus"].isNotNull()
    size = (x["shot_size"] != "") & (y["shot_size"] != "")
    apart = _distance(x["entry_focus"], y["entry_focus"])
    day = (x["daylight"] != "") & (y["daylight"] != "")
    moving = (x["motion"] > EPS) | (y["motion"] > EPS)
    peak = F.greatest(x["motion"], y["motion"])
    parts = [
        (0.5, size, (x["shot_size"] == y["shot_size"]).cast("double")),
        (0.3, apart.isNotNull(), F.greatest(F.lit(0.0), 1 - F.coalesce(apart, F.lit(0.0)) / EYE_DIAGONAL)),
        (0.1, day, (x["daylight"] == y["daylight"]).cast("double")),
        (0.1, moving, 1 - F.abs(x["motion"] - y["motion"]) / F.when(moving, peak)),
    ]
    score = sum((F.when(known, w * v).otherwise(0.0) for w, known, v in parts), F.lit(0.0))
    weight = sum((F.when(known, w).otherwise(0.0) for w, known, _ in parts), F.lit(0.0))
    value = F.when(signal(x) & signal(y) & (weight > EPS), score / F.when(weight > EPS, weight)).otherwise(0.0)
    return pairs.withColumn("kinship", value)


def pace_signals(moments: DataFrame, sections: DataFrame, key: str = "project") -> DataFrame:
    """Signs that a cut should be slower: calm footage by the second, a quiet song. Notches 0..2."""
    peak = moments.groupBy(key).agg(F.max("motion").alias("__peak"))
    sec = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    # Motion is judged against the peak of the pool, so the calm seconds are summed per (motion, highlight) first.
    level = moments.groupBy(key, "motion", "highlight").agg(F.sum(sec).alias("__sec")).join(peak, key)
    calm = (F.col("motion") / F.when(F.col("__peak") > EPS, F.col("__peak")) <= CALM_MOTION + EPS) & (F.col("highlight") <= CALM_HIGHLIGHT + EPS)
    footage = level.groupBy(key).agg(
        F.max("__peak").alias("__peak"), (F.sum(F.when(calm, F.col("__sec")).otherwise(0.0)) / F.nullif(F.sum("__sec"), F.lit(0.0))).alias("calm_share")
    ).withColumn("calm_share", F.when(F.col("__peak") > EPS, F.col("calm_share"))).drop("__peak")
    length = F.col("end_s") - F.col("start_s")
    song = sections.groupBy(key).agg((F.sum(length * F.col("energy")) / F.nullif(F.sum(length), F.lit(0.0))).alias("mean_energy"))
    out = footage.join(song, key, "full")
    one = F.coalesce((F.col("calm_share") >= CALM_SHARE - EPS).cast("bigint"), F.lit(0).cast("bigint"))
    two = F.coalesce((F.col("mean_energy") <= QUIET_ENERGY + EPS).cast("bigint"), F.lit(0).cast("bigint"))
    return out.withColumn("notches", one + two)


def scorecard_rows(
    entries: DataFrame, dips: DataFrame, gaps: DataFrame, sfx: DataFrame, drops: DataFrame
) -> DataFrame:
    """One row per measured item: (plan_id, name, item, ok). Failing rows are the culprits of their metric.

    ``gaps`` (gap_start, gap_end), ``sfx`` (kind, time, length), ``drops`` (t).
    """
    e = entries
    on_screen = F.col("peak_source").between(F.col("source_start") - EPS, F.col("source_end") + EPS)
    hit = on_screen & (F.abs(F.col("peak_source") - F.col("source_start")) <= COINCIDENCE_TOL + EPS)
    coincidence = e.where((F.col("record_start") > EPS) & (F.col("peak_source") >= 0)).select(
        PLAN, F.lit("coincidence").alias("name"), F.col("slot").alias("item"), hit.alias("ok")
    )
    short = F.col("record_end") - F.col("record_start") >= MIN_SLOT - EPS
    slivers = e.select(PLAN, F.lit("slivers").alias("name"), F.col("slot").alias("item"), short.alias("ok"))
    dip_rows = dips.select(PLAN, F.lit("slivers").alias("name"), F.lit(-1).cast("bigint").alias("item"), (F.col("dip_len") >= MIN_SLOT - EPS).alias("ok"))
    # An item number for silences and drops: their place in the plan's list.
    g = settle(scan(gaps, [PLAN], ["gap_start", "gap_end"], F.floor(F.col("gap_start") / 600), item=row_index()))
    g = g.withColumn("item", F.col("item") - 1)
    reach = CARRIER_TOL + EPS
    cues = sfx.where(F.col("kind").isin(*CARRIERS)).select(
        PLAN, (F.col("time") - reach).alias("c0"), (F.col("time") + F.greatest("length", F.lit(0.0)) + reach).alias("c1")
    )
    by_cue = range_join(g, cues, [PLAN], ("gap_start", "gap_end"), ("c0", "c1"), BIN).select(PLAN, "item").distinct()
    tol = DROP_TOL + EPS
    ends = g.select(PLAN, "item", (F.col("gap_end") - tol).alias("e0"), (F.col("gap_end") + tol).alias("e1"))
    by_drop = range_join(ends, drops.select(PLAN, "t").distinct(), [PLAN], ("e0", "e1"), ("t", "t"), BIN).select(PLAN, "item").distinct()
    carried = by_cue.unionByName(by_drop).distinct().withColumn("ok", F.lit(True))
    silence = g.select(PLAN, "item").join(carried, [PLAN, "item"], "left").select(
        PLAN, F.lit("silence").alias("name"), "item", F.coalesce("ok", F.lit(False)).alias("ok")
    )
    d = settle(scan(drops, [PLAN], ["t"], F.floor(F.col("t") / 600), item=row_index()).withColumn("item", F.col("item") - 1))
    near = range_join(
        d.select(PLAN, "item", (F.col("t") - tol).alias("d0"), (F.col("t") + tol).alias("d1")), e.select(PLAN, "record_start").distinct(),
        [PLAN], ("d0", "d1"), ("record_start", "record_start"), BIN,
    ).select(PLAN, "item").distinct().withColumn("ok", F.lit(True))
    drop_rows = d.select(PLAN, "item").join(near, [PLAN, "item"], "left").select(
        PLAN, F.lit("drops").alias("name"), "item", F.coalesce("ok", F.lit(False)).alias("ok")
    )
    sized = scan(e.select(PLAN, "slot", "shot_size"), [PLAN], ["slot"], by_slot(), __p=previous("shot_size"))
    grammar = sized.where((F.col("shot_size") != "") & (F.col("__p") != "")).select(
        PLAN, F.lit("grammar").alias("name"), F.col("slot").alias("item"), (F.col("shot_size") != F.col("__p")).alias("ok")
    )
    out = coincidence
    for part in (slivers, dip_rows, silence, drop_rows, grammar):
        out = out.unionByName(part)
    return out


def scorecard(rows: DataFrame, plans: DataFrame, loudness: DataFrame | None = None) -> DataFrame:
    """Metrics of every plan in long form: value, passed, hard, sample and the metric's share of the aggregate."""
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("hard")) for n, h in (
        ("coincidence", True), ("silence", True), ("slivers", True), ("drops", False), ("grammar", False)
    )])
    every = plans.select(PLAN, F.explode(names).alias("m")).select(PLAN, "m.*")
    counted = rows.groupBy(PLAN, "name").agg(F.count("*").alias("sample"), F.sum(F.col("ok").cast("bigint")).alias("good"))
    m = every.join(counted, [PLAN, "name"], "left").fillna(0, ["sample", "good"])
    n, good, name = F.col("sample"), F.col("good"), F.col("name")
    rate = F.when(n > 0, good / F.when(n > 0, n))
    value = (
        F.when(name == "slivers", (n - good).cast("double")).when(name == "grammar", F.coalesce(1 - rate, F.lit(0.0)))
        .otherwise(F.coalesce(rate, F.lit(1.0)))
    )
    passed = F.when(n == 0, True).when(name == "coincidence", rate >= COINCIDENCE_MIN - EPS).otherwise(good == n)
    share = F.when(name == "slivers", (good == n).cast("double")).when(name == "grammar", 1 - F.col("value")).otherwise(F.col("value"))
    m = m.withColumn("value", value).withColumn("passed", passed).withColumn("share", clamp(share, 0.0, 1.0)).drop("good")
    if loudness is None:
        return m
    off = F.abs(F.col("lufs") - LOUDNESS)
    loud = loudness.select(
        PLAN, F.lit("loudness").alias("name"), F.lit(True).alias("hard"), F.lit(1).cast("bigint").alias("sample"), F.col("lufs").alias("value"),
        (off <= LOUDNESS_TOL + EPS).alias("passed"), F.greatest(F.lit(0.0), 1 - off / LOUDNESS_TOL).alias("share"),
    )
    return m.unionByName(loud)


def culprits(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("ok") & (F.col("item") >= 0)).select(PLAN, "name", F.col("item").alias("culprit"))


def card_totals(card: DataFrame) -> DataFrame:
    """Acceptance and aggregate per plan; metrics without samples do not count, hard ones count double."""
    weight = F.when(F.col("sample") > 0, F.when(F.col("hard"), 2.0).otherwise(1.0)).otherwise(0.0)
    ok = F.col("passed") | ~F.col("hard") | (F.col("sample") == 0)
    out = card.groupBy(PLAN).agg(F.sum(weight).alias("__w"), F.sum(weight * F.col("share")).alias("__s"), F.bool_and(ok).alias("accepted"))
    total = F.when(F.col("__w") > EPS, F.col("__s") / F.when(F.col("__w") > EPS, F.col("__w"))).otherwise(1.0)
    return out.select(PLAN, "accepted", total.alias("aggregate"))


def best_plan(totals: DataFrame, project: str = "project", order: str = "pass_no") -> DataFrame:
    """The plan that wins pass by pass: acceptance first, then an aggregate more than 1e-6 better.

    Only plans above everything before them can take the lead, so those records are all the walk needs.
    """
    best_state = totals.groupBy(project).agg(F.max("accepted").alias("__any"))
    chunk = F.floor(F.col(order) / 4096)
    live = attach(totals, best_state, [project], chunk).where(F.col("accepted") == F.col("__any"))
    records = scan(live, [project], [order], chunk, __top=max_before("aggregate"))
    records = records.where(F.col("__top").isNull() | (F.col("aggregate") > F.col("__top")))
    row_type = f"struct<o:bigint,plan:{dict(totals.dtypes)[PLAN]},v:double>"
    walk = F.aggregate(
        F.col("l"), F.lit(None).cast(row_type),
        lambda best, x: F.when(best.isNull() | (x["v"] > best["v"] + EPS), x).otherwise(best),
    )
    rows = records.groupBy(project).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(PLAN).alias("plan"), F.col("aggregate").alias("v")))).cast(f"array<{row_type}>").alias("l"),
        F.first("__any").alias("accepted"),
    ).withColumn("w", walk)
    return rows.select(project, F.col("w.plan").alias(PLAN), "accepted", F.col("w.v").alias("aggregate"))


def match_versions(old: DataFrame, new: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Shots two versions share: new entries in order take the unclaimed old one of their clip they overlap most.

    Entries meet where their source ranges overlap; who takes what is settled along these overlaps (``greedy.best_partners``).
    """
    keys = [pair, "clip_path"]
    look = lambda df, n: df.where(F.col("source_end") > F.col("source_start")).select(*keys, F.col("slot").alias(n), F.col("source_start").alias(f"{n}0"), F.col("source_end").alias(f"{n}1"))
    both = range_join(look(new, "a"), look(old, "b"), keys, ("a0", "a1"), ("b0", "b1"), 64.0)
    value = F.least("a1", "b1") - F.greatest("a0", "b0")
    edges = both.select(*keys, "a", "b", value.alias("value")).where(F.col("value") > 0)
    return best_partners(edges, keys).select(pair, F.col("a").alias("new_slot"), F.col("b").alias("old_slot"))


def diff_plans(old: DataFrame, new: DataFrame, plans: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Change list from old to new entries with the value that changed before (``was``) and after (``now``); ``plans`` has (pair, old_duration, new_duration, old_tempo, new_tempo)."""
    pairs = settle(match_versions(old, new, pair))
    name = basename(F.regexp_replace("clip_path", r"\\", "/"))
    at = F.col("record_start")

    def change(kind: str, rank: int, was: Column | None = None, now: Column | None = None) -> Column:
        value = lambda c: (F.lit(None) if c is None else c).cast("double")
        return F.struct(F.lit(kind).alias("kind"), value(was).alias("was"), value(now).alias("now"), F.lit(rank).alias("__rank"))

    def rows(df: DataFrame, changes: list[Column], clip: Column = name, when: Column = at, slot: Column = F.col("slot")) -> DataFrame:
        """All changes of a row at once: the table is read once, whatever can have changed."""
        out = df.select(pair, when.alias("at"), clip.alias("clip"), slot.alias("__slot"), F.explode(F.array_compact(F.array(*changes))).alias("c"))
        return out.select(pair, "c.kind", "at", "clip", "c.was", "c.now", "c.__rank", "__slot")

    added = new.join(pairs.select(pair, F.col("new_slot").alias("slot")), [pair, "slot"], "left_anti")
    removed = old.join(pairs.select(pair, F.col("old_slot").alias("slot")), [pair, "slot"], "left_anti")
    look = ["source_start", "source_end", "record_start", "record_end", "transition"]
    was = old.select(pair, F.col("slot").alias("old_slot"), *[F.col(c).alias(f"o_{c}") for c in look])
    kept = new.join(pairs.withColumnRenamed("new_slot", "slot"), [pair, "slot"]).join(was, [pair, "old_slot"])
    trimmed = (F.abs(F.col("source_start") - F.col("o_source_start")) > CHANGE_EPS) | (F.abs(F.col("source_end") - F.col("o_source_end")) > CHANGE_EPS)
    longer = (F.col("record_end") - F.col("record_start")) - (F.col("o_record_end") - F.col("o_record_start"))
    dissolve, was_dissolve = F.col("transition") > CHANGE_EPS, F.col("o_transition") > CHANGE_EPS
    length, was_length = F.col("record_end") - F.col("record_start"), F.col("o_record_end") - F.col("o_record_start")
    whole = plans.withColumn("__d", F.col("new_duration") - F.col("old_duration")).withColumn("__t", F.col("new_tempo") - F.col("old_tempo"))
    tempos = (F.col("old_tempo") != 0) & (F.col("new_tempo") != 0) & (F.abs("__t") > TEMPO_CHANGE)
    parts = [
        rows(added, [change("added", 0)]), rows(removed, [change("removed", 1)]),
        rows(kept, [
            F.when(trimmed, change("trimmed", 2, F.col("o_source_start"), F.col("source_start"))),
            F.when(~trimmed & (F.abs(longer) > CHANGE_EPS), change("retimed", 2, was_length, length)),
            F.when(dissolve != was_dissolve, change("transition", 3, F.col("o_transition"), F.col("transition"))),
        ]),
        rows(whole, [
            F.when(F.abs("__d") > LENGTH_CHANGE, change("length", 4, F.col("old_duration"), F.col("new_duration"))),
            F.when(tempos, change("tempo", 5, F.col("old_tempo"), F.col("new_tempo"))),
        ], F.lit(""), F.lit(0.0), F.lit(0).cast("bigint")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def change_lines(changes: DataFrame, pair: str = "pair_id") -> DataFrame:
    """The changes as numbered lines: by record position, whole-cut changes last."""
    plan_level = F.col("kind").isin("length", "tempo").cast("int")
    # A pair's changes of one shot keep the order trim or retime, then transition.
    rank = F.when(F.col("__rank") >= 2, 2).otherwise(F.col("__rank"))
    rows = changes.withColumns({"__last": plan_level, "__k": rank})
    chunk = F.col("__last") * 1_000_000 + F.floor(F.col("at") / 600)
    out = scan(rows, [pair], ["__last", "at", "__k", "__slot", "__rank"], chunk, line_no=row_index())
    return out.select(pair, "line_no", "kind", "at", "clip", "was", "now")


def change_summary(changes: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Added, removed and other changes per pair."""
    return changes.groupBy(pair).agg(
        F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"),
        F.count_if(~F.col("kind").isin("added", "removed")).alias("other"),
    )


def _mmss(seconds: Column) -> Column:
    total = F.rint(F.greatest(F.lit(0.0), seconds)).cast("bigint")
    return F.concat(F.floor(total / 60), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))


def change_text() -> Column:
    """One sentence for a change of :func:`diff_plans`; halves are rounded to even."""
    decimals = lambda c, form: F.call_function("format_number", c, F.lit(form))
    clip, at, by = F.coalesce("clip", F.lit("")), _mmss(F.col("at")), F.col("now") - F.col("was")
    by = F.concat(decimals(F.abs(by), "0.0"), F.when(by > 0, "s longer").otherwise("s shorter"))
    texts = {
        "added": ("Added ", clip, " at ", at), "removed": ("Removed ", clip, " (was at ", at, ")"), "trimmed": ("Re-trimmed ", clip, " at ", at),
        "retimed": (clip, " is ", by, " at ", at),
        "transition": (clip, " is now ", F.when(F.col("now") > CHANGE_EPS, "a dissolve").otherwise("a hard cut"), " at ", at),
        "length": ("Cut is ", by, " (", _mmss(F.col("was")), " -> ", _mmss(F.col("now")), ")"),
        "tempo": ("Tempo ", decimals(F.col("was"), "0"), " -> ", decimals(F.col("now"), "0"), " BPM"),
    }
    out = F.lit(None).cast("string")
    for kind, parts in texts.items():
        out = F.when(F.col("kind") == kind, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(out)
    return out


def change_notes(changes: DataFrame, plans: DataFrame, pair: str = "pair_id", old: str = "previous", new: str = "current") -> DataFrame:
    """The counts of :func:`change_summary` and a ``note`` for every pair of ``plans`` or ``changes``: counts, then one line per change in the order of :func:`change_lines`."""
    order = [F.col("kind").isin("length", "tempo").alias("last"), F.coalesce("at", F.lit(0.0)).alias("at"), F.least("__rank", F.lit(2)).alias("k"), "__slot", "__rank"]
    rows = changes.select(pair, "kind", F.struct(*order, change_text().alias("text")).alias("line"))
    # A pair without changes has a row of no kind.
    every = rows.unionByName(plans.select(pair), allowMissingColumns=True)
    kind = F.col("kind")
    counted = every.groupBy(pair).agg(
        F.count_if(kind == "added").alias("added"), F.count_if(kind == "removed").alias("removed"), F.count_if(~kind.isin("added", "removed")).alias("other"),
        F.array_sort(F.collect_list("line"))["text"].alias("texts"),
    )
    head = F.concat(F.lit(f"Changes: {old} -> {new}\n  "), "added", F.lit(" added, "), "removed", F.lit(" removed, "), "other", F.lit(" other\n"))
    lines = F.array_join(F.transform("texts", lambda t: F.concat(F.lit("\n  - "), t)), "")
    note = F.when(F.size("texts") > 0, F.concat(head, lines)).otherwise(f"No editorial changes between {old} and {new}.")
    return counted.select(pair, "added", "removed", "other", note.alias("note"))


def snapshots(saves: DataFrame, project: str = "project", order: str = "saved_no", chunk: Column | None = None, keep: int = SNAPSHOTS) -> DataFrame:
    """Saves that differ from the one before them, the newest ``keep`` per project, newest first.

    ``saves`` has (project, order, plan_hash, shots, duration); the rank filter prunes before the shuffle.
    """
    back = scan(saves, [project], [order], F.floor(F.col(order) / 4096) if chunk is None else chunk, __p=previous("plan_hash"))
    fresh = back.where(F.col("__p").isNull() | (F.col("__p") != F.col("plan_hash"))).drop("__p")
    newest = F.row_number().over(Window.partitionBy(project).orderBy(F.desc(order)))
    return fresh.withColumn("age", newest).where(F.col("age") <= keep).withColumn("age", F.col("age").cast("bigint"))


def append_snapshot(history: DataFrame, saves: DataFrame, project: str = "project", order: str = "saved_no") -> DataFrame:
    """Stored history plus new saves under the same rules; restoring a snapshot is one more save."""
    return snapshots(history.drop("age").unionByName(saves, allowMissingColumns=True), project, order)


def plan_hash(columns: list[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*columns)))


def plan_summaries(plans: DataFrame, entries: DataFrame) -> DataFrame:
    """Style from the first ``style "x"`` note, duration and cut count."""
    cuts = entries.groupBy(PLAN).agg(F.count("*").alias("cuts"))
    named = F.filter("notes", lambda x: x.rlike(r'^style "[^"]+"'))
    style = F.when(F.size(named) > 0, F.regexp_extract(F.get(named, F.lit(0)), r'^style "([^"]+)"', 1)).otherwise("auto")
    out = plans.join(cuts, PLAN, "left")
    return out.select(PLAN, style.alias("style"), "duration", F.coalesce("cuts", F.lit(0)).alias("cuts"), *([F.col("saved_at")] if "saved_at" in plans.columns else []))


def coverage(moments: DataFrame, clips: DataFrame, target: float | None = None, key: str = "project") -> DataFrame:
    """What a project's footage covers: counts, unique seconds, unusable share, roles, heroes, groups, findings."""
    roles = list(dict.fromkeys(ROLE_FOR_PHASE.values()))
    seen = (F.col("role") != "") | (F.col("hero") > EPS) | (F.col("grp") != "")
    facts = moments.groupBy(key).agg(
        F.count("*").alias("moments"), *[F.count_if(F.col("role") == r).alias(r) for r in roles],
        F.count_if(F.col("hero") >= HERO_MIN).alias("heroes"), F.max(seen).alias("vision"),
    )
    groups = moments.where(F.col("grp") != "").groupBy(key, "grp").agg(F.lit(1).alias("__x")).groupBy(key).agg(F.count("*").alias("groups"))
    merged = union_intervals(moments, [key, "clip_path"], "start_s", "end_s")
    unique = merged.groupBy(key).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("usable_seconds"))
    usable = clips.groupBy(key).agg(
        F.count("*").alias("clips"), F.sum("duration").alias("__d"), F.sum(F.col("usable_ratio") * F.col("duration")).alias("__u")
    )
    out = usable.join(facts, key, "left").join(groups, key, "left").join(unique, key, "left")
    zero = ["moments", *roles, "heroes", "groups", "usable_seconds"]
    out = out.fillna(0, zero).withColumn("vision", F.coalesce("vision", F.lit(False)))
    share = F.when(F.col("__d") > EPS, clamp(1 - F.col("__u") / F.when(F.col("__d") > EPS, F.col("__d")), 0.0, 1.0)).otherwise(0.0)
    out = out.withColumn("unusable_share", share)
    risk = F.lit(target) > F.col("usable_seconds") + EPS if target else F.lit(None).cast("boolean")
    notes = [
        F.when(risk, F.lit("short_of_target")), F.when((F.col("__d") > EPS) & (F.col("unusable_share") >= 0.5), F.lit("mostly_unusable")),
        *[F.when(F.col("vision") & (F.col(c) == 0), F.lit(f"no_{c}")) for c in ("opener", "closer", "heroes")],
        F.when(F.col("vision") & (F.col("groups") == 1) & (F.col("moments") >= 2), F.lit("one_group")),
    ]
    return out.withColumn("repetition_risk", risk).withColumn("findings", F.array_compact(F.array(*notes))).drop("__d", "__u")


def pool_dossier(moments: DataFrame, key: str = "project", tags: int = 8, labels: int = 10) -> DataFrame:
    """Facets of a pool in long form: daylight, shot size, most common tags, first labels and heroes."""

    def counts(facet: str, value: Column, df: DataFrame) -> DataFrame:
        g = df.select(key, value.alias("value"), "mid").where((F.col("value").isNotNull()) & (F.trim("value") != ""))
        return g.groupBy(key, "value").agg(F.count("*").alias("n"), F.min("mid").alias("__first")).select(
            key, F.lit(facet).alias("facet"), "value", "n", "__first"
        )

    tag_rows = moments.select(key, "mid", F.posexplode("tags").alias("__i", "tag")).withColumn("mid", F.col("mid") * 100 + F.col("__i"))
    parts = {
        "daylight": counts("daylight", F.col("daylight"), moments), "shot_size": counts("shot_size", F.col("shot_size"), moments),
        "tag": counts("tag", F.col("tag"), tag_rows), "label": counts("label", F.trim("label"), moments),
    }
    common = Window.partitionBy(key).orderBy(F.desc("n"), "__first")
    early = Window.partitionBy(key).orderBy("__first")
    parts = {n: df.withColumn("rank", F.row_number().over(early if n == "label" else common)) for n, df in parts.items()}
    parts["tag"] = parts["tag"].where(F.col("rank") <= tags)
    parts["label"] = parts["label"].where(F.col("rank") <= labels)
    heroes = moments.groupBy(key).agg(F.count_if(F.col("hero") >= HERO_MIN).alias("n")).select(
        key, F.lit("heroes").alias("facet"), F.lit("").alias("value"), "n", F.lit(1).alias("rank")
    )
    out = heroes.withColumn("rank", F.col("rank").cast("bigint"))
    for df in parts.values():
        out = out.unionByName(df.drop("__first").withColumn("rank", F.col("rank").cast("bigint")))
    return out


def chapters(entries: DataFrame, gap: float = CHAPTER_SECONDS) -> DataFrame:
    """A new chapter where scene (else clip) changes and the last chapter is at least ``gap`` seconds back.

    ``entries`` needs grp, label and title parts. The walk sees one time per scene change, in blocks of time.
    """
    key = F.when(F.coalesce("grp", F.lit("")) != "", F.col("grp")).otherwise(F.col("clip_path"))
    stem = F.regexp_replace(basename("clip_path"), r"(?<=.)\.[^.]*$", "")
    title = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.nullif(F.col("moment_label"), F.lit("")), stem)
    rows = entries.withColumns({"__key": key, "title": title})
    back = scan(rows, [PLAN], ["record_start", "slot"], F.floor(F.col("record_start") / 600), __p=previous("__key"))
    changes = settle(back.where(F.col("__p").isNull() | (F.col("__p") != F.col("__key"))).select(
        PLAN, "slot", "title", F.when(F.col("__p").isNull(), 0.0).otherwise(F.col("record_start")).alias("start_s")
    ))
    kept = spaced_in_time(changes, [PLAN], "start_s", "slot", gap)
    numbered = scan(kept, [PLAN], ["start_s", "slot"], F.floor(F.col("start_s") / 600), chapter=row_index())
    return numbered.select(PLAN, "slot", "chapter").join(changes, [PLAN, "slot"]).select(PLAN, "chapter", "start_s", "title")


def thumbnails(entries: DataFrame, k: int = 6) -> DataFrame:
    """Stills hero first, then score and time; one per scene group before a group may repeat."""
    order = [F.desc(F.coalesce("hero", F.lit(0.0))), F.desc("score"), F.asc("record_start"), F.asc("slot")]
    grp = F.coalesce("grp", F.lit(""))
    rows = entries.withColumn("__g", grp).withColumn("__h", F.coalesce("hero", F.lit(0.0)))
    pos = F.struct((-F.col("__h")).alias("a"), (-F.col("score")).alias("b"), "record_start", "slot")
    firsts = rows.where(F.col("__g") != "").groupBy(PLAN, "__g").agg(F.min(pos).alias("__p")).select(PLAN, F.col("__p.slot").alias("slot"))
    fresh = rows.where(F.col("__g") == "").select(PLAN, "slot").unionByName(firsts).withColumn("__fresh", F.lit(0))
    # With fewer scenes than stills, the repeats needed are among the first 2k rows of the plan.
    head = rows.withColumn("__r", F.row_number().over(Window.partitionBy(PLAN).orderBy(*order))).where(F.col("__r") <= 2 * k)
    pool = rows.join(fresh, [PLAN, "slot"]).unionByName(
        head.drop("__r").join(fresh.select(PLAN, "slot"), [PLAN, "slot"], "left_anti").withColumn("__fresh", F.lit(1))
    )
    rank = F.row_number().over(Window.partitionBy(PLAN).orderBy("__fresh", *order))
    return pool.withColumn("pick", rank).where(F.col("pick") <= k).select(PLAN, F.col("pick").cast("bigint").alias("pick"), "slot")


def _top_words(words: DataFrame, k: int) -> DataFrame:
    counted = words.groupBy(PLAN, "tag").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(PLAN).orderBy(F.desc("n"), "tag"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def plan_tags(matched: DataFrame, k: int = 12) -> DataFrame:
    """Most frequent tags of the moments a plan used. ``matched`` has (plan_id, tags)."""
    return _top_words(matched.select(PLAN, F.explode("tags").alias("tag")), k)


def label_tags(entries: DataFrame, k: int = 12) -> DataFrame:
    """Tags from the entries' own labels: words of three letters or more without filler words."""
    words = F.regexp_extract_all(F.lower(F.coalesce("label", F.lit(""))), F.lit(r"[a-z0-9äöüß]+"), F.lit(0))
    rows = entries.select(PLAN, F.explode(words).alias("tag")).where((F.length("tag") >= 3) & ~F.col("tag").isin(*TAG_STOPWORDS))
    return _top_words(rows, k)


def derive_cues(plans: DataFrame, phases: DataFrame, drops: DataFrame, dips: DataFrame, entries: DataFrame) -> DataFrame:
    """Sound cues of a cut: opening bed, risers into act changes, hits, sub-drops, whooshes on the fastest cuts; ``note`` is a code.

    ``plans`` (duration, music_in), ``phases`` (i, span_start, span_end, label), ``drops`` (t) are forced cuts.
    """
    live = plans.where(F.col("duration") > EPS).select(PLAN, "duration", "music_in").join(entries.select(PLAN).distinct(), PLAN)
    base = phases.select(PLAN, "i", "span_start", "span_end", "label").join(live, PLAN)
    opening = base.groupBy(PLAN).agg(F.min(F.struct("i", (F.col("span_end") - F.col("span_start")).alias("len"))).alias("o"))
    first = live.join(opening, PLAN, "left").select(
        PLAN, F.lit(0.0).alias("time"), F.coalesce(F.col("o.len"), F.least(F.lit(AUTO_OPENING), F.col("duration"))).alias("length"),
        F.lit("ambience").alias("kind"), F.lit("opening").alias("note"),
    ).where(F.col("length") > EPS)
    inner = (F.col("t") > EPS) & (F.col("t") < F.col("duration") - EPS)
    climax = base.where(F.col("label") == "climax").groupBy(PLAN).agg(F.min(F.struct("i", F.col("span_start").alias("t"), "duration")).alias("c")).select(PLAN, "c.t", "c.duration").where(inner)
    hits = climax.select(PLAN, "t", "duration", F.lit("climax").alias("note")).unionByName(
        drops.select(PLAN, "t").join(live.select(PLAN, "duration"), PLAN).select(PLAN, "t", "duration", F.lit("drop").alias("note"))
    )
    hits = hits.select(PLAN, F.col("t").alias("time"), F.least(F.lit(IMPACT_SECONDS), F.col("duration") - F.col("t")).alias("length"), F.lit("impact").alias("kind"), "note")
    booms = dips.join(live.select(PLAN), PLAN).select(PLAN, F.col("dip_start").alias("time"), F.col("dip_len").alias("length"), F.lit("sub-drop").alias("kind"), F.lit("title").alias("note"))
    essential = settle(first.unionByName(hits).unionByName(booms))
    nxt = scan(base, [PLAN], ["i"], F.lit(0), __n=following("label"))
    length = F.least(F.lit(RISER_MAX), (F.col("span_end") - F.col("span_start")) / 2)
    risers = nxt.where(
        F.col("__n").isNotNull() & (F.col("__n") != F.col("label")) & (F.col("span_end") > EPS) & (F.col("span_end") < F.col("duration") - EPS) & (length > EPS)
    ).select(PLAN, (F.col("span_end") - length).alias("time"), length.alias("length"), F.lit("riser").alias("kind"), F.concat("label", F.lit(">"), "__n").alias("note"), (F.col("__n") != "climax").alias("__late"))
    room = live.join(essential.groupBy(PLAN).agg(F.count("*").alias("__e")), PLAN, "left").select(
        PLAN, (F.greatest(F.lit(1), F.ceil(F.col("duration") / CUE_SECONDS)) - F.coalesce("__e", F.lit(0))).alias("room")
    )
    # At most four act changes per plan, so the rank below sorts a handful of rows.
    order = F.row_number().over(Window.partitionBy(PLAN).orderBy("__late", "time"))
    risers = risers.withColumn("__r", order).join(room, PLAN).where(F.col("__r") <= F.col("room")).drop("__late", "__r", "room")
    placed = settle(essential.unionByName(risers))
    left = room.join(placed.where("kind = 'riser'").groupBy(PLAN).agg(F.count("*").alias("__k")), PLAN, "left").select(
        PLAN, F.least(F.col("room") - F.coalesce("__k", F.lit(0)), F.lit(WHOOSH_MAX)).alias("room")
    )
    cuts = entries.join(live.select(PLAN, "duration"), PLAN).where((F.col("record_start") > EPS) & (F.col("record_start") < F.col("duration") - EPS))
    clear = WHOOSH_CLEAR - EPS
    near = range_join(
        cuts.select(PLAN, "slot", "record_start"), placed.select(PLAN, (F.col("time") - clear).alias("p0"), (F.col("time") + F.col("length") + clear).alias("p1")),
        [PLAN], ("record_start", "record_start"), ("p0", "p1"), BIN,
    ).where((F.col("record_start") > F.col("p0")) & (F.col("record_start") < F.col("p1"))).select(PLAN, "slot").distinct()
    free = cuts.join(near, [PLAN, "slot"], "left_anti")
    start = F.greatest(F.lit(0.0), F.col("record_start") - WHOOSH_SECONDS / 2)
    closed = (start - clear, start + WHOOSH_SECONDS + clear)
    fast = F.struct((F.col("record_end") - F.col("record_start")).alias("len"), F.col("record_start").alias("t"), "slot")
    apart = spaced_picks(free, [PLAN], F.col("record_start"), closed, fast, WHOOSH_SECONDS + 2 * clear, WHOOSH_MAX, "slot")
    # At most WHOOSH_MAX rows per plan.
    nth = F.row_number().over(Window.partitionBy(PLAN).orderBy(fast))
    chosen = free.join(apart, [PLAN, "slot"]).withColumn("__nth", nth).join(left, PLAN).where(F.col("__nth") <= F.col("room"))
    whooshes = chosen.select(PLAN, F.greatest(F.lit(0.0), F.col("record_start") - WHOOSH_SECONDS / 2).alias("time"), F.lit(WHOOSH_SECONDS).alias("length"), F.lit("whoosh").alias("kind"), F.lit("fast_cut").alias("note"))
    cues = settle(placed.unionByName(whooshes))
    entry = live.where(F.col("music_in") > EPS).select(PLAN, "music_in")
    off = F.abs(F.col("time") + F.col("length") - F.col("music_in"))
    closest = cues.where("kind = 'riser'").join(entry, PLAN).groupBy(PLAN, "music_in").agg(
        F.min(F.struct(F.round(off, 9).alias("d"), F.col("time"), F.col("length"))).alias("n")
    )
    moved = closest.where(F.col("n.d") <= 1.0 + EPS).select(PLAN, F.col("n.time").alias("time"), F.lit("riser").alias("kind"), F.col("music_in").alias("__to"))
    retimed = cues.join(moved, [PLAN, "time", "kind"], "left")
    shifted = F.greatest(F.lit(0.0), F.col("__to") - F.col("length"))
    retimed = retimed.select(
        PLAN, F.when(F.col("__to").isNotNull(), shifted).otherwise(F.col("time")).alias("time"),
        F.when(F.col("__to").isNotNull(), F.col("__to") - shifted).otherwise(F.col("length")).alias("length"), "kind",
        F.when(F.col("__to").isNotNull(), F.concat("note", F.lit("+music_entry"))).otherwise(F.col("note")).alias("note"),
    )
    lead = F.least(F.lit(RISER_MAX), F.col("music_in"))
    fresh = entry.join(moved.select(PLAN), PLAN, "left_anti").where(lead > EPS).select(
        PLAN, (F.col("music_in") - lead).alias("time"), lead.alias("length"), F.lit("riser").alias("kind"), F.lit("music_entry").alias("note")
    )
    return retimed.unionByName(fresh)


def rank_elements(cues: DataFrame, elements: DataFrame) -> DataFrame:
    """The library file of every cue: nearest duration when the cue names one, then confidence, then path.

    ``cues`` has (cue_id, kind, target or NULL), ``elements`` (path, duration, kind, confidence). Files compete
    per kind and duration first; a cue then looks at the next shorter and next longer duration only.
    """
    kind = F.coalesce(*[F.when(F.col("kind") == c, F.lit(e)) for c, e in CUE_TO_ELEMENT.items()])
    want = cues.withColumn("element", kind).where(F.col("element").isNotNull())
    files = elements.where((F.col("duration") > EPS) & F.col("kind").isin(*CUE_TO_ELEMENT.values()))
    best = F.struct((-F.col("confidence")).alias("c"), F.col("path"), F.col("duration"))
    by_length = files.groupBy(F.col("kind").alias("element"), "duration").agg(F.min(best).alias("f"))
    top = files.groupBy(F.col("kind").alias("element")).agg(F.min(best).alias("f"))
    plain = want.where(F.col("target").isNull()).join(top, "element").select("cue_id", "element", "f")
    points = by_length.select("element", F.col("duration").alias("__t"), F.lit(0).alias("__k"), F.col("f"))
    # Cues that want one duration get one answer, so a duration that many want is looked up once.
    aims = want.where(F.col("target").isNotNull())
    asks = aims.select("element", F.col("target").alias("__t"), F.lit(1).alias("__k")).distinct()
    both = points.unionByName(asks, allowMissingColumns=True)
    seen = scan(both, ["element"], ["__t", "__k"], F.floor(F.col("__t") * 16), __before=carry_forward("f"), __after=carry_backward("f")).where("__k = 1")
    near = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.round(F.abs(F.col(f)["duration"] - F.col("__t")), 9).alias("d"), F.col(f).alias("f")))
    found = seen.select("element", F.col("__t").alias("target"), F.least(near("__before"), near("__after"))["f"].alias("f")).where(F.col("f").isNotNull())
    aimed = aims.join(found, ["element", "target"]).select("cue_id", "element", "f")
    out = plain.unionByName(aimed)
    return out.select("cue_id", "element", F.col("f.path").alias("path"), F.col("f.duration").alias("duration"))


def reuse_gaps(placed: DataFrame, key: str = PLAN) -> DataFrame:
    """Time since the same file last played in a plan, and whether that is too soon for its kind."""
    back = scan(placed, [key, "path"], ["time", "cue_id"], F.floor(F.col("time") / 600), __p=previous("time"))
    least = F.coalesce(*[F.when(F.col("element") == k, g) for k, g in REUSE_GAP.items()], F.lit(REUSE_DEFAULT))
    gap = F.col("time") - F.col("__p")
    return back.withColumn("gap_s", gap).withColumn("too_soon", F.coalesce(gap < least - EPS, F.lit(False))).drop("__p")


def average_focus(a: str | Column, b: str | Column) -> Column:
    x, y = col(a), col(b)
    both = F.struct(((x["x"] + y["x"]) / 2).alias("x"), ((x["y"] + y["y"]) / 2).alias("y"))
    return F.when(x.isNotNull() & y.isNotNull(), both).otherwise(F.coalesce(x, y))


def crop_offset(src_w: Column, src_h: Column, dst_w: Column, dst_h: Column, focus: Column) -> Column:
    """Struct (x, y, centred): corner of the crop window in the source scaled to cover the target."""
    real = (src_w > 0) & (src_h > 0)
    scale = F.greatest(dst_w / F.when(real, src_w), dst_h / F.when(real, src_h))
    sw, sh = F.when(real, src_w * scale).otherwise(dst_w), F.when(real, src_h * scale).otherwise(dst_h)

    def one(size: Column, out: Column, f: Column) -> Column:
        slack = size - out
        return F.when(focus.isNull(), slack / 2).otherwise(F.greatest(F.lit(0.0), F.least(slack, f * size - out / 2)))

    x, y = one(sw, dst_w, focus["x"]), one(sh, dst_h, focus["y"])
    centred = focus.isNull() | ((F.abs(x - (sw - dst_w) / 2) <= CENTRE_EPS) & (F.abs(y - (sh - dst_h) / 2) <= CENTRE_EPS))
    return F.struct(x.alias("x"), y.alias("y"), centred.alias("centred"))


def plan_pulse(downbeats: DataFrame, key: str = PLAN) -> DataFrame:
    """Seconds per beat: a quarter of the (upper) median positive gap between downbeats (key, t)."""
    back = scan(downbeats.select(key, "t"), [key], ["t"], F.floor(F.col("t") / 600), __p=previous("t"))
    gaps = back.withColumn("gap", F.col("t") - F.col("__p")).where(F.col("gap") > EPS)
    return pick_ranks(gaps, [key], "gap", lambda n: {"g": F.floor(n / 2)}).select(key, (F.col("g") / 4).alias("pulse"))


def quantize(seconds: str | Column, pulse: str | Column, cap: float | None = None) -> Column:
    """Nearest positive multiple of half a beat; above the cap the largest that fits, else the smaller of both."""
    s, p = col(seconds), col(pulse)
    on = (p > EPS) & (s > EPS)
    unit = F.when(on, p / 2)
    near = F.greatest(F.lit(1), F.bround(s / unit)) * unit
    if cap is not None:
        fits = F.floor((F.lit(cap) + EPS) / unit)
        near = F.when(near <= cap + EPS, near).when(fits < 1, F.least(s, F.lit(cap))).otherwise(fits * unit)
    return F.when(on, near).otherwise(s)
