"""Statistics of decoded pictures and sound samples; one picture is one row with its pixels as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions.columns import clamp, first_by, ramp
from cutlake.functions.ordered import attach, following, previous, scan
from cutlake.functions.staging import settle

# Daylight, shot size and sound element thresholds.
NIGHT_BELOW, GOLDEN_WARMTH, GOLDEN_BELOW, GOLDEN_SATURATION = 60.0, 18.0, 170.0, 25.0
LUMA = (0.2126, 0.7152, 0.0722)
FLAT_GRADIENT, BUSY_SHARE, WIDE_FROM, CLOSE_TO, GRID = 0.5, 0.5, 0.60, 0.35, 4
FULL_SCALE = 0.985
ENVELOPE_RATE, MAX_BUCKETS = 200, 4000
IMPACT_MAX, RISER_MIN, WHOOSH = 2.0, 1.5, (0.3, 3.0)
EARLY_PEAK, BRAAM_PEAK, LATE_PEAK, DECAY_MIN, RISE_MIN, LOW_SHARE, EDGE_MAX = 0.15, 0.35, 0.8, 0.6, 1.5, 0.5, 0.6
CONFIDENCE_FLOOR, EPS = 0.1, 1e-6


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _indexes(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def gradients(luma: Column, w: Column, h: Column) -> Column:
    """Per pixel (gx, gy): central differences, one-sided at the borders."""

    def slope(i: Column, at: Column, size: Column, step: Column) -> Column:
        here, back, ahead = F.get(luma, i), F.get(luma, i - step), F.get(luma, i + step)
        return F.when(at == 0, ahead - here).when(at == size - 1, here - back).otherwise((ahead - back) / 2)

    return F.transform(
        _indexes(w * h),
        lambda i: F.struct(
            slope(i, i % w, w, F.lit(1)).alias("gx"), slope(i, F.floor(i / w).cast("int"), h, w).alias("gy")
        ),
    )


def difference_hash(luma: Column, w: Column, h: Column) -> Column:
    """64 bits: is each of 8×9 block means larger than its left neighbour."""

    def block(r: int, c: int) -> Column:
        y0, y1 = F.floor(h * r / 8).cast("int"), F.floor(h * (r + 1) / 8).cast("int")
        x0, x1 = F.floor(w * c / 9).cast("int"), F.floor(w * (c + 1) / 9).cast("int")
        rows = F.transform(F.sequence(y0, y1 - 1), lambda y: F.slice(luma, y * w + x0 + 1, x1 - x0))
        return F.when((y1 > y0) & (x1 > x0), _mean(F.flatten(rows))).otherwise(0.0)

    means = F.array(*[block(r, c) for r in range(8) for c in range(9)])
    places = F.array(*[F.lit(r * 9 + c) for r in range(8) for c in range(1, 9)])

    def read(m: Column) -> Column:
        return F.aggregate(
            places, F.lit(0).cast("bigint"),
            lambda bits, p: F.shiftleft(bits, 1).bitwiseOR((F.get(m, p) > F.get(m, p - 1)).cast("bigint")),
        )

    return F.transform(F.array(means), read)[0]


def frame_stats(frames: DataFrame, clipped_at: float = 250.0, crushed_at: float = 5.0, chunk: float = 512) -> DataFrame:
    """Brightness, sharpness, blown and crushed share, motion against the previous picture, and picture hash.

    ``frames`` has (clip_id, t, w, h, luma). Only the previous picture of the same clip is needed, so a clip
    is spread over chunks of its time axis.
    """
    paired = scan(frames, ["clip_id"], ["t"], F.floor(F.col("t") / chunk), __back=previous("luma"))
    luma, w, h = F.col("luma"), F.col("w"), F.col("h")
    moved = F.zip_with("luma", "__back", lambda a, b: F.abs(a - b))
    share = lambda test: F.size(F.filter("luma", test)) / F.size("luma")
    return paired.select(
        "clip_id", "t", _mean(luma).alias("brightness"),
        _mean(F.transform(gradients(luma, w, h), lambda g: g["gx"] * g["gx"] + g["gy"] * g["gy"])).alias("sharpness"),
        share(lambda v: v >= clipped_at).alias("clipped"), share(lambda v: v <= crushed_at).alias("crushed"),
        F.coalesce(_mean(moved), F.lit(0.0)).alias("motion"), difference_hash(luma, w, h).alias("phash"),
    )


def _confidence(margin: Column) -> Column:
    return F.bround(0.5 + 0.5 * clamp(margin, 0.0, 1.0), 3)


def daylight(frames: DataFrame) -> DataFrame:
    """Day, golden or night from the channel means of a colour picture (arrays r, g, b)."""
    spread = F.transform(
        F.arrays_zip("r", "g", "b"), lambda p: F.greatest(p["r"], p["g"], p["b"]) - F.least(p["r"], p["g"], p["b"])
    )
    keep = [c for c in frames.columns if c not in ("r", "g", "b", "w", "h")]
    means = frames.select(*keep, _mean(F.col("r")).alias("__r"), _mean(F.col("g")).alias("__g"), _mean(F.col("b")).alias("__b"), _mean(spread).alias("saturation"))
    m = means.withColumn("brightness", LUMA[0] * F.col("__r") + LUMA[1] * F.col("__g") + LUMA[2] * F.col("__b"))
    m = m.withColumn("warmth", F.col("__r") - F.col("__b"))
    b, wa, sa = F.col("brightness"), F.col("warmth"), F.col("saturation")
    warm = (wa >= GOLDEN_WARMTH) & (sa >= GOLDEN_SATURATION)
    night, golden = b < NIGHT_BELOW, warm & (b < GOLDEN_BELOW)
    not_golden = F.when(warm, (b - GOLDEN_BELOW) / (255.0 - GOLDEN_BELOW)).otherwise((GOLDEN_WARMTH - wa) / GOLDEN_WARMTH)
    margin = (
        F.when(night, (NIGHT_BELOW - b) / NIGHT_BELOW)
        .when(golden, F.least((wa - GOLDEN_WARMTH) / GOLDEN_WARMTH, (GOLDEN_BELOW - b) / (GOLDEN_BELOW - NIGHT_BELOW)))
        .otherwise(F.least((b - NIGHT_BELOW) / NIGHT_BELOW, not_golden))
    )
    return m.select(
        *keep, F.when(night, "night").when(golden, "golden").otherwise("day").alias("label"),
        _confidence(margin).alias("confidence"), "brightness", "warmth", "saturation",
    )


def _salience(frames: DataFrame) -> DataFrame:
    luma = F.transform(F.arrays_zip("r", "g", "b"), lambda p: LUMA[0] * p["r"] + LUMA[1] * p["g"] + LUMA[2] * p["b"])
    size = F.transform(
        gradients(F.col("__luma"), F.col("w"), F.col("h")), lambda g: F.sqrt(g["gx"] * g["gx"] + g["gy"] * g["gy"])
    )
    out = frames.withColumn("__luma", luma).withColumn("salience", size).drop("__luma", "r", "g", "b")
    return out.withColumn("detail", _mean(F.col("salience")))


def shot_size(frames: DataFrame) -> DataFrame:
    """Wide, medium or close by the share of busy blocks in a 4×4 grid; a flat picture has no size."""
    s = _salience(frames)
    w, h = F.col("w"), F.col("h")

    def block(r: int, c: int) -> Column:
        y0, y1 = F.floor(h * r / GRID).cast("int"), F.floor(h * (r + 1) / GRID).cast("int")
        x0, x1 = F.floor(w * c / GRID).cast("int"), F.floor(w * (c + 1) / GRID).cast("int")
        rows = F.transform(F.sequence(y0, y1 - 1), lambda y: F.slice("salience", y * w + x0 + 1, x1 - x0))
        return F.when((y1 > y0) & (x1 > x0), _mean(F.flatten(rows)))

    means = F.array_compact(F.array(*[block(r, c) for r in range(GRID) for c in range(GRID)]))
    s = s.withColumn("__m", means)
    busy = F.size(F.filter("__m", lambda m: m >= BUSY_SHARE * F.col("detail"))) / F.size("__m")
    s = s.withColumn("spread", F.when(F.col("detail") >= FLAT_GRADIENT, busy).otherwise(0.0))
    x = F.col("spread")
    middle, half = (WIDE_FROM + CLOSE_TO) / 2, (WIDE_FROM - CLOSE_TO) / 2
    label = F.when(x >= WIDE_FROM, "wide").when(x <= CLOSE_TO, "close").otherwise("medium")
    margin = (
        F.when(x >= WIDE_FROM, (x - WIDE_FROM) / (1 - WIDE_FROM)).when(x <= CLOSE_TO, (CLOSE_TO - x) / CLOSE_TO)
        .otherwise(1 - F.abs(x - middle) / half)
    )
    flat = F.col("detail") < FLAT_GRADIENT
    return s.withColumn("label", F.when(flat, "").otherwise(label)).withColumn(
        "confidence", F.when(flat, 0.0).otherwise(_confidence(margin))
    ).drop("__m", "salience", "w", "h")


def focus_point(frames: DataFrame) -> DataFrame:
    """Where the eye is drawn: the gradient-weighted centre in 0..1, NULL for a picture without texture."""
    s = _salience(frames)
    w, h = F.col("w"), F.col("h")
    sums = F.aggregate(
        F.transform("salience", lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("m")),
        lambda a, p: F.struct(
            (a["x"] + p["v"] * (p["i"] % w)).alias("x"), (a["y"] + p["v"] * F.floor(p["i"] / w)).alias("y"), (a["m"] + p["v"]).alias("m")
        ),
    )
    s = s.withColumn("__s", sums)
    known = (F.col("__s.m") > FLAT_GRADIENT * w * h) & (w >= 2) & (h >= 2)
    at = lambda axis, size: F.when(known, F.bround(clamp(F.col(f"__s.{axis}") / F.col("__s.m") / (size - 1), 0.0, 1.0), 4))
    keep = [c for c in s.columns if c not in ("salience", "w", "h", "__s", "detail")]
    return s.select(*keep, at("x", w).alias("focus_x"), at("y", h).alias("focus_y"))


def audio_windows(samples: DataFrame, rate: int = 22050, window: float = 0.5, key: str = "clip_id") -> DataFrame:
    """Level and full-scale share of every full window of samples (key, i, x); an incomplete tail drops out."""
    size = max(1, int(round(window * rate)))
    win = F.floor(F.col("i") / size)
    out = samples.groupBy(key, win.alias("w")).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
        F.avg((F.abs("x") >= FULL_SCALE).cast("double")).alias("clipping"), F.count("*").alias("__n"),
    )
    return out.where(F.col("__n") == size).select(key, (F.col("w") * window).alias("t"), "rms", "clipping")


def waveform(
    samples: DataFrame, start: float = 0.0, duration: float = 0.0, buckets: int = 1200, rate: int = 4000,
    key: str = "clip_id",
) -> DataFrame:
    """Loudness lane of a window of every file: ``buckets`` peaks in 0..1 of the loudest one, zeros where silent."""
    buckets = max(1, min(int(buckets), MAX_BUCKETS))
    size = max(1, rate // ENVELOPE_RATE)
    env = samples.groupBy(key, F.floor(F.col("i") / size).alias("e")).agg(F.max(F.abs("x")).alias("v"), F.count("*").alias("__n"))
    env = settle(env.where(F.col("__n") == size).drop("__n"))
    length = env.groupBy(key).agg((F.max("e") + 1).alias("__total"))
    lo = max(0, round(max(0.0, start) * ENVELOPE_RATE))
    hi = F.col("__total") if duration <= 0 else F.least(F.lit(lo + round(duration * ENVELOPE_RATE)), F.col("__total"))
    length = length.withColumn("n", F.greatest(F.lit(0), hi - lo))
    inside = attach(env, length, [key], F.floor(F.col("e") / 65536)).where((F.col("e") >= lo) & (F.col("e") < lo + F.col("n")))
    at = F.col("e") - lo
    last = F.floor(((at + 1) * buckets - 1) / F.col("n"))
    first = F.least(F.ceil(at * buckets / F.col("n")), last)
    peaks = inside.withColumn("bucket", F.explode(F.sequence(first, last))).groupBy(key, "bucket").agg(F.max("v").alias("v"))
    top = inside.groupBy(key).agg(F.max("v").alias("__top"))
    every = samples.select(key).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))))
    out = every.join(peaks, [key, "bucket"], "left").join(top, key, "left")
    scaled = F.bround(F.coalesce("v", F.lit(0.0)) / F.nullif(F.col("__top"), F.lit(0.0)), 4)
    return out.select(key, "bucket", F.coalesce(scaled, F.lit(0.0)).alias("peak"))


def classify_elements(
    envelopes: DataFrame, files: DataFrame, window: float = 1024 / 22050, key: str = "file", digits: int | None = 4,
) -> DataFrame:
    """Impact, braam, riser, whoosh or other from level envelopes (key, k, rms).

    ``files`` has (key, duration, low_ratio). Features are rounded to four decimals before they are judged.
    """
    by_k = F.floor(F.col("k") / 8192)
    base = settle(scan(envelopes, [key], ["k"], by_k, nxt=following("rms")))
    peak = base.groupBy(key).agg(
        F.count("*").alias("n"), F.max("rms").alias("peak"), first_by([-F.col("rms"), "k"], "k").alias("peak_k")
    )
    rows = attach(base, peak, [key], by_k)
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    falls = (F.col("nxt") <= F.col("rms") * 1.05 + EPS).cast("double")
    f = rows.groupBy(key).agg(
        F.first("n").alias("n"), F.first("peak").alias("peak"), F.first("peak_k").alias("peak_k"),
        F.avg(F.when(F.col("k") < third, F.col("rms"))).alias("head"),
        F.avg(F.when(F.col("k") >= F.col("n") - third, F.col("rms"))).alias("tail"),
        F.avg(F.when((F.col("k") >= F.col("peak_k")) & F.col("nxt").isNotNull(), falls)).alias("falls"),
        F.max(F.when((F.col("k") == 0) | (F.col("k") == F.col("n") - 1), F.col("rms"))).alias("rim"),
    ).join(files, key)
    four = lambda c: F.bround(F.round(c, 10), 4)
    f = f.select(
        key, "duration", "peak", F.col("low_ratio"),
        four(F.least(F.lit(1.0), (F.col("peak_k") + 0.5) * window / F.col("duration"))).alias("peak_pos"),
        four(F.least(F.lit(99.0), F.col("tail") / (F.col("head") + EPS))).alias("rise_ratio"),
        four(F.when(F.col("n") - F.col("peak_k") >= 3, F.col("falls")).otherwise(1.0)).alias("decay_score"),
        four(F.col("rim") / F.nullif(F.col("peak"), F.lit(0.0))).alias("edge_ratio"),
    )
    d, p, dec, rise, low, edge = (F.col(c) for c in ("duration", "peak_pos", "decay_score", "rise_ratio", "low_ratio", "edge_ratio"))
    kind = (
        F.when(F.col("peak") <= EPS, "other")
        .when((d <= IMPACT_MAX) & (p <= EARLY_PEAK) & (dec >= DECAY_MIN), "impact")
        .when((d > IMPACT_MAX) & (p <= BRAAM_PEAK) & (low >= LOW_SHARE), "braam")
        .when((d >= RISER_MIN) & (p >= LATE_PEAK) & (rise >= RISE_MIN), "riser")
        .when(d.between(*WHOOSH) & p.between(0.2, 0.8) & (edge <= EDGE_MAX), "whoosh")
        .otherwise("other")
    )
    k = F.col("kind")
    sure = (
        F.when(k == "impact", ramp(p, EARLY_PEAK, 0.0) + ramp(dec, DECAY_MIN, 1.0))
        .when(k == "braam", ramp(low, LOW_SHARE, 0.9) + ramp(p, BRAAM_PEAK, 0.0))
        .when(k == "riser", ramp(p, LATE_PEAK, 1.0) + ramp(F.least(rise, F.lit(6.0)), RISE_MIN, 4.0))
        .when(k == "whoosh", ramp(F.abs(p - 0.5), 0.3, 0.0) + ramp(edge, EDGE_MAX, 0.1))
    )
    confidence = F.when(k == "other", 0.0).otherwise(F.greatest(F.lit(CONFIDENCE_FLOOR), sure / 2))
    return f.withColumn("kind", kind).withColumn(
        "confidence", confidence if digits is None else F.bround(F.round(confidence, 10), digits)
    )
