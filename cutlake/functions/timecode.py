"""Timecode and frame arithmetic as column expressions; invalid input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlake.functions.columns import col

# Fractional broadcast rates and the whole number they count in.
NOMINAL_RATES = {23.976: 24, 23.98: 24, 29.97: 30, 59.94: 60, 47.952: 48, 119.88: 120}
DROP_FRAME_RATES = (29.97, 59.94)
RATE_TOLERANCE = 0.005
TIMECODE = r"^(\d{1,2})[:;.](\d{1,2})[:;.](\d{1,2})([:;.,])(\d{1,3})$"


def nominal_rate(fps: str | Column) -> Column:
    f = col(fps).cast("double")
    known = [(F.abs(f - rate) < RATE_TOLERANCE, whole) for rate, whole in NOMINAL_RATES.items()]
    out = F.when(known[0][0], known[0][1])
    for hit, whole in known[1:]:
        out = out.when(hit, whole)
    return out.otherwise(F.bround(f)).cast("bigint")


def is_drop_frame_rate(fps: str | Column) -> Column:
    f = col(fps).cast("double")
    near = F.lit(False)
    for rate in DROP_FRAME_RATES:
        near = near | (F.abs(f - rate) < RATE_TOLERANCE)
    return near


def _dropped_per_minute(rate: Column) -> Column:
    return F.when(rate == 30, F.lit(2)).otherwise(F.lit(4)).cast("bigint")


def tc_to_frames(tc: str | Column, fps: str | Column) -> Column:
    """``HH:MM:SS:FF`` to a frame count; ``;`` or ``,`` before the frames means drop-frame at 29.97 and 59.94."""
    fields = F.split(F.regexp_replace(F.trim(col(tc)), TIMECODE, "$1 $2 $3 $4 $5"), " ")
    given = F.struct(fields.alias("f"), nominal_rate(fps).alias("rate"), is_drop_frame_rate(fps).alias("drop"))

    def read(x: Column) -> Column:
        hh, mm, ss, ff = (F.try_element_at(x["f"], F.lit(i)).cast("bigint") for i in (1, 2, 3, 5))
        minutes = hh * 60 + mm
        lost = _dropped_per_minute(x["rate"]) * (minutes - F.floor(minutes / 10))
        drop = x["drop"] & F.try_element_at(x["f"], F.lit(4)).isin(";", ",")
        count = (minutes * 60 + ss) * x["rate"] + ff
        return F.when((mm <= 59) & (ss <= 59) & (ff < x["rate"]), count - F.when(drop, lost).otherwise(F.lit(0).cast("bigint")))

    well_formed = F.trim(col(tc)).rlike(TIMECODE)
    return F.when(well_formed, F.transform(F.array(given), read)[0])


def frames_to_tc(frames: str | Column, fps: str | Column, drop: bool | None = None) -> Column:
    """Frame count to ``HH:MM:SS:FF``, or ``HH:MM:SS;FF`` in drop-frame; negative counts give NULL."""
    droppable = is_drop_frame_rate(fps) if drop is None or drop else F.lit(False)
    given = F.struct(col(frames).cast("bigint").alias("n"), nominal_rate(fps).alias("rate"), droppable.alias("drop"))

    def counted(x: Column) -> Column:
        n, rate = x["n"], x["rate"]
        lost = _dropped_per_minute(rate)
        per_minute = rate * 60 - lost
        per_ten = per_minute * 10 + lost
        rest = F.pmod(n, per_ten)
        # Within ten minutes the first minute keeps all its numbers, each later one skips some.
        minutes = F.when(rest < rate * 60, F.lit(0).cast("bigint")).otherwise(1 + F.floor((rest - rate * 60) / per_minute))
        skipped = F.when(x["drop"], lost * (F.floor(n / per_ten) * 9 + minutes)).otherwise(F.lit(0).cast("bigint"))
        return F.struct((n + skipped).alias("c"), rate.alias("rate"), x["drop"].alias("drop"))

    def written(x: Column) -> Column:
        seconds = F.floor(x["c"] / x["rate"])
        parts = [F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60, x["c"] % x["rate"]]
        return F.when(x["drop"], F.format_string("%02d:%02d:%02d;%02d", *parts)).otherwise(
            F.format_string("%02d:%02d:%02d:%02d", *parts)
        )

    # One-element transforms bind the intermediate values, so they are computed once per row.
    text = F.transform(F.transform(F.array(given), counted), written)[0]
    return F.when(col(frames) >= 0, text)


def frames_to_seconds(frames: str | Column, fps: str | Column) -> Column:
    return col(frames) / col(fps)


def seconds_to_frames(seconds: str | Column, fps: str | Column) -> Column:
    """Half-to-even, like the rest of the time arithmetic."""
    return F.bround(col(seconds) * col(fps)).cast("bigint")
