"""Timecode, pacing and chunking on small layouts with known results."""

import pytest
from pyspark.sql import functions as F

from cutlake.functions.intervals import range_join, union_intervals
from cutlake.functions.ordered import islands, mid_ranks, nearest_rank, pick_ranks, previous, row_index, running_sum, scan
from cutlake.functions.timecode import frames_to_tc, tc_to_frames
from cutlake.operators import pacing, timeline


def shots(spark, lengths, gaps=0):
    rows, at = [], 0
    for i, n in enumerate(lengths):
        rows.append(("t", i, "V1", "video", f"shot {i}", at, at + n * 25, 25.0))
        at += n * 25 + gaps
    return timeline.with_seconds(spark.createDataFrame(
        rows, "timeline_id string, clip_id bigint, track string, kind string, name string, record_in bigint, record_out bigint, fps double"
    ))


def test_pacing_of_known_layout(spark):
    s = shots(spark, [2, 4, 4, 4, 5, 5, 7, 9])
    row = pacing.pacing_stats(s, pacing.extents_in_seconds(s)).first()
    assert (row.shot_count, row.cut_count) == (8, 7)
    assert (row.avg_shot_seconds, row.median_shot_seconds, row.std_shot_seconds) == (5.0, 4.5, 2.0)
    assert (row.min_shot_seconds, row.max_shot_seconds, row.duration_seconds) == (2.0, 9.0, 40.0)


def test_a_gap_is_not_a_cut(spark):
    s = shots(spark, [2, 2, 2], gaps=25)
    assert timeline.cuts(s).count() == 0


def test_drop_frame_skips_numbers(spark):
    df = spark.createDataFrame([("00:01:00;02", 1800), ("00:10:00;00", 17982), ("01:00:00;00", 107892)], "tc string, frames bigint")
    for r in df.select("*", tc_to_frames("tc", F.lit(29.97)).alias("got"), frames_to_tc("frames", F.lit(29.97)).alias("back")).collect():
        assert r.got == r.frames and r.back == r.tc


def test_bad_timecode_is_null(spark):
    df = spark.createDataFrame([("00:61:00:00",), ("00:00:00:25",), ("nonsense",)], "tc string")
    assert [r[0] for r in df.select(tc_to_frames("tc", F.lit(25.0))).collect()] == [None] * 3


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_chunk_width_never_changes_a_scan(spark, width):
    df = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 11).alias("v"))
    out = scan(df, ["k"], ["t"], F.floor(F.col("t") / width), s=running_sum("v"), n=row_index(), p=previous("v"))
    want = {}
    for k in (0, 1):
        s, p = 0, None
        for n, i in enumerate(range(k, 40, 2), 1):
            s += i * 7 % 11
            want[i] = (s, n, p)
            p = i * 7 % 11
    assert {r.t: (r.s, r.n, r.p) for r in out.collect()} == want


@pytest.mark.parametrize("width", [2, 5, 100])
def test_islands_across_chunks(spark, width):
    labels = "aaabbbbbbbbbccabca"
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(labels)], "k int, t bigint, label string")
    out = islands(
        df, ["k"], ["t"], F.floor(F.col("t") / width), lambda a, b: a["label"] != b["label"], ["label"],
        lo=("min", F.col("t")), hi=("max", F.col("t")), label=("first", F.col("label")),
    )
    got = sorted((r.lo, r.hi, r.label) for r in out.collect())
    assert got == [(0, 2, "a"), (3, 11, "b"), (12, 13, "c"), (14, 14, "a"), (15, 15, "b"), (16, 16, "c"), (17, 17, "a")]


@pytest.mark.parametrize("width", [1.0, 4.0, 50.0])
def test_interval_union_across_bins(spark, width):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 9.5), (1, 3.0, 4.0), (1, 12.0, 13.0), (1, 13.0, 13.0), (2, 1.0, 1.5)], "k int, s double, e double")
    got = sorted(tuple(r) for r in union_intervals(df, ["k"], "s", "e", width).collect())
    assert got == [(1, 0.0, 9.5), (1, 12.0, 13.0), (2, 1.0, 1.5)]


@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_range_join_keeps_each_pair_once(spark, width):
    a = spark.createDataFrame([(1, i, i * 1.0, i + 2.5) for i in range(10)], "k int, a bigint, a0 double, a1 double")
    b = spark.createDataFrame([(1, i, i * 1.5, i * 1.5 + 1) for i in range(8)], "k int, b bigint, b0 double, b1 double")
    got = sorted((r.a, r.b) for r in range_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), width).collect())
    assert got == sorted((i, j) for i in range(10) for j in range(8) if i <= j * 1.5 + 1 and j * 1.5 <= i + 2.5)


def test_nearest_rank_and_mid_rank(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, 7.0, 2.0]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    rank = nearest_rank(0.9)
    assert pick_ranks(df, ["k"], "v", lambda n: {"p": rank(n)}).first().p == sorted(values)[5]
    got = {r.v: r.r for r in mid_ranks(df, ["k"], "v", "r").collect()}
    assert got[1.0] == 0.0 and got[9.0] == 1.0 and got[3.0] == 2.5 / 6


def test_scenes_start_at_markers(spark):
    s = shots(spark, [4, 4, 4, 4])
    marks = spark.createDataFrame([("t", 200, "Two")], "timeline_id string, frame bigint, name string")
    rows = {r.heading: (r.shot_count, r.scene_start, r.scene_end) for r in pacing.scene_pacing(s, s, marks).collect()}
    assert rows == {"Opening": (2, 0.0, 8.0), "Two": (2, 8.0, 16.0)}
    none = marks.where("false")
    assert [r.heading for r in pacing.scene_pacing(s, s, none).collect()] == ["Full cut"]
