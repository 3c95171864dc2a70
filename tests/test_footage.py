"""Footage rules, greedy choices and near duplicates against brute force."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from cutlake.functions import ordered
from cutlake.functions.greedy import first_free
from cutlake.functions.ordered import global_ranks, linear_percentiles, mid_ranks
from cutlake.operators import footage

FRAMES = "clip_id string, t double, brightness double, sharpness double, motion double, residual double, dx double, dy double, clipped double, crushed double, phash bigint"


def frames(spark, rows):
    return spark.createDataFrame([(c, t, b, s, m, m, 0.0, 0.0, 0.0, 0.0, 1) for c, t, b, s, m in rows], FRAMES)


def test_one_dark_stretch_becomes_a_segment(spark):
    rows = [("a", i * 0.5, 5.0 if 8 <= i < 14 else 130.0, 20.0, 1.0) for i in range(24)]
    lab = footage.label_samples(frames(spark, rows))
    d = spark.createDataFrame([("a", 12.0)], "clip_id string, duration double")
    seg = sorted((r.start_s, r.end_s, r.label) for r in footage.quality_segments(lab, d).collect())
    assert seg == [(0.0, 4.0, "usable"), (4.0, 7.0, "dark"), (7.0, 12.0, "usable")]


def test_isolated_spike_with_brightness_jump_is_a_cut(spark):
    rows = [("a", i * 0.5, 100.0 if i < 6 else 140.0, 20.0, 40.0 if i == 6 else 2.0) for i in range(12)]
    base = footage.with_neighbours(frames(spark, rows))
    cuts = footage.scene_cuts(base, footage.clip_profile(base))
    assert [r.cut_s for r in cuts.collect()] == [3.0]
    seg = spark.createDataFrame([("a", 0.0, 6.0, "usable", 1.0)], "clip_id string, start_s double, end_s double, label string, score double")
    starts = sorted(r.win_start for r in footage.candidate_windows(seg, cuts).collect())
    assert 2.5 not in starts and {2.0, 3.0} <= set(starts)


def test_clip_with_detail_is_never_skipped(spark):
    rows = [("a", i * 0.5, 10.0, 30.0, 1.0) for i in range(10)]
    lab = footage.label_samples(frames(spark, rows))
    d = spark.createDataFrame([("a", 5.0)], "clip_id string, duration double")
    none = spark.createDataFrame([], "clip_id string, cut_s double")
    assert footage.best_moments(lab, footage.quality_segments(lab, d), none, d).count() == 5


def test_constant_sound_is_ignored(spark):
    rows = [("hum", i * 0.5, 0.3, 0.0, 0.9) for i in range(10)] + [("hush", i * 0.5, 0.001, 0.0, 0.9) for i in range(10)]
    rows += [("party", i * 0.5, 0.9 if i == 4 else 0.1 + 0.01 * (i % 3), 0.0, 0.2) for i in range(10)]
    audio = spark.createDataFrame(rows, "clip_id string, t double, rms double, clipping double, low_ratio double")
    profile = footage.audio_profile(audio)
    notes = {r.clip_id: list(r.audio_notes) for r in profile.collect()}
    assert notes["hum"] == ["constant_tone"] and notes["hush"] == ["silent"] and notes["party"] == []
    bursts = {(r.clip_id, r.t) for r in footage.audio_bursts(audio, profile).where("burst = 1").collect()}
    assert bursts == {("party", 2.0)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(20)]
    hashes = base + [h ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(1, 8))) for h in base for _ in range(5)]
    df = spark.createDataFrame([(h,) for h in hashes], "phash bigint")
    got = {(r.a_hash, r.b_hash) for r in footage.near_duplicates(df).collect()}
    pool = sorted(set(hashes))
    want = {(a, b) for i, a in enumerate(pool) for b in pool[i + 1 :] if bin(a ^ b).count("1") <= 6}
    assert got == want


def test_greedy_rounds_equal_one_walk(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(40)) for k in ("x", "y") for i in range(60)]
    clash = [(k, a, b) for k, a, v in rows for q, b, w in rows if k == q and a < b and abs(v - w) < 4]
    ids = spark.createDataFrame([(k, i) for k, i, _ in rows if i], "k string, mid bigint")
    taken = spark.createDataFrame([(k, 0) for k in ("x", "y")], "k string, mid bigint")
    out = first_free(ids, spark.createDataFrame(clash, "k string, a bigint, b bigint"), taken, ["k"])
    got = {k: sorted(r.mid for r in out.collect() if r.k == k) for k in ("x", "y")}
    for k in got:
        walk = []
        for _, i, v in (r for r in rows if r[0] == k):
            if all(abs(v - w) >= 4 for _, w in walk):
                walk.append((i, v))
        assert got[k] == [i for i, _ in walk if i]


def test_ranks_of_a_hot_key_with_an_outlier(spark):
    rng = random.Random(5)
    values = [float(rng.randrange(500)) for _ in range(4000)] + [1e12]
    rows = [("hot", v) for v in values] + [("cold", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    ordered = sorted(values)
    got = {r.k: (r.low, r.high) for r in linear_percentiles(df, ["k"], "v", low=0.25, high=0.9).collect()}
    assert got["hot"] == (ordered[1000], ordered[3600]) and got["cold"] == (99.75, 359.1)
    ranks = {r.v: r.m for r in mid_ranks(df, ["k"], "v", "m").where("k = 'hot'").collect()}
    assert ranks[1e12] == 1.0
    v = ordered[2000]
    first, last = ordered.index(v), len(ordered) - 1 - ordered[::-1].index(v)
    assert abs(ranks[v] - (first + last) / 2 / 4000) < 1e-12
    numbered = {r.i: r.n for r in global_ranks(spark.range(1000).selectExpr("id as i", "id % 7 as g").repartition(5), [F.desc("g"), F.asc("i")], "n").collect()}
    assert [i for i, _ in sorted(numbered.items(), key=lambda x: x[1])] == sorted(range(1000), key=lambda i: (-(i % 7), i))


def test_ranks_of_values_of_every_size(spark):
    rng = random.Random(15)
    pool = [0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0 + 2**-52, 1.7e9, 1.7e9 + 1e-6, -1e300, 1e300, -3.5] + [rng.gauss(0, 10) ** 5 for _ in range(60)]
    rows = [(k, rng.choice(pool)) for k in ("a", "b", "c") for _ in range({"a": 500, "b": 7, "c": 1}[k])] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    by = {k: sorted(v for c, v in rows if c == k and v is not None) for k in "abc"}
    got = ordered.pick_ranks(df, ["k"], "v", lambda n: {"first": n * 0, "third": F.floor(n / 3), "last": n - 1}, "size").collect()
    assert {(r.k, r.first, r.third, r.last, r.size) for r in got} == {(k, v[0], v[len(v) // 3], v[-1], len(v)) for k, v in by.items()}
    for r in ordered.linear_percentiles(df, ["k"], "v", p=0.3).collect():
        assert r.p == pytest.approx(float(np.percentile(by[r.k], 30)), rel=1e-12)
    ranks = ordered.mid_ranks(df.where("v is not null"), ["k"], "v", "r").collect()
    for r in ranks:
        below, same, n = sum(x < r.v for x in by[r.k]), sum(x == r.v for x in by[r.k]), len(by[r.k])
        assert r.r == pytest.approx(0.5 if n == 1 else (below + below + same - 1) / 2 / (n - 1))
    cells = spark.createDataFrame([(v,) for v in sorted(pool)], "v double").select("v", ordered.cell_of("v").alias("c")).orderBy("v").collect()
    assert all(x.c <= y.c for x, y in zip(cells, cells[1:]))
