"""Steps that once grew faster than their input: what bounds them now."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cutlake.functions.distance import prefix_distances
from cutlake.functions.ordered import carry_backward, scan, sorted_groups
from cutlake.llm import near_takes
from cutlake.operators import intervals, scoring, takes


def test_many_small_groups_share_a_frame():
    rows = pd.DataFrame({"k": np.repeat(np.arange(1000), 3), "v": np.arange(3000)})
    frames = list(sorted_groups(iter([rows.iloc[:1000], rows.iloc[1000:1001], rows.iloc[1001:]]), ["k"]))
    assert len(frames) <= 4
    got = [tuple(part["v"].iloc[a:b]) for part, begins in frames for a, b in zip(begins, np.r_[begins[1:], len(part)])]
    assert got == [(3 * k, 3 * k + 1, 3 * k + 2) for k in range(1000)]
    assert list(sorted_groups(iter([rows.iloc[:0]]), ["k"])) == []


def test_values_carried_back_are_no_shrinking_frames(spark, capsys):
    rng = random.Random(3)
    rows = [("a", i, i if rng.random() < 0.2 else None) for i in range(200)]
    table = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    out = scan(table, ["k"], ["i"], F.floor(F.col("i") / 50), after=carry_backward("v"))
    want = {i: next((v for _, j, v in rows[i + 1 :] if v is not None), None) for i in range(200)}
    assert {r.i: r.after for r in out.collect()} == want
    out.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_cues_of_one_length_ask_once(spark):
    elements = [("x", 1.0, "riser", 0.5), ("y", 2.0, "riser", 0.9), ("z", 2.0, "riser", 0.9), ("h", 1.0, "impact", 0.2)]
    cues = [(i, "riser", i % 4 * 0.5 + 0.7) for i in range(400)] + [(500, "impact", None), (501, "whoosh", 1.0), (502, "ambience", None)]
    files = spark.createDataFrame(elements, "path string, duration double, kind string, confidence double")
    out = scoring.rank_elements(spark.createDataFrame(cues, "cue_id bigint, kind string, target double"), files)
    want = {(i, "riser", "x" if t < 1.5 else "y") for i, k, t in cues if k == "riser"} | {(500, "impact", "h")}
    assert {(r.cue_id, r.element, r.path) for r in out.collect()} == want


def test_pictures_are_walked_by_heads(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(takes, "PICTURES", 7)
    rows = []
    for i in range(400):
        base = rng.randrange(12) * 0x0F0F0F0F1234567 % (1 << 62)
        picture = 0 if rng.random() < 0.05 else base ^ sum(1 << rng.randrange(62) for _ in range(rng.randint(0, 3)))
        rows.append(("ab"[i % 2], f"c{rng.randrange(3)}", i, float(rng.randrange(20)), rng.randrange(90) / 2, picture))
    want = set()
    for p in "ab":
        place = lambda r: (-r[3], r[1], r[4], r[2])
        mine = sorted((r for r in rows if r[0] == p), key=place)
        lead = [min((r for r in mine if r[1] == c), key=place) for c in {r[1] for r in mine}]
        kept = sorted(lead, key=place)
        for r in mine:
            if r not in lead and len(kept) < 24 and not any(o[5] and r[5] and (o[5] ^ r[5]).bit_count() <= 6 for o in kept):
                kept.append(r)
        want |= {(p, n, r[2]) for n, r in enumerate(kept, 1)}
    table = spark.createDataFrame(rows, "project string, clip_path string, mid bigint, score double, start_s double, phash bigint")
    assert {(r.project, r.pick, r.mid) for r in takes.select_moments(table, 24).collect()} == want


def test_spans_of_plans_are_not_broadcast(spark, capsys):
    rows = spark.range(50).selectExpr("id as plan_id", "1.0D as at")
    spans = spark.range(50).selectExpr("id as plan_id", "0.0D as span_start", "2.0D as span_end", "'x' as label")
    out = intervals.label_at(rows, spans, "at", "found")
    assert {(r.plan_id, r.found) for r in out.collect()} == {(i, "x") for i in range(50)}
    out.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_equal_sketches_do_not_make_texts_similar(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:59], "z"]), " ".join(reversed(words)), " ".join(f"v{i}" for i in range(60))]
    rows = spark.createDataFrame([(i, i + 10, bytearray(b"\x01" * 2 * near_takes.HASHES), t) for i, t in enumerate(texts)], "take_id bigint, fingerprint bigint, sketch binary, text string")
    nodes = rows.selectExpr("fingerprint as value", "take_id as first_id")
    assert {(r.a, r.b) for r in near_takes.similar_links(rows, nodes, 5, 0.8).collect()} == {(11, 10)}


def test_texts_of_a_crowded_key_meet_beyond_its_first(spark, monkeypatch):
    monkeypatch.setattr(near_takes, "TILE", 5)
    foreign = [f"{n} " + " ".join(f"f{n}w{k}" for k in range(40)) for n in range(20)]
    base, ends = [f"w{k}" for k in range(60)], [[f"{c}{k}" for k in range(5)] for c in "xy"]
    # A chain: the last is not similar to its first, and none to the first text of the key.
    chain = [" ".join(base), " ".join(base[:55] + ends[0]), " ".join(ends[1] + base[5:55] + ends[0])]
    texts = [*foreign, *chain]
    rows = spark.createDataFrame([(f"t{n}", n, bytearray(b"ab" * 64), t) for n, t in enumerate(texts)], "take_id string, fingerprint bigint, sketch binary, text string")
    monkeypatch.setattr(near_takes, "BLOCK", 2)  # the pairs are many now
    nodes = rows.selectExpr("fingerprint as value", "take_id as first_id")
    assert {(r.a, r.b) for r in near_takes.similar_links(rows, nodes, 5, 0.8).collect()} == {(21, 20), (22, 21)}


def test_tiles_of_many_scenes_are_compared_together(monkeypatch):
    calls = []
    monkeypatch.setattr(takes, "prefix_distances", lambda *a: calls.append(len(a[2])) or prefix_distances(*a))
    tile = lambda k: (k, 10 * k, 0, np.array([0, 1]), ["we go now", "again"], np.array([0]), ["we go now again"])
    tiles = pd.DataFrame([tile(k) for k in range(300)], columns=["scene_id", "take_id", "block", "places", "heard", "numbers", "said"])
    out = pd.concat(takes._tile_scores(0.55, 0.3, 6)(iter([tiles.iloc[:100], tiles.iloc[100:]])))
    assert calls == [600] and sorted(map(tuple, out[out.scene_id == 299].values)) == [(299, 2990, 0, 0, 1, 0.6), (299, 2990, 0, 0, 2, 1.0), (299, 2990, 0, 1, 1, 1 - 10 / 15)]
    monkeypatch.setattr(takes, "LETTERS", 84 * 50)
    assert len(pd.concat(takes._tile_scores(0.55, 0.3, 6)(iter([tiles])))) == 900 and calls[1:] == [100] * 6


def test_distances_of_lines_of_many_words(monkeypatch):
    rng = random.Random(9)
    said = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    lines = [said(n) for n in (1, 63, 64, 65, 128, 129, 300)]
    texts = [said(n) for n in (1, 70, 400)] + ["".join(c for c in line if rng.random() < 0.8) + said(9) for line in lines]
    line_of, text_of = (x.ravel() for x in np.meshgrid(np.arange(len(lines)), np.arange(len(texts))))
    ends = [np.unique(rng.choices(range(1, len(texts[t]) + 1), k=4)) for t in text_of]

    def plain(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last

    want = [np.array(plain(lines[a], texts[b]))[e] for a, b, e in zip(line_of, text_of, ends)]
    for together in (1, 40, 1 << 14):
        monkeypatch.setattr("cutlake.functions.distance.TOGETHER", together)
        got = prefix_distances(lines, texts, line_of, text_of, np.array([e[-1] for e in ends]), ends)
        assert [list(x) for x in got] == [list(x) for x in want]
    assert prefix_distances([], [], np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), []) == []


def test_partitions_follow_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    from cutlake.functions import staging

    key = "spark.sql.shuffle.partitions"
    given, advised = spark.conf.get(key), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (tmp_path / "events.parquet").write_bytes(b"x" * 9000)
    try:
        staging.share_out(spark, str(tmp_path))
        assert spark.conf.get(key) == given
        monkeypatch.setattr(staging, "PARTITION_BYTES", 100)
        staging.share_out(spark, str(tmp_path))
        assert int(spark.conf.get(key)) >= 90
    finally:
        spark.conf.set(key, given)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advised)


def test_runs_of_a_union_are_written_once(spark, monkeypatch):
    from cutlake.functions import intervals

    written = []
    monkeypatch.setattr(intervals, "settle", lambda df: (written.append(df.columns), df)[1])
    rows = spark.createDataFrame([(1, 0.0, 5.0), (1, 4.0, 1300.0), (1, 1300.5, 1301.0), (2, 1.0, 2.0)], "k int, s double, e double")
    # A side joined on the key alone, as plans are to their gaps.
    joined = rows.join(rows.select("k").distinct(), "k")
    out = intervals.union_intervals(joined, ["k"], "s", "e").collect()
    assert sorted((r.k, r.s, r.e) for r in out) == [(1, 0.0, 1300.0), (1, 1300.5, 1301.0), (2, 1.0, 2.0)]
    assert len(written) == 1 and "__runs" in written[0]


def test_borders_of_phases_are_worked_out_once(spark, monkeypatch):
    from cutlake.operators import intervals as iv

    written = []
    plain = iv.settle
    monkeypatch.setattr(iv, "settle", lambda df: (written.append(df.columns), plain(df))[1])
    plans = spark.createDataFrame([(1, 100.0, "trailer"), (2, 50.0, "short"), (3, 10.0, "other")], "plan_id int, duration double, style string")
    drops = spark.createDataFrame([(1, 60.0, 1.0)], "plan_id int, t double, weight double")
    grid = spark.createDataFrame([(2, "beat", 4.25)], "plan_id int, kind string, t double")
    out = {(r.plan_id, r.phase_no): (r.label, round(r.span_start, 6), round(r.span_end, 6)) for r in iv.phase_spans(plans, drops, grid).collect()}
    assert out[1, 3] == ("climax", 60.0, round(100 - (100 - 90) * (100 - 60) / (100 - 70), 6)) and out[1, 0][1] == 0.0 and out[1, 4][2] == 100.0
    # Both inner borders of the short plan snap to its only beat.
    assert out[2, 0] == ("hook", 0.0, 4.25) and out[2, 1] == ("punch", 4.25, 4.25) and len(out) == 8
    assert sum("bounds" in columns for columns in written) == 1


def test_crowded_hashes_lose_no_near_pair(spark, monkeypatch):
    import random

    from cutlake.operators import footage

    monkeypatch.setattr(footage, "CROWD", 3)
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(4)]
    hashes = {b ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 4))) for b in base for _ in range(40)}
    out = footage.near_duplicates(spark.createDataFrame([(h % 2, h) for h in hashes], "k bigint, phash bigint"), keys=["k"]).collect()
    pairs = [(r.k, r.a_hash, r.b_hash, r.distance) for r in out]
    near = {(a % 2, a, b, (a ^ b).bit_count()) for a in hashes for b in hashes if a < b and a % 2 == b % 2 and (a ^ b).bit_count() <= 6}
    assert len(pairs) == len(set(pairs)) and set(pairs) == near


def test_window_of_a_splice_is_written_once(spark, monkeypatch):
    from cutlake.operators import intervals as iv

    written = []
    plain = iv.settle
    monkeypatch.setattr(iv, "settle", lambda df: (written.append(df.columns), plain(df))[1])
    kind = "plan_id int, slot int, source_start double, source_end double, record_start double, record_end double"
    old = spark.createDataFrame([(1, i, 0.0, 2.0, 2.0 * i, 2.0 * i + 2) for i in range(4)] + [(2, 0, 0.0, 2.0, 0.0, 2.0)], kind)
    new = spark.createDataFrame([(1, 9, 5.0, 9.0, 1.0, 5.0), (2, 9, 5.0, 9.0, 0.0, 4.0)], kind)
    region = spark.createDataFrame([(1, 1.5, 6.5), (2, 0.5, 1.0)], "plan_id int, r0 double, r1 double")
    out = sorted(map(tuple, iv.splice_region(old, new, region).collect()))
    assert out == [(1, 0, 0.0, 2.0, 0.0, 2.0), (1, 3, 0.0, 2.0, 6.0, 8.0), (1, 9, 6.0, 9.0, 2.0, 5.0), (2, 9, 5.0, 9.0, 0.0, 4.0)]
    assert written == [["plan_id", "win_lo", "win_hi"]]
