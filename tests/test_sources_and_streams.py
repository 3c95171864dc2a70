"""File corpora in and out, and the two streams."""

import json
import time

from pyspark.sql import functions as F

from cutlake.operators import pacing, timeline
from cutlake.sources import stores, timelines, transcripts
from cutlake.streaming import jobs

EDL = """TITLE: A cut
FCM: NON-DROP FRAME

001  ONE      V     C        01:00:00:00 01:00:02:00 00:00:00:00 00:00:02:00
* FROM CLIP NAME: First
002  TWO      AA/V  C        02:00:00:00 02:00:01:00 00:00:02:00 00:00:03:00
003  TWO      V     C        02:00:01:00 02:00:01:00 00:00:03:00 00:00:03:00
003  THREE    V     D    025 03:00:00:00 03:00:04:00 00:00:03:00 00:00:07:00
* FROM CLIP NAME: Second
* TO CLIP NAME: Third
004  FOUR     X     C        03:00:00:00 03:00:04:00 00:00:07:00 00:00:08:00
005  FIVE     V     C        03:00:00:00 03:00:04:00 00:00:07:00
"""


def test_edl_folder(spark, tmp_path):
    (tmp_path / "a.edl").write_text(EDL)
    clips, wrong = timelines.read_edl_corpus(spark, str(tmp_path), 25.0)
    rows = sorted((r.event, r.kind, r.track, r.name, r.record_in, r.record_out, r.transition) for r in clips.collect())
    assert rows == [
        (1, "video", "V1", "First", 0, 50, None), (2, "audio", "A1", "TWO", 50, 75, None), (2, "audio", "A2", "TWO", 50, 75, None), (2, "video", "V1", "TWO", 50, 75, None),
        (3, "video", "V1", "Third", 75, 175, "D"),
    ]
    assert sorted(r.pos for r in wrong.collect()) == [11, 12]
    cuts = timelines.as_clips(clips, 25.0)
    made = timeline.with_seconds(timeline.select_shots(cuts))
    row = pacing.pacing_stats(made, pacing.extents_in_seconds(cuts)).first()
    assert (row.shot_count, row.cut_count, row.duration_seconds) == (3, 2, 7.0)


def test_edl_sink_writes_one_file_per_timeline(spark, tmp_path):
    clips = spark.createDataFrame([("x", 1, "V1", "video", "a", 0, 10, 0, 10), ("x", 2, "V1", "video", "b", 5, 9, 10, 14), ("y", 3, "A2", "audio", "c", 0, 4, 0, 4)],
                                  "timeline_id string, clip_id bigint, track string, kind string, name string, source_in bigint, source_out bigint, record_in bigint, record_out bigint")
    timelines.write_edl_corpus(clips, str(tmp_path / "out"), 25.0)
    back, wrong = timelines.read_edl_corpus(spark, str(tmp_path / "out" / "*" / "*.txt"), 25.0)
    assert sorted((r.name, r.track, r.record_in, r.source_out) for r in back.collect()) == [("a", "V1", 0, 10), ("b", "V1", 10, 9), ("c", "A2", 0, 4)]
    assert wrong.count() == 0


def test_fcpxml_lanes_and_asset_starts(spark):
    text = """<?xml version="1.0"?><fcpxml version="1.9"><resources><format id="r1" frameDuration="1001/30000s"/>
    <asset id="r2" name="Wide" start="3600s" hasVideo="1" hasAudio="1" src="file:///w.mov"/></resources><library><event><project name="P"><sequence format="r1"><spine>
    <asset-clip ref="r2" name="" offset="0s" duration="30030/30000s" start="3600s"/>
    <gap offset="30030/30000s" duration="2s" start="10s"><asset-clip ref="r2" name="Up" lane="1" offset="11s" duration="30030/30000s" start="3601s"/></gap>
    </spine></sequence></project></event></library></fcpxml>"""
    clips, wrong = timelines.parse_fcpxml(spark.createDataFrame([("f", text), ("g", "<other/>")], "file string, text string"))
    rows = sorted((r.name, r.track, r.source_in, r.source_out, r.record_in, r.record_out) for r in clips.collect())
    assert rows == [("Up", "A2", 30, 60, 60, 90), ("Up", "V2", 30, 60, 60, 90), ("Wide", "A1", 0, 30, 0, 30), ("Wide", "V1", 0, 30, 0, 30)]
    assert [(r.file, r.message) for r in wrong.collect()] == [("g", "root element is not fcpxml")]


def test_srt_and_whisper(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nANNA: Hello\nthere\n\n00:00:03.000 --> 00:00:04.000\nno counter\n\n3\nbroken\n"
    rows, wrong = transcripts.parse_srt(spark.createDataFrame([("f", srt)], "file string, text string"))
    assert [(r.seg, r.start_s, r.end_s, r.speaker, r.text) for r in rows.orderBy("seg").collect()] == [(1, 1.0, 2.5, "ANNA", "Hello there"), (2, 3.0, 4.0, "", "no counter")]
    assert wrong.count() == 1
    docs = [("a", '{"language": "de", "segments": [{"id": 4, "start": 0, "end": 1.5, "text": " hi "}]}'), ("b", '[{"start": 1, "end": 2, "text": "x", "speaker": "B"}, {"start": 1}]'), ("c", "{}")]
    rows, wrong = transcripts.parse_whisper(spark.createDataFrame(docs, "file string, text string"))
    assert sorted((r.file, r.seg, r.text, r.speaker, r.language) for r in rows.collect()) == [("a", 4, "hi", "", "de"), ("b", 0, "x", "B", "")]
    assert sorted(r.file for r in wrong.collect()) == ["b", "c"]


def test_fountain(spark):
    text = "Title: Draft\nAuthor: X\n\nCUT TO:\n\nint. kitchen - day #12A#\n\nShe *waits*. [[note]]\n\nANNA (V.O.)\n(softly)\nWhere are you?\nStill _here_.\n\n.ROOF\n\n@McBob\nUp."
    scenes, elements = transcripts.parse_fountain(spark.createDataFrame([("f", text)], "file string, text string"))
    assert [(r.heading, r.number) for r in scenes.orderBy("scene_no").collect()] == [("INT. KITCHEN - DAY", "12A"), ("ROOF", "")]
    got = [(r.scene_no, r.kind, r.text, r.character, r.parenthetical) for r in elements.orderBy("pos").collect()]
    assert got == [(1, "action", "She waits.", "", ""), (1, "dialogue", "Where are you? Still here.", "ANNA", "(softly)"), (2, "dialogue", "Up.", "MCBOB", "")]


def test_papercut_sections_carry_down(spark):
    text = "# Papercut: X\nsource: a\nfps: 24\n- [x] [00:00:01.5 --> 00:00:02.000] BO: yes\n## source: b\n- [ ] [0:0:3,0 --> 0:0:4,0] no\n- [x] oops\n"
    lines = spark.createDataFrame([("f", i, s) for i, s in enumerate(text.split("\n"), 1)], "file string, pos bigint, line string")
    rows, wrong = transcripts.parse_papercut(lines)
    assert [(r.selected, r.source_name, r.start_s, r.speaker, r.text, r.fps) for r in rows.orderBy("pos").collect()] == [(True, "a", 1.5, "BO", "yes", 24.0), (False, "b", 3.0, "", "no", 24.0)]
    assert wrong.count() == 1


def test_plan_documents(spark):
    entry = {"clip_path": "a.mov", "source_start": 0, "source_end": 2, "record_start": 0, "record_end": 2, "score": 0.5}
    good = {"version": 1, "music_path": "m.wav", "duration": 9, "entries": [entry], "dips": [[1, 0.4]], "phases": [[0, 4, "opening"]], "sfx": [{"time": 1, "duration": 2, "kind": "riser", "query": "q", "note": "n"}]}
    docs = [("ok", json.dumps(good)), ("old", json.dumps({**good, "version": 2})), ("odd", json.dumps({**good, "entries": [{**entry, "x": 1}]})), ("none", json.dumps({"duration": 1}))]
    out = stores.parse_plans(spark.createDataFrame(docs, "file string, text string"))
    assert [(r.plan_id, r.duration, r.tempo) for r in out["plans"].collect()] == [("ok", 9.0, 0.0)]
    row = out["entries"].first()
    assert (row.slot, row.peak_source, row.pinned, row.track) == (0, -1.0, False, "")
    assert out["phases"].first().label == "opening" and out["sfx"].first().length == 2.0 and out["dips"].first().dip_len == 0.4
    assert {r.file: r.message for r in out["bad_rows"].collect()} == {"old": "unsupported plan version", "odd": "malformed entry", "none": "the version key is missing"}


def test_unsigned_hash_keeps_its_bits(spark):
    big = (1 << 64) - 5
    df = spark.createDataFrame([(str(big),)], "h string")
    assert df.select(stores.signed_hash(F.col("h"))).first()[0] == big - (1 << 64)


def _clip(name, n=12, broken=False):
    return [(name, 1.0, i * 0.5, None if broken and i == 3 else 130.0, 20.0 + i % 2, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 7, n) for i in range(n)]


def test_triage_stream_takes_each_clip_once_and_retries(spark, tmp_path):
    source, reports, failed, state = (str(tmp_path / p) for p in ("in", "reports", "failed", "state"))

    def arrive(rows):
        spark.createDataFrame(rows, jobs.FRAMES).coalesce(1).write.mode("append").parquet(source)
        assert jobs.triage_stream(spark, source, reports, failed, state).awaitTermination(120)
        return sorted((r.clip_path, r.usable_ratio) for r in spark.read.parquet(reports).collect())

    assert arrive(_clip("a") + _clip("bad", broken=True)) == [("a", 1.0)]
    assert arrive(_clip("b") + _clip("a")) == [("a", 1.0), ("b", 1.0)]
    # The broken sample comes again, this time with its values.
    assert arrive(_clip("bad")[3:4]) == [("a", 1.0), ("b", 1.0), ("bad", 1.0)]
    assert jobs._stored(spark, failed, f"{jobs.FRAMES}, batch_id bigint").count() == 0


def test_clip_that_never_completes_is_given_up(spark, tmp_path):
    source, reports, failed, state = (str(tmp_path / p) for p in ("in", "reports", "failed", "state"))
    for n, rows in enumerate((_clip("half")[:5] + _clip("a"), _clip("b"), _clip("c"))):
        spark.createDataFrame(rows, jobs.FRAMES).coalesce(1).write.mode("append").parquet(source)
        assert jobs.triage_stream(spark, source, reports, failed, state, patience="1 second").awaitTermination(120)
        time.sleep(2.5)
    assert sorted(r.clip_path for r in spark.read.parquet(reports).collect()) == ["a", "b", "c"]
    gone = spark.read.parquet(failed).collect()
    assert {r.clip_path for r in gone} == {"half"} and len(gone) == 5


def test_clip_in_two_parts_is_judged_whole(spark, tmp_path):
    source, reports, failed, state = (str(tmp_path / p) for p in ("in", "reports", "failed", "state"))
    rows = _clip("late", 20)
    for part in (rows[:7], _clip("other"), rows[7:]):
        spark.createDataFrame(part, jobs.FRAMES).coalesce(1).write.mode("append").parquet(source)
        assert jobs.triage_stream(spark, source, reports, failed, state).awaitTermination(120)
    found = {r.clip_path: r.duration for r in spark.read.parquet(reports).collect()}
    assert found == {"late": 10.0, "other": 6.0}


def test_preference_stream_counts(spark, tmp_path):
    source, store, state = (str(tmp_path / p) for p in ("in", "store", "state"))
    for n in (1, 2):
        spark.createDataFrame([("shot_size", "", "close", None)] * n, jobs.SIGNALS).coalesce(1).write.mode("append").parquet(source)
        assert jobs.preference_stream(spark, source, store, state).awaitTermination(120)
    row = jobs.learned(spark, store).first()
    assert (row.family, row.context, row["count"], row.active) == ("shot_size", "*", 3, True)
