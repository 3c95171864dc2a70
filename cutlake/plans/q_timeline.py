"""Timeline core and pacing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cutlake.functions.columns import r6
from cutlake.functions.staging import settle, shared_folder
from cutlake.functions.timecode import frames_to_seconds, frames_to_tc, seconds_to_frames, tc_to_frames
from cutlake.operators import pacing, timeline
from cutlake.plans.registry import query
from cutlake.plans.views import Tables, oracle

SHOTS = """
shots as (select *, record_in / 25e0 as start_s, (record_out - record_in) / 25e0 as length_s,
    row_number() over (partition by timeline_id order by record_in, clip_id) as rn, count(*) over (partition by timeline_id) as n,
    lag(record_out) over (partition by timeline_id order by record_in, clip_id) as back
  from b_clips where track = 'V1'),
extents as (select timeline_id, max(record_out) / 25e0 as duration_seconds from b_clips group by timeline_id)
"""
STATS = SHOTS + """,
stats as (select e.timeline_id, e.duration_seconds, coalesce(shot_count, 0) as shot_count, coalesce(cut_count, 0) as cut_count,
    coalesce(a, 0e0) as avg_shot_seconds, coalesce(m, 0e0) as median_shot_seconds, coalesce(lo, 0e0) as min_shot_seconds,
    coalesce(hi, 0e0) as max_shot_seconds, coalesce(sd, 0e0) as std_shot_seconds
  from extents e left join (select timeline_id, count(*) as shot_count, count(*) filter (where record_in <= back) as cut_count, avg(length_s) as a,
    median(length_s) as m, min(length_s) as lo, max(length_s) as hi, stddev_pop(length_s) as sd from shots group by timeline_id) s on s.timeline_id = e.timeline_id)
"""
CURVE = SHOTS + """,
near as (select a.timeline_id, a.clip_id, count(*) as c from shots a join shots b on a.timeline_id = b.timeline_id
    and abs(b.start_s - a.start_s) <= 15 group by a.timeline_id, a.clip_id),
curve as (select a.timeline_id, a.clip_id, a.record_in, a.start_s, a.length_s, a.rn, avg(b.length_s) as rolling
  from shots a join near c on c.timeline_id = a.timeline_id and c.clip_id = a.clip_id
  join shots b on a.timeline_id = b.timeline_id and (abs(b.start_s - a.start_s) <= 15
    or (c.c < 5 and b.rn >= greatest(1, least(a.rn - 2, a.n - 4)) and b.rn < greatest(1, least(a.rn - 2, a.n - 4)) + 5))
  group by a.timeline_id, a.clip_id, a.record_in, a.start_s, a.length_s, a.rn)
"""
SECTIONS = CURVE + """,
labelled as (select c.*, m.cut_mean, case when cut_mean <= 0 then 'medium' when rolling < 75e-2 * cut_mean then 'fast'
    when rolling > 15e-1 * cut_mean then 'slow' else 'medium' end as label
  from curve c join (select timeline_id, avg(length_s) as cut_mean from shots group by timeline_id) m on m.timeline_id = c.timeline_id),
runs as (select *, rn - row_number() over (partition by timeline_id, label order by rn) as g from labelled),
sections as (select timeline_id, min(start_s) as start_s, max_by(start_s + length_s, rn) as end_s, label, count(*) as shots,
    avg(length_s) as avg_shot_length, min(cut_mean) as cut_mean from runs group by timeline_id, label, g)
"""


def stats_of(t: Tables):
    return pacing.pacing_stats(shots_of(t), pacing.extents_in_seconds(t.clips))


def shots_of(t: Tables):
    return timeline.with_seconds(timeline.select_shots(t.clips))


def rounded(df, *exact):
    return df.select(*[c if c in exact or dt not in ("double", "float") else r6(c).alias(c) for c, dt in df.dtypes])


TC_RATES = [23.976, 25.0, 29.97, 59.94]


@query("timecode_parse", oracle("", """
raw as (select event_id, case event_id % 4 when 0 then 23.976e0 when 1 then 25e0 when 2 then 29.97e0 else 59.94e0 end as fps,
    concat(lpad(cast(event_id % 30 as varchar), 2, '0'), ':', lpad(cast(event_id % 67 as varchar), 2, '0'), ':', lpad(cast(event_id * 7 % 61 as varchar), 2, '0'),
    case when event_id % 3 = 0 then ';' when event_id % 3 = 1 then ':' else ',' end, lpad(cast(event_id * 3 % 32 as varchar), 2, '0')) as tc from events),
p as (select *, cast(substr(tc, 1, 2) as bigint) as hh, cast(substr(tc, 4, 2) as bigint) as mm, cast(substr(tc, 7, 2) as bigint) as ss, substr(tc, 9, 1) as sep,
    cast(substr(tc, 10, 2) as bigint) as ff, case when fps > 50 then 60 when fps > 28 then 30 when fps < 24 then 24 else 25 end as rate from raw)
select event_id, tc, case when mm > 59 or ss > 59 or ff >= rate then null else cast(((hh * 60 + mm) * 60 + ss) * rate + ff
    - case when sep in (';', ',') and rate in (30, 60) then (rate // 15) * (hh * 60 + mm - (hh * 60 + mm) // 10) else 0 end as bigint) end as frames from p
"""))
def timecode_parse(t):
    i = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rate = F.when(i % 4 == 0, 23.976).when(i % 4 == 1, 25.0).when(i % 4 == 2, 29.97).otherwise(59.94)
    sep = F.when(i % 3 == 0, ";").when(i % 3 == 1, ":").otherwise(",")
    tc = F.concat(two(i % 30), F.lit(":"), two(i % 67), F.lit(":"), two(i * 7 % 61), sep, two(i * 3 % 32))
    return t.read("events").select("event_id", tc.alias("tc"), rate.alias("fps")).select(
        "event_id", "tc", tc_to_frames("tc", "fps").alias("frames")
    )


@query("timecode_format", oracle("b_clips", """
r as (select clip_id, record_in * 13 as f, case clip_id % 4 when 0 then 24 when 1 then 25 when 2 then 30 else 60 end as rate from b_clips),
d as (select *, rate in (30, 60) as df, rate // 15 as dpm, rate * 60 - rate // 15 as fpm, (rate * 60 - rate // 15) * 10 + rate // 15 as fp10 from r),
c as (select *, f + case when df then dpm * (f // fp10 * 9 + case when f % fp10 < rate * 60 then 0 else 1 + (f % fp10 - rate * 60) // fpm end) else 0 end as g from d)
select clip_id, concat(lpad(cast(g // rate // 3600 as varchar), 2, '0'), ':', lpad(cast(g // rate // 60 % 60 as varchar), 2, '0'), ':',
  lpad(cast(g // rate % 60 as varchar), 2, '0'), case when df then ';' else ':' end, lpad(cast(g % rate as varchar), 2, '0')) as tc, f as frames_again from c
"""))
def timecode_format(t):
    i = F.col("clip_id")
    fps = F.when(i % 4 == 0, 23.976).when(i % 4 == 1, 25.0).when(i % 4 == 2, 29.97).otherwise(59.94)
    tc = t.clips.select("clip_id", frames_to_tc(F.col("record_in") * 13, fps).alias("tc"), fps.alias("fps"))
    return tc.select("clip_id", "tc", tc_to_frames("tc", "fps").alias("frames_again"))


@query("frames_and_seconds", oracle("b_clips", """
select clip_id, round(record_in / 29.97e0, 6) as seconds, cast(round_even(record_in / 29.97e0 * 29.97e0, 0) as bigint) as frames,
  cast(round_even(record_in / 2e0, 0) as bigint) as half_frames from b_clips
"""))
def frames_and_seconds(t):
    s = frames_to_seconds("record_in", F.lit(29.97))
    return t.clips.select(
        "clip_id", r6(s).alias("seconds"), seconds_to_frames(s, F.lit(29.97)).alias("frames"),
        seconds_to_frames(F.col("record_in") / 2, F.lit(1.0)).alias("half_frames"),
    )


@query("shot_selection", oracle("b_clips", """
select timeline_id, clip_id, track, record_in from (select *, max(case when track = 'V1' and timeline_id % 5 > 0 then 1 else 0 end) over (partition by timeline_id) as has,
  case when timeline_id % 5 > 0 then track else concat('X', track) end as tr from b_clips) a where (has = 1 and track = 'V1') or has = 0
"""))
def shot_selection(t):
    track = F.when(F.col("timeline_id") % 5 > 0, F.col("track")).otherwise(F.concat(F.lit("X"), "track"))
    clips = t.clips.withColumn("was", F.col("track")).withColumn("track", track)
    return timeline.select_shots(clips).select("timeline_id", "clip_id", F.col("was").alias("track"), "record_in")


@query("cuts", oracle("b_clips", SHOTS + "select timeline_id, record_in as cut_frame from shots where record_in <= back"))
def cuts(t):
    return timeline.cuts(shots_of(t))


@query("timeline_extent", oracle("b_clips", "select user_id as timeline_id, coalesce(max(record_out), 0) as duration_frames from (select distinct user_id from events) u left join b_clips on timeline_id = user_id group by user_id"))
def timeline_extent(t):
    users = t.read("events").select(F.col("user_id").alias("timeline_id")).distinct()
    return timeline.timeline_extent(t.clips, users)


@query("transcript_extent", oracle("b_segments", "select take_id, round(max(end_s), 6) as duration_s, count(*) as segments from b_segments group by take_id"))
def transcript_extent(t):
    return rounded(timeline.transcript_extent(t.segments))


@query("transcript_text", oracle("b_segments", "select take_id, string_agg(text, chr(10) order by seg) as text from b_segments group by take_id"))
def transcript_text(t):
    return timeline.transcript_text(t.segments)


@query("overlap_pairs", oracle("b_clips", """
select a.timeline_id, a.source_file as track, a.clip_id as a_id, b.clip_id as b_id from b_clips a join b_clips b
on a.timeline_id = b.timeline_id and a.source_file = b.source_file and a.source_in < b.source_out and b.source_in < a.source_out and a.clip_id < b.clip_id
"""))
def overlap_pairs(t):
    clips = t.clips.withColumn("track", F.col("source_file"))
    return timeline.overlaps(clips, span=("source_in", "source_out"))


PACK = """
sel as (select take_id % 20 as papercut_id, take_id * 100 + seg as pos, trim(substring(text, 1, 40)) as name,
    cast(round_even(greatest(0e0, start_s - 25e-2) * 25, 0) as bigint) as source_in, cast(round_even((end_s + 25e-2) * 25, 0) as bigint) as source_out
  from b_segments where speaker = 'user'),
p as (select *, cast(sum(source_out - source_in) over (partition by papercut_id order by pos rows between unbounded preceding and current row) as bigint) as record_out from sel)
select papercut_id, pos, name, source_in, source_out, record_out - (source_out - source_in) as record_in, record_out, track, kind
from p cross join (select 'V1' as track, 'video' as kind union all select 'A1', 'audio') k
"""


@query("pack_selects", oracle("b_segments", PACK))
def pack_selects(t):
    sel = t.segments.select(
        (F.col("take_id") % 20).alias("papercut_id"), (F.col("take_id") * 100 + F.col("seg")).alias("pos"), "text",
        F.lit("cam").alias("source_name"), F.lit(25.0).alias("fps"), "start_s", "end_s", (F.col("speaker") == "user").alias("selected"),
    )
    return timeline.pack_selects(sel, 0.25).drop("source_name", "fps")


ASSEMBLY = """
d as (select take_id, max(end_s) as dur from b_segments group by take_id),
sel as (select s.take_id % 20 as plan_id, s.take_id as scene_no, seg, greatest(0e0, start_s - 5e-1) as a, greatest(least(end_s + 5e-1, dur), greatest(0e0, start_s - 5e-1)) as b
  from b_segments s join d on d.take_id = s.take_id),
f as (select *, cast(round_even(a * 25, 0) as bigint) as source_in, cast(round_even(b * 25, 0) as bigint) as source_out from sel),
p as (select *, cast(sum(source_out - source_in) over (partition by plan_id order by scene_no, seg rows between unbounded preceding and current row) as bigint) as record_out from f)
"""


def _assembly(t):
    seg = t.segments.withColumns({"plan_id": F.col("take_id") % 20, "scene_no": F.col("take_id"), "fps": F.lit(25.0)})
    return timeline.pack_assembly(seg, timeline.transcript_extent(t.segments))


@query("pack_assembly", oracle("b_segments", ASSEMBLY + "select plan_id, scene_no, seg, source_in, source_out, record_out - (source_out - source_in) as record_in, record_out, track from p cross join (select 'V1' as track union all select 'A1') k"))
def pack_assembly(t):
    return _assembly(t).select("plan_id", "scene_no", "seg", "source_in", "source_out", "record_in", "record_out", "track")


@query("assembly_markers", oracle("b_segments", ASSEMBLY + "select plan_id, scene_no, min(record_out - (source_out - source_in)) as frame from p group by plan_id, scene_no"))
def assembly_markers(t):
    return timeline.scene_markers(_assembly(t))


STAT_COLS = ", ".join(f"round({m}, 6) as {m}" if "count" not in m else m for m in pacing.METRICS)


@query("pacing_stats", oracle("b_clips", STATS + f"select timeline_id, {STAT_COLS} from stats"))
def pacing_stats(t):
    return rounded(stats_of(t))


@query("pacing_curve", oracle("b_clips", CURVE + "select timeline_id, clip_id, round(start_s, 6) as start_s, round(rolling, 6) as rolling from curve"))
def pacing_curve(t):
    return rounded(pacing.pacing_curve(shots_of(t)).select("timeline_id", "clip_id", "start_s", "rolling"))


@query("shot_histogram", oracle("b_clips", SHOTS + """
select e.timeline_id, bucket, count(s.clip_id) as shots from extents e cross join (values ('0–1s', 0e0, 1e0), ('1–2s', 1e0, 2e0), ('2–4s', 2e0, 4e0),
  ('4–8s', 4e0, 8e0), ('8–15s', 8e0, 15e0), ('15–30s', 15e0, 30e0), ('30s+', 30e0, 1e300)) b(bucket, lo, hi)
left join shots s on s.timeline_id = e.timeline_id and s.length_s >= lo and s.length_s < hi group by e.timeline_id, bucket
"""))
def shot_histogram(t):
    return pacing.shot_histogram(shots_of(t), pacing.extents_in_seconds(t.clips))


@query("longest_shots", oracle("b_clips", SHOTS + """
select timeline_id, rank, name, round(start_s, 6) as start_s, round(length_s, 6) as length_s from
(select *, row_number() over (partition by timeline_id order by length_s desc, record_in, clip_id) as rank from shots) a where rank <= 5
"""))
def longest_shots(t):
    return rounded(pacing.longest_shots(shots_of(t)))


@query("tempo_sections", oracle("b_clips", SECTIONS + """
select timeline_id, round(start_s, 6) as start_s, round(end_s, 6) as end_s, label, shots, round(avg_shot_length, 6) as avg_shot_length from sections
"""))
def tempo_sections(t):
    return rounded(pacing.pacing_sections(shots_of(t)).drop("cut_mean"))


@query("rhythm_signature", oracle("b_clips", SHOTS + """
select e.timeline_id, slice, round(coalesce(avg(length_s), 0), 6) as mean_length from extents e cross join range(20) r(slice) left join shots s
on s.timeline_id = e.timeline_id and least(19, floor(s.start_s / e.duration_seconds * 20)) = slice group by e.timeline_id, slice
"""))
def rhythm_signature(t):
    return rounded(pacing.rhythm_signature(shots_of(t), pacing.extents_in_seconds(t.clips)))


SCENES = SHOTS + """,
mk as (select timeline_id, frame, name, row_number() over (partition by timeline_id order by frame, name) as i from b_markers),
bounds as (select timeline_id, frame, name from mk union all select timeline_id, 0, 'Opening' from mk where i = 1 and frame > 0
  union all select timeline_id, 0, 'Full cut' from extents where timeline_id not in (select timeline_id from mk)),
scenes as (select b.timeline_id, row_number() over (partition by b.timeline_id order by frame, name) as scene_no, name as heading, frame as lo,
    coalesce(lead(frame) over (partition by b.timeline_id order by frame, name), cast(round(duration_seconds * 25) as bigint)) as hi from bounds b join extents e on e.timeline_id = b.timeline_id),
inside as (select s.timeline_id, scene_no, clip_id, (record_in - lo) / 25e0 as start_s, (record_out - lo) / 25e0 as end_s, length_s, record_in,
    lag(record_out) over (partition by s.timeline_id, scene_no order by record_in, clip_id) as back
  from shots s join scenes c on c.timeline_id = s.timeline_id and record_in >= lo and record_in < hi)
"""


@query("scene_pacing", oracle("b_clips b_markers", SCENES + """
select c.timeline_id, c.scene_no, c.heading, round(min(lo) / 25e0, 6) as scene_start, round(min(hi) / 25e0, 6) as scene_end, round(coalesce(max(end_s), 0), 6) as duration_seconds,
  count(clip_id) as shot_count, count(*) filter (where record_in <= back) as cut_count, round(coalesce(avg(length_s), 0), 6) as avg_shot_seconds,
  round(coalesce(median(length_s), 0), 6) as median_shot_seconds, round(coalesce(min(length_s), 0), 6) as min_shot_seconds,
  round(coalesce(max(length_s), 0), 6) as max_shot_seconds, round(coalesce(stddev_pop(length_s), 0), 6) as std_shot_seconds
from scenes c left join inside i on i.timeline_id = c.timeline_id and i.scene_no = c.scene_no group by c.timeline_id, c.scene_no, c.heading
"""))
def scene_pacing(t):
    return rounded(pacing.scene_pacing(t.clips, shots_of(t), t.markers))


def _pairs(t):
    return t.read("events").select(F.col("user_id").alias("a_id"), (F.col("user_id") + 1).alias("b_id")).distinct()


@query("cut_comparison", oracle("b_clips", STATS + """,
long as (unpivot (select timeline_id, duration_seconds, cast(shot_count as double) as shot_count, cast(cut_count as double) as cut_count, avg_shot_seconds, median_shot_seconds,
  min_shot_seconds, max_shot_seconds, std_shot_seconds from stats) on columns(* exclude (timeline_id)) into name metric value v)
select a.timeline_id as a_id, b.timeline_id as b_id, a.metric, round(a.v, 6) as a, round(b.v, 6) as b, round(b.v - a.v, 6) as delta
from long a join long b on b.timeline_id = a.timeline_id + 1 and a.metric = b.metric
"""))
def cut_comparison(t):
    return rounded(pacing.compare_cuts(stats_of(t), _pairs(t)))


@query("cut_verdicts", oracle("b_clips", STATS + """,
d as (select a.timeline_id as a_id, b.timeline_id as b_id, b.avg_shot_seconds - a.avg_shot_seconds as da, a.avg_shot_seconds as a0,
  b.std_shot_seconds - a.std_shot_seconds as ds, a.std_shot_seconds as s0, b.duration_seconds - a.duration_seconds as dd, a.duration_seconds as d0
  from stats a join stats b on b.timeline_id = a.timeline_id + 1)
select a_id, b_id, case when abs(da) <= 1e-9 or (a0 > 0 and abs(da) / a0 < 5e-2) then 'same' when da < 0 then 'faster' else 'slower' end as tempo,
  case when abs(ds) <= 1e-9 or (s0 > 0 and abs(ds) / s0 < 5e-2) then null when ds < 0 then 'tighter' else 'looser' end as rhythm,
  case when abs(dd) <= 1e-9 or (d0 > 0 and abs(dd) / d0 < 5e-2) then null else round(dd, 6) end as runtime_s from d
"""))
def cut_verdicts(t):
    return rounded(pacing.cut_verdicts(stats_of(t), _pairs(t)))


@query("genre_bands", oracle("b_clips", STATS + """,
g(genre, low, high) as (values ('action', 2e0, 35e-1), ('thriller', 3e0, 5e0), ('horror', 3e0, 55e-1), ('comedy', 35e-1, 55e-1), ('drama', 4e0, 7e0),
  ('arthouse', 8e0, 30e0), ('documentary', 4e0, 8e0), ('musicvideo', 1e0, 25e-1))
select timeline_id, round(avg_shot_seconds, 6) as asl, genre, case when avg_shot_seconds < low then 'below' when avg_shot_seconds > high then 'above' else 'inside' end as position,
  row_number() over (partition by timeline_id order by round(greatest(low - avg_shot_seconds, avg_shot_seconds - high, 0), 9), genre) as fit_rank from stats cross join g
"""))
def genre_bands(t):
    return rounded(pacing.genre_position(stats_of(t)).drop("profile", "low", "high"))


@query("cut_character", oracle("b_clips", STATS + """
select timeline_id, case when shot_count = 0 then null when avg_shot_seconds < 25e-1 then 'fast' when avg_shot_seconds <= 6 then 'moderate' else 'slow' end as tempo,
  case when shot_count = 0 then null when std_shot_seconds < 5e-1 * avg_shot_seconds then 'even' else 'varied' end as rhythm from stats
"""))
def cut_character(t):
    return pacing.characterize(stats_of(t))


@query("slow_sections", oracle("b_clips", SECTIONS + """
select timeline_id, round(start_s, 6) as start_s, round(end_s, 6) as end_s, label, round(avg_shot_length, 6) as avg_shot_length,
  cast(round_even(start_s * 25, 0) as bigint) as frame from sections where cut_mean > 0 and avg_shot_length >= 12e-1 * cut_mean
"""))
def slow_sections(t):
    return rounded(pacing.slow_sections(pacing.pacing_sections(shots_of(t)), 25.0, 1.2).drop("cut_mean", "shots"))


@query("version_history", oracle("b_clips", STATS + """,
v as (select *, timeline_id % 10 as project, row_number() over (partition by timeline_id % 10 order by timeline_id) as id from stats)
select project, id, concat('cut ', cast(timeline_id as varchar)) as label, round(duration_seconds, 6) as duration_seconds, shot_count, round(avg_shot_seconds, 6) as avg_shot_seconds,
  round(std_shot_seconds, 6) as std_shot_seconds, round(avg_shot_seconds - lag(avg_shot_seconds) over (partition by project order by id), 6) as tempo_trend from v
"""))
def version_history(t):
    stats = stats_of(t).withColumn("project", F.col("timeline_id") % 10).withColumn(
        "label", F.concat(F.lit("cut "), "timeline_id")
    )
    chunk = F.floor(F.col("timeline_id") / 1024)
    return rounded(pacing.versions(pacing.append_version(None, stats, order=["timeline_id"], chunk=chunk)))


@query("stored_history", oracle("b_clips", STATS + """,
v as (select *, timeline_id % 10 as project, row_number() over (partition by timeline_id % 10 order by timeline_id // 10 % 3, timeline_id) as id from stats)
select project, id, concat('cut ', cast(timeline_id as varchar)) as label, shot_count, round(avg_shot_seconds, 6) as avg_shot_seconds,
  round(avg_shot_seconds - lag(avg_shot_seconds) over (partition by project order by id), 6) as tempo_trend from v
"""))
def stored_history(t):
    """Three saves, each appended to the history that the ones before have stored."""
    stats = stats_of(t).withColumns({"project": F.col("timeline_id") % 10, "label": F.concat(F.lit("cut "), "timeline_id")})
    stats = settle(stats)
    path = f"{shared_folder(t.spark)}/stage-{t.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    for save in range(3):
        pacing.save_versions(stats.where(F.floor(F.col("timeline_id") / 10) % 3 == save), path, order=["timeline_id"], chunk=F.floor(F.col("timeline_id") / 1024))
    history = t.spark.read.parquet(path).withColumn("project", F.col("project").cast("bigint"))
    return rounded(pacing.versions(history).select("project", "id", "label", "shot_count", "avg_shot_seconds", "tempo_trend"))
