"""Footage quality, pixel and sample queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.columns import r6
from cutlake.functions.ordered import row_index, scan
from cutlake.operators import footage, pixels
from cutlake.plans.q_timeline import rounded
from cutlake.plans.registry import query
from cutlake.plans.views import oracle

BASE = """
base as (select *, count(*) over w as n, row_number() over (partition by clip_id order by t) as rn, lag(motion) over o as pm, lead(motion) over o as nm, lag(brightness) over o as pb,
    (rank() over (partition by clip_id order by sharpness) - 1 + rank() over (partition by clip_id order by sharpness) - 1 + count(*) over (partition by clip_id, sharpness) - 1) / 2e0 as mid
  from b_frames window w as (partition by clip_id), o as (partition by clip_id order by t)),
prof as (select clip_id, count(*) as n, list_sort(list(brightness)) as bs, list_sort(list(sharpness)) as ss, median(brightness) as median_brightness,
    coalesce(median(motion) filter (where rn > 1), 0) as median_motion, coalesce(avg(motion) filter (where rn > 1), 0) as mean_motion,
    coalesce(max(motion) filter (where rn > 1), 0) as peak_motion, coalesce(median(residual) filter (where rn > 1), 0) as median_residual from base group by clip_id),
p as (select *, bs[1 + cast(round_even(9e-1 * (n - 1), 0) as bigint)] - bs[1 + cast(round_even(1e-1 * (n - 1), 0) as bigint)] as spread, ss[1 + cast(round_even(9e-1 * (n - 1), 0) as bigint)] as detail from prof),
q as (select *, n >= 2 and spread < 45 and detail >= 8 and median_brightness < 110 as is_flat, detail >= 4 as has_detail from p)
"""
LABELS = BASE + """,
raw as (select b.*, case when b.n > 1 then mid / (b.n - 1) else 5e-1 end as sharp_rank, least(1e0, greatest(0e0, (brightness - 18) / 102e0)) as adequacy, q.median_residual, q.peak_motion, q.median_motion, q.mean_motion,
    case when pm is null and nm is null then 0 when pm is null then abs(nm - motion) when nm is null then abs(motion - pm) else (abs(motion - pm) + abs(nm - motion)) / 2 end as jitter,
    q.is_flat, q.median_brightness, q.detail, q.has_detail
  from base b join q on q.clip_id = b.clip_id),
lab as (select *, case when brightness < 18 or (not is_flat and brightness < 5e-1 * median_brightness) or (brightness < 110 and sharpness < 4) then 'dark'
    when sharpness < 25e-2 * detail then 'blurry' when motion > 3 * median_motion and jitter > 5e-1 * mean_motion then 'shaky' else 'usable' end as raw_label from raw),
sm as (select *, case when lag(raw_label) over o = lead(raw_label) over o and lag(raw_label) over o <> raw_label then lag(raw_label) over o else raw_label end as label
  from lab window o as (partition by clip_id order by t)),
runs as (select *, rn - row_number() over (partition by clip_id, label order by t) as g from sm),
seg0 as (select clip_id, label, min(t) as s, avg(sharp_rank * adequacy) as q, max(n) * 5e-1 as dur from runs group by clip_id, label, g),
seg as (select clip_id, case when row_number() over (partition by clip_id order by s) = 1 then 0e0 else s end as start_s, coalesce(lead(s) over (partition by clip_id order by s), dur) as end_s, label,
    case when label = 'usable' then q else 0e0 end as score from seg0)
"""
WINDOWS = LABELS + """,
cut as (select b.clip_id, round_even(t, 3) as cut_s from base b join q on q.clip_id = b.clip_id where pm is not null and nm is not null and q.n >= 3 and median_motion > 0
    and motion >= 35e-1 * median_motion and motion >= 22e-1 * greatest(pm, nm, 1e-9) and abs(brightness - pb) >= 12),
win0 as (select clip_id, start_s + k * 5e-1 as a from (select *, unnest(range(cast(ceil((end_s - start_s) * 2) as bigint) + 1)) as k from seg where label = 'usable') z where start_s + k * 5e-1 + 1 <= end_s + 1e-9),
win as (select clip_id, a, a + 1 as b from win0 w where not exists (select 1 from cut c where c.clip_id = w.clip_id and cut_s > a + 1e-9 and cut_s < a + 1 - 1e-9)),
scored as (select w.clip_id, a, b, least(1e0, 75e-2 * avg(sharp_rank) + 25e-2 * avg(case when median_residual > 0 and residual >= 5e-1 * median_residual and residual <= 25e-1 * median_residual then 1e0 else 0e0 end))
    * greatest(0e0, 1 - 15e-1 * avg(clipped + crushed)) as score from win w join sm on sm.clip_id = w.clip_id and t >= a - 1e-9 and t < b - 1e-9 group by w.clip_id, a, b)
"""
KEPT = WINDOWS + """,
ord as (select clip_id, list({'s': a, 'e': b, 'v': score} order by round(score, 12) desc, a) as l from scored group by clip_id),
folded as (select clip_id, list_reduce(l, lambda acc, x: case when len(acc) < 12 and len(list_filter(acc, lambda o: not (x.e <= o.s + 1e-9 or x.s >= o.e - 1e-9))) = 0 then list_append(acc, x) else acc end, cast([] as struct(s double, e double, v double)[])) as k from (select clip_id, list_transform(l, lambda x: [x]) as l0, l from ord) z),
kept as (select clip_id, i as rank, k[i].s as win_start, k[i].e as win_end, k[i].v as score from (select clip_id, k, unnest(range(1, len(k) + 1)) as i from folded) z)
"""


def durations(t):
    return t.frames.groupBy("clip_id").agg((F.count("*") * 0.5).alias("duration"))


@query("nearest_rank_percentiles", oracle("b_frames", BASE + "select clip_id, round(detail, 6) as sharpness_p90, round(bs[1 + cast(round_even(25e-2 * (n - 1), 0) as bigint)], 6) as brightness_p25 from q"))
def nearest_rank_percentiles(t):
    a = footage.nearest_rank_percentile(t.frames, "sharpness", 0.9, "sharpness_p90")
    return rounded(a.join(footage.nearest_rank_percentile(t.frames, "brightness", 0.25, "brightness_p25"), "clip_id"))


@query("sharpness_rank", oracle("b_frames", BASE + "select clip_id, t, round(case when n > 1 then mid / (n - 1) else 5e-1 end, 6) as sharp_rank from base"))
def sharpness_rank(t):
    return rounded(footage.sharpness_rank(t.frames).select("clip_id", "t", "sharp_rank"))


@query("clip_exposure", oracle("b_frames", BASE + "select clip_id, round(spread, 6) as spread, round(detail, 6) as detail, round(median_brightness, 6) as median_brightness, is_flat, has_detail from q"))
def clip_exposure(t):
    return rounded(footage.clip_exposure(t.frames))


@query("motion_profile", oracle("b_frames", LABELS + "select clip_id, t, round(median_motion, 6) as median_motion, round(mean_motion, 6) as mean_motion, round(jitter, 6) as jitter from raw"))
def motion_profile(t):
    return rounded(footage.motion_profile(t.frames).select("clip_id", "t", "median_motion", "mean_motion", "jitter"))


@query("sample_labels", oracle("b_frames", LABELS + "select clip_id, t, raw_label, label from sm"))
def sample_labels(t):
    return footage.label_samples(t.frames).select("clip_id", "t", "raw_label", "label")


@query("quality_segments", oracle("b_frames", LABELS + "select clip_id, start_s, end_s, label, round(score, 6) as score from seg"))
def quality_segments(t):
    return rounded(footage.quality_segments(footage.label_samples(t.frames), durations(t)))


@query("hard_cuts", oracle("b_frames", WINDOWS + "select clip_id, cut_s from cut"))
def hard_cuts(t):
    base = footage.with_neighbours(t.frames)
    return footage.scene_cuts(base, footage.clip_profile(base))


def triage(t):
    from cutlake.functions.staging import settle

    lab = footage.label_samples(t.frames)
    cuts = footage.scene_cuts(lab.drop("median_motion", "samples"), lab.groupBy("clip_id").agg(F.first("median_motion").alias("median_motion"), F.first("samples").alias("samples")))
    return lab, settle(footage.quality_segments(lab, durations(t))), settle(cuts)


@query("candidate_windows", oracle("b_frames", WINDOWS + "select clip_id, a as win_start, b as win_end from win"))
def candidate_windows(t):
    _, seg, cuts = triage(t)
    return footage.candidate_windows(seg, cuts)


@query("window_scores", oracle("b_frames", WINDOWS + "select clip_id, a as win_start, b as win_end, round(score, 6) as score from scored"))
def window_scores(t):
    lab, seg, cuts = triage(t)
    return rounded(footage.score_windows(footage.candidate_windows(seg, cuts), lab))


@query("best_windows", oracle("b_frames", KEPT + "select clip_id, rank, win_start, win_end, round(score, 6) as score from kept"))
def best_windows(t):
    lab, seg, cuts = triage(t)
    return rounded(footage.pick_moments(footage.score_windows(footage.candidate_windows(seg, cuts), lab)))


FEATURES = KEPT + """,
mem as (select k.clip_id, win_start, win_end, score, t, residual, motion, dx, dy, phash, sharp_rank * adequacy as quality, peak_motion, max(residual) over (partition by k.clip_id, win_start) as rp,
    row_number() over (partition by k.clip_id, win_start order by t) as i, count(*) over (partition by k.clip_id, win_start) as c
  from kept k join sm on sm.clip_id = k.clip_id and t >= win_start - 1e-9 and t < win_end - 1e-9),
env as (select *, case when rp > 1e-9 then residual / rp when peak_motion > 0 then motion / peak_motion else 0e0 end as v from mem)
"""
PEAK = """
pk as (select *, lag(v) over o as v0, lead(v) over o as v2, lag(t) over o as t0, lead(t) over o as t2, row_number() over (partition by clip_id, win_start order by round(v, 10) desc, t) as r from {src} window o as (partition by clip_id, win_start order by t)),
pk2 as (select *, least(5e-1, greatest(-5e-1, 5e-1 * (v0 - v2) / nullif(v0 - 2 * v + v2, 0))) as off from pk where r = 1),
peaks as (select clip_id, win_start, case when v <= 1e-12 then -1e0 when v0 is not null and v2 is not null and v0 - 2 * v + v2 < -1e-12 then t + off * case when off >= 0 then t2 - t else t - t0 end else t end as peak_time from pk2)
"""


@query("moment_peaks", oracle("b_frames", FEATURES + "," + PEAK.format(src="env") + "select clip_id, win_start, round(peak_time, 6) as peak_time from peaks"))
def moment_peaks(t):
    return rounded(_featured(t)[1].select("clip_id", "win_start", "peak_time"))


def _featured(t):
    lab, seg, cuts = triage(t)
    kept = footage.pick_moments(footage.score_windows(footage.candidate_windows(seg, cuts), lab))
    return lab, footage.moment_features(kept, lab)


@query("moment_features", oracle("b_frames", FEATURES + """
select clip_id, win_start, round(avg(dx) filter (where i <= 2), 6) as entry_dx, round(avg(dy) filter (where i <= 2), 6) as entry_dy, round(avg(dx) filter (where i > c - 2), 6) as exit_dx,
  round(avg(dy) filter (where i > c - 2), 6) as exit_dy, round(sum(quality), 6) as quality_sum, max(phash) filter (where i = c // 2 + 1) as phash, count(*) as samples from env group by clip_id, win_start
"""))
def moment_features(t):
    m = _featured(t)[1]
    q = F.aggregate("frame_quality", F.lit(0.0), lambda a, x: a + x["q"])
    return rounded(m.select(
        "clip_id", "win_start", F.col("entry_motion.dx").alias("entry_dx"), F.col("entry_motion.dy").alias("entry_dy"),
        F.col("exit_motion.dx").alias("exit_dx"), F.col("exit_motion.dy").alias("exit_dy"), q.alias("quality_sum"), "phash",
        F.size("frame_quality").cast("bigint").alias("samples"),
    ))


AUDIO = """
ap as (select clip_id, count(*) as windows, median(rms) as mr, median(low_ratio) as ml, max(rms) as peak, avg(rms) as mean, stddev_pop(rms) as sd, count(*) filter (where clipping > 1e-3) as cl from b_audio group by clip_id),
af as (select *, mr >= 1e-2 and windows >= 4 and case when mean > 0 then sd / mean else 0 end < 8e-2 as bad from ap),
bu as (select a.*, peak, windows, case when not bad and rms > 18e-1 * mr and rms > 1e-2 then 1e0 else 0e0 end as burst, row_number() over (partition by a.clip_id order by t) as i from b_audio a join af on af.clip_id = a.clip_id)
"""


@query("audio_flags", oracle("b_audio", AUDIO + """
select clip_id, windows, round(mr, 6) as median_rms, round(ml, 6) as median_low, bad as unreliable, case when bad then 'constant_tone' else concat_ws('; ',
  case when cl > 0 then 'clipping' end, case when ml > 6e-1 and mr >= 1e-2 then 'wind' end, case when mr < 1e-2 then 'silent' end) end as notes from af
"""))
def audio_flags(t):
    return rounded(footage.audio_profile(t.audio).select(
        "clip_id", "windows", "median_rms", "median_low", "unreliable", F.array_join("audio_notes", "; ").alias("notes")
    ))


@query("audio_bursts", oracle("b_audio", AUDIO + "select clip_id, t, burst from bu"))
def audio_bursts(t):
    return footage.audio_bursts(t.audio, footage.audio_profile(t.audio)).select("clip_id", "t", "burst")


@query("audio_highlights", oracle("b_frames b_audio", FEATURES + "," + AUDIO + """,
hl as (select k.clip_id, win_start, least(1e0, 3 * avg(burst)) as highlight from kept k join bu on bu.clip_id = k.clip_id and bu.t >= win_start - 1e-9 and bu.t < win_end - 1e-9 group by k.clip_id, win_start),
env2 as (select e.clip_id, win_start, e.t, case when peak > 0 then 5e-1 * v + 5e-1 * rms / peak else v end as v from env e left join bu on bu.clip_id = e.clip_id and bu.i = least(windows, greatest(0, cast(floor(e.t / 5e-1) as bigint)) + 1)),
env3 as (select e.clip_id, e.win_start, e.t, coalesce(f.v, e.v) as v from env e left join env2 f on f.clip_id = e.clip_id and f.win_start = e.win_start and f.t = e.t),
""" + PEAK.format(src="env3") + """
select p.clip_id, p.win_start, round(coalesce(highlight, 0), 6) as highlight, round(peak_time, 6) as peak_time from peaks p left join hl on hl.clip_id = p.clip_id and hl.win_start = p.win_start
"""))
def audio_highlights(t):
    out = footage.apply_audio(_featured(t)[1], t.audio)
    return rounded(out.select("clip_id", "win_start", "highlight", "peak_time"))


REPORT = KEPT + "," + AUDIO + """,
bl as (select clip_id, label, sum(end_s - start_s) as sec, min(start_s) as f from seg group by clip_id, label),
sp as (select clip_id, coalesce(sum(sec) filter (where label = 'usable'), 0) as usable_s, max_by(label, {'a': round(sec, 9), 'b': -f}) filter (where label <> 'usable') as worst from bl group by clip_id),
fw as (select q.clip_id, k * 5e-1 as a, k * 5e-1 + 1 as b from (select *, unnest(range(n + 1)) as k from q) q where has_detail and clip_id not in (select clip_id from kept) and k * 5e-1 + 1 <= n * 5e-1 + 1e-9),
fx as (select clip_id, count(*) as c from (select distinct w.clip_id, w.a from fw w where not exists (select 1 from cut c where c.clip_id = w.clip_id and cut_s > a + 1e-9 and cut_s < b - 1e-9)) z group by clip_id),
mo as (select q.clip_id, q.n * 5e-1 as duration, q.is_flat, (select count(*) from kept k where k.clip_id = q.clip_id) as m, (select count(*) from cut c where c.clip_id = q.clip_id) as c, coalesce(fx.c, 0) as fc from q left join fx on fx.clip_id = q.clip_id),
rep as (select mo.clip_id, duration, usable_s / duration as usable_ratio, worst, m as moments, c as hard_cuts, fc, concat_ws('; ', case when c > 0 then 'hard_cuts' end, case when is_flat then 'flat' end,
  case when af.bad then 'constant_tone' else nullif(concat_ws('; ', case when cl > 0 then 'clipping' end, case when ml > 6e-1 and mr >= 1e-2 then 'wind' end, case when mr < 1e-2 then 'silent' end), '') end,
  case when duration - usable_s > 1e-6 then concat('mostly_', worst) end, case when m = 0 and fc = 0 then 'no_moments' end) as notes
  from mo join sp on sp.clip_id = mo.clip_id left join af on af.clip_id = mo.clip_id)
"""


def reports(t):
    lab, seg, cuts = triage(t)
    return footage.clip_report(lab, seg, footage.best_moments(lab, seg, cuts, durations(t)), cuts, durations(t), t.audio)


@query("clip_verdicts", oracle("b_frames b_audio", REPORT + """
select clip_id, duration, round(usable_ratio, 6) as usable_ratio, worst, moments, hard_cuts, notes from rep
"""))
def clip_verdicts(t):
    return rounded(reports(t).withColumn("notes", F.array_join("notes", "; ")))


@query("folder_summary", oracle("b_frames b_audio", REPORT + """
select clip_id % 10 as folder, count(*) as clips, cast(sum(moments) as bigint) as moments, cast(count(*) filter (where notes <> '') as bigint) as clips_with_problems, round(avg(round_even(usable_ratio * 100, 0)), 6) as mean_usable_percent from rep group by clip_id % 10
"""))
def folder_summary(t):
    return rounded(footage.folder_summary(reports(t).withColumn("folder", F.col("clip_id") % 10)))


@query("near_duplicates", oracle("", """
h as (select p_partkey * 2654435761 as phash, p_size % 3 as project from part union all select p_partkey * 2654435761 + p_size % 4, p_size % 3 from part),
c as (select project, phash, count(*) as copies from h where phash <> 0 group by project, phash)
select a.project, a.phash as a_hash, b.phash as b_hash, a.copies as a_copies, b.copies as b_copies, cast(bit_count(xor(a.phash, b.phash)) as bigint) as distance
from c a join c b on a.project = b.project and a.phash < b.phash where bit_count(xor(a.phash, b.phash)) <= 6
"""))
def near_duplicates(t):
    m = t.moments.select("phash", "mid").join(t.read("part").select(F.col("p_partkey").alias("mid"), "p_size"), "mid")
    project = (F.col("p_size") % 3).alias("project")
    twice = m.select("phash", project).unionByName(m.select((F.col("phash") + F.col("p_size") % 4).alias("phash"), project))
    return footage.near_duplicates(twice, keys=["project"])


# Pixel frames: 64 numbers of an embedding as an 8×8 picture.
def pictures(t):
    e = t.read("embeddings").select(F.col("label").cast("bigint").alias("clip_id"), F.col("vec_id"), "embedding")
    luma = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("double"))
    return e.select("clip_id", F.col("vec_id").cast("double").alias("t"), F.lit(8).alias("w"), F.lit(8).alias("h"), luma.alias("luma"))


def colour_pictures(t):
    p = pictures(t)
    turn = lambda k: F.concat(F.slice("luma", k + 1, 64 - k), F.slice("luma", 1, k))
    warm = F.transform(turn(21), lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x - 128) * 3 + 90)))
    return p.select(
        "clip_id", "t", "w", "h",
        F.transform("luma", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x - 128) * 3 + 120 + F.pmod(F.col("t"), F.lit(40.0))))).alias("r"),
        warm.alias("g"),
        F.transform(turn(42), lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x - 128) * 3 + 100 - F.pmod(F.col("t"), F.lit(60.0))))).alias("b"),
    )


PIXELS = """
e as (select vec_id, label as clip_id, list_transform(embedding, lambda x: floor((cast(x as double) + 1) * 1275e-1)) as l from embeddings),
fr as (select cast(clip_id as bigint) as clip_id, cast(vec_id as double) as t, l, lag(l) over (partition by clip_id order by vec_id) as pl from e),
px as (select clip_id, t, i, i % 8 as x, i // 8 as y, l[i + 1] as v, pl[i + 1] as pv, case when i % 8 = 0 then l[i + 2] - l[i + 1] when i % 8 = 7 then l[i + 1] - l[i] else (l[i + 2] - l[i]) / 2e0 end as gx,
  case when i // 8 = 0 then l[i + 9] - l[i + 1] when i // 8 = 7 then l[i + 1] - l[i - 7] else (l[i + 9] - l[i - 7]) / 2e0 end as gy from fr cross join range(64) r(i))
"""


@query("frame_statistics", oracle("", PIXELS + """,
blocks as (select f.clip_id, f.t, r, c, coalesce((select avg(v) from px where px.clip_id = f.clip_id and px.t = f.t and y >= 8 * r // 8 and y < 8 * (r + 1) // 8 and x >= 8 * c // 9 and x < 8 * (c + 1) // 9), 0) as m from fr f cross join range(8) a(r) cross join range(9) b(c)),
bits as (select clip_id, t, sum(case when m > pm then cast(pow(cast(2 as hugeint), 63 - (r * 8 + c - 1)) as hugeint) else 0 end) as h from (select *, lag(m) over (partition by clip_id, t, r order by c) as pm from blocks) z where c > 0 group by clip_id, t)
select px.clip_id, px.t, round(avg(v), 6) as brightness, round(avg(gx * gx + gy * gy), 6) as sharpness, round(avg(case when v >= 140 then 1e0 else 0e0 end), 6) as clipped, round(avg(case when v <= 110 then 1e0 else 0e0 end), 6) as crushed,
  round(coalesce(avg(abs(v - pv)), 0), 6) as motion, cast(case when min(h) >= 9223372036854775808 then min(h) - 18446744073709551616 else min(h) end as bigint) as phash from px join bits on bits.clip_id = px.clip_id and bits.t = px.t group by px.clip_id, px.t
"""))
def frame_statistics(t):
    return rounded(pixels.frame_stats(pictures(t), clipped_at=140.0, crushed_at=110.0))


COLOUR = """
e as (select vec_id, label as clip_id, list_transform(embedding, lambda x: floor((cast(x as double) + 1) * 1275e-1)) as l from embeddings),
px as (select cast(clip_id as bigint) as clip_id, cast(vec_id as double) as t, i, i % 8 as x, i // 8 as y, least(255e0, greatest(0e0, (l[i + 1] - 128) * 3 + 120 + vec_id % 40)) as r,
  least(255e0, greatest(0e0, (l[(i + 21) % 64 + 1] - 128) * 3 + 90)) as g, least(255e0, greatest(0e0, (l[(i + 42) % 64 + 1] - 128) * 3 + 100 - vec_id % 60)) as b from e cross join range(64) z(i))
"""


@query("daylight_class", oracle("", COLOUR + """,
m as (select clip_id, t, 2126e-4 * avg(r) + 7152e-4 * avg(g) + 722e-4 * avg(b) as br, avg(r) - avg(b) as wa, avg(greatest(r, g, b) - least(r, g, b)) as sa from px group by clip_id, t),
k as (select *, case when br < 60 then 'night' when wa >= 18 and br < 170 and sa >= 25 then 'golden' else 'day' end as label from m),
c as (select *, case label when 'night' then (60 - br) / 60 when 'golden' then least((wa - 18) / 18, (170 - br) / 110) else least((br - 60) / 60, case when wa >= 18 and sa >= 25 then (br - 170) / 85 else (18 - wa) / 18 end) end as margin from k)
select clip_id, t, label, round_even(5e-1 + 5e-1 * least(1e0, greatest(0e0, margin)), 3) as confidence, round(br, 6) as brightness, round(wa, 6) as warmth, round(sa, 6) as saturation from c
"""))
def daylight_class(t):
    return rounded(pixels.daylight(colour_pictures(t)), "confidence")


SHOT = COLOUR + """,
lu as (select *, 2126e-4 * r + 7152e-4 * g + 722e-4 * b as v from px),
gr as (select a.clip_id, a.t, x, y, sqrt(pow(case when x = 0 then lead(v, 1) over o - v when x = 7 then v - lag(v, 1) over o else (lead(v, 1) over o - lag(v, 1) over o) / 2 end, 2)
  + pow(case when y = 0 then lead(v, 8) over o - v when y = 7 then v - lag(v, 8) over o else (lead(v, 8) over o - lag(v, 8) over o) / 2 end, 2)) as m from lu a window o as (partition by clip_id, t order by i)),
d as (select clip_id, t, avg(m) as detail, sum(m * x) / nullif(sum(m), 0) / 7 as fx, sum(m * y) / nullif(sum(m), 0) / 7 as fy from gr group by clip_id, t),
bl as (select gr.clip_id, gr.t, y // 2 as br, x // 2 as bc, avg(m) as bm, min(detail) as detail from gr join d on d.clip_id = gr.clip_id and d.t = gr.t group by gr.clip_id, gr.t, y // 2, x // 2),
s as (select clip_id, t, avg(case when bm >= 5e-1 * detail then 1e0 else 0e0 end) as spread from bl group by clip_id, t)
"""


@query("shot_size", oracle("", SHOT + """
select d.clip_id, d.t, case when detail < 5e-1 then '' when spread >= 6e-1 then 'wide' when spread <= 35e-2 then 'close' else 'medium' end as label, round(spread, 4) as spread, round(detail, 4) as detail from d join s on s.clip_id = d.clip_id and s.t = d.t
"""))
def shot_size(t):
    return pixels.shot_size(colour_pictures(t)).select("clip_id", "t", "label", F.round("spread", 4).alias("spread"), F.round("detail", 4).alias("detail"))


@query("attention_point", oracle("", SHOT + "select clip_id, t, case when detail > 5e-1 then round(fx, 4) end as focus_x, case when detail > 5e-1 then round(fy, 4) end as focus_y from d"))
def attention_point(t):
    return pixels.focus_point(colour_pictures(t)).select("clip_id", "t", F.round("focus_x", 4).alias("focus_x"), F.round("focus_y", 4).alias("focus_y"))


SAMPLES = """
sm as (select l_suppkey as clip_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as i, (l_discount * 100 - 5) / 5e0 as x from lineitem)
"""


def samples(t):
    a = scan(t.audio.select("clip_id", "t", "rms"), ["clip_id"], ["t"], footage.by_time(), i=row_index())
    return a.select("clip_id", (F.col("i") - 1).alias("i"), ((F.col("rms") / 2 * 100 - 5) / 5).alias("x"))


@query("audio_windows", oracle("", SAMPLES + """
select clip_id, i // 8 * 5e-1 as t, round(sqrt(avg(x * x)), 6) as rms, avg(case when abs(x) >= 985e-3 then 1e0 else 0e0 end) as clipping from sm group by clip_id, i // 8 having count(*) = 8
"""))
def audio_windows(t):
    return rounded(pixels.audio_windows(samples(t), rate=16), "clipping")


@query("waveform", oracle("", SAMPLES + """,
env as (select clip_id, i // 4 as e, max(abs(x)) as v from sm group by clip_id, i // 4 having count(*) = 4),
n as (select clip_id, greatest(10, least(100, max(e) + 1)) - 10 as n from env group by clip_id),
b as (select n.clip_id, n.n, k, k * n.n // 40 as a, greatest(k * n.n // 40 + 1, (k + 1) * n.n // 40) as z from n cross join range(40) r(k)),
m as (select b.clip_id, k, coalesce(max(v), 0) as v from b left join env on env.clip_id = b.clip_id and e - 10 >= a and e - 10 < z and e - 10 < b.n group by b.clip_id, k)
select clip_id, k as bucket, case when max(v) over (partition by clip_id) > 0 then round_even(v / max(v) over (partition by clip_id), 4) else 0e0 end as peak from m
"""))
def waveform(t):
    return pixels.waveform(samples(t), start=0.05, duration=0.45, buckets=40, rate=800)


@query("waveform_whole", oracle("", SAMPLES + """,
env as (select clip_id, i // 4 as e, max(abs(x)) as v from sm group by clip_id, i // 4 having count(*) = 4),
n as (select clip_id, max(e) + 1 as n from env group by clip_id),
b as (select n.clip_id, n.n, k, k * n.n // 300 as a, greatest(k * n.n // 300 + 1, (k + 1) * n.n // 300) as z from n cross join range(300) r(k)),
m as (select b.clip_id, k, coalesce(max(v), 0) as v from b left join env on env.clip_id = b.clip_id and e >= a and e < z and e < b.n group by b.clip_id, k)
select clip_id, k as bucket, case when max(v) over (partition by clip_id) > 0 then round_even(v / max(v) over (partition by clip_id), 4) else 0e0 end as peak from m
"""))
def waveform_whole(t):
    """The lane of every whole file."""
    return pixels.waveform(samples(t), buckets=300, rate=800)


ELEMENTS = """
w as (select l_orderkey as file, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) - 1 as k, count(*) over (partition by l_orderkey) as n, l_discount as rms, l_quantity / 50 as low from lineitem),
pk as (select file, n, max(rms) as peak, min_by(k, {'a': -rms, 'k': k}) as pi, round(avg(low), 4) as low_ratio, n * 75e-2 as duration from w group by file, n),
f as (select w.file, any_value(pk.n) as n, any_value(duration) as duration, any_value(peak) as peak, any_value(low_ratio) as low_ratio, round_even(round(least(1, (any_value(pi) + 5e-1) * 75e-2 / any_value(duration)), 10), 4) as peak_pos,
  round_even(round(least(99, avg(rms) filter (where k >= w.n - greatest(1, w.n // 3)) / (avg(rms) filter (where k < greatest(1, w.n // 3)) + 1e-6)), 10), 4) as rise_ratio,
  round_even(round(case when any_value(pk.n) - any_value(pi) >= 3 then avg(case when nx <= rms * 105e-2 + 1e-6 then 1e0 else 0e0 end) filter (where k >= pi and nx is not null) else 1e0 end, 10), 4) as decay,
  round_even(round(max(rms) filter (where k = 0 or k = w.n - 1) / any_value(nullif(peak, 0)), 10), 4) as edge
  from (select *, lead(rms) over (partition by file order by k) as nx from w) w join pk on pk.file = w.file group by w.file)
"""
KIND = """
c as (select *, case when peak <= 1e-6 then 'other' when duration <= 2 and peak_pos <= 15e-2 and decay >= 6e-1 then 'impact' when duration > 2 and peak_pos <= 35e-2 and low_ratio >= 5e-1 then 'braam'
  when duration >= 15e-1 and peak_pos >= 8e-1 and rise_ratio >= 15e-1 then 'riser' when duration >= 3e-1 and duration <= 3 and peak_pos >= 2e-1 and peak_pos <= 8e-1 and edge <= 6e-1 then 'whoosh' else 'other' end as kind from f),
r as (select *, case kind when 'impact' then (greatest(0, least(1, (peak_pos - 15e-2) / -15e-2)) + greatest(0, least(1, (decay - 6e-1) / 4e-1))) / 2
  when 'braam' then (greatest(0, least(1, (low_ratio - 5e-1) / 4e-1)) + greatest(0, least(1, (peak_pos - 35e-2) / -35e-2))) / 2
  when 'riser' then (greatest(0, least(1, (peak_pos - 8e-1) / 2e-1)) + greatest(0, least(1, (least(rise_ratio, 6) - 15e-1) / 25e-1))) / 2
  when 'whoosh' then (greatest(0, least(1, (abs(peak_pos - 5e-1) - 3e-1) / -3e-1)) + greatest(0, least(1, (edge - 6e-1) / -5e-1))) / 2 end as raw from c)
select file, kind, round(case when kind = 'other' then 0 else greatest(1e-1, raw) end, 6) as confidence from r
"""


def envelopes(t):
    line = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity")
    line = scan(line, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], F.floor(F.col("l_linenumber") / 1024), k=row_index())
    return line.select(
        F.col("l_orderkey").alias("file"), (F.col("k") - 1).alias("k"), F.col("l_discount").alias("rms"),
        (F.col("l_quantity") / 50).alias("low"),
    )


def classified(t):
    env = envelopes(t)
    files = env.groupBy("file").agg((F.count("*") * 0.75).alias("duration"), F.round(F.avg("low"), 4).alias("low_ratio"))
    return pixels.classify_elements(env.drop("low"), files, window=0.75, digits=None)


@query("sound_elements", oracle("", ELEMENTS + "," + KIND))
def sound_elements(t):
    return rounded(classified(t).select("file", "kind", "confidence"))
