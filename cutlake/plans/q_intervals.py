"""Interval algebra queries on cut plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.intervals import union_intervals
from cutlake.operators import intervals as iv
from cutlake.plans.q_timeline import rounded
from cutlake.plans.registry import query
from cutlake.plans.views import oracle

# Plan-level tables derived from the entries.
PLAN_CTES = """
plans as (select plan_id, max(record_end) as duration, plan_id % 7 * 2e-1 as music_in, case when plan_id % 4 = 0 then 0e0 else max(record_end) * 8e-1 end as music_out,
    case plan_id % 3 when 0 then 'short' when 1 then 'travel' else 'trailer' end as style, 5e-1 as beat, count(*) * 2 as beats from b_entries group by plan_id),
dips as (select plan_id, record_start as dip_start, 4e-1 as dip_len from b_entries where transition > 0),
sfx as (select plan_id, case slot % 4 when 0 then 'impact' when 1 then 'riser' when 2 then 'whoosh' else 'sub-drop' end as kind, record_start + slot % 3 * 25e-2 as time,
    score / 4e0 as length, case when slot % 2 = 0 then 'hit.wav' else '' end as file from b_entries),
downbeats as (select plan_id, record_start + 65e-2 as t from b_entries),
drops as (select plan_id, record_end as t, score as weight from b_entries where score > 6),
gaps as (select plan_id, record_start + 25e-2 as gap_start, record_start + 1 + slot % 3 * 2 as gap_end from b_entries where score < 5),
prominent as (select plan_id, record_start as start_s, record_start + 1 as end_s, slot % 5 * -2e0 as peak_db from b_entries),
phases as (select plan_id, i, label, duration * lo as span_start, duration * hi as span_end from plans cross join (values (0, 'opening', 0e0, 15e-2), (1, 'build', 15e-2, 5e-1), (2, 'climax', 5e-1, 7e-1), (3, 'outro', 7e-1, 1e0)) v(i, label, lo, hi))
"""


class P:
    """The same plan-level tables as DataFrames."""

    def __init__(self, t):
        e = t.entries
        slot, plan = F.col("slot"), F.col("plan_id")
        self.entries = e
        self.plans = e.groupBy("plan_id").agg(F.max("record_end").alias("duration"), (F.count("*") * 2).alias("beats")).select(
            "plan_id", "duration", (plan % 7 * 0.2).alias("music_in"), F.when(plan % 4 == 0, 0.0).otherwise(F.col("duration") * 0.8).alias("music_out"),
            F.when(plan % 3 == 0, "short").when(plan % 3 == 1, "travel").otherwise("trailer").alias("style"), F.lit(0.5).alias("beat"), "beats",
        )
        self.dips = e.where("transition > 0").select("plan_id", F.col("record_start").alias("dip_start"), F.lit(0.4).alias("dip_len"))
        kind = F.when(slot % 4 == 0, "impact").when(slot % 4 == 1, "riser").when(slot % 4 == 2, "whoosh").otherwise("sub-drop")
        self.sfx = e.select(
            "plan_id", kind.alias("kind"), (F.col("record_start") + slot % 3 * 0.25).alias("time"), (F.col("score") / 4).alias("length"),
            F.when(slot % 2 == 0, "hit.wav").otherwise("").alias("file"),
        )
        self.downbeats = e.select("plan_id", (F.col("record_start") + 0.65).alias("t"))
        self.drops = e.where("score > 6").select("plan_id", F.col("record_end").alias("t"), F.col("score").alias("weight"))
        self.gaps = e.where("score < 5").select(
            "plan_id", (F.col("record_start") + 0.25).alias("gap_start"), (F.col("record_start") + 1 + slot % 3 * 2).alias("gap_end")
        )
        self.prominent = e.select(
            "plan_id", F.col("record_start").alias("start_s"), (F.col("record_start") + 1).alias("end_s"), (slot % 5 * -2.0).alias("peak_db")
        )
        arc = [(0, "opening", 0.0, 0.15), (1, "build", 0.15, 0.5), (2, "climax", 0.5, 0.7), (3, "outro", 0.7, 1.0)]
        spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("label"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, n, a, b in arc])
        self.phases = self.plans.select("plan_id", "duration", F.explode(spans).alias("s")).select(
            "plan_id", "s.i", "s.label", (F.col("duration") * F.col("s.lo")).alias("span_start"), (F.col("duration") * F.col("s.hi")).alias("span_end")
        )


UNION = """
spans as (select distinct clip_path, start_s, end_s from b_moments where end_s - start_s > 1e-6),
mk as (select *, case when start_s > max(end_s) over (partition by clip_path order by start_s, end_s rows between unbounded preceding and 1 preceding) + 1e-6 then 1 else 0 end as o from spans),
gr as (select *, sum(o) over (partition by clip_path order by start_s, end_s rows between unbounded preceding and current row) as g from mk),
un as (select clip_path, min(start_s) as start_s, max(end_s) as end_s from gr group by clip_path, g)
"""


@query("interval_union", oracle("b_clips", """
spans as (select distinct timeline_id, source_file, source_in / 25e0 as s, source_out / 25e0 as e from b_clips),
mk as (select *, case when s > max(e) over (partition by timeline_id, source_file order by s, e rows between unbounded preceding and 1 preceding) + 1e-6 then 1 else 0 end as o from spans),
gr as (select *, sum(o) over (partition by timeline_id, source_file order by s, e rows between unbounded preceding and current row) as g from mk)
select timeline_id, source_file, round(min(s), 6) as start_s, round(max(e), 6) as end_s from gr group by timeline_id, source_file, g
"""))
def interval_union(t):
    c = t.clips.select("timeline_id", "source_file", (F.col("source_in") / 25.0).alias("start_s"), (F.col("source_out") / 25.0).alias("end_s"))
    return rounded(union_intervals(c, ["timeline_id", "source_file"], "start_s", "end_s", width=4.0))


@query("unique_material", oracle("b_moments", UNION + "select clip_path, round(sum(end_s - start_s), 6) as unique_s, count(*) as spans from un group by clip_path"))
def unique_material(t):
    return rounded(iv.unique_material(t.moments))


FREE = """
u0 as (select distinct clip_path, source_start + 25e-2 as a, source_start + 75e-2 as b from b_entries),
sp as (select distinct clip_path, start_s, end_s from b_moments),
st as (select clip_path, start_s, end_s, start_s as x, -1e0 as y from sp union all select sp.clip_path, start_s, end_s, b, a from sp join u0 on u0.clip_path = sp.clip_path and b > start_s + 1e-6 and a < end_s - 1e-6
  union all select clip_path, start_s, end_s, 1e9, end_s from sp),
gp as (select clip_path, start_s, end_s, lag(x) over (partition by clip_path, start_s, end_s order by x) as gap_start, y as gap_end from st),
free as (select * from gp where gap_start is not null and gap_end > gap_start + 1e-6)
"""


def _used(t):
    return t.entries.select("clip_path", (F.col("source_start") + 0.25).alias("u0"), (F.col("source_start") + 0.75).alias("u1"))


@query("free_gaps", oracle("b_entries b_moments", FREE + "select clip_path, start_s, end_s, round(gap_start, 6) as gap_start, round(gap_end, 6) as gap_end from free"))
def free_gaps(t):
    return rounded(iv.free_gaps(t.moments, _used(t)))


@query("free_window", oracle("b_entries b_moments", FREE + """,
r as (select m.clip_path, mid, gap_start, gap_end - gap_start as len from b_moments m join free f on f.clip_path = m.clip_path and f.start_s = m.start_s and f.end_s = m.end_s),
f as (select *, row_number() over (partition by clip_path order by case when len >= 8e-1 - 1e-6 then 0 when len >= 4e-1 - 1e-6 then 1 else 2 end, case when len >= 8e-1 - 1e-6 then 0 else -round(len, 6) end, mid, gap_start) as k from r)
select clip_path, mid, round(gap_start, 6) as gap_start, round(least(len, 8e-1), 6) as length from f where k = 1 and len >= 4e-1 - 1e-6
"""))
def free_window(t):
    return rounded(iv.free_window(t.moments, _used(t), 0.8, order=["mid"], group=["clip_path"]))


@query("trimmed_pool", oracle("b_moments", """
m as (select *, max(end_s) over (partition by clip_path order by start_s, end_s, mid rows between unbounded preceding and 1 preceding) as hw from b_moments)
select clip_path, mid, round(greatest(start_s, coalesce(hw, start_s)), 6) as start_s, round(end_s, 6) as end_s from m where end_s - greatest(start_s, coalesce(hw, start_s)) > 1e-6
"""))
def trimmed_pool(t):
    return rounded(iv.trim_pool(t.moments).select("clip_path", "mid", "start_s", "end_s"))


MATCH = """
best as (select plan_id, slot, min_by(mid, {'d': -round(ov, 6), 'm': mid}) as mid, max(ov) as overlap_s from (select plan_id, slot, mid, least(end_s, source_end) - greatest(start_s, source_start) as ov
  from b_entries e join b_moments m on m.clip_path = e.clip_path and least(end_s, source_end) - greatest(start_s, source_start) > 1e-6) z group by plan_id, slot)
"""


@query("matched_moments", oracle("b_entries b_moments", MATCH + "select e.plan_id, e.slot, mid, round(overlap_s, 6) as overlap_s from b_entries e left join best b on b.plan_id = e.plan_id and b.slot = e.slot"))
def matched_moments(t):
    prefix = F.when(F.col("slot") % 3 == 0, "/volume/").otherwise("")
    spelled = t.entries.withColumn("clip_path", F.concat(prefix, F.col("clip_path")))
    out = iv.best_overlap(iv.on_material(spelled, t.moments), t.moments)
    return rounded(out.select("plan_id", "slot", "mid", "overlap_s"))


@query("used_material", oracle("b_entries b_moments", "select clip_path, mid from b_moments m where exists (select 1 from b_entries e where e.clip_path = m.clip_path and least(end_s, source_end) - greatest(start_s, source_start) > 1e-6)"))
def used_material(t):
    return iv.used_material(t.moments, t.entries).select("clip_path", "mid")


BENCH = """
rk as (select *, row_number() over (order by score desc, hero desc, clip_path, start_s, mid) as r from b_moments),
us as (select plan_id, list(distinct r) as l from b_entries e join rk m on m.clip_path = e.clip_path and least(end_s, source_end) - greatest(start_s, source_start) > 1e-6 group by plan_id),
fr as (select p.plan_id, list_filter(range(1, (select count(*) + 1 from rk)), lambda x: not list_contains(coalesce(l, []), x))[1:20] as f from (select distinct plan_id from b_entries) p left join us on us.plan_id = p.plan_id),
un as (select plan_id, unnest(range(1, len(f) + 1)) as rank, f from fr),
bench as (select plan_id, rank, rk.* from un join rk on rk.r = f[rank])
"""


def benches(t):
    plans = t.entries.select("plan_id").distinct()
    return iv.bench(plans, t.entries, t.moments)


@query("unused_bench", oracle("b_entries b_moments", BENCH + "select plan_id, rank, mid, clip_path, round(score, 6) as score from bench"))
def unused_bench(t):
    return rounded(benches(t).select("plan_id", "rank", "mid", "clip_path", "score"))


@query("swap_alternatives", oracle("b_entries b_moments", BENCH + "," + MATCH + """,
sl as (select e.plan_id, e.slot, e.clip_path, coalesce(m.grp, '') as grp from b_entries e left join best b on b.plan_id = e.plan_id and b.slot = e.slot left join b_moments m on m.mid = b.mid),
al as (select s.plan_id, s.slot, b.mid, b.clip_path = s.clip_path or (s.grp <> '' and b.grp = s.grp) as same_scene, row_number() over (partition by s.plan_id, s.slot order by case when b.clip_path = s.clip_path or (s.grp <> '' and b.grp = s.grp) then 0 else 1 end, rank) as choice
  from sl s join bench b on b.plan_id = s.plan_id)
select plan_id, slot, choice, mid, same_scene from al where choice <= 6
"""))
def swap_alternatives(t):
    slots = iv.best_overlap(t.entries, t.moments, carried=["mid", "grp"]).withColumn("grp", F.coalesce("grp", F.lit("")))
    return iv.alternatives(benches(t), slots).select("plan_id", "slot", "choice", "mid", "same_scene")


@query("repeated_material", oracle("b_entries", """
select a.plan_id, a.clip_path, a.slot as slot_a, b.slot as slot_b, round(least(a.source_end, b.source_end) - greatest(a.source_start, b.source_start), 6) as overlap_s from b_entries a join b_entries b
on a.plan_id = b.plan_id and a.clip_path = b.clip_path and a.slot < b.slot and least(a.source_end - a.source_start, b.source_end - b.source_start) > 1e-6
where least(a.source_end, b.source_end) - greatest(a.source_start, b.source_start) >= 5e-1 * least(a.source_end - a.source_start, b.source_end - b.source_start) - 1e-6
"""))
def repeated_material(t):
    return rounded(iv.repeats(t.entries))


@query("continuity_runs", oracle("b_entries", """
l as (select *, lag(clip_path) over w as pc, lag(source_end) over w as pe, lag(record_end) over w as pr from b_entries window w as (partition by plan_id order by slot)),
o as (select *, case when clip_path = pc and source_start - pe >= -60 - 1e-6 and source_start - pe <= 60 + 1e-6 and abs(record_start - pr) <= 1e-6 then 0 else 1 end as o from l),
g as (select *, sum(case when clip_path = pc and source_start - pe >= -1e-6 and source_start - pe <= 20 + 1e-6 and abs(record_start - pr) <= 1e-6 then 0 else 1 end) over (partition by plan_id order by slot rows between unbounded preceding and current row) as g from o)
select plan_id, min(slot) as first_slot, max(slot) as last_slot, min_by(clip_path, slot) as clip_path, round(min(record_start), 6) as record_start, round(max(record_end), 6) as record_end,
  round(min_by(source_start, slot), 6) as source_start, round(max_by(source_end, slot), 6) as source_end from g group by plan_id, g
"""))
def continuity_runs(t):
    return rounded(iv.continuity_runs(t.entries, max_gap=20.0))


BED = PLAN_CTES + """,
w0 as (select plan_id, least(greatest(music_in, 0), duration) as a, case when music_out > 1e-6 then least(music_out, duration) else duration end as b, duration as d from plans),
w as (select plan_id, case when b <= a + 1e-6 then 0e0 else a end as w_in, case when b <= a + 1e-6 then d else b end as w_end from w0),
c as (select distinct g.plan_id, greatest(gap_start, w_in) as s, least(gap_end, w_end) as e from gaps g join w on w.plan_id = g.plan_id where least(gap_end, w_end) - greatest(gap_start, w_in) > 1e-6),
mk as (select *, case when s > max(e) over (partition by plan_id order by s, e rows between unbounded preceding and 1 preceding) + 1e-6 then 1 else 0 end as o from c),
gr as (select *, sum(o) over (partition by plan_id order by s, e rows between unbounded preceding and current row) as g from mk),
un as (select plan_id, min(s) as s, max(e) as e from gr group by plan_id, g),
st as (select plan_id, s, e from un union all select plan_id, w_end, w_end from w),
seg as (select st.plan_id, coalesce(lag(e) over (partition by st.plan_id order by s, e), w_in) as bed_start, s as bed_end from st join w on w.plan_id = st.plan_id),
bed as (select * from seg where bed_end - bed_start > 1e-6)
"""


@query("music_bed", oracle("b_entries", BED + """
select plan_id, round(bed_start, 6) as bed_start, round(bed_end, 6) as bed_end from bed union all select plan_id, round(w_in, 6), round(w_end, 6) from w where plan_id not in (select plan_id from bed)
"""))
def music_bed(t):
    p = P(t)
    return rounded(iv.bed_segments(p.plans, p.gaps))


SILENCE = BED + """,
win as (select w.*, beat, beats, style from w join plans p on p.plan_id = w.plan_id where w_end - w_in > 1e-6),
car as (select distinct d.plan_id, dip_start, dip_start + dip_len as dip_end from dips d join sfx s on s.plan_id = d.plan_id and kind in ('sub-drop', 'impact') and time <= dip_start + dip_len + 5e-1 + 1e-6 and time + greatest(length, 0) >= dip_start - 5e-1 - 1e-6),
und as (select c.plan_id, greatest(dip_start, w_in) as lo, coalesce((select least(min(t), w_end) from downbeats x where x.plan_id = c.plan_id and t > dip_end + 1e-6 and t <= dip_end + beat + 1e-6 and t <= w_end + 1e-6), least(dip_end, w_end)) as hi
  from car c join win on win.plan_id = c.plan_id where least(dip_end, w_end) - greatest(dip_start, w_in) > 1e-6),
fd as (select d.plan_id, min(t) as t, min(beat) as beat, min(w_in) as w_in from drops d join win on win.plan_id = d.plan_id where t > w_in + 1e-6 and t < w_end - 1e-6 and style <> 'short' and beats >= 2 group by d.plan_id),
pre as (select plan_id, t - beat as lo, t as hi from fd f where t - beat >= w_in + 1e-6 and t - beat > 1e-6 and not exists (select 1 from und u where u.plan_id = f.plan_id and f.t - f.beat < u.hi + 1e-6 and f.t > u.lo - 1e-6))
"""


@query("planned_silences", oracle("b_entries", SILENCE + """
select plan_id, round(lo, 6) as gap_start, round(hi, 6) as gap_end, 'dip' as reason from und union all select plan_id, round(lo, 6), round(hi, 6), 'drop' from pre
"""))
def planned_silences(t):
    p = P(t)
    return rounded(iv.plan_silences(p.plans, p.dips, p.sfx, p.downbeats, p.drops))


@query("ducking_windows", oracle("b_entries", PLAN_CTES + """,
x as (select plan_id, time as s, time + case when kind = 'riser' then greatest(length, 0) when length > 0 then least(length, 15e-1) else 15e-1 end as e, case when kind = 'riser' then -4e0 else -6e0 end as db,
    case when kind = 'riser' then 25e-2 else 5e-2 end as fade from sfx where file <> '' and kind in ('impact', 'sub-drop', 'riser') union all select plan_id, start_s, end_s, -4e0, 25e-2 from prominent)
select x.plan_id, round(greatest(0, s), 6) as duck_start, round(least(e, duration), 6) as duck_end, round(pow(10, db / 20), 6) as gain, fade from x join plans p on p.plan_id = x.plan_id where least(e, duration) - greatest(0, s) > 1e-2
"""))
def ducking_windows(t):
    p = P(t)
    return rounded(iv.ducking_windows(p.sfx, p.plans, p.prominent))


@query("lift_windows", oracle("b_entries", PLAN_CTES + """,
x as (select r.plan_id, greatest(0, start_s) as s, least(end_s, duration) as e, least(35e-1, greatest(0, -1 - (peak_db + 20 * log10(6e-1)))) as db from prominent r join plans p on p.plan_id = r.plan_id)
select plan_id, round(s, 6) as duck_start, round(e, 6) as duck_end, round(pow(10, db / 20), 6) as gain, 25e-2 as fade from x where e - s > 1e-2 and db > 1e-9
"""))
def lift_windows(t):
    p = P(t)
    return rounded(iv.lift_windows(p.prominent, p.plans))


JL = PLAN_CTES + """,
en as (select e.*, source_end + slot % 3 * 3e-1 as clip_duration, case when slot = 5 then 2e-1 else 0e0 end as audio_lead, case when slot = 4 and plan_id % 5 = 0 then 1e-1 else 0e0 end as audio_lag,
    coalesce((select max(label) from phases p where p.plan_id = e.plan_id and span_start - 1e-6 <= record_start and record_start < span_end - 1e-6), case when record_start >= (select max(span_end) from phases p where p.plan_id = e.plan_id) - 1e-6 then 'outro' end) as phase from b_entries e),
pr as (select a.plan_id, a.slot, a.record_end as cut, a.phase as p0, b.phase as p1, a.clip_path as c0, b.clip_path as c1, b.record_start as ns, b.transition as nt, b.source_start as nss, a.clip_duration as cd, a.source_end as se,
    least(a.record_end - a.record_start, b.record_end - b.record_start) - 4e-1 as room, a.audio_lead > 1e-6 or a.audio_lag > 1e-6 as h0, b.audio_lead > 1e-6 or b.audio_lag > 1e-6 as h1, a.audio_lag as lag0,
    (select max(audio_lead) from en z where z.plan_id = a.plan_id and z.slot = a.slot + 2) as lead2, (select max(audio_lag) from en z where z.plan_id = a.plan_id and z.slot = a.slot - 1) as lagp
  from en a join en b on b.plan_id = a.plan_id and b.slot = a.slot + 1),
ev as (select *, case p0 when 'opening' then 35e-2 when 'build' then 65e-2 when 'climax' then 1e0 when 'outro' then 3e-1 else 5e-1 end as e0, case p1 when 'opening' then 35e-2 when 'build' then 65e-2 when 'climax' then 1e0 when 'outro' then 3e-1 else 5e-1 end as e1 from pr),
mks as (select plan_id, t from drops union all select plan_id, gap_start from gaps union all select plan_id, gap_end from gaps),
cd as (select plan_id, slot, case when e1 - e0 > 1e-6 then 'J' else 'L' end as kind, case when e1 - e0 > 1e-6 then least(least(2e-1, room), greatest(0, nss)) when cd > 1e-6 then least(least(2e-1, room), greatest(0, cd - se)) else 0 end as amount, -round(abs(e1 - e0), 9) as k
  from ev where not h0 and not h1 and coalesce(lag0, 0) <= 1e-6 and coalesce(lead2, 0) <= 1e-6 and coalesce(lagp, 0) <= 1e-6 and abs(ns - cut) <= 5e-2 and nt <= 1e-6 and c0 <> c1 and room > 1e-6 and coalesce(p0, '') <> 'climax' and coalesce(p1, '') <> 'climax'
  and not exists (select 1 from mks m where m.plan_id = ev.plan_id and abs(m.t - cut) <= 5e-2 + 1e-6)),
ls as (select plan_id, list({'slot': slot, 'kind': kind, 'amount': amount} order by k, slot) as l from cd where amount > 1e-6 group by plan_id),
fo as (select plan_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: case when len(acc) < 4 and len(list_filter(acc, lambda o: abs(o.slot - y[1].slot) = 1)) = 0 then list_concat(acc, y) else acc end) as f from ls),
au as (select plan_id, unnest(f) as c from fo)
"""


@query("sound_offsets", oracle("b_entries", JL + """
select plan_id, slot, round(audio_lead, 6) as lead, round(audio_lag, 6) as lag, 'hand' as kind from en where audio_lead > 1e-6 or audio_lag > 1e-6
union all select plan_id, c.slot + case when c.kind = 'J' then 1 else 0 end, round(case when c.kind = 'J' then c.amount else 0 end, 6), round(case when c.kind = 'J' then 0 else c.amount end, 6), c.kind from au
"""))
def sound_offsets(t):
    p = P(t)
    e = p.entries.withColumn("clip_duration", F.col("source_end") + F.col("slot") % 3 * 0.3)
    e = e.withColumn("audio_lead", F.when(F.col("slot") == 5, 0.2).otherwise(0.0))
    e = e.withColumn("audio_lag", F.when((F.col("slot") == 4) & (F.col("plan_id") % 5 == 0), 0.1).otherwise(0.0))
    marks = p.drops.select("plan_id", "t").unionByName(p.gaps.select("plan_id", F.col("gap_start").alias("t"))).unionByName(p.gaps.select("plan_id", F.col("gap_end").alias("t")))
    return rounded(iv.jl_edits(e, marks, p.phases))


SPLICE = PLAN_CTES + """,
rg as (select plan_id, duration * 2e-1 as r0, duration * 9e-1 as r1 from plans),
rv as (select plan_id, slot + 100 as slot, clip_path, source_start + 5e-1 as source_start, source_end + 5e-1 as source_end, record_start + 25e-2 as record_start, record_end + 25e-2 as record_end from b_entries),
wi as (select e.plan_id, min(record_start) as lo, max(record_end) as hi from b_entries e join rg on rg.plan_id = e.plan_id where record_start >= r0 - 1e-6 and record_end <= r1 + 1e-6 group by e.plan_id)
"""


def _splice_inputs(t):
    p = P(t)
    region = p.plans.select("plan_id", (F.col("duration") * 0.2).alias("r0"), (F.col("duration") * 0.9).alias("r1"))
    cols = ["plan_id", "slot", "clip_path", "source_start", "source_end", "record_start", "record_end"]
    old = p.entries.select(*cols)
    new = old.select(
        "plan_id", (F.col("slot") + 100).alias("slot"), "clip_path", *[(F.col(c) + 0.5).alias(c) for c in cols[3:5]], *[(F.col(c) + 0.25).alias(c) for c in cols[5:]]
    )
    return old, new, region


@query("region_splice", oracle("b_entries", SPLICE + """
select e.plan_id, slot, clip_path, round(source_start, 6) as source_start, round(source_end, 6) as source_end, round(record_start, 6) as record_start, round(record_end, 6) as record_end from b_entries e join wi on wi.plan_id = e.plan_id where record_end <= lo + 1e-6 or record_start >= hi - 1e-6
union all select r.plan_id, slot, clip_path, round(least(source_end, source_start + greatest(record_start, lo) - record_start), 6), round(least(source_end, source_start + least(record_end, hi) - record_start), 6), round(greatest(record_start, lo), 6), round(least(record_end, hi), 6)
  from rv r join wi on wi.plan_id = r.plan_id where least(record_end, hi) - greatest(record_start, lo) > 1e-6
union all select plan_id, slot, clip_path, round(source_start, 6), round(source_end, 6), round(record_start, 6), round(record_end, 6) from rv where plan_id not in (select plan_id from wi)
"""))
def region_splice(t):
    return rounded(iv.splice_region(*_splice_inputs(t)))


@query("region_merge", oracle("b_entries", SPLICE + """,
en as (select e.*, r0, r1, source_end + 10 as clip_duration, slot % 5 = 4 as pinned from b_entries e join rg on rg.plan_id = e.plan_id),
ii as (select *, record_start >= r0 - 1e-6 and record_end <= r1 + 1e-6 and not pinned as i from en),
op as (select *, case when i and coalesce(lag(i) over w, false) and abs(lag(record_end) over w - record_start) <= 1e-6 then 0 else 1 end as o from ii window w as (partition by plan_id order by slot)),
ru as (select *, sum(o) over (partition by plan_id order by slot rows between unbounded preceding and current row) as run from op),
pc as (select *, (row_number() over (partition by plan_id, run order by slot) - 1) // 2 as piece from ru)
select plan_id, min(slot) as slot, min_by(clip_path, slot) as clip_path, round(min_by(source_start, slot), 6) as source_start,
  round(case when count(*) > 1 then least(min_by(source_start, slot) + max(record_end) - min_by(record_start, slot), min_by(clip_duration, slot)) else min(source_end) end, 6) as source_end,
  round(min_by(record_start, slot), 6) as record_start, round(max(record_end), 6) as record_end, count(*) as slots from pc group by plan_id, run, piece
"""))
def region_merge(t):
    _, _, region = _splice_inputs(t)
    e = t.entries.withColumn("clip_duration", F.col("source_end") + 10).withColumn("pinned", F.col("slot") % 5 == 4)
    return rounded(iv.merge_region(e, region, 2.4))


@query("distilled_material", oracle("b_clips", """
spans as (select timeline_id, source_file as path, source_in / 25e0 as s, source_out / 25e0 as e, record_in, nullif(case when clip_id % 3 = 0 then '' else name end, '') as label from b_clips),
mk as (select *, case when s > max(e) over (partition by timeline_id, path order by s, e, record_in rows between unbounded preceding and 1 preceding) + 1e-6 then 1 else 0 end as o from spans),
gr as (select *, sum(o) over (partition by timeline_id, path order by s, e, record_in rows between unbounded preceding and current row) as g from mk),
un as (select timeline_id, path, min(s) as s, max(e) as e, coalesce(min_by(label, {'s': s, 'e': e, 'r': record_in}) filter (where label is not null), '') as label from gr group by timeline_id, path, g)
select timeline_id, path, round(s, 6) as start_s, round(e, 6) as end_s, label, round(least(1, 75e-2 + 2e-1 * (e - s) / max(e - s) over (partition by timeline_id)), 6) as score, round(max(e) over (partition by timeline_id, path), 6) as duration from un
"""))
def distilled_material(t):
    c = t.clips.withColumn("shot_label", F.when(F.col("clip_id") % 3 == 0, "").otherwise(F.col("name")))
    return rounded(iv.distill(c, label="shot_label"))


ARC = PLAN_CTES + """,
ar as (select * from (values ('short', 0, 8e-2, 'hook'), ('short', 1, 72e-2, 'punch'), ('short', 2, 2e-1, 'loop'),
  ('travel', 0, 15e-2, 'opening'), ('travel', 1, 35e-2, 'build'), ('travel', 2, 35e-2, 'climax'), ('travel', 3, 15e-2, 'outro'),
  ('trailer', 0, 2e-1, 'opening'), ('trailer', 1, 25e-2, 'build'), ('trailer', 2, 25e-2, 'build'), ('trailer', 3, 2e-1, 'climax'), ('trailer', 4, 1e-1, 'outro')) v(style, i, share, label)),
an as (select style, count(*) as n, sum(share) as total, coalesce(min(i) filter (where label = 'climax'), -1) as ci from ar group by style),
bd as (select d.plan_id, min({'w': -round(weight, 9), 't': t}).t as dr from drops d join plans p on p.plan_id = d.plan_id where t >= 5e-2 * duration and t <= (1 - 5e-2) * duration group by d.plan_id),
b0 as (select p.plan_id, p.style, duration as length, n, ci, r.i, dr, case when r.i = n then duration else duration * coalesce((select sum(share) from ar where ar.style = p.style and ar.i < r.i), 0) / total end as b
  from plans p join an on an.style = p.style join range(0, 6) r(i) on r.i <= n left join bd on bd.plan_id = p.plan_id),
p1 as (select b0.*, og, coalesce(dr is not null and ci > 0 and og > 1e-6 and og < length - 1e-6, false) as pin from b0 left join (select plan_id, b as og from b0 where i = ci) o on o.plan_id = b0.plan_id),
b1 as (select *, case when not pin or i = 0 or i = n then b when i < ci then b * dr / og when i = ci then dr else length - (length - b) * (length - dr) / (length - og) end as b1 from p1),
i2 as (select *, hi - b1 as ln, 5e-2 * length as fl from (select *, lead(b1) over (partition by plan_id order by i) as hi, case when i < ci then 0 else 1 end as side from b1) z where hi is not null and pin),
sd as (select plan_id, side, count(*) as m, max_by(hi, i) - min_by(b1, i) as span, sum(greatest(ln, fl) - fl) as spare, bool_or(ln < fl - 1e-6) as tight, min_by(b1, i) as base, max(fl) as f from i2 group by plan_id, side),
s2 as (select *, case when spare > 1e-6 then (span - m * f) / spare else 0 end as scale from sd where m >= 2 and span >= m * f - 1e-6 and tight),
f1 as (select i2.plan_id, i2.i, base + coalesce(sum(fl + (greatest(ln, fl) - fl) * scale) over (partition by i2.plan_id, i2.side order by i2.i rows between unbounded preceding and 1 preceding), 0) as nb,
  row_number() over (partition by i2.plan_id, i2.side order by i2.i) as q from i2 join s2 on s2.plan_id = i2.plan_id and s2.side = i2.side),
b2 as (select b1.*, coalesce(nb, b1.b1) as b2 from b1 left join f1 on f1.plan_id = b1.plan_id and f1.i = b1.i and q > 1),
pt as (select d.plan_id, t from downbeats d join plans p on p.plan_id = d.plan_id where t > 1e-6 and t < duration - 1e-6),
sn as (select b2.plan_id, i, min({'d': abs(t - b2), 't': t}).t as s from b2 join pt on pt.plan_id = b2.plan_id where i > 0 and i < n and not (pin and i = ci) group by b2.plan_id, i),
b3 as (select b2.*, least(max(coalesce(s, b2)) over (partition by b2.plan_id order by b2.i rows between unbounded preceding and current row), length) as b3 from b2 left join sn on sn.plan_id = b2.plan_id and sn.i = b2.i),
b4 as (select *, lead(b3) over (partition by plan_id order by i) as nx from b3)
"""


@query("arc_phases", oracle("b_entries", ARC + "select plan_id, cast(b4.i as bigint) as phase_no, label, round(b3, 6) as span_start, round(nx, 6) as span_end from b4 join ar on ar.style = b4.style and ar.i = b4.i"))
def arc_phases(t):
    p = P(t)
    grid = p.downbeats.select("plan_id", F.lit("downbeat").alias("kind"), "t")
    return rounded(iv.phase_spans(p.plans, p.drops, grid))
