"""Plan scoring, diff and publishing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.columns import r6
from cutlake.operators import intervals as iv
from cutlake.operators import scoring as sc
from cutlake.plans.q_footage import ELEMENTS, KIND, classified
from cutlake.plans.q_intervals import MATCH, PLAN_CTES, P
from cutlake.plans.q_timeline import rounded
from cutlake.plans.registry import query
from cutlake.plans.views import oracle

SECTION_CTES = PLAN_CTES + """,
pm as (select *, plan_id % 5 * 3e-1 as music_start from plans),
sections as (select plan_id, case i when 0 then 'low' when 1 then 'mid' when 2 then 'high' else 'mid' end as label, duration * lo * 11e-1 as span_start, duration * hi * 11e-1 as span_end, 2e-1 + i * 2e-1 as energy
  from plans cross join (values (0, 0e0, 2e-1), (1, 2e-1, 6e-1), (2, 6e-1, 8e-1), (3, 8e-1, 1e0)) v(i, lo, hi))
"""
LABEL_AT = "coalesce((select max(label) from {spans} s where s.plan_id = {row}.plan_id and span_start - 1e-6 <= {t} and {t} < span_end - 1e-6), (select max_by(label, span_end) from {spans} s where s.plan_id = {row}.plan_id having {t} >= max(span_end) - 1e-6))"


def _sections(p):
    parts = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(n).alias("label"), F.lit(a).alias("lo"), F.lit(b).alias("hi"))
        for i, n, a, b in [(0, "low", 0.0, 0.2), (1, "mid", 0.2, 0.6), (2, "high", 0.6, 0.8), (3, "mid", 0.8, 1.0)]
    ])
    rows = p.plans.select("plan_id", "duration", F.explode(parts).alias("s"))
    return rows.select(
        "plan_id", "s.label", (F.col("duration") * F.col("s.lo") * 1.1).alias("span_start"), (F.col("duration") * F.col("s.hi") * 1.1).alias("span_end"),
        (0.2 + F.col("s.i") * 0.2).alias("energy"),
    )


@query("slot_context", oracle("b_entries", SECTION_CTES + f""",
a as (select e.plan_id, slot, record_start, record_end, music_start, duration, music_start + record_start as song from b_entries e join pm on pm.plan_id = e.plan_id),
ph as (select a.plan_id, a.slot, coalesce(max(label) filter (where span_start - 1e-6 <= record_start and record_start < span_end - 1e-6), case when max(record_start) >= max(span_end) - 1e-6 then max_by(label, span_end) end) as phase from a left join phases s on s.plan_id = a.plan_id group by a.plan_id, a.slot),
mu as (select a.plan_id, a.slot, coalesce(max(label) filter (where span_start - 1e-6 <= song and song < span_end - 1e-6), case when max(song) >= max(span_end) - 1e-6 then max_by(label, span_end) end) as music from a left join sections s on s.plan_id = a.plan_id group by a.plan_id, a.slot)
select a.plan_id, a.slot, round(record_end - record_start, 6) as seconds, phase, music,
  exists (select 1 from drops d where d.plan_id = a.plan_id and d.t >= music_start - 1e-6 and d.t <= music_start + duration + 1e-6 and abs(d.t - song) <= 25e-2) as drop,
  exists (select 1 from dips d where d.plan_id = a.plan_id and abs(dip_start + dip_len - record_start) <= 1e-3) as after_dip
from a join ph on ph.plan_id = a.plan_id and ph.slot = a.slot join mu on mu.plan_id = a.plan_id and mu.slot = a.slot
"""))
def slot_context(t):
    p = P(t)
    plans = p.plans.withColumn("music_start", F.col("plan_id") % 5 * 0.3)
    return rounded(sc.slot_context(p.entries, p.phases, _sections(p), p.drops, p.dips, plans))


DAY = """
sh as (select sum(case when daylight = 'day' then end_s - start_s else 0 end) as d, sum(case when daylight = 'golden' then end_s - start_s else 0 end) as g, sum(case when daylight = 'night' then end_s - start_s else 0 end) as n from b_moments),
og as (select plan_id, min_by(record_start, slot) as o, max_by(record_end, slot) as z, count(*) as slots from b_entries group by plan_id),
dt as (select e.plan_id, slot, case when (record_start + record_end) / 2 - o <= d / (d + g + n) * (z - o) + 1e-6 then 'day' when (record_start + record_end) / 2 - o <= (d + g) / (d + g + n) * (z - o) + 1e-6 then 'golden' else 'night' end as daylight_target
  from b_entries e join og on og.plan_id = e.plan_id cross join sh)
"""


@query("daylight_targets", oracle("b_entries b_moments", DAY + "select * from dt"))
def daylight_targets(t):
    return sc.daylight_targets(t.entries, t.moments)


def _moving(t):
    return t.moments.withColumn("motion", F.col("mid") % 17 / 2.0)


def _slots_and_pool(t):
    p = P(t)
    at = F.col("record_start") / F.col("duration")
    slots = p.entries.join(p.plans.select("plan_id", "duration", (F.col("beats") / 2).cast("bigint").alias("slots")), "plan_id")
    slots = slots.join(sc.daylight_targets(p.entries, t.moments), ["plan_id", "slot"])
    slots = slots.select(
        "plan_id", "slot", "slots", "daylight_target", (F.col("score") / 10).alias("energy"),
        F.when(at < 0.15, "opening").when(at < 0.5, "build").when(at < 0.7, "climax").otherwise("outro").alias("phase"),
    )
    moments = _moving(t).select("clip_path", "mid", "start_s", "score", "motion", "role", "hero", "daylight", "shot_size")
    return slots, moments


CANDIDATES = """,
rk as (select *, mid % 17 / 2e0 as motion, row_number() over (order by score desc, clip_path, start_s, mid) as r from b_moments),
sl as (select e.plan_id, e.slot, slots, daylight_target, case when record_start / duration < 15e-2 then 'opening' when record_start / duration < 5e-1 then 'build' when record_start / duration < 7e-1 then 'climax' else 'outro' end as phase, score / 1e1 as energy
  from b_entries e join og on og.plan_id = e.plan_id join plans p on p.plan_id = e.plan_id join dt on dt.plan_id = e.plan_id and dt.slot = e.slot),
cd as (select plan_id, slot, mid, k, 7e-1 * (1 - k / 4e0) + 2e-1 * (1 - abs(energy - motion / (select max(motion) from rk)))
  + case when role <> '' and (role = case phase when 'opening' then 'opener' when 'build' then 'build' when 'climax' then 'climax' else 'closer' end or (slot = 0 and role = 'opener') or (slot = slots - 1 and role = 'closer')) then 2e-1 else 0 end
  + case when phase = 'climax' then 5e-1 * hero else 0 end + case when daylight <> '' and daylight = daylight_target then 1e-1 else 0 end + case when phase = 'climax' and shot_size = 'close' then 8e-2 else 0 end as v
  from sl cross join range(4) x(k) join rk on rk.r = slot + 1 + k)
select plan_id, slot, row_number() over (partition by plan_id, slot order by round(v, 9) desc, k) as choice, mid, round(v, 6) as value from cd
"""


@query("slot_candidates", oracle("b_entries b_moments", PLAN_CTES + "," + DAY + CANDIDATES))
def slot_candidates(t):
    return rounded(sc.slot_candidates(*_slots_and_pool(t), size_bonus={("climax", "close"): 0.08}))


@query("project_candidates", oracle("b_entries b_moments", PLAN_CTES + "," + DAY + CANDIDATES.replace("over (order by score", "over (partition by mid % 5 order by score")
       .replace("from rk))", "from rk m where m.mid % 5 = plan_id % 5))").replace("rk.r = slot + 1 + k", "rk.r = slot + 1 + k and rk.mid % 5 = plan_id % 5")))
def project_candidates(t):
    """Five projects, each with its plans and its pool."""
    slots, moments = _slots_and_pool(t)
    slots, moments = slots.withColumn("project", F.col("plan_id") % 5), moments.withColumn("project", F.col("mid") % 5)
    return rounded(sc.slot_candidates(slots, moments, size_bonus={("climax", "close"): 0.08}, project="project"))


LOOK = PLAN_CTES + "," + MATCH + """,
ph as (select e.plan_id, e.slot, max(label) filter (where span_start - 1e-6 <= record_start and record_start < span_end - 1e-6) as phase from b_entries e left join phases s on s.plan_id = e.plan_id group by e.plan_id, e.slot),
ee as (select e.*, m.grp, m.daylight, m.hero, m.role, ph.phase, count(*) over (partition by e.plan_id) as slots, (e.slot % 3 - 1) * 2e0 as edx, (e.plan_id % 3 - 1) * 15e-1 as edy, (e.slot % 4 - 15e-1) * 2 as xdx, (e.plan_id % 5 - 2) * 1e0 as xdy,
    case when e.slot % 6 <> 5 then e.slot % 5 / 4e0 end as fx, case when e.slot % 6 <> 5 then e.plan_id % 4 / 3e0 end as fy
  from b_entries e left join best b on b.plan_id = e.plan_id and b.slot = e.slot left join b_moments m on m.mid = b.mid join ph on ph.plan_id = e.plan_id and ph.slot = e.slot)
"""


def matched(t, *cols):
    return iv.best_overlap(t.entries, t.moments, carried=["mid", *cols])


def _looks(t):
    p = P(t)
    e = matched(t, "grp", "daylight", "hero", "role")
    e = iv.label_at(e, p.phases, "record_start", "phase").join(p.plans.select("plan_id", (F.col("beats") / 2).cast("bigint").alias("slots")), "plan_id")
    slot, plan = F.col("slot"), F.col("plan_id")
    focus = F.when(slot % 6 != 5, F.struct((slot % 5 / 4.0).alias("x"), (plan % 4 / 3.0).alias("y")))
    return e.withColumns({
        "grp": F.coalesce("grp", F.lit("")), "daylight": F.coalesce("daylight", F.lit("")), "on_drop": F.lit(False),
        "entry_motion": F.struct(((slot % 3 - 1) * 2.0).alias("dx"), ((plan % 3 - 1) * 1.5).alias("dy")),
        "exit_motion": F.struct(((slot % 4 - 1.5) * 2).alias("dx"), ((plan % 5 - 2) * 1.0).alias("dy")),
        "entry_focus": focus, "exit_focus": focus,
    })


@query("adjacency_scores", oracle("b_entries b_moments", LOOK + """,
pr as (select b.*, a.xdx as ax, a.xdy as ay, a.fx as afx, a.fy as afy, a.shot_size as asz, coalesce(a.daylight, '') as ad, coalesce(a.grp, '') as ag, a.phase as aph, a.clip_path as ac, a.source_start as ass, a.source_end as ase, a.record_start as ars,
    b.source_start - a.source_end as gap, b.record_end - a.record_start as span from ee b join ee a on a.plan_id = b.plan_id and a.slot = b.slot - 1),
tm as (select plan_id, slot, 3e-1 * case when sqrt(ax * ax + ay * ay) > 5e-1 and sqrt(edx * edx + edy * edy) > 5e-1 then (ax * edx + ay * edy) / (sqrt(ax * ax + ay * ay) * sqrt(edx * edx + edy * edy)) else 0 end as motion,
  case when phase is not distinct from aph and fx is not null and afx is not null then 12e-2 * (1 - 2 * sqrt((afx - fx) * (afx - fx) + (afy - fy) * (afy - fy)) / sqrt(2)) else 0 end as eye_trace,
  case when asz = '' or shot_size = '' then 0 when asz = shot_size then case when shot_size = 'close' and coalesce(phase, '') = 'climax' then 0 else -1e-1 end when (asz = 'wide' and shot_size = 'medium') or (asz = 'medium' and shot_size = 'close') then 12e-2 else 0 end as grammar,
  case when coalesce(daylight, '') <> '' and ad <> '' and daylight <> ad then -15e-2 else 0 end as daylight_switch, case when coalesce(grp, '') <> '' and grp = ag then -25e-2 else 0 end as same_group,
  case when clip_path = ac and abs(gap) <= 8 + 1e-6 and not (gap >= -1e-6 and gap <= 3 + 1e-6 and slot <> slots - 1 and phase is not distinct from aph and span <= 8 + 1e-6 and ass + span >= source_start - 1e-6) then -4e-1 else 0 end as jump_cut from pr)
select plan_id, slot, round(motion, 6) as motion, round(eye_trace, 6) as eye_trace, cast(grammar as double) as grammar, cast(daylight_switch as double) as daylight_switch, cast(same_group as double) as same_group, cast(jump_cut as double) as jump_cut,
  round(motion + eye_trace + grammar + daylight_switch + same_group + jump_cut, 6) as total from tm
"""))
def adjacency_scores(t):
    return rounded(sc.adjacency_scores(_looks(t)))


@query("opening_closing_kinship", oracle("b_entries b_moments", LOOK + """,
x as (select *, case when slot = 0 then 1 else 0 end as f, case when slot = slots - 1 then 1 else 0 end as l, (sqrt(edx * edx + edy * edy) + sqrt(xdx * xdx + xdy * xdy)) / 2 as mag from ee where slot = 0 or slot = slots - 1),
p as (select a.plan_id, a.shot_size as s1, b.shot_size as s2, a.fx as x1, a.fy as y1, b.fx as x2, b.fy as y2, coalesce(a.daylight, '') as d1, coalesce(b.daylight, '') as d2, a.mag as m1, b.mag as m2 from x a join x b on a.plan_id = b.plan_id and a.f = 1 and b.l = 1 and a.slot < b.slot),
w as (select *, case when s1 <> '' and s2 <> '' then 5e-1 else 0 end as ws, case when x1 is not null and x2 is not null then 3e-1 else 0 end as wf, case when d1 <> '' and d2 <> '' then 1e-1 else 0 end as wd, case when m1 > 1e-6 or m2 > 1e-6 then 1e-1 else 0 end as wm from p)
select plan_id, round(case when (s1 <> '' or x1 is not null) and (s2 <> '' or x2 is not null) and ws + wf + wd + wm > 1e-6 then (ws * case when s1 = s2 then 1 else 0 end + wf * coalesce(greatest(0, 1 - sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / sqrt(2)), 0)
  + wd * case when d1 = d2 then 1 else 0 end + wm * coalesce(1 - abs(m1 - m2) / nullif(greatest(m1, m2), 0), 0)) / (ws + wf + wd + wm) else 0 end, 6) as kinship from w
"""))
def opening_closing_kinship(t):
    e = _looks(t)
    look = F.struct("shot_size", "entry_focus", "exit_focus", "daylight", sc.motion_magnitude().alias("motion"))
    ends = e.groupBy("plan_id").agg(
        F.min_by(look, "slot").alias("a"), F.max_by(look, "slot").alias("b"), F.count("*").alias("n")
    ).where("n > 1")
    return rounded(sc.kinship(ends).select("plan_id", "kinship"))


@query("pace_signals", oracle("b_moments", """
m as (select *, mid % 17 / 2e0 as motion from b_moments),
pk as (select grp, max(motion) as pk from m group by grp),
ca as (select m.grp as project, sum(case when motion / pk <= 35e-2 + 1e-6 and highlight <= 3e-1 + 1e-6 then end_s - start_s else 0 end) / sum(end_s - start_s) as calm_share from m join pk on pk.grp = m.grp group by m.grp),
so as (select grp as project, sum((end_s - start_s) * score) / sum(end_s - start_s) as mean_energy from b_moments where role <> '' group by grp)
select ca.project, round(calm_share, 6) as calm_share, round(mean_energy, 6) as mean_energy, cast(case when calm_share >= 6e-1 - 1e-6 then 1 else 0 end + case when mean_energy <= 35e-2 + 1e-6 then 1 else 0 end as bigint) as notches from ca left join so on so.project = ca.project
"""))
def pace_signals(t):
    m = _moving(t).withColumnRenamed("grp", "project")
    songs = t.moments.where("role <> ''").select(F.col("grp").alias("project"), "start_s", "end_s", F.col("score").alias("energy"))
    return rounded(sc.pace_signals(m, songs))


CARD = PLAN_CTES + """,
gi as (select *, row_number() over (partition by plan_id order by gap_start, gap_end) - 1 as item from gaps),
di as (select *, row_number() over (partition by plan_id order by t) - 1 as item from drops),
it as (select plan_id, 'coincidence' as name, slot as item, peak_source between source_start - 1e-6 and source_end + 1e-6 and abs(peak_source - source_start) <= 25e-2 + 1e-6 as ok from b_entries where record_start > 1e-6 and peak_source >= 0
  union all select plan_id, 'slivers', slot, record_end - record_start >= 3e-1 - 1e-6 from b_entries union all select plan_id, 'slivers', -1, dip_len >= 3e-1 - 1e-6 from dips
  union all select plan_id, 'silence', item, exists (select 1 from sfx s where s.plan_id = g.plan_id and kind in ('sub-drop', 'impact') and time <= gap_end + 5e-1 + 1e-6 and time + greatest(length, 0) >= gap_start - 5e-1 - 1e-6)
    or exists (select 1 from drops d where d.plan_id = g.plan_id and abs(gap_end - d.t) <= 12e-2 + 1e-6) from gi g
  union all select plan_id, 'drops', item, exists (select 1 from b_entries e where e.plan_id = d.plan_id and abs(record_start - d.t) <= 12e-2 + 1e-6) from di d
  union all select a.plan_id, 'grammar', b.slot, a.shot_size <> b.shot_size from b_entries a join b_entries b on b.plan_id = a.plan_id and b.slot = a.slot + 1 where a.shot_size <> '' and b.shot_size <> ''),
ct as (select plan_id, name, count(*) as n, count(*) filter (where ok) as g from it group by plan_id, name),
mt as (select p.plan_id, v.name, hard, coalesce(n, 0) as sample, coalesce(g, 0) as good from plans p cross join (values ('coincidence', true), ('silence', true), ('slivers', true), ('drops', false), ('grammar', false)) v(name, hard) left join ct on ct.plan_id = p.plan_id and ct.name = v.name),
mv as (select *, case name when 'slivers' then sample - good when 'grammar' then case when sample > 0 then 1 - good / sample else 0 end else case when sample > 0 then good / sample else 1 end end as value,
    case when sample = 0 then true when name = 'coincidence' then good / sample >= 8e-1 - 1e-6 else good = sample end as passed from mt),
ms as (select *, case name when 'slivers' then case when good = sample then 1 else 0 end when 'grammar' then 1 - value else value end as share from mv
  union all select plan_id, 'loudness', true, 1, 1, -14 + (plan_id % 9 - 4) * 4e-1, abs((plan_id % 9 - 4) * 4e-1) <= 1 + 1e-6, greatest(0, 1 - abs((plan_id % 9 - 4) * 4e-1)) from plans),
tt as (select plan_id, bool_and(passed or not hard or sample = 0) as accepted, sum(case when sample > 0 then case when hard then 2 else 1 end * share else 0 end) / nullif(sum(case when sample > 0 then case when hard then 2 else 1 end else 0 end), 0) as aggregate from ms group by plan_id)
"""


def _card(t):
    from cutlake.functions.staging import settle

    p = P(t)
    rows = settle(sc.scorecard_rows(p.entries, p.dips, p.gaps, p.sfx, p.drops))
    lufs = p.plans.select("plan_id", (-14 + (F.col("plan_id") % 9 - 4) * 0.4).alias("lufs"))
    return rows, sc.scorecard(rows, p.plans, lufs)


@query("quality_scorecard", oracle("b_entries", CARD + "select plan_id, name, hard, cast(sample as bigint) as sample, round(value, 6) as value, passed, round(share, 6) as share from ms"))
def quality_scorecard(t):
    return rounded(_card(t)[1])


@query("scorecard_culprits", oracle("b_entries", CARD + "select plan_id, name, item as culprit from it where not ok and item >= 0"))
def scorecard_culprits(t):
    return sc.culprits(_card(t)[0])


@query("plan_scores", oracle("b_entries", CARD + "select plan_id, accepted, round(coalesce(aggregate, 1), 6) as aggregate from tt"))
def plan_scores(t):
    return rounded(sc.card_totals(_card(t)[1]))


@query("best_plans", oracle("b_entries", CARD + """,
lv as (select plan_id % 40 as project, plan_id, accepted, aggregate, max(accepted) over (partition by plan_id % 40) as any_ok from tt),
ls as (select project, bool_or(accepted) as accepted, list({'p': plan_id, 'v': aggregate} order by plan_id) filter (where accepted = any_ok) as l from lv group by project),
wk as (select project, accepted, list_reduce(l, lambda b, x: case when x.v > b.v + 1e-6 then x else b end) as w from ls)
select project, w.p as plan_id, accepted, round(w.v, 6) as aggregate from wk
"""))
def best_plans(t):
    totals = sc.card_totals(_card(t)[1]).withColumn("project", F.col("plan_id") % 40).withColumn("pass_no", F.col("plan_id"))
    return rounded(sc.best_plan(totals))


DIFF = """
old as (select plan_id as pair_id, slot, clip_path, source_start, source_end, record_start, record_end, transition from b_entries),
new as (select plan_id as pair_id, slot, clip_path, case when slot % 5 = 2 then source_start + 5e-1 else source_start end as source_start, case when slot % 5 = 2 then source_end + 5e-1 else source_end end as source_end,
    record_start, case when slot % 5 = 1 then record_end - 1e-1 else record_end end as record_end, case when slot % 4 = 1 then 5e-1 - transition else transition end as transition from b_entries where slot % 7 <> 3),
ol as (select pair_id, clip_path, list({'slot': slot, 'a': source_start, 'b': source_end} order by slot) as o from old group by pair_id, clip_path),
nl as (select pair_id, clip_path, list({'slot': slot, 'a': source_start, 'b': source_end} order by slot) as n from new group by pair_id, clip_path),
wk as (select ol.pair_id, ol.clip_path, list_reduce(list_transform(n, lambda x: {'left': [x], 'pairs': cast([] as struct(n bigint, o bigint)[])}), lambda s, y:
    {'left': list_filter(s.left, lambda z: z.slot is distinct from list_sort(list_transform(list_filter(s.left, lambda q: least(q.b, y.left[1].b) > greatest(q.a, y.left[1].a)), lambda q: {'k': -(least(q.b, y.left[1].b) - greatest(q.a, y.left[1].a)), 'slot': q.slot}))[1].slot),
     'pairs': list_append(s.pairs, {'n': y.left[1].slot, 'o': list_sort(list_transform(list_filter(s.left, lambda q: least(q.b, y.left[1].b) > greatest(q.a, y.left[1].a)), lambda q: {'k': -(least(q.b, y.left[1].b) - greatest(q.a, y.left[1].a)), 'slot': q.slot}))[1].slot})},
    {'left': o, 'pairs': cast([] as struct(n bigint, o bigint)[])}) as w from ol join nl on nl.pair_id = ol.pair_id and nl.clip_path = ol.clip_path),
pr as (select pair_id, p.n as new_slot, p.o as old_slot from (select pair_id, unnest(w.pairs) as p from wk) z where p.o is not null),
kp as (select n.*, o.slot as old_slot, o.source_start as o_s, o.source_end as o_e, o.record_start as o_r0, o.record_end as o_r1, o.transition as o_t from pr join new n on n.pair_id = pr.pair_id and n.slot = new_slot join old o on o.pair_id = pr.pair_id and o.slot = pr.old_slot),
pl as (select o.pair_id, od, nd, 120e0 as old_tempo, 120 + o.pair_id % 3 * 4e-1 as new_tempo from (select pair_id, max(record_end) as od from old group by pair_id) o join (select pair_id, max(record_end) as nd from new group by pair_id) n on n.pair_id = o.pair_id),
tx as (select pair_id, slot, record_start, clip_path, source_start, source_end, record_end, transition, o_s, o_e, o_r0, o_r1, o_t from kp),
ch as (select n.pair_id, 'added' as kind, record_start as at, clip_path as clip, 0 as rk, n.slot, null as was, null as "now" from new n left join pr on pr.pair_id = n.pair_id and new_slot = n.slot where new_slot is null
  union all select o.pair_id, 'removed', record_start, clip_path, 1, o.slot, null, null from old o left join pr on pr.pair_id = o.pair_id and old_slot = o.slot where old_slot is null
  union all select pair_id, 'trimmed', record_start, clip_path, 2, slot, o_s, source_start from tx where abs(source_start - o_s) > 5e-2 or abs(source_end - o_e) > 5e-2
  union all select pair_id, 'retimed', record_start, clip_path, 2, slot, o_r1 - o_r0, record_end - record_start from tx where abs(source_start - o_s) <= 5e-2 and abs(source_end - o_e) <= 5e-2 and abs(record_end - record_start - o_r1 + o_r0) > 5e-2
  union all select pair_id, 'transition', record_start, clip_path, 3, slot, o_t, transition from tx where (transition > 5e-2) <> (o_t > 5e-2)
  union all select pair_id, 'length', 0, '', 4, 0, od, nd from pl where abs(nd - od) > 25e-2 union all select pair_id, 'tempo', 0, '', 5, 0, old_tempo, new_tempo from pl where abs(new_tempo - old_tempo) > 5e-1)
"""


def versions(t):
    old = t.entries.select(F.col("plan_id").alias("pair_id"), "slot", "clip_path", "source_start", "source_end", "record_start", "record_end", "transition")
    slot = F.col("slot")
    moved = F.when(slot % 5 == 2, 0.5).otherwise(0.0)
    new = old.where(slot % 7 != 3).withColumns({
        "source_start": F.col("source_start") + moved, "source_end": F.col("source_end") + moved,
        "record_end": F.col("record_end") - F.when(slot % 5 == 1, 0.1).otherwise(0.0),
        "transition": F.when(slot % 4 == 1, 0.5 - F.col("transition")).otherwise(F.col("transition")),
    })
    length = lambda df, n: df.groupBy("pair_id").agg(F.max("record_end").alias(n))
    plans = length(old, "old_duration").join(length(new, "new_duration"), "pair_id").withColumn("old_tempo", F.lit(120.0)).withColumn(
        "new_tempo", 120 + F.col("pair_id") % 3 * 0.4
    )
    return old, new, plans


@query("version_matches", oracle("b_entries", DIFF + "select pair_id, new_slot, old_slot from pr"))
def version_matches(t):
    old, new, _ = versions(t)
    return sc.match_versions(old, new)


@query("version_changes", oracle("b_entries", DIFF + "select pair_id, row_number() over (partition by pair_id order by case when kind in ('length', 'tempo') then 1 else 0 end, \"at\", least(rk, 2), slot, rk) as line_no, kind, round(\"at\", 6) as \"at\", clip, round(was, 6) as was, round(\"now\", 6) as \"now\" from ch"))
def version_changes(t):
    return rounded(sc.change_lines(sc.diff_plans(*versions(t))))


@query("change_summary", oracle("b_entries", DIFF + """,
sc as (select *, cast(printf('%.0f', greatest(0e0, "at")) as bigint) as s0, cast(printf('%.0f', greatest(0e0, was)) as bigint) as s1, cast(printf('%.0f', greatest(0e0, "now")) as bigint) as s2,
    concat(printf('%.1f', abs("now" - was)), case when "now" > was then 's longer' else 's shorter' end) as by_ from ch),
sx as (select *, case kind when 'added' then concat('Added ', clip, ' at ', printf('%d:%02d', s0 // 60, s0 % 60)) when 'removed' then concat('Removed ', clip, ' (was at ', printf('%d:%02d', s0 // 60, s0 % 60), ')')
    when 'trimmed' then concat('Re-trimmed ', clip, ' at ', printf('%d:%02d', s0 // 60, s0 % 60)) when 'retimed' then concat(clip, ' is ', by_, ' at ', printf('%d:%02d', s0 // 60, s0 % 60))
    when 'transition' then concat(clip, ' is now ', case when "now" > 5e-2 then 'a dissolve' else 'a hard cut' end, ' at ', printf('%d:%02d', s0 // 60, s0 % 60))
    when 'length' then concat('Cut is ', by_, ' (', printf('%d:%02d', s1 // 60, s1 % 60), ' -> ', printf('%d:%02d', s2 // 60, s2 % 60), ')') else concat('Tempo ', printf('%.0f', was), ' -> ', printf('%.0f', "now"), ' BPM') end as line
  from sc),
ev as (select pair_id, kind, "at", rk, slot, line from sx union all select pair_id, null, null, null, null, null from pl),
sm as (select pair_id, count(*) filter (where kind = 'added') as added, count(*) filter (where kind = 'removed') as removed, count(*) filter (where kind not in ('added', 'removed')) as other,
    string_agg(concat(chr(10), '  - ', line), '' order by case when kind in ('length', 'tempo') then 1 else 0 end, coalesce("at", 0), least(rk, 2), slot, rk) filter (where kind is not null) as lines from ev group by pair_id)
select pair_id, added, removed, other, case when lines is null then 'No editorial changes between previous and current.'
  else concat('Changes: previous -> current', chr(10), '  ', added, ' added, ', removed, ' removed, ', other, ' other', chr(10), lines) end as note from sm
"""))
def change_summary(t):
    old, new, plans = versions(t)
    return sc.change_notes(sc.diff_plans(old, new, plans), plans)


@query("plan_snapshots", oracle("b_entries", """
sv as (select o_custkey % 50 as project, o_orderkey as saved_no, concat(o_orderpriority, o_orderstatus) as h, shots, duration from orders join (select plan_id, count(*) as shots, max(record_end) as duration from b_entries group by plan_id) e on plan_id = o_orderkey),
ks as (select *, lag(h) over (partition by project order by saved_no) as p from sv),
ag as (select *, row_number() over (partition by project order by saved_no desc) as age from ks where p is null or p <> h)
select project, saved_no, shots, round(duration, 6) as duration, age from ag where age <= 50
"""))
def plan_snapshots(t):
    stats = t.entries.groupBy("plan_id").agg(F.count("*").alias("shots"), F.max("record_end").alias("duration"))
    saves = t.read("orders").select(
        (F.col("o_custkey") % 50).alias("project"), F.col("o_orderkey").alias("saved_no"), sc.plan_hash(["o_orderpriority", "o_orderstatus"]).alias("plan_hash"),
        F.col("o_orderkey").alias("plan_id"),
    ).join(stats, "plan_id").drop("plan_id")
    return rounded(sc.snapshots(saves).drop("plan_hash"))


@query("plan_summaries", oracle("b_entries", PLAN_CTES + "select plan_id, case when plan_id % 4 = 0 then 'auto' else style end as style, round(duration, 6) as duration, beats // 2 as cuts from plans"))
def plan_summaries(t):
    p = P(t)
    note = F.when(F.col("plan_id") % 4 == 0, F.lit("hand-made")).otherwise(F.concat(F.lit('style "'), "style", F.lit('": planned')))
    return rounded(sc.plan_summaries(p.plans.withColumn("notes", F.array(F.lit("cut pace"), note)), p.entries))


COVER = """
m as (select *, mid % 7 as project from b_moments),
cl as (select project, clip_path, max(end_s) + 5 as duration, 4e-1 + project % 3 * 2e-1 as usable_ratio from m group by project, clip_path),
sp as (select distinct project, clip_path, start_s, end_s from m),
mk as (select *, case when start_s > max(end_s) over (partition by project, clip_path order by start_s, end_s rows between unbounded preceding and 1 preceding) + 1e-6 then 1 else 0 end as o from sp),
gr as (select *, sum(o) over (partition by project, clip_path order by start_s, end_s rows between unbounded preceding and current row) as g from mk),
us as (select project, sum(b - a) as u from (select project, clip_path, g, min(start_s) as a, max(end_s) as b from gr group by project, clip_path, g) z group by project),
cc as (select project, count(*) as clips, 1 - sum(usable_ratio * duration) / sum(duration) as share from cl group by project),
mm as (select project, count(*) as moments, count(*) filter (where role = 'opener') as opener, count(*) filter (where role = 'build') as build, count(*) filter (where role = 'climax') as climax, count(*) filter (where role = 'closer') as closer, count(*) filter (where hero >= 5e-1) as heroes, count(distinct grp) as groups from m group by project)
select mm.project, clips, moments, opener, build, climax, closer, heroes, groups, round(u, 6) as usable_seconds, round(share, 6) as unusable_share, 300 > u + 1e-6 as repetition_risk,
  concat_ws('; ', case when 300 > u + 1e-6 then 'short_of_target' end, case when share >= 5e-1 then 'mostly_unusable' end, case when opener = 0 then 'no_opener' end, case when closer = 0 then 'no_closer' end,
    case when heroes = 0 then 'no_heroes' end, case when groups = 1 and moments >= 2 then 'one_group' end) as findings
from mm join cc on cc.project = mm.project join us on us.project = mm.project
"""


@query("coverage_facts", oracle("b_moments", COVER))
def coverage_facts(t):
    m = t.moments.withColumn("project", F.col("mid") % 7)
    clips = m.groupBy("project", "clip_path").agg((F.max("end_s") + 5).alias("duration")).withColumn("usable_ratio", 0.4 + F.col("project") % 3 * 0.2)
    return rounded(sc.coverage(m, clips, 300.0).withColumn("findings", F.array_join("findings", "; ")).drop("vision"))


@query("pool_dossier", oracle("b_moments", """
m as (select b.*, mid % 7 as project, p_name, p_type from b_moments b join part on p_partkey = mid),
tg as (select project, mid * 100 + i - 1 as o, [string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], p_type][i] as v from m cross join range(1, 4) r(i)),
f as (select project, 'daylight' as facet, daylight as v, mid as o from m where daylight <> '' union all select project, 'shot_size', shot_size, mid from m union all select project, 'tag', v, o from tg where v is not null union all select project, 'label', p_name, mid from m),
c as (select project, facet, v as value, count(*) as n, min(o) as o from f group by project, facet, v),
r as (select *, row_number() over (partition by project, facet order by case when facet = 'label' then 0 else -n end, o) as rank from c)
select project, facet, value, n, rank from r where (facet <> 'tag' or rank <= 8) and (facet <> 'label' or rank <= 10) union all select project, 'heroes', '', count(*) filter (where hero >= 5e-1), 1 from m group by project
"""))
def pool_dossier(t):
    names = t.read("part").select(F.col("p_partkey").alias("mid"), F.col("p_name").alias("label"), "p_type")
    words = F.split("label", " ")
    m = t.moments.join(names, "mid").withColumn("project", F.col("mid") % 7).withColumn("tags", F.array_compact(F.array(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.col("p_type"))))
    return sc.pool_dossier(m)


@query("chapters", oracle("b_entries b_moments", MATCH + """,
ee as (select e.*, coalesce(nullif(m.grp, ''), e.clip_path) as k, case when e.slot % 3 = 0 then concat('shot ', cast(e.slot as varchar)) when m.role is not null and m.role <> '' then m.role else e.clip_path end as title from b_entries e left join best b on b.plan_id = e.plan_id and b.slot = e.slot left join b_moments m on m.mid = b.mid),
ch as (select *, lag(k) over (partition by plan_id order by record_start, slot) as pk from ee),
ls as (select plan_id, list({'t': case when pk is null then 0e0 else record_start end, 'title': title} order by case when pk is null then 0e0 else record_start end, slot) as l from ch where pk is null or pk <> k group by plan_id),
wk as (select plan_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: case when y[1].t - acc[len(acc)].t >= 10 then list_concat(acc, y) else acc end) as w from ls)
select plan_id, i as chapter, round(w[i].t, 6) as start_s, w[i].title as title from (select plan_id, w, unnest(range(1, len(w) + 1)) as i from wk) z
"""))
def chapters(t):
    e = matched(t, "grp", "role").withColumn("label", F.when(F.col("slot") % 3 == 0, F.concat(F.lit("shot "), "slot")).otherwise("")).withColumnRenamed("role", "moment_label")
    return rounded(sc.chapters(e))


@query("thumbnails", oracle("b_entries b_moments", MATCH + """,
ee as (select e.plan_id, e.slot, e.score, e.record_start, coalesce(m.hero, 0) as hero, coalesce(m.grp, '') as g from b_entries e left join best b on b.plan_id = e.plan_id and b.slot = e.slot left join b_moments m on m.mid = b.mid),
d as (select *, case when g <> '' and row_number() over (partition by plan_id, g order by hero desc, score desc, record_start, slot) > 1 then 1 else 0 end as late from ee),
r as (select *, row_number() over (partition by plan_id order by late, hero desc, score desc, record_start, slot) as pick from d)
select plan_id, pick, slot from r where pick <= 3
"""))
def thumbnails(t):
    return sc.thumbnails(matched(t, "hero", "grp"), 3)


@query("used_moment_tags", oracle("b_entries b_moments", MATCH + """,
w as (select b.plan_id, unnest([grp, daylight, shot_size]) as tag from best b join b_moments m on m.mid = b.mid),
c as (select plan_id, tag, count(*) as n from w where tag <> '' group by plan_id, tag),
r as (select *, row_number() over (partition by plan_id order by n desc, tag) as rank from c)
select plan_id, tag, n, rank from r where rank <= 12
"""))
def used_moment_tags(t):
    e = iv.best_overlap(t.entries.drop("shot_size"), t.moments, carried=["mid", "grp", "daylight", "shot_size"])
    tags = F.filter(F.array("grp", "daylight", "shot_size"), lambda x: x.isNotNull() & (x != ""))
    return sc.plan_tags(e.where("mid is not null").withColumn("tags", tags))


@query("label_tags", oracle("b_annotations", """
w as (select tag as plan_id, unnest(regexp_extract_all(lower(label), '[a-z0-9äöüß]+')) as tag from b_annotations),
c as (select plan_id, tag, count(*) as n from w where length(tag) >= 3 and tag not in ('the','and','with','into','onto','from','over','under','for','its','his','her','their','a','an','der','die','das','und','ein','eine','einem','einen','mit','dem','den','auf','aus','bei','durch') group by plan_id, tag),
r as (select *, row_number() over (partition by plan_id order by n desc, tag) as rank from c)
select plan_id, tag, n, rank from r where rank <= 12
"""))
def label_tags(t):
    return sc.label_tags(t.annotations.select(F.col("tag").alias("plan_id"), "label"))


CUES = PLAN_CTES + """,
es as (
  select plan_id, 0e0 as time, span_end - span_start as length, 'ambience' as kind, 'opening' as note from phases where i = 0 and span_end - span_start > 1e-6
  union all select p.plan_id, span_start, least(1e0, duration - span_start), 'impact', 'climax' from phases h join plans p on p.plan_id = h.plan_id where label = 'climax' and span_start > 1e-6 and span_start < duration - 1e-6
  union all select d.plan_id, t, least(1e0, duration - t), 'impact', 'drop' from drops d join plans p on p.plan_id = d.plan_id
  union all select plan_id, dip_start, dip_len, 'sub-drop', 'title' from dips
),
ne as (select plan_id, count(*) as n from es group by plan_id),
rm as (select p.plan_id, duration, music_in, greatest(1, ceil(duration / 35e-1)) - coalesce(n, 0) as room from plans p left join ne on ne.plan_id = p.plan_id),
nx as (select *, lead(label) over (partition by plan_id order by i) as nl, least(2e0, (span_end - span_start) / 2) as length from phases),
rs as (select n.plan_id, span_end - length as time, length, concat(label, '>', nl) as note, room, row_number() over (partition by n.plan_id order by case when nl = 'climax' then 0 else 1 end, span_end - length) as r
  from nx n join rm on rm.plan_id = n.plan_id where nl is not null and nl <> label and span_end > 1e-6 and span_end < duration - 1e-6 and length > 1e-6),
pc as (select * from es union all select plan_id, time, length, 'riser', note from rs where r <= room),
lf as (select rm.plan_id, duration, least(room - (select count(*) from rs where rs.plan_id = rm.plan_id and r <= room), 6) as room from rm),
fr as (select e.plan_id, e.record_end - e.record_start as len, e.record_start as t, room from b_entries e join lf on lf.plan_id = e.plan_id where e.record_start > 1e-6 and e.record_start < duration - 1e-6
  and not exists (select 1 from pc where pc.plan_id = e.plan_id and e.record_start > pc.time - (1 - 1e-6) and e.record_start < pc.time + pc.length + (1 - 1e-6))),
ls as (select plan_id, room, list({'len': len, 't': t} order by len, t) as l from fr group by plan_id, room),
wl as (select plan_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: case when len(acc) < room and len(list_filter(acc, lambda o: y[1].t > greatest(0, o.t - 3e-1) - (1 - 1e-6) and y[1].t < greatest(0, o.t - 3e-1) + 6e-1 + (1 - 1e-6))) = 0
  then list_concat(acc, y) else acc end, cast([] as struct(len double, t double)[])) as w from ls),
cu as (select * from pc union all select plan_id, greatest(0e0, x.t - 3e-1), 6e-1, 'whoosh', 'fast_cut' from (select plan_id, unnest(w) as x from wl) z),
nr as (select c.plan_id, music_in, min({'d': round(abs(time + length - music_in), 9), 't': time, 'l': length}) as m from cu c join plans p on p.plan_id = c.plan_id where kind = 'riser' and music_in > 1e-6 group by c.plan_id, music_in),
mv as (select plan_id, m.t as t, music_in as "to" from nr where m.d <= 1 + 1e-6)
"""


@query("sound_cues", oracle("b_entries", CUES + """
select c.plan_id, round(case when "to" is not null then greatest(0e0, "to" - length) else time end, 6) as time, round(case when "to" is not null then "to" - greatest(0e0, "to" - length) else length end, 6) as length, kind,
  case when "to" is not null then concat(note, '+music_entry') else note end as note from cu c left join mv on mv.plan_id = c.plan_id and mv.t = c.time and c.kind = 'riser'
union all select plan_id, round(music_in - least(2e0, music_in), 6), round(least(2e0, music_in), 6), 'riser', 'music_entry' from plans where music_in > 1e-6 and plan_id not in (select plan_id from mv)
"""))
def sound_cues(t):
    p = P(t)
    return rounded(sc.derive_cues(p.plans, p.phases, p.drops, p.dips, p.entries))


@query("cue_files", oracle("b_entries", PLAN_CTES + "," + ELEMENTS.replace("w as (select l_orderkey", "w as (select l_orderkey", 1) + "," + KIND.strip().rsplit("select file", 1)[0].rstrip() + """,
lib as (select concat('file_', cast(file as varchar)) as path, duration + file % 7 / 8e0 as d, kind, round(case when kind = 'other' then 0 else greatest(1e-1, raw) end, 6) as conf from r),
best as (select kind, d, min_by(path, {'c': -conf, 'p': path}) as path, max(conf) as conf from lib where kind <> 'other' group by kind, d),
cue as (select plan_id * 100 + row_number() over (partition by plan_id order by time, kind, length) as cue_id, case kind when 'sub-drop' then 'braam' else kind end as kind, case when kind = 'riser' then length end as target from sfx),
picks as (select cue_id, b.kind as element, b.path, b.d, row_number() over (partition by cue_id order by case when target is null then 0 else round(abs(b.d - target), 9) end, -conf, path) as k from cue join best b on b.kind = cue.kind)
select cue_id, element, path, round(d, 6) as duration from picks where k = 1
"""))
def cue_files(t):
    from cutlake.functions.ordered import row_index, scan

    p = P(t)
    cues = scan(p.sfx, ["plan_id"], ["time", "kind", "length"], F.floor(F.col("time") / 600), n=row_index())
    cues = cues.select((F.col("plan_id") * 100 + F.col("n")).alias("cue_id"), "kind", F.when(F.col("kind") == "riser", F.col("length")).alias("target"))
    lib = classified(t).select(
        F.concat(F.lit("file_"), "file").alias("path"), (F.col("duration") + F.col("file") % 7 / 8.0).alias("duration"), "kind", r6("confidence").alias("confidence")
    )
    return rounded(sc.rank_elements(cues, lib))


@query("file_reuse", oracle("b_entries", """
p as (select plan_id, slot, record_start as time, case when slot % 2 = 0 then 'impact' else 'whoosh' end as element, concat('file_', cast(slot % 3 as varchar)) as path from b_entries),
g as (select *, time - lag(time) over (partition by plan_id, path order by time, slot) as gap_s from p)
select plan_id, slot as cue_id, path, round(gap_s, 6) as gap_s, coalesce(gap_s < case element when 'impact' then 25e-1 else 4 end - 1e-6, false) as too_soon from g
"""))
def file_reuse(t):
    placed = t.entries.select(
        "plan_id", F.col("slot").alias("cue_id"), F.col("record_start").alias("time"), F.when(F.col("slot") % 2 == 0, "impact").otherwise("whoosh").alias("element"),
        F.concat(F.lit("file_"), F.col("slot") % 3).alias("path"),
    )
    return rounded(sc.reuse_gaps(placed).drop("time", "element"))


@query("reframe_offsets", oracle("b_entries", """
e as (select plan_id, slot, case when slot % 6 <> 5 then slot % 5 / 4e0 end as fx, plan_id % 4 / 3e0 as fy, case when slot % 3 = 0 then plan_id % 6 / 5e0 end as gx, plan_id % 7 / 6e0 as gy from b_entries),
f as (select *, case when fx is not null and gx is not null then (fx + gx) / 2 else coalesce(fx, gx) end as x, case when fx is not null and gx is not null then (fy + gy) / 2 when fx is not null then fy when gx is not null then gy end as y from e),
s as (select *, 1920 * greatest(1080 / 1920e0, 1920 / 1080e0) as sw, 1080 * greatest(1080 / 1920e0, 1920 / 1080e0) as sh from f),
o as (select plan_id, slot, x is null as none, case when x is null then (sw - 1080) / 2 else greatest(0, least(sw - 1080, x * sw - 540)) end as ox, case when x is null then (sh - 1920) / 2 else greatest(0, least(sh - 1920, y * sh - 960)) end as oy, (sw - 1080) / 2 as cx, (sh - 1920) / 2 as cy from s)
select plan_id, slot, round(ox, 6) as x, round(oy, 6) as y, none or (abs(ox - cx) <= 5e-1 and abs(oy - cy) <= 5e-1) as centred from o
"""))
def reframe_offsets(t):
    slot, plan = F.col("slot"), F.col("plan_id")
    a = F.when(slot % 6 != 5, F.struct((slot % 5 / 4.0).alias("x"), (plan % 4 / 3.0).alias("y")))
    b = F.when(slot % 3 == 0, F.struct((plan % 6 / 5.0).alias("x"), (plan % 7 / 6.0).alias("y")))
    e = t.entries.select("plan_id", "slot", a.alias("a"), b.alias("b")).withColumn("f", sc.average_focus("a", "b"))
    w, h = F.lit(1920.0), F.lit(1080.0)
    return rounded(e.withColumn("o", sc.crop_offset(w, h, h, w, F.col("f"))).select("plan_id", "slot", "o.x", "o.y", "o.centred"))


@query("beat_quantised", oracle("b_entries", """
g as (select plan_id, record_start - lag(record_start) over (partition by plan_id order by record_start) as gap from b_entries),
l as (select plan_id, list_sort(list(gap) filter (where gap > 1e-6)) as l from g group by plan_id),
p as (select plan_id, coalesce(l[len(l) // 2 + 1] / 4, 0) as pulse from l),
e as (select e.plan_id, slot, pulse, record_end - record_start as s from b_entries e join p on p.plan_id = e.plan_id),
q as (select *, case when pulse > 1e-6 and s > 1e-6 then greatest(1, round_even(s / (pulse / 2), 0)) * pulse / 2 end as near, floor((2 + 1e-6) / nullif(pulse / 2, 0)) as fits from e)
select plan_id, slot, round(pulse, 6) as pulse, round(coalesce(near, s), 6) as free, round(case when near is null then s when near <= 2 + 1e-6 then near when fits < 1 then least(s, 2) else fits * pulse / 2 end, 6) as capped from q
"""))
def beat_quantised(t):
    pulse = sc.plan_pulse(t.entries.select("plan_id", F.col("record_start").alias("t")))
    e = t.entries.select("plan_id", "slot", (F.col("record_end") - F.col("record_start")).alias("s")).join(pulse, "plan_id", "left").fillna(0.0, ["pulse"])
    return rounded(e.select("plan_id", "slot", "pulse", sc.quantize("s", "pulse").alias("free"), sc.quantize("s", "pulse", 2.0).alias("capped")))
