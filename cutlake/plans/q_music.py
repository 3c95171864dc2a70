"""Music queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.staging import settle
from cutlake.operators import music as mu
from cutlake.plans.q_timeline import rounded
from cutlake.plans.registry import query
from cutlake.plans.views import oracle

CURVE = """
s0 as (select clip_id as track_id, t, row_number() over (partition by clip_id order by t) - 1 as i, round(avg(rms) over (partition by clip_id order by t rows between 4 preceding and 3 following), 12) as level from b_audio),
p as (select track_id, quantile_cont(level, 95e-2) as p95 from s0 group by track_id),
curve as (select s0.track_id, i, t, case when p95 > 1e-9 then least(1e0, greatest(0e0, level / p95)) else 0e0 end as energy from s0 join p on p.track_id = s0.track_id)
"""
# Songs of the beat table: sections of 16 beats, duration by beat count.
SONG = """
tracks as (select track_id, count(*) * 5e-1 as duration from b_beats group by track_id),
sections as (select b.track_id, i // 16 as k, i // 16 * 8e0 as start_s, least(min(duration), (i // 16 + 1) * 8e0) as end_s, avg(energy) as energy, case when avg(energy) < 65e-2 then 'low' when avg(energy) < 75e-2 then 'mid' else 'high' end as label
  from b_beats b join tracks t on t.track_id = b.track_id group by b.track_id, i // 16),
dr as (select track_id, t from b_beats where energy >= 1),
en as (select d.track_id, d.t, sum(greatest(0, least(d.t, end_s) - greatest(d.t - 4, start_s)) * energy) / nullif(sum(greatest(0, least(d.t, end_s) - greatest(d.t - 4, start_s))), 0) as b,
    sum(greatest(0, least(d.t + 4, end_s) - greatest(d.t, start_s)) * energy) / nullif(sum(greatest(0, least(d.t + 4, end_s) - greatest(d.t, start_s))), 0) as a from dr d join sections s on s.track_id = d.track_id group by d.track_id, d.t),
wt as (select track_id, t, greatest(coalesce(a, 0) - coalesce(b, 0), 0) + coalesce(a, 0) as weight from en),
bd as (select track_id, min_by(t, {'w': -round(weight, 9), 't': t}) as t, max(weight) as weight from wt group by track_id)
"""


class Song:
    """Music tables derived from the beat view."""

    def __init__(self, t):
        b = t.beats
        self.beats = b
        self.tracks = b.groupBy("track_id").agg((F.count("*") * 0.5).alias("duration"))
        k = F.floor(F.col("i") / 16)
        means = b.groupBy("track_id", k.alias("k")).agg(F.avg("energy").alias("energy")).join(self.tracks, "track_id")
        label = F.when(F.col("energy") < 0.65, "low").when(F.col("energy") < 0.75, "mid").otherwise("high")
        self.sections = settle(means.select(
            "track_id", (F.col("k") * 8.0).alias("start_s"), F.least(F.col("duration"), (F.col("k") + 1) * 8.0).alias("end_s"), "energy", label.alias("label")
        ))
        self.drops = b.where("energy >= 1").select("track_id", "t")


def curve(t):
    return mu.energy_curve(t.audio.withColumnRenamed("clip_id", "track_id"))


@query("energy_curve", oracle("b_audio", CURVE + "select track_id, i, round(energy, 6) as energy from curve"))
def energy_curve(t):
    return rounded(curve(t).drop("t"))


RUNS = CURVE + """,
q as (select track_id, quantile_cont(energy, 4e-1) as p40, quantile_cont(energy, 1e-1) as p10, max(energy) as hi from curve group by track_id),
l as (select c.*, case when x < 35e-2 then 'low' when x < 7e-1 then 'mid' else 'high' end as label from (select c.*, case when p40 >= 7e-1 and hi - p10 > 1e-9 then least(1e0, greatest(0e0, (energy - p10) / nullif(hi - p10, 0))) else energy end as x from curve c join q on q.track_id = c.track_id) c),
r as (select *, i - row_number() over (partition by track_id, label order by i) as g from l),
rn as (select track_id, label, min(i) * 5e-1 as start_s, (max(i) + 1) * 5e-1 as end_s, avg(energy) as energy from r group by track_id, label, g)
"""
# One section goes at a time: the shortest, the earliest of equal ones, to the side nearer in energy.
JOINED = "{{'s': least({a}.s, {b}.s), 'e': greatest({a}.e, {b}.e), 'g': round(({a}.g * ({a}.e - {a}.s) + {b}.g * ({b}.e - {b}.s)) / ({a}.e - {a}.s + {b}.e - {b}.s), 12), 'lab': {a}.lab}}"
SECTIONS = RUNS + f""",
st as (
  select track_id, list({{'s': start_s, 'e': end_s, 'g': round(energy, 12), 'lab': label}} order by start_s) as l, false as done from rn group by track_id
  union all
  select track_id, case when x is null then l else list_concat(list_concat(l[1:lo - 1], [x]), l[hi + 1:]) end, x is null from (
    select track_id, l, case when a is null then null when r is not null then {JOINED.format(a="a2", b="r")} else a2 end as x, lo, hi + case when r is not null then 1 else 0 end as hi from (
      select *, case when a is not null and hi < len(l) and l[hi + 1].lab = a.lab then l[hi + 1] end as r from (
        select track_id, l, a, case when p then lo - 1 else lo end as lo, hi, case when p then {JOINED.format(a="l[lo - 1]", b="a")} else a end as a2 from (
          select *, a is not null and lo > 1 and l[lo - 1].lab = a.lab as p from (
            select track_id, l, least(ix, tx) as lo, greatest(ix, tx) as hi, case when go then {JOINED.format(a="l[tx]", b="l[ix]")} end as a from (
              select *, case when ix = len(l) then ix - 1 when ix = 1 then 2 when abs(l[ix - 1].g - l[ix].g) <= abs(l[ix + 1].g - l[ix].g) then ix - 1 else ix + 1 end as tx from (
                select track_id, l, ix, len(l) > 1 and l[ix].e - l[ix].s < 4 as go from (
                  select track_id, l, list_position(list_transform(l, lambda z: z.e - z.s), list_min(list_transform(l, lambda z: z.e - z.s))) as ix from st where not done) a1) a2) a3) a4) a5) a6) a7) a8
),
fin as (select track_id, l from st where done),
ex as (select track_id, l, unnest(range(1, len(l) + 1)) as k from fin)
"""


@query("energy_runs", oracle("b_audio", RUNS + "select track_id, label, start_s, end_s, round(energy, 6) as energy from rn"))
def energy_runs(t):
    c = settle(curve(t))
    d = c.groupBy("track_id").agg((F.count("*") * 0.5).alias("duration"))
    return rounded(mu.labelled_runs(c, d).drop("duration"))


@query("music_sections", oracle("b_audio", SECTIONS + "select track_id, case when k = 1 then 0e0 else l[k - 1].e end as start_s, l[k].e as end_s, round(l[k].g, 6) as energy, l[k].lab as label from ex").replace("with ", "with recursive ", 1))
def music_sections(t):
    c = settle(curve(t))
    return rounded(mu.music_sections(c, c.groupBy("track_id").agg((F.count("*") * 0.5).alias("duration"))))


@query("tempo", oracle("b_beats", "select track_id, round(60 / median(gap), 6) as tempo from (select track_id, t - lag(t) over (partition by track_id order by t) as gap, count(*) over (partition by track_id) as n from b_beats) z where gap is not null and n >= 4 group by track_id"))
def tempo(t):
    return rounded(mu.tempo(t.beats))


@query("dominant_period", oracle("b_beats", """
c as (select track_id, i, energy - avg(energy) over (partition by track_id) as x, count(*) over (partition by track_id) as n from b_beats),
ac as (select a.track_id, lag, min(a.n) as n, sum(a.x * b.x) / (min(a.n) - lag) as acf from c a cross join range(1, 31) r(lag) join c b on b.track_id = a.track_id and b.i = a.i + lag where lag < a.n group by a.track_id, lag),
sc as (select a.track_id, a.lag, a.n, a.acf, greatest(a.acf, 0) + coalesce((select 5e-1 * max(greatest(b.acf, 0)) from ac b where b.track_id = a.track_id and abs(b.lag - 2 * a.lag) <= 1 and 2 * a.lag < a.n), 0)
  + coalesce((select 33e-2 * max(greatest(b.acf, 0)) from ac b where b.track_id = a.track_id and abs(b.lag - 3 * a.lag) <= 1 and 3 * a.lag < a.n), 0) as s from ac a where lag between 3 and 10),
pr as (select *, s * exp(-5e-1 * pow(log2(60 / (lag * 1e-1) / 120), 2)) as v from sc where n >= 8),
be as (select track_id, min_by(lag, {'v': -round(v, 12), 'g': lag}) as lag, max(v) as v from pr group by track_id),
nb as (select be.track_id, be.lag, v, (select acf from ac where ac.track_id = be.track_id and ac.lag = be.lag - 1) as a, (select acf from ac where ac.track_id = be.track_id and ac.lag = be.lag) as b, (select acf from ac where ac.track_id = be.track_id and ac.lag = be.lag + 1) as c from be)
select t.track_id, round(coalesce(case when v <= 0 then 0 when c is not null and a - 2 * b + c < 0 and abs(5e-1 * (a - c) / (a - 2 * b + c)) <= 1 then lag + 5e-1 * (a - c) / (a - 2 * b + c) else lag end, 0), 6) as period from (select distinct track_id from b_beats) t left join nb on nb.track_id = t.track_id
"""))
def dominant_period(t):
    return rounded(mu.dominant_period(t.beats.select("track_id", "i", "energy"), 0.1))


BARS = """
nb as (select *, row_number() over (partition by track_id order by t) - 1 as j, count(*) over (partition by track_id) as n from b_beats),
mp as (select track_id, j % 4 as ph, avg(energy) as m from nb where n >= 8 group by track_id, j % 4),
bp as (select track_id, min_by(ph, {'m': -round(m, 12), 'p': ph}) as ph from mp group by track_id),
bars as (select nb.track_id, t from nb join bp on bp.track_id = nb.track_id and bp.ph = j % 4),
bn as (select *, row_number() over (partition by track_id order by t) - 1 as j, count(*) over (partition by track_id) as n from bars),
phr as (select track_id, t from bn where n >= 4 and j % case when n >= 16 then 8 else 4 end = 0)
"""


@query("downbeats", oracle("b_beats", BARS + "select track_id, round(t, 6) as t from bars"))
def downbeats(t):
    return rounded(mu.downbeats(t.beats))


@query("phrases", oracle("b_beats", BARS + "select track_id, round(t, 6) as t from phr"))
def phrases(t):
    return rounded(mu.phrases(mu.downbeats(t.beats)))


DROPS = """
cu as (select clip_id as track_id, i, case when i % 90 < 45 then rms / 10 else 7e-1 + rms end as energy from (select *, row_number() over (partition by clip_id order by t) - 1 as i from b_audio) z),
ca as (select *, energy - min(energy) over (partition by track_id order by i rows between 4 preceding and 1 preceding) as rise, count(*) over f as an, min(energy) over f as am, count(*) over b as bn, avg(energy) over b as ba from cu
  window f as (partition by track_id order by i rows between 1 following and 8 following), b as (partition by track_id order by i rows between 8 preceding and 1 preceding)),
cd as (select track_id, (i + 5e-1) * 5e-1 as t, rise from ca where round(rise, 12) >= 3e-1 and an >= 4 and am >= 65e-2 and bn >= 4 and round(ba, 12) <= 55e-2),
gr as (select *, sum(o) over (partition by track_id order by t rows between unbounded preceding and current row) as g from (select *, case when t - lag(t) over (partition by track_id order by t) < 8 then 0 else 1 end as o from cd) z),
dp as (select track_id, min(t) as t from (select *, max(rise) over (partition by track_id, g) as m from gr) z where rise >= 95e-2 * m group by track_id, g)
"""


def _jumpy(t):
    from cutlake.functions.ordered import row_index, scan
    from cutlake.operators.footage import by_time

    a = scan(t.audio.select("clip_id", "t", "rms"), ["clip_id"], ["t"], by_time(), i=row_index())
    i = F.col("i") - 1
    return a.select(F.col("clip_id").alias("track_id"), i.alias("i"), F.when(i % 90 < 45, F.col("rms") / 10).otherwise(0.7 + F.col("rms")).alias("energy"))


@query("drops", oracle("b_audio", DROPS + "select track_id, t from dp"))
def drops(t):
    return mu.drops(_jumpy(t))


@query("snapped_drops", oracle("b_beats", SONG + "," + BARS + """,
gp as (select track_id, median(gap) as beat from (select track_id, t - lag(t) over (partition by track_id order by t) as gap from b_beats) z group by track_id),
ne as (select d.track_id, d.t, min_by(b.t, {'d': abs(b.t - d.t), 't': b.t}) as near from dr d join bars b on b.track_id = d.track_id group by d.track_id, d.t)
select d.track_id, round(case when abs(near - d.t) <= beat then near else d.t end, 6) as t from dr d left join ne on ne.track_id = d.track_id and ne.t = d.t left join gp on gp.track_id = d.track_id
"""))
def snapped_drops(t):
    return rounded(mu.snap_drops(Song(t).drops, mu.downbeats(t.beats), t.beats))


@query("snapped_points", oracle("b_beats", BARS + """,
pt as (select track_id, i as row_id, t + 7e-1 as t from b_beats),
n1 as (select p.track_id, row_id, min_by(g.t, {'d': round(abs(g.t - p.t), 9), 't': g.t}) as v, min(abs(g.t - p.t)) as d from pt p join phr g on g.track_id = p.track_id group by p.track_id, row_id),
n2 as (select p.track_id, row_id, min_by(g.t, {'d': round(abs(g.t - p.t), 9), 't': g.t}) as v, min(abs(g.t - p.t)) as d from pt p join bars g on g.track_id = p.track_id group by p.track_id, row_id)
select p.track_id, p.row_id, round(case when n1.d <= 45e-2 then n1.v when n2.d <= 45e-2 then n2.v else p.t end, 6) as snapped, case when n1.d <= 45e-2 then 0 when n2.d <= 45e-2 then 1 else -1 end as grid
from pt p left join n1 on n1.track_id = p.track_id and n1.row_id = p.row_id left join n2 on n2.track_id = p.track_id and n2.row_id = p.row_id
"""))
def snapped_points(t):
    bars = settle(mu.downbeats(t.beats))
    points = t.beats.select("track_id", F.col("i").alias("row_id"), (F.col("t") + 0.7).alias("t"))
    return rounded(mu.snap(points, [mu.phrases(bars), bars], 0.45).select("track_id", "row_id", "snapped", "grid"))


@query("drop_weights", oracle("b_beats", SONG + "select track_id, round(t, 6) as t, round(weight, 6) as weight from wt"))
def drop_weights(t):
    s = Song(t)
    return rounded(mu.drop_weights(s.drops, s.sections))


@query("best_drops", oracle("b_beats", SONG + "select track_id, round(t, 6) as t, round(weight, 6) as weight from bd"))
def best_drops(t):
    s = Song(t)
    return rounded(mu.best_drop(mu.drop_weights(s.drops, s.sections)))


@query("secondary_drops", oracle("b_beats", SONG + """,
po as (select w.track_id, w.t, w.weight from wt w join bd on bd.track_id = w.track_id where bd.weight > 1e-6 and abs(w.t - bd.t) >= 4 - 1e-6 and w.weight >= 5e-1 * bd.weight - 1e-6),
f1 as (select track_id, min_by(t, {'w': -round(weight, 9), 't': t}) as t, max(weight) as weight from po group by track_id),
p2 as (select po.* from po join f1 on f1.track_id = po.track_id where abs(po.t - f1.t) >= 4 - 1e-6),
f2 as (select track_id, min_by(t, {'w': -round(weight, 9), 't': t}) as t, max(weight) as weight from p2 group by track_id)
select track_id, round(t, 6) as t, round(weight, 6) as weight, cast(1 as bigint) as rank from f1 union all select track_id, round(t, 6), round(weight, 6), 2 from f2
"""))
def secondary_drops(t):
    s = Song(t)
    w = settle(mu.drop_weights(s.drops, s.sections))
    beat = s.tracks.select("track_id", F.lit(0.5).alias("beat"))
    return rounded(mu.secondary_drops(w, mu.best_drop(w), beat))


PROFILE = SONG + """,
lw as (select track_id, i, energy / 2 as low, max(i) over (partition by track_id) as mi from b_beats),
wn as (select track_id, duration, {lo} as lo, {hi} as hi from tracks),
sm as (select w.track_id, 'w' as part, lo + i * 5e-1 as t from (select *, unnest(range(cast(greatest(1, floor(greatest(hi - lo, 1e-6) / 5e-1)) as bigint))) as i from wn) w union all select w.track_id, 'b', {bf} + i * 5e-1 from (select *, unnest(range(cast({bn} as bigint))) as i from wn) w),
se as (select sm.*, coalesce((select max(energy) from sections s where s.track_id = sm.track_id and start_s - 1e-6 <= sm.t and sm.t < end_s - 1e-6), case when sm.t >= (select max(end_s) from sections s where s.track_id = sm.track_id) - 1e-6 then (select max_by(energy, end_s) from sections s where s.track_id = sm.track_id) end, 0) as e from sm),
ag as (select track_id, avg(e) filter (where part = 'w') as ie, median(e) filter (where part = 'b') as be from se group by track_id),
ft as (select w.track_id, lo, hi, case when ie > 1e-6 then least(4, ie / greatest(coalesce(be, ie), 1e-6)) else 0 end as rel_energy, (select count(*) from b_beats b where b.track_id = w.track_id and b.t >= lo and b.t < hi) / greatest(hi - lo, 1e-6) as onset_density,
  coalesce((select avg(low) from lw where lw.track_id = w.track_id and i >= floor(lo / 5e-1) and i < greatest(floor(lo / 5e-1) + 1, round_even(hi / 5e-1, 0))), (select max(low) from lw where lw.track_id = w.track_id and i = mi)) as low_presence from wn w join ag on ag.track_id = w.track_id),
hd as (select *, 4e-1 * greatest(0, least(1, (rel_energy - 4e-1) / 6e-1)) + 3e-1 * greatest(0, least(1, (onset_density - 5e-1) / 2)) + 3e-1 * greatest(0, least(1, (low_presence - 1e-1) / 3e-1)) as hardness from ft)
select track_id, case when hardness <= 35e-2 then 'ambient' when hardness >= 65e-2 then 'hard' else 'moderate' end as label, round(hardness, 6) as hardness, round(rel_energy, 6) as rel_energy, round(onset_density, 6) as onset_density, round(low_presence, 6) as low_presence,
  round(hi - lo, 6) as window_s, round({edge}, 6) as "{name}" from hd
"""


@query("intro_profile", oracle("b_beats", PROFILE.replace("{lo}", "least(3e0, duration)").replace("{hi}", "least(least(3e0, duration) + 12, duration)").replace("{bf}", "hi").replace("{bn}", "floor(greatest(0, duration - hi) / 5e-1)").replace("{edge}", "lo").replace("{name}", "start")))
def intro_profile(t):
    s = Song(t)
    low = t.beats.select("track_id", "i", (F.col("energy") / 2).alias("low"))
    return rounded(mu.intro_profile(s.tracks.withColumn("from_s", F.lit(3.0)), s.sections, s.beats, low, start="from_s"))


@query("outro_profile", oracle("b_beats", PROFILE.replace("{lo}", "greatest(0, duration - 12)").replace("{hi}", "duration").replace("{bf}", "0").replace("{bn}", "floor(lo / 5e-1)").replace("{edge}", "hi").replace("{name}", "end")))
def outro_profile(t):
    s = Song(t)
    low = t.beats.select("track_id", "i", (F.col("energy") / 2).alias("low"))
    return rounded(mu.outro_profile(s.tracks, s.sections, s.beats, low))


@query("section_lookup", oracle("b_beats", SONG + """,
pt as (select track_id, i, t * 11e-1 as t from b_beats),
ls as (select track_id, max(end_s) as e, max_by(label, end_s) as label, max_by(energy, end_s) as energy, max_by(start_s, end_s) as s from sections group by track_id)
select p.track_id, p.i, coalesce(s.label, case when p.t >= l.e - 1e-6 then l.label end, 'mid') as label, round(coalesce(s.energy, case when p.t >= l.e - 1e-6 then l.energy end, 5e-1), 6) as energy, coalesce(s.start_s, case when p.t >= l.e - 1e-6 then l.s end) as section_start
from pt p left join sections s on s.track_id = p.track_id and start_s - 1e-6 <= p.t and p.t < end_s - 1e-6 left join ls l on l.track_id = p.track_id
"""))
def section_lookup(t):
    points = t.beats.select("track_id", "i", (F.col("t") * 1.1).alias("t"))
    out = mu.section_at(points, Song(t).sections, "t", ["i"])
    return rounded(out.select("track_id", "i", "label", "energy", "section_start"))


@query("best_window", oracle("b_beats", SONG + """,
ok as (select track_id, duration, duration - 10 as mx from tracks where 10 < duration - 1e-6),
ld as (select o.track_id, least(greatest(t - 15e-1, 0), mx) as start_s from ok o join bd on bd.track_id = o.track_id),
cn as (select distinct o.track_id, mx, c from ok o join (select track_id, start_s as c from sections union all select track_id, end_s - 10 from sections union all select track_id, 0 from ok union all select track_id, mx from ok) z on z.track_id = o.track_id where o.track_id not in (select track_id from bd) and c >= -1e-6 and c <= mx + 1e-6),
ws as (select cn.track_id, least(greatest(c, 0), mx) as c, sum(greatest(0, least(c + 10, end_s) - greatest(c, start_s)) * energy) / 10 as e from cn join sections s on s.track_id = cn.track_id group by cn.track_id, least(greatest(c, 0), mx), c, mx),
be as (select track_id, min_by(c, {'e': -round(e, 6), 'c': c}) as start_s from ws group by track_id)
select t.track_id, round(coalesce(ld.start_s, be.start_s, 0), 6) as start_s from tracks t left join ld on ld.track_id = t.track_id left join be on be.track_id = t.track_id
"""))
def best_window(t):
    s = Song(t)
    return rounded(mu.best_window(s.tracks, s.sections, mu.drop_weights(s.drops, s.sections), 10.0))


@query("cropped_beats", oracle("b_beats", SONG + "select b.track_id, b.i, round(b.t - duration / 4, 6) as t from b_beats b join tracks k on k.track_id = b.track_id where b.t >= duration / 4 - 1e-6 and b.t <= duration / 4 + duration / 2 + 1e-6"))
def cropped_beats(t):
    return rounded(mu.crop_marks(t.beats.drop("energy"), _windows(t)))


def _windows(t):
    return Song(t).tracks.select("track_id", (F.col("duration") / 4).alias("start_s"), (F.col("duration") / 2).alias("length"))


@query("cropped_sections", oracle("b_beats", SONG + """,
c as (select s.track_id, greatest(start_s, duration / 4) - duration / 4 as a, least(end_s, duration * 75e-2) - duration / 4 as b, energy, label, duration / 2 as l from sections s join tracks k on k.track_id = s.track_id where least(end_s, duration * 75e-2) - greatest(start_s, duration / 4) > 1e-6)
select track_id, round(coalesce(lag(b) over (partition by track_id order by a), 0), 6) as start_s, round(case when lead(a) over (partition by track_id order by a) is null then l else b end, 6) as end_s, round(energy, 6) as energy, label from c
"""))
def cropped_sections(t):
    return rounded(mu.crop_sections(Song(t).sections, _windows(t)))


@query("energy_lane", oracle("b_beats", SONG + """,
g as (select track_id, i, i / 2e0 as t from (select *, unnest(range(cast(floor(duration * 2) as bigint) + 1)) as i from tracks) z),
e as (select g.track_id, i, coalesce((select max(energy) from sections s where s.track_id = g.track_id and start_s - 1e-6 <= g.t and g.t < end_s - 1e-6), (select max_by(energy, end_s) from sections s where s.track_id = g.track_id)) as e from g)
select track_id, i, round_even(round(avg(e) over (partition by track_id order by i rows between 1 preceding and 1 following), 10), 3) as lane from e
"""))
def energy_lane(t):
    s = Song(t)
    return mu.energy_lane(s.sections, s.tracks)


@query("song_ranking", oracle("b_beats b_moments", SONG + """,
pl as (select mid % 3 as project, 3e1 + mid % 3 * 1e1 as unique_s, least(avg(mid % 17 / 2e0) / 8 * (1 + mid % 3), 1) as motion from b_moments group by mid % 3),
gp as (select track_id, t - lag(t) over (partition by track_id order by t) as gap from b_beats),
gs as (select track_id, count(*) as beats, avg(gap) as gm, stddev_pop(gap) as gd, case when count(*) >= 4 then 60 / median(gap) else 0 end as bpm from gp group by track_id),
lb as (select track_id, count(distinct label) as nl, bool_or(label = 'low') and bool_or(label = 'high') as story from sections group by track_id),
fd as (select track_id, min(t) as fd from dr group by track_id),
x as (select k.track_id, k.track_id % 3 as project, duration, bpm, beats, gm, gd, nl, story, fd, unique_s, motion, 90 + 60 * motion as want from tracks k join gs on gs.track_id = k.track_id join lb on lb.track_id = k.track_id left join fd on fd.track_id = k.track_id join pl on pl.project = k.track_id % 3),
y as (select *, bpm * pow(2, greatest(0, ceil(log2(want / 15e-1 / bpm))) - greatest(0, ceil(log2(bpm / (want * 15e-1))))) as fold from x),
z as (select track_id, project, want, concat_ws(' ', case when bpm <= 0 or beats < 8 then 'no_beat' when gm <= 1e-6 then 'no_grid' when greatest(0, 1 - gd / gm / 1e-1) >= 8e-1 then 'steady' when greatest(0, 1 - gd / gm / 1e-1) > 3e-1 then 'loose' else 'irregular' end,
  case when duration <= unique_s + 1e-6 then 'fits_pool' else 'longer_than_pool' end, case when bpm <= 0 then 'no_tempo' when motion > 6e-1 then 'fast_pool' when motion < 3e-1 then 'calm_pool' else 'medium_pool' end,
  case when fd is not null then 'drop' else 'no_drop' end, case when story then 'quiet_and_loud' when nl > 1 then 'some_change' else 'flat' end) as reasons, case when bpm > 0 and beats >= 8 and gm > 1e-6 then greatest(0, 1 - gd / gm / 1e-1) else 0 end as clarity_part, case when duration <= unique_s + 1e-6 then 1 else greatest(0, 1 - 5e-1 * (duration / unique_s - 1)) end as length_part,
  case when bpm > 0 then exp(-5e-1 * pow((fold - want) / 25, 2)) else 0 end as tempo_part, case when fd is not null then 1e0 else 0e0 end as drop_part, case when story then 1e0 when nl > 1 then 6e-1 else 2e-1 end as arc_part from y)
select project, track_id, round(want, 6) as ideal_bpm, reasons, round(clarity_part, 6) as clarity_part, round(length_part, 6) as length_part, round(tempo_part, 6) as tempo_part, drop_part, cast(arc_part as double) as arc_part, round(3e-1 * clarity_part + 3e-1 * length_part + 2e-1 * tempo_part + 1e-1 * drop_part + 1e-1 * arc_part, 6) as score from z
"""))
def song_ranking(t):
    s = Song(t)
    project = F.col("mid") % 3
    pool = t.moments.groupBy(project.alias("project")).agg(F.avg(F.col("mid") % 17 / 2.0).alias("m"))
    pool = pool.select("project", (30.0 + F.col("project") * 10).alias("unique_s"), F.least(F.col("m") / 8 * (1 + F.col("project")), F.lit(1.0)).alias("motion"))
    songs = mu.song_facts(s.tracks, s.beats, s.sections, s.drops).withColumn("project", F.col("track_id") % 3)
    return rounded(mu.rank_songs(songs, pool).withColumn("reasons", F.array_join("reasons", " ")))
