"""Search, take matching, scene and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.staging import settle
from cutlake.functions.text import normalize
from cutlake.operators import takes as tk
from cutlake.plans.q_timeline import rounded
from cutlake.plans.registry import query
from cutlake.plans.views import oracle

SHOTS = """
shots as (select concat('doc:', cast(mid as varchar)) as shot_id, concat('doc_', cast(mid as varchar)) as clip_path, start_s, start_s + 1 as end_s, label, tag, grp, hero, false as spoken from b_annotations),
sp as (select concat('line:', cast(take_id as varchar), ':', cast(seg as varchar)) as shot_id, cast(take_id as varchar) as clip_path, start_s, end_s, trim(text) as label, '' as tag, '' as grp, 0e0 as hero, true as spoken from b_segments where trim(text) <> ''),
al as (select * from shots union all select * from sp),
wd as (select distinct shot_id, unnest(regexp_extract_all(lower(concat(label, ' ', tag, ' ', grp)), '[\\p{L}\\p{N}]+')) as word from al),
qt as (select item_id as query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ts from benchmark),
tk as (select query_id, len(ts) as n, unnest(ts) as token, unnest(range(len(ts))) as pos from qt),
vc as (select distinct word from wd), tt as (select distinct token from tk),
pr as (select token, word from tt join vc on token = word or (length(token) >= 3 and starts_with(word, token)) or (length(word) >= 3 and starts_with(token, word))),
ht as (select query_id, shot_id, n, count(distinct pos) as h from tk join pr on pr.token = tk.token join wd on wd.word = pr.word group by query_id, shot_id, n),
rl as (select ht.query_id, al.*, least(1, h / n + 2e-1 * hero) as relevance from ht join al using (shot_id)),
rk as (select *, row_number() over (partition by query_id order by round(relevance, 9) desc, hero desc, clip_path, start_s, shot_id) as rank from rl)
"""


def annotated(t):
    a = t.annotations
    return a.select(
        F.concat(F.lit("doc:"), "mid").alias("shot_id"), F.concat(F.lit("doc_"), "mid").alias("clip_path"), "start_s", (F.col("start_s") + 1).alias("end_s"), "label",
        F.array("tag").alias("tags"), "grp", F.lit("").alias("role"), "hero",
    )


@query("shot_search", oracle("b_annotations b_segments", SHOTS + "select query_id, rank, shot_id, clip_path, round(start_s, 6) as start_s, round(end_s, 6) as end_s, label, spoken, round(relevance, 6) as relevance from rk where rank <= 20"))
def shot_search(t):
    shots = tk.searchable(annotated(t), tk.spoken_shots(t.segments))
    queries = t.read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rounded(tk.search(shots, queries).select("query_id", "rank", "shot_id", "clip_path", "start_s", "end_s", "label", "spoken", "relevance"))


@query("hero_shots", oracle("b_annotations", "select concat('doc_', cast(mid as varchar)) as clip_path, start_s, hero from b_annotations where hero >= 5e-1 order by hero desc, clip_path, start_s limit 20"))
def hero_shots(t):
    return tk.top_heroes(annotated(t).select("clip_path", "start_s", "hero"))


@query("spoken_shots", oracle("b_segments", "select cast(take_id as varchar) as clip_path, round(start_s, 6) as start_s, round(end_s, 6) as end_s, trim(text) as label, true as spoken from b_segments where trim(text) <> ''"))
def spoken_shots(t):
    return rounded(tk.spoken_shots(t.segments).select("clip_path", "start_s", "end_s", "label", "spoken"))


NORM = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w not in ('uh', 'um', 'äh', 'ähm', 'eh', 'hm') and w <> ''), ' ')"


@query("normalised_text", oracle("", "select doc_id, " + NORM.format(c="text") + " as norm from documents"))
def normalised_text(t):
    return t.read("documents").select("doc_id", normalize("text").alias("norm"))


# Every conversation is a scene; its turns are the script, and four takes say them more or less well. Every seventh line
# is said in no take; in every second scene take 2 breaks each line off and starts it again. The SQL engine's edit distance
# counts bytes, so its side writes each accented letter as a capital, which no normalised line has.
ACCENTS = ("éçèêëüßäöóíñúîïáàâôûùæœ", "ABCDEFGHIJKLMNOPQRSTUVW")
PLAIN = f"translate({NORM.format(c='text')}, '{ACCENTS[0]}', '{ACCENTS[1]}')"
TAKES = f"""
ln as (select conv_id as scene_id, turn as line_no, text, count(*) over (partition by conv_id) as n from conversations),
sd as (select scene_id, line_no, n, case when (scene_id + line_no) % 7 = 6 then 'xylo xylo' else text end as text from ln),
sg as (select scene_id * 10 as take_id, scene_id, line_no as i, text from sd union all select scene_id * 10 + 1, scene_id, line_no, replace(text, 'e', '') from sd
  union all select scene_id * 10 + 2, scene_id, line_no * 2, concat(substring(text, 1, length(text) // 2), case when scene_id % 2 = 0 then '--' else '' end) from sd
  union all select scene_id * 10 + 2, scene_id, line_no * 2 + 1, case when scene_id % 2 = 0 then text else substring(text, length(text) // 2 + 1) end from sd
  union all select scene_id * 10 + 3, scene_id, n - 1 - line_no, text from sd),
ns as (select *, {PLAIN} as norm, i * 5e0 as start_s, i * 5e0 + 4 as end_s from sg),
wn as (select a.take_id, a.scene_id, a.i, w as width, trim(regexp_replace(string_agg(b.norm, ' ' order by b.i), ' +', ' ', 'g')) as norm, min(b.start_s) as start_s, max(b.end_s) as end_s
  from ns a cross join range(1, 7) r(w) join ns b on b.take_id = a.take_id and b.i >= a.i and b.i < a.i + w group by a.take_id, a.scene_id, a.i, w having count(*) = w),
nl as (select scene_id, line_no, {PLAIN} as line from ln),
cd as (select w.scene_id, take_id, line_no, i, width, start_s, end_s, line, norm from wn w join nl on nl.scene_id = w.scene_id where length(line) > 0 and length(norm) > 0
  and least(length(line), length(norm)) / greatest(length(line), length(norm)) >= case when width = 1 then 3e-1 else 55e-2 end - 1e-12),
ps as (select scene_id, take_id, line_no, i, width, start_s, end_s, 1 - levenshtein(line, norm) / greatest(length(line), length(norm)) as sim from cd),
pp as (select * from ps where sim >= case when width = 1 then 3e-1 else 55e-2 end)
"""
MATCHED = TAKES + """,
pl as (select scene_id, take_id, line_no, list({'d': -sim, 'i': i, 'w': width} order by -sim, i, width) as ws from pp where sim >= 55e-2 group by scene_id, take_id, line_no),
wl as (select scene_id, take_id, list({'ln': line_no, 'ws': ws} order by line_no) as l from pl group by scene_id, take_id),
fo as (select scene_id, take_id, list_reduce(list_transform(l, lambda x: {'cur': cast(0 as bigint), 'row': [x], 'out': cast([] as struct(ln bigint, i bigint, w bigint, f bigint)[])}), lambda s, y:
  case when len(list_filter(y.row[1].ws, lambda q: q.i >= s.cur)) > 0 then {'cur': list_filter(y.row[1].ws, lambda q: q.i >= s.cur)[1].i, 'row': s.row,
    'out': list_append(s.out, {'ln': y.row[1].ln, 'i': list_filter(y.row[1].ws, lambda q: q.i >= s.cur)[1].i, 'w': list_filter(y.row[1].ws, lambda q: q.i >= s.cur)[1].w, 'f': s.cur})} else s end,
  {'cur': cast(0 as bigint), 'row': [l[1]], 'out': cast([] as struct(ln bigint, i bigint, w bigint, f bigint)[])}).out as o from wl),
mt as (select z.scene_id, z.take_id, m.ln as line_no, m.i, m.w as width, m.f as from_i, sim, start_s, end_s from (select scene_id, take_id, unnest(o) as m from fo) z join pp p on p.scene_id = z.scene_id and p.take_id = z.take_id and p.line_no = m.ln and p.i = m.i and p.width = m.w)
"""
SCORED = MATCHED + """,
nx as (select scene_id, take_id, i, rtrim(text) as raw, string_split(norm, ' ') as a, string_split(lead(norm) over (partition by take_id order by i), ' ') as b from ns),
hd as (select scene_id, take_id, i, array_to_string(a[1:3], ' ') as a, array_to_string(b[1:3], ' ') as b from nx where (ends_with(raw, '--') or ends_with(raw, '...')) and len(a) >= 3 and len(b) >= 3),
fl as (select scene_id, take_id, i from hd where 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 8e-1
  union select distinct p.scene_id, p.take_id, p.i from pp p join mt m on m.scene_id = p.scene_id and m.take_id = p.take_id and m.line_no = p.line_no where p.width = 1 and p.sim < 55e-2 and p.i >= m.from_i and p.i < m.i and p.sim < m.sim),
rt as (select distinct scene_id, take_id from ns),
sz as (select scene_id, count(*) as n from ln group by scene_id),
sc as (select r.scene_id, r.take_id, coalesce(c, 0) / n as coverage, coalesce(a, 0) as accuracy, coalesce(f, 0) as fluffs, coalesce(d, 0) as duration from rt r join sz on sz.scene_id = r.scene_id
  left join (select scene_id, take_id, count(*) as c, avg(sim) as a, sum(end_s - start_s) as d from mt group by scene_id, take_id) m on m.scene_id = r.scene_id and m.take_id = r.take_id
  left join (select scene_id, take_id, count(*) as f from fl group by scene_id, take_id) f on f.scene_id = r.scene_id and f.take_id = r.take_id),
st as (select *, 6e-1 * coverage + 3e-1 * accuracy - 2e-2 * least(fluffs, 10) as total from sc),
sr as (select *, row_number() over (partition by scene_id order by round(total, 9) desc, take_id) as rank from st)
"""


class Script:
    """Lines, take segments and routes of the conversation scenes, and the matching built on them."""

    def __init__(self, t):
        c = t.read("conversations").select(F.col("conv_id").alias("scene_id"), F.col("turn").alias("line_no"), "text")
        self.lines = c
        n = c.groupBy("scene_id").agg(F.count("*").alias("n"))
        line, base, again = F.col("line_no"), F.col("scene_id") * 10, F.col("scene_id") % 2 == 0
        said = F.when((F.col("scene_id") + line) % 7 == 6, "xylo xylo").otherwise(F.col("text"))
        half = F.floor(F.length(said) / 2).cast("int")
        take = lambda k, i, text: F.struct((base + k).alias("take_id"), i.cast("bigint").alias("i"), text.alias("text"))
        rows = F.array(
            take(0, line, said), take(1, line, F.replace(said, F.lit("e"), F.lit(""))),
            take(2, line * 2, F.concat(F.substring(said, F.lit(1), half), F.when(again, "--").otherwise(""))),
            take(2, line * 2 + 1, F.when(again, said).otherwise(F.substring(said, half + 1, F.length(said)))), take(3, F.col("n") - 1 - line, said),
        )
        s = c.join(n, "scene_id").select("scene_id", F.explode(rows).alias("s")).select("scene_id", "s.*")
        self.segments = settle(s.withColumns({"start_s": F.col("i") * 5.0, "end_s": F.col("i") * 5.0 + 4}))
        self.routes = self.segments.select("scene_id", "take_id").distinct()
        self.pairs = settle(tk.line_windows(self.lines, self.segments.drop("scene_id"), self.routes, texts=False))

    def matches(self):
        return settle(tk.match_lines(self.pairs))

    def scored(self):
        m = self.matches()
        flagged = tk.fluffs(self.pairs, m, self.segments, self.routes)
        return m, flagged, settle(tk.take_scores(m, flagged, self.lines, self.routes))


@query("line_windows", oracle("", TAKES + "select scene_id, take_id, line_no, i, width, round(sim, 6) as similarity from pp"))
def line_windows(t):
    return rounded(Script(t).pairs.select("scene_id", "take_id", "line_no", "i", F.col("width").cast("bigint").alias("width"), "similarity"))


@query("matched_lines", oracle("", MATCHED + "select scene_id, take_id, line_no, i, width, from_i, round(sim, 6) as similarity from mt"))
def matched_lines(t):
    return rounded(Script(t).matches().select("scene_id", "take_id", "line_no", "i", F.col("width").cast("bigint").alias("width"), "from_i", "similarity"))


@query("fluffs", oracle("", SCORED + "select scene_id, take_id, i from fl"))
def fluffs(t):
    return Script(t).scored()[1]


@query("take_scores", oracle("", SCORED + "select scene_id, take_id, round(coverage, 6) as coverage, round(accuracy, 6) as accuracy, fluffs, round(duration, 6) as duration, round(total, 6) as total, rank from sr"))
def take_scores(t):
    return rounded(Script(t).scored()[2])


ROUTES = """
sn as (select conv_id % 10 as script_id, conv_id as scene_no, case when conv_id % 3 = 0 then concat('0', cast(conv_id as varchar), 'A') else cast(conv_id as varchar) end as number from (select distinct conv_id from conversations) z),
tz as (select conv_id % 10 as script_id, conv_id * 10 as take_id, case when conv_id % 7 = 0 then '' when conv_id % 3 = 0 then concat(cast(conv_id as varchar), 'a') else concat('00', cast(conv_id as varchar)) end as hint from (select distinct conv_id from conversations) z),
nk as (select script_id, scene_no, case when ltrim(lower(number), '0') <> '' then ltrim(lower(number), '0') else '0' end as k from sn),
tj as (select script_id, take_id, case when hint = '' then '' when ltrim(lower(hint), '0') <> '' then ltrim(lower(hint), '0') else '0' end as k from tz)
select n.script_id, n.scene_no, t.take_id from nk n join tj t on t.script_id = n.script_id and (t.k = '' or t.k = n.k)
"""


@query("take_routing", oracle("", ROUTES))
def take_routing(t):
    c = t.read("conversations").select("conv_id").distinct()
    i, text = F.col("conv_id"), F.col("conv_id").cast("string")
    scenes = c.select((i % 10).alias("script_id"), i.alias("scene_no"), F.when(i % 3 == 0, F.concat(F.lit("0"), text, F.lit("A"))).otherwise(text).alias("number"))
    hint = F.when(i % 7 == 0, "").when(i % 3 == 0, F.concat(text, F.lit("a"))).otherwise(F.concat(F.lit("00"), text))
    return tk.candidate_takes(scenes, c.select((i % 10).alias("script_id"), (i * 10).alias("take_id"), hint.alias("scene_hint")))


CHOSEN = SCORED + """,
fc as (select sr.*, case when take_id = scene_id * 10 + 3 and scene_id % 4 = 0 then 0 else rank end as o from sr),
m1 as (select m.*, o from mt m join fc on fc.scene_id = m.scene_id and fc.take_id = m.take_id),
c1 as (select *, cast(1 as bigint) as take_order from m1 x where o = (select min(o) from m1 y where y.scene_id = x.scene_id)),
m2 as (select * from m1 x where not exists (select 1 from c1 where c1.scene_id = x.scene_id and c1.line_no = x.line_no)),
c2 as (select *, cast(2 as bigint) as take_order from m2 x where o = (select min(o) from m2 y where y.scene_id = x.scene_id)),
ch as (select * from c1 union all select * from c2)
"""


def chosen(t):
    s = Script(t)
    m, _, scores = s.scored()
    forced = s.routes.where((F.col("take_id") == F.col("scene_id") * 10 + 3) & (F.col("scene_id") % 4 == 0))
    return s, tk.choose_lines(m, scores, 2, forced)


@query("chosen_lines", oracle("", CHOSEN + "select scene_id, line_no, take_id, take_order, round(start_s, 6) as start_s, round(end_s, 6) as end_s from ch"))
def chosen_lines(t):
    return rounded(chosen(t)[1].select("scene_id", "line_no", "take_id", "take_order", "start_s", "end_s"))


@query("missing_lines", oracle("", CHOSEN + "select scene_id, line_no from ln where not exists (select 1 from ch where ch.scene_id = ln.scene_id and ch.line_no = ln.line_no)"))
def missing_lines(t):
    s, c = chosen(t)
    return tk.unmatched_lines(s.lines, c)


@query("select_segments", oracle("", CHOSEN + """,
sl as (select scene_id, list({'ln': line_no, 't': take_id, 's': start_s, 'e': end_s} order by line_no) as l from ch group by scene_id),
sf as (select scene_id, list_reduce(list_transform(l, lambda x: [{'t': x.t, 's': x.s, 'e': x.e, 'n': 1}]), lambda acc, y:
  case when acc[len(acc)].t = y[1].t and y[1].s >= acc[len(acc)].s and y[1].s - acc[len(acc)].e < 15e-1 then list_append(acc[1:len(acc) - 1], {'t': acc[len(acc)].t, 's': acc[len(acc)].s, 'e': greatest(acc[len(acc)].e, y[1].e), 'n': acc[len(acc)].n + 1}) else list_concat(acc, y) end) as g from sl)
select scene_id, p as segment_no, cast(g[p].t as varchar) as take_id, round(g[p].s, 6) as start_s, round(g[p].e, 6) as end_s, cast(g[p].n as bigint) as lines from (select scene_id, g, unnest(range(1, len(g) + 1)) as p from sf) z
"""))
def select_segments(t):
    s, c = chosen(t)
    seg = tk.select_segments(tk.window_texts(c, s.segments))
    return rounded(seg.select("scene_id", "segment_no", "take_id", "start_s", "end_s", F.size("lines").cast("bigint").alias("lines")))


@query("assembly_coverage", oracle("", CHOSEN + "select ln.scene_id, round(count(ch.line_no) / count(*), 6) as coverage from ln left join ch on ch.scene_id = ln.scene_id and ch.line_no = ln.line_no group by ln.scene_id"))
def assembly_coverage(t):
    s, c = chosen(t)
    return rounded(tk.assembly_coverage(c, s.lines, "scene_id"))


LISTS = {"o": tk.OUTDOOR, "i": tk.INDOOR, "n": tk.NIGHT, "d": tk.DAY}
FIXED = " union all ".join(f"select '{n}' as list, unnest([{', '.join(repr(w) for w in ws)}]) as token" for n, ws in LISTS.items())
SCENE = f"""
mo as (select tag as folder, label, grp from b_annotations),
vc as (select distinct folder, unnest(regexp_extract_all(lower(concat(label, ' ', grp)), '[\\p{{L}}\\p{{N}}]+')) as word from mo),
fx as ({FIXED}),
vt as (select folder, count(distinct case when list = 'o' then token end) as o, count(distinct case when list = 'i' then token end) as i, count(distinct case when list = 'n' then token end) as n, count(distinct case when list = 'd' then token end) as d
  from fx join vc on token = word or (length(token) >= 3 and starts_with(word, token)) or (length(word) >= 3 and starts_with(token, word)) group by folder),
sn as (select item_id as scene_no, concat('src', cast(item_id % 20 as varchar)) as folder, concat(case when item_id % 2 = 0 then 'INT. ' else 'EXT. ' end, 'PLACE ', cast(item_id as varchar), case when item_id % 3 = 0 then ' - DAY' else ' - NIGHT' end) as heading, text as summary from benchmark),
tk as (select distinct scene_no, folder, unnest(regexp_extract_all(lower(concat(heading, ' ', summary)), '[\\p{{L}}\\p{{N}}]+')) as token from sn),
ov as (select t.scene_no, count(distinct token) as m, string_agg(distinct token, ' ' order by token) as mw from tk t join vc on vc.folder = t.folder and (token = word or (length(token) >= 3 and starts_with(word, token)) or (length(word) >= 3 and starts_with(token, word))) where token not in ('int', 'ext', 'day', 'night', 'i', 'e') group by t.scene_no),
cl as (select folder, count(*) as clips, avg(hero) as avg_usable from (select tag as folder, hero from b_annotations) z group by folder),
jd as (select s.*, coalesce(m, 0) as m, mw, coalesce(clips, 0) as clips, coalesce(avg_usable, 0) as avg_usable, v.folder is not null as seen, case when o > i then 'EXT' when i > o then 'INT' end as lean, case when n > d then 'NIGHT' when d > n then 'DAY' end as tod
  from sn s left join ov on ov.scene_no = s.scene_no left join vt on vt.folder = s.folder left join cl on cl.folder = s.folder left join (select distinct folder from vc) v on v.folder = s.folder),
ck as (select *, case when seen and lean is not null then case when contains(heading, lean) then 'match' else 'mismatch' end end as place, case when seen and tod is not null then case when contains(heading, tod) then 'match' else 'mismatch' end end as time, case when seen then m > 0 end as overlap from jd),
sk as (select *, 5e-1 + case when overlap then 25e-2 else 0 end + case when place = 'match' then 15e-2 else 0 end + case when time = 'match' then 1e-1 else 0 end as score from ck)
"""


def scenes(t):
    i = F.col("item_id")
    heading = F.concat(F.when(i % 2 == 0, "INT. ").otherwise("EXT. "), F.lit("PLACE "), i.cast("string"), F.when(i % 3 == 0, " - DAY").otherwise(" - NIGHT"))
    s = t.read("benchmark").select(i.alias("scene_no"), F.concat(F.lit("src"), i % 20).alias("folder"), heading.alias("heading"), F.col("text").alias("summary"))
    moments = t.annotations.select(F.col("tag").alias("folder"), "label", F.array().cast("array<string>").alias("tags"), "grp")
    clips = t.annotations.select(F.col("tag").alias("folder"), F.col("hero").alias("usable_ratio"))
    return s, tk.scene_check(s, moments, clips)


@query("scene_checks", oracle("b_annotations", SCENE + """select scene_no, folder, round(score, 6) as score, seen as content_checked, clips, round(avg_usable, 6) as avg_usable, overlap, place, time, coalesce(mw, '') as matched,
  concat_ws(' ', case when clips = 0 then 'no_clips' end, case when not seen then 'no_labels' end, case when overlap then 'words_shared' when not overlap then 'no_words_shared' end,
    case when place is not null then concat('place_', lower(lean), '_', place) end, case when time is not null then concat('time_', lower(tod), '_', time) end) as findings from sk"""))
def scene_checks(t):
    return rounded(scenes(t)[1].withColumns({c: F.array_join(c, " ") for c in ("matched", "findings")}))


PLAN = SCENE + """,
as_ as (select scene_no, case when scene_no % 5 = 0 then '' when scene_no % 5 = 1 then 'elsewhere' else folder end as folder from sn),
pl as (select a.scene_no, a.folder, case when a.scene_no % 4 = 0 then 1 else 3 end as takes, k.scene_no is not null as judged, clips, avg_usable, seen, score, place, time from as_ a left join sk k on k.scene_no = a.scene_no and k.folder = a.folder),
pw as (select *, concat_ws('; ', case when judged and clips = 0 then 'no_clips' end, case when judged and clips > 0 and avg_usable < 4e-1 then 'little_usable' end,
  case when judged and clips > 0 and seen and score < 75e-2 then 'low_score' end, case when judged and clips > 0 and place = 'mismatch' then 'place' end, case when judged and clips > 0 and time = 'mismatch' then 'time' end) as why from pl),
pz as (select scene_no, folder, case when folder = '' then 'unshot' when not judged then 'assigned' when why <> '' then 'checked-weak' else 'checked-ok' end as status, case when folder = '' then '' else why end as why, folder <> '' and takes = 1 as thin from pw)
"""


def plan_of(t):
    s, checks = scenes(t)
    i = F.col("scene_no")
    assigned = s.select("scene_no", F.when(i % 5 == 0, "").when(i % 5 == 1, "elsewhere").otherwise(F.col("folder")).alias("folder"))
    takes = assigned.select("scene_no", "folder", F.when(i % 4 == 0, 1).otherwise(3).alias("takes"))
    return tk.shoot_plan(assigned, checks, takes)


@query("shoot_plan", oracle("b_annotations", PLAN + "select * from pz"))
def shoot_plan(t):
    return plan_of(t).withColumn("why", F.array_join("why", "; ")).drop("takes")


@query("shoot_progress", oracle("b_annotations", PLAN + """
select scene_no % 4 as project, count(*) as scenes, count(*) filter (where status = 'unshot') as unshot, count(*) filter (where status = 'assigned') as assigned, count(*) filter (where status = 'checked-ok') as checked_ok, count(*) filter (where status = 'checked-weak') as checked_weak,
  count(*) filter (where thin) as thin, cast(round_even(100 * count(*) filter (where status <> 'unshot') / count(*), 0) as bigint) as percent from pz group by scene_no % 4
"""))
def shoot_progress(t):
    return tk.shoot_progress(plan_of(t).withColumn("project", F.col("scene_no") % 4), "project")


@query("scene_targets", oracle("", """
s as (select conv_id as scene_no, count(*) as lines, max(text) as action, case conv_id % 5 when 0 then 'ruhiger Rhythmus, Blenden' when 1 then 'hektisch, harte Schnitte' when 2 then 'slow and fast' when 3 then 'weich' else '' end as cut_intent from conversations group by conv_id),
w as (select *, len(list_filter(regexp_split_to_array(trim(action), '\\s+'), lambda x: x <> '')) as n, lower(cut_intent) as t from s)
select scene_no, round(least(45, greatest(4, 6 + 25e-1 * lines + least(10, n / 4))), 6) as target_s, case when contains(t, 'ruhig') or contains(t, 'slow') then 3e0 when contains(t, 'hektisch') or contains(t, 'fast') then 1e0 else 2e0 end as pace,
  case when contains(t, 'harte schnitte') then 'cuts' when contains(t, 'blende') or contains(t, 'weich') then 'dissolves' else 'cuts' end as transitions from w
"""))
def scene_targets(t):
    i = F.col("conv_id")
    s = t.read("conversations").groupBy(i.alias("scene_no")).agg(F.count("*").alias("lines"), F.max("text").alias("action"))
    k = F.col("scene_no") % 5
    intent = F.when(k == 0, "ruhiger Rhythmus, Blenden").when(k == 1, "hektisch, harte Schnitte").when(k == 2, "slow and fast").when(k == 3, "weich").otherwise("")
    return rounded(tk.scene_targets(s.withColumn("cut_intent", intent)).drop("lines", "action", "cut_intent"))


POOL = """
m as (select *, grp as project, xphash as ph from (select *, cast(cast(phash as hugeint) * 1048583 % 4294967291 as bigint) as xphash from b_moments) z),
b as (select *, row_number() over (partition by project, clip_path order by score desc, start_s, mid) = 1 as lead_ from m),
"""


@query("budgeted_moments", oracle("b_moments", POOL + """
f as (select * from (select *, row_number() over (partition by project order by score desc, clip_path, start_s, mid) as r from b where lead_) z where r <= 24),
fl as (select project, list({'mid': mid, 'h': ph} order by r) as s from f group by project),
rl as (select project, list({'mid': mid, 'h': ph} order by score desc, clip_path, start_s, mid) as l from b where not lead_ group by project),
fo as (select fl.project, list_reduce(list_transform(coalesce(l, []), lambda x: [x]), lambda acc, y: case when len(acc) < 24 and len(list_filter(acc, lambda o: bit_count(xor(o.h, y[1].h)) <= 6)) = 0 then list_concat(acc, y) else acc end, s) as k from fl left join rl on rl.project = fl.project)
select project, i as pick, k[i].mid as mid from (select project, k, unnest(range(1, len(k) + 1)) as i from fo) z
"""))
def budgeted_moments(t):
    m = t.moments.withColumn("project", F.col("grp")).withColumn("phash", (F.col("phash").cast("decimal(38,0)") * 1048583 % 4294967291).cast("bigint"))
    return tk.select_moments(m, 24).select("project", "pick", "mid")


SEEDS = """
m as (select *, grp as project, round(score + 5e-1 * hero + 25e-2 * highlight, 9) as st from b_moments),
c1 as (select *, row_number() over (partition by project order by st desc, clip_path, start_s, end_s, mid) as pick from (select *, row_number() over (partition by project, clip_path order by st desc, start_s, end_s, mid) as r from m) z where r = 1),
f as (select * from c1 where pick <= 30),
ag as (select project, count(*) as n, list(distinct daylight) filter (where daylight <> '') as ds, list(distinct shot_size) filter (where shot_size <> '') as ss from f group by project),
rs as (select m.*, case when list_contains(ds, daylight) then 1 else 0 end + case when list_contains(ss, shot_size) then 1 else 0 end as nov from m join ag on ag.project = m.project where n < 30 and not exists (select 1 from f where f.mid = m.mid)),
fl as (select project, list({'mid': mid, 'c': clip_path, 's': start_s} order by pick) as s from f group by project),
rl as (select project, list({'mid': mid, 'c': clip_path, 's': start_s} order by nov, st desc, clip_path, start_s, end_s, mid) as l from rs group by project),
fo as (select fl.project, list_reduce(list_transform(coalesce(l, []), lambda x: [x]), lambda acc, y: case when len(acc) < 30 and len(list_filter(acc, lambda o: o.c = y[1].c and abs(o.s - y[1].s) < 8 - 1e-6)) = 0 then list_concat(acc, y) else acc end, s) as k from fl left join rl on rl.project = fl.project),
seeds as (select project, i as pick, k[i].mid as mid from (select project, k, unnest(range(1, len(k) + 1)) as i from fo) z)
"""


def seeds_of(t):
    m = t.moments.withColumn("project", F.col("grp"))
    return m, settle(tk.series_seeds(m, 30))


@query("series_seeds", oracle("b_moments", SEEDS + "select * from seeds"))
def series_seeds(t):
    return seeds_of(t)[1].select("project", "pick", "mid")


@query("series_partition", oracle("b_moments", SEEDS + """,
sd as (select s.project, pick, b.* from seeds s join b_moments b on b.mid = s.mid),
ds as (select m.mid, s.pick, round(case when m.clip_path = s.clip_path then abs(m.start_s - s.start_s) else 1e6 + greatest(0, 1 + case when m.daylight <> '' and s.daylight <> '' and m.daylight <> s.daylight then 1 else 0 end + case when m.shot_size <> s.shot_size then 5e-1 else 0 end + case when m.grp <> s.grp then 1 else 0 end) end, 6) as d
  from b_moments m join sd s on s.project = m.grp)
select mid, min_by(pick, {'d': d, 'p': pick}) as seed, min(d) as distance from ds group by mid
"""))
def series_partition(t):
    m, seeds = seeds_of(t)
    return tk.partition_moments(m, seeds).select("mid", "seed", "distance")


SIGNALS = """
sg as (select user_id % 10 as who, case event_type when 'click' then 'shot_size' when 'view' then 'avoid_shot_size' when 'purchase' then 'transition' when 'signup' then 'shot_length' else 'hold' end as family,
  case when event_id % 3 = 0 then '*' when event_id % 3 = 1 then 'climax' else 'opening' end as context, case event_type when 'click' then case when event_id % 2 = 0 then 'close' else 'wide' end when 'view' then 'medium' when 'purchase' then 'cut' when 'signup' then case when event_id % 4 < 3 then 'shorter' else 'longer' end else 'longer' end as direction, ts from events),
ct as (select who, family, context, direction, count(*) as count, max(ts) as last, count(*) >= 2 as active from sg group by who, family, context, direction)
"""


def signals(t):
    i, e = F.col("event_id"), F.col("event_type")
    family = F.when(e == "click", "shot_size").when(e == "view", "avoid_shot_size").when(e == "purchase", "transition").when(e == "signup", "shot_length").otherwise("hold")
    direction = (
        F.when(e == "click", F.when(i % 2 == 0, "close").otherwise("wide")).when(e == "view", "medium").when(e == "purchase", "cut")
        .when(e == "signup", F.when(i % 4 < 3, "shorter").otherwise("longer")).otherwise("longer")
    )
    context = F.when(i % 3 == 0, "").when(i % 3 == 1, "climax").otherwise("opening")
    return t.read("events").select((F.col("user_id") % 10).alias("who"), family.alias("family"), context.alias("context"), direction.alias("direction"), F.col("ts").alias("at"))


@query("preference_counts", oracle("", SIGNALS + 'select who, family, context, direction, "count", last, active from ct'))
def preference_counts(t):
    return tk.preference_counts(signals(t), ["who"])


@query("size_preferences", oracle("", SIGNALS + "select who, context as phase, direction as shot_size, round(sum(case family when 'shot_size' then 8e-2 else -8e-2 end), 6) as weight from ct where active and family in ('shot_size', 'avoid_shot_size') and direction in ('wide', 'medium', 'close') group by who, context, direction"))
def size_preferences(t):
    return rounded(tk.casting_bias(tk.preference_counts(signals(t), ["who"]), ["who"])[0])


@query("pace_preferences", oracle("", SIGNALS + "select who, cast(greatest(-1, least(1, sum(case when family = 'shot_length' then case direction when 'shorter' then -1 when 'longer' then 1 else 0 end else 0 end))) as bigint) as pace_notches, bool_or(family = 'transition' and direction = 'cut') as fewer_dissolves from ct where active group by who"))
def pace_preferences(t):
    return tk.casting_bias(tk.preference_counts(signals(t), ["who"]), ["who"])[1]


@query("pool_statistics", oracle("", """
md as (select distinct doc_id % 20 as project, concat('/media/', source, '/', cast(doc_id % 60 as varchar)) as path, case when doc_id % 60 % 4 = 0 then 'folder' else 'file' end as kind from documents),
rp as (select distinct doc_id % 20 as project, concat('/media/', source, '/', cast(doc_id % 60 as varchar)) as path, n_chars % 3 as mtime from documents),
iv as (select concat('/media/', source, '/', cast(doc_id % 60 as varchar)) as path, max(n_chars % 3) as mtime from documents group by 1),
p as (select distinct doc_id % 20 as project from documents)
select p.project, p.project % 2 = 0 as has_plan, (select count(*) from md where md.project = p.project) as pool_size, (select count(*) from md where md.project = p.project and kind = 'file') as files, (select count(*) from md where md.project = p.project and kind = 'folder') as folders,
  (select count(distinct rp.path) from rp join iv on iv.path = rp.path and iv.mtime = rp.mtime where rp.project = p.project) as analysed from p
"""))
def pool_statistics(t):
    d = t.read("documents").select("doc_id", "source", "n_chars")
    i = F.col("doc_id")
    path = F.concat(F.lit("/media/"), "source", F.lit("/"), i % 60).alias("path")
    mtime = (F.col("n_chars") % 3).alias("mtime")
    media = d.select((i % 20).alias("project"), path, F.when(i % 60 % 4 == 0, "folder").otherwise("file").alias("kind"))
    projects = d.select((i % 20).alias("project")).distinct().withColumn("has_plan", F.col("project") % 2 == 0)
    inventory = d.select(path, mtime).groupBy("path").agg(F.max("mtime").alias("mtime"))
    return tk.pool_stats(projects, media, d.select((i % 20).alias("project"), path, mtime), inventory)
