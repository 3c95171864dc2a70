"""Readers and sinks: what a sink writes, the reader must give back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.ordered import row_index, scan
from cutlake.functions.staging import settle
from cutlake.functions.text import normalize
from cutlake.plans.q_takes import NORM
from cutlake.plans.q_timeline import rounded
from cutlake.plans.registry import query
from cutlake.plans.views import oracle
from cutlake.sources import stores, timelines, transcripts


def as_files(rows, keys, order, line, glue, head="", tail=""):
    """The rows of each key gathered into one text, a whole document: (file, text)."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("__l")))).alias("l"))
    text = F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["__l"]), glue), F.lit(tail))
    return settle(packed.select(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]).alias("file"), text.alias("text")))


@query("edl_round_trip", oracle("b_clips", """
p as (select distinct timeline_id, track, record_out from b_clips),
c as (select b.*, clip_id % 5 = 0 and p.record_out is not null as pair, row_number() over (partition by b.timeline_id order by b.record_in, b.track, clip_id) as event from b_clips b left join p on p.timeline_id = b.timeline_id and p.track = b.track and p.record_out = b.record_in)
select cast(timeline_id as varchar) as file, event, 'video' as kind, 'V1' as track, name, upper(source_file) as source_name, source_in, source_out, record_in, record_out, case when pair then 'D' end as transition, case when pair then cast(12 as bigint) end as transition_frames from c
"""))
def edl_round_trip(t):
    c = t.clips.withColumns({
        "source_name": F.col("source_file"), "transition": F.when(F.col("clip_id") % 5 == 0, "D"), "transition_frames": F.lit(12),
    })
    lines = timelines.edl_lines(c, 25.0).select(F.col("timeline_id").cast("string").alias("file"), (F.col("event") * 10 + F.col("line_no")).alias("pos"), "line")
    return timelines.parse_edl(settle(lines), 25.0)[0].drop("pos")


@query("fcpxml_ingest", oracle("b_clips", """
select cast(timeline_id as varchar) as file, name, case when clip_id % 4 = 1 then 'V3' else 'V1' end as track, 'video' as kind, source_in, source_in + record_out - record_in as source_out, record_in, record_out, source_file as source_name from b_clips
union all select cast(timeline_id as varchar), name, case when clip_id % 4 = 1 then 'A3' else 'A1' end, 'audio', source_in, source_in + record_out - record_in, record_in, record_out, source_file from b_clips where cast(substring(source_file, 6) as bigint) % 2 = 0
"""))
def fcpxml_ingest(t):
    time = lambda frames: F.concat((frames * 100).cast("string"), F.lit("/2500s"))
    q = lambda name, v: F.concat(F.lit(f' {name}="'), v, F.lit('"'))
    c = t.clips
    body = F.concat(q("ref", F.col("source_file")), q("name", F.col("name")), q("duration", time(F.col("record_out") - F.col("record_in"))), q("start", time(F.col("source_in") + 90_000)))
    plain = F.concat(F.lit("<asset-clip"), body, q("offset", time(F.col("record_in"))), F.lit("/>"))
    # Every fourth clip hangs in a gap, one lane up; its offset counts from the gap's own start.
    lane = F.concat(
        F.lit("<gap"), q("offset", time(F.col("record_in") - F.lit(10))), q("start", F.lit("5s")), F.lit("><asset-clip"), body, q("lane", F.lit("2")), q("offset", time(F.lit(135))), F.lit("/></gap>")
    )
    c = c.withColumn("el", F.when(F.col("clip_id") % 4 == 1, lane).otherwise(plain))
    assets = "".join(f'<asset id="clip_{i}" name="clip_{i}" start="3600s" hasVideo="1"{" hasAudio=\"1\"" if i % 2 == 0 else ""} src="file:///m/clip_{i}.mov"/>' for i in range(12))
    head = f'<fcpxml version="1.9"><resources><format id="r1" frameDuration="100/2500s" width="1920" height="1080"/>{assets}</resources><library><event><project name="x"><sequence format="r1"><spine>'
    files = as_files(c, ["timeline_id"], ["record_in", "clip_id"], "el", "", head, "</spine></sequence></project></event></library></fcpxml>")
    clips, _ = timelines.parse_fcpxml(files)
    return clips.select("file", "name", "track", "kind", "source_in", "source_out", "record_in", "record_out", "source_name")


def tidy_segments(t):
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return t.segments.select("take_id", "seg", F.upper("speaker").alias("speaker"), text.alias("text"), "start_s", "end_s")


SEGS = "sg as (select cast(take_id as varchar) as file, take_id, seg, upper(speaker) as speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, start_s, end_s from b_segments)"


@query("srt_round_trip", oracle("b_segments", SEGS + """
select file, row_number() over (partition by file order by seg) as seg, speaker, text, round(round_even(start_s * 1000, 0) / 1000, 6) as start_s, round(round_even(end_s * 1000, 0) / 1000, 6) as end_s from sg
"""))
def srt_round_trip(t):
    s = tidy_segments(t)
    blocks = transcripts.srt_blocks(s)
    return rounded(transcripts.parse_srt(as_files(blocks, ["take_id"], ["n"], "line", "\n"))[0])


@query("whisper_ingest", oracle("b_segments", SEGS + "select file, seg, speaker, text, round(start_s, 6) as start_s, round(end_s, 6) as end_s, 'de' as language from sg"))
def whisper_ingest(t):
    row = F.to_json(F.struct(F.col("seg").alias("id"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "speaker"))
    s = tidy_segments(t).withColumn("json", row)
    files = as_files(s, ["take_id"], ["seg"], "json", ",", '{"language": "de", "segments": [', "]}")
    return rounded(transcripts.parse_whisper(files)[0])


@query("papercut_round_trip", oracle("b_segments", SEGS + """
select cast(take_id % 20 as varchar) as file, cast(take_id as varchar) as source_name, speaker, text, speaker = 'USER' as selected, round(round_even(start_s * 1000, 0) / 1000, 6) as start_s, round(round_even(end_s * 1000, 0) / 1000, 6) as end_s, 25e0 as fps from sg
"""))
def papercut_round_trip(t):
    s = tidy_segments(t).withColumn("papercut_id", F.col("take_id") % 20).withColumn("selected", F.col("speaker") == "USER")
    lines = transcripts.papercut_lines(s, 25.0)
    lines = scan(lines, ["papercut_id"], ["take_id", "seg", "n"], F.floor(F.col("take_id") / 64), pos=row_index())
    found, _ = transcripts.parse_papercut(settle(lines.select(F.col("papercut_id").cast("string").alias("file"), "pos", "line")))
    return rounded(found.drop("pos"), "fps")


@query("edl_bad_rows", oracle("b_clips", """
select cast(timeline_id as varchar) as file, clip_id as pos, case clip_id % 5 when 0 then 'malformed event line: expected 8 or 9 fields, got 7' when 1 then 'invalid timecode in event line' else 'unrecognized channel field Q9' end as message from b_clips where clip_id % 5 < 3
"""))
def edl_bad_rows(t):
    k = F.col("clip_id") % 5
    code = F.lit("00:00:01:00 00:00:02:00 00:00:01:00 ")
    line = F.concat_ws(" ", F.lit("001 REEL"), F.when(k == 2, "Q9").otherwise("V"), F.lit("C"), code)
    line = F.concat(line, F.when(k == 0, "").when(k == 1, "0:0x").otherwise("00:00:02:00"))
    return timelines.parse_edl(t.clips.select(F.col("timeline_id").cast("string").alias("file"), F.col("clip_id").alias("pos"), line.alias("line")), 25.0)[1]


NTH = "nt as (select cast(take_id as varchar) as file, seg, row_number() over (partition by take_id order by seg) as n from b_segments)"


@query("srt_bad_rows", oracle("b_segments", NTH + "\nselect file, n as pos, case when seg % 7 = 3 then 'expected a time line' else 'end time precedes start time' end as message from nt where seg % 7 in (3, 5)"))
def srt_bad_rows(t):
    s, k = tidy_segments(t), F.col("seg") % 7
    clock = F.when(k == 3, "no clock").when(k == 5, "00:00:09,000 --> 00:00:01,000").otherwise("00:00:01,000 --> 00:00:09,000")
    s = s.withColumn("line", F.concat(F.col("seg").cast("string"), F.lit("\n"), clock, F.lit("\nsaid\n")))
    return transcripts.parse_srt(as_files(s, ["take_id"], ["seg"], "line", "\n"))[1]


@query("whisper_bad_rows", oracle("b_segments", NTH + "\nselect file, n - 1 as pos, 'segment lacks start, end or text' as message from nt where seg % 4 = 1"))
def whisper_bad_rows(t):
    row = F.struct(F.col("seg").alias("id"), F.col("start_s").alias("start"), F.when(F.col("seg") % 4 != 1, F.col("end_s")).alias("end"), "text")
    files = as_files(tidy_segments(t).withColumn("json", F.to_json(row)), ["take_id"], ["seg"], "json", ",", '{"language": "de", "segments": [', "]}")
    return transcripts.parse_whisper(files)[1]


@query("papercut_bad_rows", oracle("b_segments", NTH + "\nselect file, n as pos, 'entry has a malformed or missing timestamp' as message from nt where seg % 5 = 2"))
def papercut_bad_rows(t):
    span = F.when(F.col("seg") % 5 == 2, "[00:xx]").otherwise("[00:00:01.000 --> 00:00:02.000]")
    lines = tidy_segments(t).withColumn("line", F.concat(F.lit("- [x] "), span, F.lit(" A: said")))
    lines = scan(lines, ["take_id"], ["seg"], F.floor(F.col("seg") / 4096), pos=row_index())
    return transcripts.parse_papercut(settle(lines.select(F.col("take_id").cast("string").alias("file"), "pos", "line")))[1]


SPOKEN = "ln as (select conv_id, turn, upper(role) as role, " + NORM.format(c="text") + " as norm from conversations)"


@query("fountain_ingest", oracle("", SPOKEN + "select cast(conv_id as varchar) as file, cast(1 as bigint) as scene_no, 'dialogue' as kind, norm as text, role as character, '(quiet)' as parenthetical from ln"))
def fountain_ingest(t):
    return _script(t)[1].drop("pos")


@query("fountain_scenes", oracle("", "select cast(conv_id as varchar) as file, cast(1 as bigint) as scene_no, concat('INT. PLACE ', cast(conv_id as varchar)) as heading, cast(conv_id as varchar) as number from (select distinct conv_id from conversations) z"))
def fountain_scenes(t):
    return _script(t)[0]


def _script(t):
    c = t.read("conversations").select("conv_id", "turn", F.upper("role").alias("role"), normalize("text").alias("norm"))
    speech = F.concat_ws("\n", "role", F.lit("(quiet)"), F.col("norm"), F.lit(""))
    place = F.concat(F.lit("Title: Draft\n\nint. place "), F.col("conv_id").cast("string"), F.lit(" #"), F.col("conv_id").cast("string"), F.lit("#\n\n"))
    files = as_files(c.withColumn("block", F.when(F.col("turn") == 0, F.concat(place, speech)).otherwise(speech)), ["conv_id"], ["turn"], "block", "\n")
    return transcripts.parse_fountain(files)


@query("plan_ingest", oracle("b_entries", """
select cast(plan_id as varchar) as plan_id, slot, clip_path, source_start, source_end, record_start, record_end, round(score, 6) as score, transition, peak_source, shot_size, false as pinned, 0e0 as audio_lead from b_entries where plan_id % 9 > 0
"""))
def plan_ingest(t):
    out = plan_documents(t)["entries"]
    return rounded(out.select("plan_id", "slot", "clip_path", "source_start", "source_end", "record_start", "record_end", "score", "transition", "peak_source", "shot_size", "pinned", "audio_lead"))


def plan_documents(t):
    e = t.entries
    row = F.struct("clip_path", "source_start", "source_end", "record_start", "record_end", "score", "transition", "peak_source", "shot_size")
    # Every ninth plan is malformed: one of its entries has a field no plan knows.
    odd = F.struct("clip_path", "source_start", "source_end", "record_start", "record_end", "score", F.lit(1).alias("surprise"))
    e = e.withColumn("json", F.when(F.col("plan_id") % 9 > 0, F.to_json(row)).otherwise(F.to_json(odd)))
    files = as_files(e, ["plan_id"], ["slot"], "json", ",", '{"version": 1, "music_path": "a.wav", "duration": 30.5, "entries": [', '], "dips": [[1.0, 0.4]]}')
    return stores.parse_plans(files)


@query("plan_dips", oracle("b_entries", "select distinct cast(plan_id as varchar) as plan_id, 1e0 as dip_start, 4e-1 as dip_len from b_entries where plan_id % 9 > 0"))
def plan_dips(t):
    return plan_documents(t)["dips"]


@query("plan_bad_rows", oracle("b_entries", "select distinct cast(plan_id as varchar) as file, cast(0 as bigint) as pos, 'malformed entry' as message from b_entries where plan_id % 9 = 0"))
def plan_bad_rows(t):
    return plan_documents(t)["bad_rows"]


@query("report_ingest", oracle("b_moments", """
select concat('/m/', clip_path, '.mov') as clip_path, start_s, end_s, round(score, 6) as score, role, grp, phash, -1e0 as peak_time, 2e0 as focus_x from b_moments
"""))
def report_ingest(t):
    out = stored_reports(t)["moments"]
    return rounded(out.select("clip_path", "start_s", "end_s", "score", "role", "grp", "phash", "peak_time", F.col("entry_focus.x").alias("focus_x")))


def stored_reports(t):
    """One store per clip: an old and a new report, a key and a value that are none; and one file that is no store."""
    m = t.moments
    row = F.to_json(F.struct(
        F.col("start_s").alias("start"), F.col("end_s").alias("end"), "score", "role", F.col("grp").alias("group"), "phash", F.array(F.lit(2.0), F.lit(1.0)).alias("entry_focus"),
    ))
    files = as_files(m.withColumn("json", row), ["clip_path"], ["mid"], "json", ",")
    key = F.concat(F.lit('"/m/'), "file", F.lit(".mov|"))
    older = F.concat(key, F.lit('100.5": {"duration": 1.0, "moments": []}'))
    rest = '"segments": [{"start": 0.0, "end": 20.0, "label": "usable", "score": 0.75}, {"start": 20.0, "end": 60.0, "label": "dark"}], "notes": ["dark"], "scene_cuts": [20.0]'
    newer = F.concat(key, F.lit('200.25": {"duration": 60.0, "usable_ratio": 0.5, ' + rest + ', "moments": ['), "text", F.lit("]}"))
    none = F.concat(F.lit(', "broken": {"duration": 1.0}, '), key, F.lit('300": 7}'))
    stored = files.select("file", F.concat(F.lit("{"), older, F.lit(", "), newer, none).alias("text"))
    other = t.moments.select(F.lit("torn").alias("file"), F.lit('{"/m/torn.mov|1": {"dur').alias("text")).limit(1)
    return stores.parse_reports(stored.unionByName(other))


@query("report_clips", oracle("b_moments", """
select distinct concat('/m/', clip_path, '.mov') as path, 20025e-2 as mtime, 6e1 as duration, 5e-1 as usable_ratio, 'dark' as notes, 2e1 as first_cut from b_moments
"""))
def report_clips(t):
    out = stored_reports(t)["clips"]
    return out.select("path", "mtime", "duration", "usable_ratio", F.array_join("notes", ",").alias("notes"), F.get("scene_cuts", F.lit(0)).alias("first_cut"))


@query("report_segments", oracle("b_moments", """
select path, i, case when i = 0 then 0e0 else 2e1 end as start_s, case when i = 0 then 2e1 else 6e1 end as end_s, case when i = 0 then 'usable' else 'dark' end as label, case when i = 0 then 75e-2 else 0e0 end as score
from (select distinct concat('/m/', clip_path, '.mov') as path from b_moments) c cross join range(2) r(i)
"""))
def report_segments(t):
    return stored_reports(t)["segments"]


@query("report_bad_rows", oracle("b_moments", """
select distinct cast(clip_path as varchar) as file, 'broken' as key, 'malformed key' as message from b_moments
union all select distinct cast(clip_path as varchar), concat('/m/', clip_path, '.mov|300'), 'malformed report' from b_moments union all select 'torn', '', 'malformed store'
"""))
def report_bad_rows(t):
    return stored_reports(t)["bad_rows"]


ANNOTATIONS = """
an as (select concat('/m/', cast(doc_id as varchar), '.mov') as clip_path, n_chars * 1e0 as mtime, (n_chars % 100) * 1e0 as start_s, (n_chars % 100) * 1e0 + 2 as end_s, trim(regexp_replace(text, '\\s+', ' ', 'g')) as label, case doc_id % 5 when 0 then 'opener' when 1 then 'climax' else '' end as role,
  least(1e0, greatest(0e0, (doc_id % 15) / 1e1 - 2e-1)) as hero, concat('lang ', lang) as grp, array_to_string(case when source = lang then [lang] else [lang, source] end, ',') as tags from documents where doc_id % 11 > 0)
"""


def raw_annotations(t):
    d = t.read("documents")
    i, s = F.col("doc_id"), F.col("n_chars") % 100
    window = F.concat_ws("-", s.cast("double").cast("string"), (s + 2).cast("double").cast("string"))
    good = F.concat_ws("|", F.concat(F.lit("/m/"), i.cast("string"), F.lit(".mov")), F.col("n_chars").cast("double").cast("string"), window, F.lit("model"))
    key = F.when(i % 11 == 0, "nonsense").when(i % 2 == 0, F.concat(good, F.lit("|3f"))).otherwise(good)
    role = F.when(i % 5 == 0, "opener").when(i % 5 == 1, "climax").otherwise("villain")
    return d.select(
        key.alias("key"), F.col("text").alias("label"), role.alias("role"), ((i % 15) / 10 - 0.2).cast("string").alias("hero"),
        F.array(F.upper("lang"), F.concat(F.lit(" "), "lang"), F.col("source")).alias("tags"), F.concat(F.lit("  LANG   "), "lang").alias("grp"),
    )


@query("annotation_ingest", oracle("", ANNOTATIONS + "select clip_path, mtime, start_s, end_s, label, role, round(hero, 6) as hero, grp, tags from an"))
def annotation_ingest(t):
    return rounded(stores.clean_annotations(raw_annotations(t)).withColumn("tags", F.array_join("tags", ",")))


def _inventory(t):
    i = F.col("doc_id")
    return t.read("documents").select(
        F.concat(F.lit("/m/"), i.cast("string"), F.lit(".mov")).alias("clip_path"), (F.col("n_chars") + F.when(i % 3 == 0, 1).otherwise(0)).cast("double").alias("mtime")
    ).where(~F.col("clip_path").endswith("7.mov"))


@query("fresh_annotations", oracle("", ANNOTATIONS + """,
iv as (select concat('/m/', cast(doc_id as varchar), '.mov') as clip_path, n_chars + case when doc_id % 3 = 0 then 1e0 else 0e0 end as mtime from documents where doc_id % 10 <> 7)
select clip_path, mtime from an where exists (select 1 from iv where iv.clip_path = an.clip_path and iv.mtime = an.mtime)
"""))
def fresh_annotations(t):
    return stores.fresh(stores.clean_annotations(raw_annotations(t)), _inventory(t)).select("clip_path", "mtime")


@query("pending_clips", oracle("", ANNOTATIONS + """,
iv as (select concat('/m/', cast(doc_id as varchar), '.mov') as clip_path, n_chars + case when doc_id % 3 = 0 then 1e0 else 0e0 end as mtime from documents where doc_id % 10 <> 7)
select clip_path, mtime from iv where not exists (select 1 from an where iv.clip_path = an.clip_path and iv.mtime = an.mtime)
"""))
def pending_clips(t):
    return stores.pending(_inventory(t), stores.clean_annotations(raw_annotations(t)))


NAMES = """
n as (select doc_id, case doc_id % 6 when 0 then concat('/f/S', cast(doc_id as varchar), '_T0', cast(doc_id % 9 + 1 as varchar), '.mov') when 1 then concat('sc0', cast(doc_id % 900 as varchar), 'b_tk7.mp4') when 2 then concat('Scene ', cast(doc_id % 1000 as varchar), ' Take 3.mov')
  when 3 then concat('0', cast(doc_id % 100 as varchar), '-', cast(doc_id % 7 as varchar), '.mov') when 4 then concat('IMG_', cast(doc_id as varchar), '.MOV') else 'interview.mov' end as name, source from documents),
r as (select doc_id, name, source, case doc_id % 6 when 0 then cast(doc_id as varchar) when 1 then concat(cast(doc_id % 900 as varchar), 'B') when 2 then cast(doc_id % 1000 as varchar) when 3 then cast(doc_id % 100 as varchar) else '' end as scene,
  case doc_id % 6 when 0 then cast(doc_id % 9 + 1 as varchar) when 1 then '7' when 2 then '3' when 3 then cast(doc_id % 7 as varchar) else '' end as take from n)
"""


def named_files(t):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    k = i % 6
    name = (
        F.when(k == 0, F.concat(F.lit("/f/S"), s(i), F.lit("_T0"), s(i % 9 + 1), F.lit(".mov"))).when(k == 1, F.concat(F.lit("sc0"), s(i % 900), F.lit("b_tk7.mp4")))
        .when(k == 2, F.concat(F.lit("Scene "), s(i % 1000), F.lit(" Take 3.mov"))).when(k == 3, F.concat(F.lit("0"), s(i % 100), F.lit("-"), s(i % 7), F.lit(".mov")))
        .when(k == 4, F.concat(F.lit("IMG_"), s(i), F.lit(".MOV"))).otherwise("interview.mov")
    )
    return t.read("documents").select("doc_id", name.alias("name"), F.col("source").alias("folder"))


# Four digits are the most a scene number may have; the tables of every scale stay below that up to 10,000 documents.
@query("scene_take_names", oracle("", NAMES + "select doc_id, name, case when doc_id % 6 = 0 and doc_id > 9999 then '' else scene end as scene, case when doc_id % 6 = 0 and doc_id > 9999 then '' else take end as take from r"))
def scene_take_names(t):
    return named_files(t).select("doc_id", "name", stores.scene_take(F.col("name")).alias("s")).select("doc_id", "name", "s.scene", "s.take")


@query("scene_take_counts", oracle("", NAMES + "select source as folder, scene, count(*) as takes from r where scene <> '' and not (doc_id % 6 = 0 and doc_id > 9999) group by source, scene"))
def scene_take_counts(t):
    return stores.scene_take_counts(named_files(t), "name", "folder")
