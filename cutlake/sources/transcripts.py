"""Transcripts, scripts and paper edits in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.functions.ordered import carry_forward, row_index, running_sum, scan
from cutlake.sources.lines import bad, by_line, corpus, to_lines

# Line formats of the text files.
TIME_LINE = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*-->\s*(\d{1,2}):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*(?:X1.*)?$"
SPEAKER = r"^([A-Z][A-Z0-9 .'_-]{0,40}):\s*(.+)$"
ENTRY = r"^\s*[-*]\s*\[([ xX])\]\s*(.*)$"
SPAN = r"^\[\s*(\d{1,2}):(\d{1,2}):(\d{1,2})[.,](\d{1,3})\s*-->\s*(\d{1,2}):(\d{1,2}):(\d{1,2})[.,](\d{1,3})\s*\]\s*(.*)$"
PAPER_SPEAKER = r"^([A-Z][A-Z0-9 _.'-]{0,29}):\s*(.*)$"
SECTION, FIELD = r"(?i)^##\s*source\s*:\s*(.*)$", r"(?i)^(source|fps)\s*:\s*(.*)$"
HEADING = r"(?i)^(?:INT\.?/EXT|INT|EXT|EST|I/E)[. ]"
SCENE_NUMBER = r"\s*#([A-Za-z0-9.\-]+)#\s*$"
TITLE_KEYS = ("title", "credit", "author", "authors", "source", "draft date", "date", "contact", "notes", "copyright", "revision")
CUE = r"^[\p{L}\p{N} .'\-()^&,#/]+$"
DEFAULT_FPS = 25.0


def _clock(text: Column, pattern: str, first: int, pad: bool) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, first + i), F.lit(""))
    ms = F.rpad(part(3), 3, "0") if pad else part(3)
    return part(0).cast("int") * 3600 + part(1).cast("int") * 60 + part(2).cast("int") + ms.cast("int") / 1000.0


def _blocks(files: DataFrame) -> DataFrame:
    """Blank-line separated blocks as (file, pos, lines)."""
    text = F.regexp_replace("text", "\r\n|\r", "\n")
    rows = files.select("file", F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select("file", (F.col("pos") + 1).cast("bigint").alias("pos"), lines.alias("lines")).where(F.size("lines") > 0)


def parse_srt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subtitle blocks of (file, text) as segments; ``NAME:`` in capitals becomes the speaker."""
    rows = _blocks(files)
    counter = F.get("lines", F.lit(0)).rlike(r"^\d+$") & (F.size("lines") > 1)
    rows = rows.withColumn("lines", F.when(counter, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines")))
    clock = F.get("lines", F.lit(0))
    rows = rows.withColumns({"start_s": _clock(clock, TIME_LINE, 1, False), "end_s": _clock(clock, TIME_LINE, 5, False), "__time": clock.rlike(TIME_LINE)})
    early = F.col("end_s") < F.col("start_s")
    wrong = bad(rows, ~F.col("__time"), F.lit("expected a time line")).unionByName(bad(rows, F.col("__time") & early, F.lit("end time precedes start time")))
    said = F.trim(F.array_join(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), " "))
    good = rows.where(F.col("__time") & ~early).withColumn("__said", said)
    spoken = F.col("__said").rlike(SPEAKER)
    good = scan(good, ["file"], ["pos"], by_line(), seg=row_index())
    return good.select(
        "file", "seg", "start_s", "end_s", F.when(spoken, F.trim(F.regexp_extract("__said", SPEAKER, 2))).otherwise(F.col("__said")).alias("text"),
        F.when(spoken, F.trim(F.regexp_extract("__said", SPEAKER, 1))).otherwise("").alias("speaker"),
    ), wrong


def read_srt_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_srt(corpus(spark, path))


def stamp(seconds: Column, mark: str) -> Column:
    ms = F.bround(seconds * 1000).cast("bigint")
    s = F.floor(ms / 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def srt_blocks(segments: DataFrame, key: str = "take_id") -> DataFrame:
    """Segments as numbered subtitle blocks: (key, n, line), the block's lines joined."""
    n = scan(segments, [key], ["seg"], F.floor(F.col("seg") / 4096), n=row_index())
    speaker = F.coalesce("speaker", F.lit(""))
    text = F.when(speaker != "", F.concat(speaker, F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(stamp(F.col("start_s"), ","), F.lit(" --> "), stamp(F.col("end_s"), ",")), text, F.lit(""))
    return n.select(key, "n", block.alias("line"))


def write_srt_corpus(segments: DataFrame, path: str, key: str = "take_id") -> None:
    from cutlake.sources.timelines import write_lines

    write_lines(srt_blocks(segments, key), path, key, ["n"])


SEGMENT = "struct<id: double, start: double, end: double, text: string, speaker: string>"


def parse_whisper(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Speech recognition JSON: an object with segments, or a bare list of them."""
    obj = F.from_json("text", f"language string, segments array<{SEGMENT}>")
    lst = F.from_json("text", f"array<{SEGMENT}>")
    is_list = F.trim("text").startswith("[")
    rows = files.withColumns({"__o": F.when(~is_list, obj), "__l": F.when(is_list, lst)})
    rows = rows.withColumns({"segments": F.coalesce("__l", "__o.segments"), "language": F.coalesce("__o.language", F.lit("")), "pos": F.lit(0)})
    wrong = bad(rows, F.col("segments").isNull(), F.lit("not valid JSON with a list of segments"))
    each = rows.select("file", "language", F.posexplode("segments").alias("pos", "s"))
    lacks = F.col("s.start").isNull() | F.col("s.end").isNull() | F.col("s.text").isNull()
    wrong = wrong.unionByName(bad(each, lacks, F.lit("segment lacks start, end or text")))
    return each.where(~lacks).select(
        "file", F.coalesce(F.col("s.id").cast("bigint"), F.col("pos").cast("bigint")).alias("seg"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"),
        F.trim("s.text").alias("text"), F.coalesce("s.speaker", F.lit("")).alias("speaker"), "language",
    ), wrong


def read_whisper_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_whisper(corpus(spark, path))


def _clean(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"\*{1,3}(.+?)\*{1,3}", "$1"), r"_(.+?)_", "$1")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def parse_fountain(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Screenplays as (scenes, elements): headings with numbers, dialogue with speaker and parenthetical, action."""
    text = F.regexp_replace("text", "\r\n|\r", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?s)\[\[.*?\]\]", "")
    keys = "|".join(TITLE_KEYS)
    # A title page is a first block that opens with one of its keys.
    text = F.regexp_replace(text, rf"(?i)^\s*(?:{keys}):[^\n]*(?:\n[^\n]*\S[^\n]*)*", "")
    rows = _blocks(files.withColumn("text", text))
    head = F.get("lines", F.lit(0))
    forced = head.startswith(".") & ~head.startswith("..")
    is_head = forced | head.rlike(HEADING)
    bare = F.regexp_replace(head, SCENE_NUMBER, "")
    title = F.upper(_clean(F.when(forced, F.substr(bare, F.lit(2))).otherwise(bare)))
    rows = rows.withColumns({"__h": F.when(is_head, title), "__num": F.when(is_head, F.regexp_extract(head, SCENE_NUMBER, 1))})
    rest = F.when(is_head, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))
    skip = lambda s: s.rlike("^[#=>]") | ((s == F.upper(s)) & s.endswith("TO:"))
    rows = rows.withColumn("body", F.filter(rest, lambda s: ~skip(s)))
    rows = scan(rows, ["file"], ["pos"], by_line(), scene_no=running_sum(F.col("__h").isNotNull().cast("bigint")))
    cue = F.get("body", F.lit(0))
    letters = F.regexp_replace(F.regexp_replace(cue, r"\(.*?\)", ""), r"\^", "").rlike(r"\p{L}")
    is_cue = (F.size("body") >= 2) & ~cue.rlike(r"^[.!>#=~]") & (
        cue.startswith("@") | ((cue == F.upper(cue)) & ~cue.endswith("TO:") & ~cue.rlike(HEADING) & cue.rlike(CUE) & letters)
    )
    speech = F.slice("body", 2, F.size("body"))
    aside = lambda s: s.startswith("(") & s.endswith(")")
    who = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(cue), r"^@", ""), r"\^$", ""), r"\(.*?\)", " ")
    action = _clean(F.array_join(F.transform("body", lambda s: F.regexp_replace(s, "^!", "")), " "))
    full = rows.where(F.size("body") > 0).withColumn("__cue", is_cue)
    elements = full.select(
        "file", "scene_no", "pos", F.when(F.col("__cue"), "dialogue").otherwise("action").alias("kind"),
        F.when(F.col("__cue"), _clean(F.array_join(F.filter(speech, lambda s: ~aside(s)), " "))).otherwise(action).alias("text"),
        F.when(F.col("__cue"), F.upper(F.trim(F.regexp_replace(who, r"\s+", " ")))).otherwise("").alias("character"),
        F.when(F.col("__cue"), F.array_join(F.transform(F.filter(speech, aside), _clean), " ")).otherwise("").alias("parenthetical"),
    ).where((F.col("kind") == "dialogue") | (F.col("text") != ""))
    implicit = elements.where("scene_no = 0").select("file", "scene_no").distinct().select("file", "scene_no", F.lit("").alias("heading"), F.lit("").alias("number"))
    scenes = rows.where(F.col("__h").isNotNull()).select("file", "scene_no", F.col("__h").alias("heading"), F.col("__num").alias("number"))
    return scenes.unionByName(implicit), elements


def read_fountain_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_fountain(corpus(spark, path))


def parse_papercut(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checklist rows of (file, pos, line) as selects; ``## source:`` sections and the fps header carry down."""
    text = F.trim("line")
    rows = lines.where(text != "").withColumn("__t", text)
    entry = F.col("__t").rlike(ENTRY)
    section = ~entry & F.col("__t").rlike(SECTION)
    field = ~entry & ~F.col("__t").startswith("#") & F.col("__t").rlike(FIELD)
    key, value = F.lower(F.regexp_extract("__t", FIELD, 1)), F.trim(F.regexp_extract("__t", FIELD, 2))
    rows = rows.withColumns({
        "__section": F.when(section, F.trim(F.regexp_extract("__t", SECTION, 1))), "__source": F.when(field & (key == "source"), value),
        "__fps": F.when(field & (key == "fps"), value.try_cast("double")),
    })
    fps = rows.groupBy("file").agg(F.max_by("__fps", F.when(F.col("__fps").isNotNull(), F.col("pos"))).alias("fps"))
    rows = scan(rows, ["file"], ["pos"], by_line(), sec=carry_forward("__section"), src=carry_forward("__source"))
    body = F.regexp_extract("__t", ENTRY, 2)
    picks = rows.where(entry).withColumn("__b", body)
    timed = F.col("__b").rlike(SPAN)
    wrong = bad(picks, ~timed, F.lit("entry has a malformed or missing timestamp"))
    said = F.trim(F.regexp_extract("__b", SPAN, 9))
    good = picks.where(timed).withColumn("__said", said).join(fps, "file")
    spoken = F.col("__said").rlike(PAPER_SPEAKER)
    return good.select(
        "file", "pos", (F.lower(F.regexp_extract("__t", ENTRY, 1)) == "x").alias("selected"), F.coalesce("sec", "src", F.lit("")).alias("source_name"),
        _clock(F.col("__b"), SPAN, 1, True).alias("start_s"), _clock(F.col("__b"), SPAN, 5, True).alias("end_s"),
        F.when(spoken, F.trim(F.regexp_extract("__said", PAPER_SPEAKER, 1))).otherwise("").alias("speaker"),
        F.when(spoken, F.trim(F.regexp_extract("__said", PAPER_SPEAKER, 2))).otherwise(F.col("__said")).alias("text"), F.coalesce("fps", F.lit(DEFAULT_FPS)).alias("fps"),
    ), wrong


def read_papercut_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_papercut(to_lines(corpus(spark, path)))


def papercut_lines(segments: DataFrame, fps: float, key: str = "papercut_id", source: str = "take_id") -> DataFrame:
    """Transcripts as a checklist per paper edit: (key, source, seg, n, line), one section per transcript."""
    who = F.upper(F.coalesce("speaker", F.lit("")))
    text = F.when(who != "", F.concat(who, F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    tick = F.when(F.coalesce(F.col("selected"), F.lit(False)), "x").otherwise(" ") if "selected" in segments.columns else F.lit(" ")
    row = F.concat(F.lit("- ["), tick, F.lit("] ["), stamp(F.col("start_s"), "."), F.lit(" --> "), stamp(F.col("end_s"), "."), F.lit("] "), text)
    rows = segments.select(key, source, "seg", F.lit(2).alias("n"), row.alias("line"))
    first = segments.groupBy(key).agg(F.min(source).alias(source))
    none = F.lit(-1).cast("bigint").alias("seg")
    top = first.select(key, source, none, F.posexplode(F.array(
        F.concat(F.lit("# Papercut: "), F.col(key).cast("string")), F.lit(""), F.concat(F.lit("source: "), F.col(source).cast("string")), F.lit(f"fps: {fps:g}"), F.lit(""),
    )).alias("n", "line"))
    later = segments.select(key, source).distinct().join(first, [key, source], "left_anti")
    heads = later.select(key, source, none, F.posexplode(F.array(F.lit(""), F.concat(F.lit("## source: "), F.col(source).cast("string")), F.lit(""))).alias("n", "line"))
    return rows.unionByName(top).unionByName(heads)


def write_papercut_corpus(segments: DataFrame, path: str, fps: float, key: str = "papercut_id", source: str = "take_id") -> None:
    from cutlake.sources.timelines import write_lines

    write_lines(papercut_lines(segments, fps, key, source), path, key, [source, "seg", "n"])
