"""Edit decision lists and XML timelines in and out.

Readers return (rows, bad_rows): what cannot be read comes back with a message instead of stopping the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.functions.ordered import carry_forward, row_index, scan
from cutlake.functions.timecode import frames_to_tc, is_drop_frame_rate, tc_to_frames
from cutlake.sources.lines import by_line, corpus, to_lines, bad

# Line formats.
FROM_NAME, TO_NAME = r"(?i)^\*\s*FROM CLIP NAME:\s*(.+?)\s*$", r"(?i)^\*\s*TO CLIP NAME:\s*(.+?)\s*$"
CHANNEL = r"^(V|AA?|A\d+|B|NONE)(/(V|AA?|A\d+|B|NONE))*$"


def parse_edl(lines: DataFrame, fps: float) -> tuple[DataFrame, DataFrame]:
    """Event lines of (file, pos, line) as clips; name comments belong to the event line before them."""
    text = F.trim("line")
    parts = F.split(text, r"\s+")
    rows = lines.where(text != "").withColumns({"__t": text, "__p": parts})
    rows = rows.withColumn("__event", F.get("__p", F.lit(0)).rlike(r"^\d+$") & ~F.col("__t").rlike(r"(?i)^(TITLE:|FCM:|\*)"))
    n = F.size("__p")
    cut = F.upper(F.get("__p", F.lit(3))) == "C"
    rows = scan(rows, ["file"], ["pos"], by_line(), event_pos=carry_forward(F.when(F.col("__event"), F.col("pos"))))
    named = rows.where(~F.col("__event") & F.col("event_pos").isNotNull()).select(
        "file", "event_pos", "pos", F.nullif(F.regexp_extract("__t", FROM_NAME, 1), F.lit("")).alias("f"), F.nullif(F.regexp_extract("__t", TO_NAME, 1), F.lit("")).alias("t")
    )
    names = named.groupBy("file", "event_pos").agg(
        F.max_by("f", F.when(F.col("f").isNotNull(), F.col("pos"))).alias("__from"), F.max_by("t", F.when(F.col("t").isNotNull(), F.col("pos"))).alias("__to")
    )
    events = rows.where("__event").withColumn("__n", n)
    tc = lambda back: tc_to_frames(F.get("__p", F.col("__n") - back), F.lit(fps))
    events = events.withColumns({"source_in": tc(4), "source_out": tc(3), "record_in": tc(2), "record_out": tc(1), "__channel": F.upper(F.get("__p", F.lit(2)))})
    fields = F.col("__n").isin(8, 9)
    codes = F.col("source_in").isNotNull() & F.col("source_out").isNotNull() & F.col("record_in").isNotNull() & F.col("record_out").isNotNull()
    known = F.col("__channel").rlike(CHANNEL)
    empty = F.col("record_out") <= F.col("record_in")
    wrong = bad(events, ~fields, F.concat(F.lit("malformed event line: expected 8 or 9 fields, got "), F.col("__n").cast("string"))).unionByName(
        bad(events, fields & ~codes, F.lit("invalid timecode in event line"))
    ).unionByName(bad(events, fields & codes & ~empty & ~known, F.concat(F.lit("unrecognized channel field "), F.col("__channel"))))
    good = events.where(fields & codes & ~empty & known).join(names, ["file", "event_pos"], "left")
    pair = lambda kind, track: F.struct(F.lit(kind).alias("kind"), F.lit(track).alias("track") if isinstance(track, str) else track.alias("track"))

    def target(part: Column) -> Column:
        none = F.array().cast("array<struct<kind:string,track:string>>")
        return (
            F.when(part == "V", F.array(pair("video", "V1"))).when(part == "A", F.array(pair("audio", "A1")))
            .when(part == "AA", F.array(pair("audio", "A1"), pair("audio", "A2"))).when(part == "B", F.array(pair("video", "V1"), pair("audio", "A1")))
            .when(part == "NONE", none).otherwise(F.array(pair("audio", part)))
        )

    targets = F.array_distinct(F.flatten(F.transform(F.split("__channel", "/"), target)))
    reel = F.get("__p", F.lit(1))
    name = F.coalesce(F.when(~cut, F.col("__to")), F.col("__from"), reel)
    clips = good.withColumns({"__x": F.explode(targets), "__cut": cut}).select(
        "file", "pos", F.get("__p", F.lit(0)).cast("bigint").alias("event"), F.col("__x.kind").alias("kind"), F.col("__x.track").alias("track"), name.alias("name"),
        reel.alias("source_name"), "source_in", "source_out", "record_in", "record_out",
        F.when(~F.col("__cut"), F.upper(F.get("__p", F.lit(3)))).alias("transition"),
        F.when(~F.col("__cut") & (F.col("__n") == 9), F.get("__p", F.lit(4)).try_cast("bigint")).alias("transition_frames"),
    )
    return clips, wrong


def read_edl_corpus(spark: SparkSession, path: str, fps: float) -> tuple[DataFrame, DataFrame]:
    if fps <= 0:
        raise ValueError("fps must be positive: edit decision lists do not carry a frame rate")
    return parse_edl(to_lines(corpus(spark, path)), fps)


def as_clips(rows: DataFrame, fps: float | None = None) -> DataFrame:
    """Reader rows as the clip table the timeline operators take: one timeline per file, an id per clip."""
    out = rows.withColumnRenamed("file", "timeline_id")
    out = out.withColumn("clip_id", F.xxhash64("timeline_id", "kind", "track", "record_in", "record_out", "source_in", "name"))
    return out if fps is None else out.withColumn("fps", F.lit(float(fps)))


def edl_titles(lines: DataFrame) -> DataFrame:
    title = F.nullif(F.regexp_extract("line", r"(?i)^\s*TITLE:\s*(.*?)\s*$", 1), F.lit(""))
    return lines.where(title.isNotNull()).groupBy("file").agg(F.min_by(title, "pos").alias("title"))


def edl_lines(clips: DataFrame, fps: float, key: str = "timeline_id") -> DataFrame:
    """Clips as the lines of one list per timeline: (key, event, line_no, line).

    ``clips`` may carry transition, transition_frames and media_start_s. A dissolve whose predecessor on the same
    track ends at its start becomes a pair of lines under one number.
    """
    have = set(clips.columns)
    get = lambda c, default: F.col(c) if c in have else default
    shift = F.bround(F.greatest(F.coalesce(get("media_start_s", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) * fps).cast("bigint")
    c = clips.withColumns({"__shift": shift, "__sound": F.when(F.col("kind") == "video", 0).otherwise(1), "source_name": get("source_name", F.col("name"))})
    c = scan(c, [key], ["record_in", "__sound", "track", "clip_id"], F.floor(F.col("record_in") / 15_000), event=row_index())
    frames = F.when(F.upper(F.coalesce(get("transition", F.lit("")), F.lit(""))).isin("D", "DISSOLVE"), F.coalesce(get("transition_frames", F.lit(0)), F.lit(0))).otherwise(0)
    c = c.withColumn("__d", F.greatest(frames, F.lit(0)))
    reel = F.substring(F.regexp_replace(F.upper(F.replace(F.coalesce(F.nullif("source_name", F.lit("")), "name"), F.lit(" "), F.lit("_"))), "[^A-Z0-9_]", ""), 1, 8)
    c = c.withColumn("__reel", F.when(reel == "", "AX").otherwise(reel))
    number = F.regexp_extract(F.upper("track"), r"^A(\d+)$", 1)
    c = c.withColumn("__ch", F.when(F.col("kind") == "video", "V").when((number != "") & (number != "1"), F.concat(F.lit("A"), number)).otherwise("A"))
    back = c.groupBy(key, "kind", "track", F.col("record_out").alias("record_in")).agg(
        F.min(F.struct("event", "clip_id", "__reel", (F.col("source_out") + F.col("__shift")).alias("out"), F.coalesce(F.nullif("name", F.lit("")), "source_name").alias("name"))).alias("__o")
    )
    c = c.join(back, [key, "kind", "track", "record_in"], "left").withColumn("__pair", (F.col("__d") > 0) & F.coalesce(F.col("__o.clip_id") != F.col("clip_id"), F.lit(False)))
    tc = lambda f: frames_to_tc(f, F.lit(fps))
    codes = lambda *fs: F.concat_ws(" ", *[tc(f) for f in fs])
    num = F.when(F.col("event") < 1000, F.lpad(F.col("event").cast("string"), 3, "0")).otherwise(F.col("event").cast("string"))
    pad = lambda s, n: F.when(F.length(s) < n, F.rpad(s, n, " ")).otherwise(s)
    head = lambda r: F.concat(num, F.lit("  "), pad(r, 8), F.lit(" "), pad(F.col("__ch"), 5))
    own = codes(F.col("source_in") + F.col("__shift"), F.col("source_out") + F.col("__shift"), F.col("record_in"), F.col("record_out"))
    tail = codes(F.col("__o.out"), F.col("__o.out"), F.col("record_in"), F.col("record_in"))
    full = F.coalesce(F.nullif("name", F.lit("")), F.col("source_name"))
    named = lambda tag, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"* {tag} CLIP NAME: "), v))
    plain = F.array(F.concat(head(F.col("__reel")), F.lit(" C        "), own), named("FROM", full))
    pair = F.array(
        F.concat(head(F.col("__o.__reel")), F.lit(" C        "), tail),
        F.concat(head(F.col("__reel")), F.lit(" D    "), F.lpad(F.col("__d").cast("string"), 3, "0"), F.lit(" "), own), named("FROM", F.col("__o.name")), named("TO", full),
    )
    rows = c.select(key, "event", F.posexplode(F.array_compact(F.when(F.col("__pair"), pair).otherwise(plain))).alias("n", "line"))
    drop = is_drop_frame_rate(F.lit(fps))
    top = clips.select(key).distinct().select(
        key, F.lit(0).cast("bigint").alias("event"),
        F.posexplode(F.array(F.concat(F.lit("TITLE: "), F.col(key).cast("string")), F.concat(F.lit("FCM: "), F.when(drop, "DROP FRAME").otherwise("NON-DROP FRAME")), F.lit(""))).alias("n", "line"),
    )
    return top.unionByName(rows).select(key, "event", F.col("n").cast("bigint").alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str, key: str, order: list[str]) -> None:
    """One folder of text per key, its lines in order; a timeline is written by one task as one file."""
    lines.repartition(key).sortWithinPartitions(key, *order).select(key, F.col("line").alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def write_edl_corpus(clips: DataFrame, path: str, fps: float, key: str = "timeline_id") -> None:
    write_lines(edl_lines(clips, fps, key), path, key, ["event", "line_no"])


ITEM = "_ref string, _name string, _offset string, _duration string, _start string, _lane string"
KINDS = ["asset-clip", "clip", "video", "audio", "ref-clip", "gap"]
INNER = ", ".join(f"`{k}`: array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ITEM.split(', '))}>>" for k in KINDS)
OUTER = ", ".join(f"`{k}`: array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ITEM.split(', '))}, {INNER}>>" for k in KINDS)
SEQUENCE = f"_format string, spine struct<{OUTER}>"
RESOURCES = (
    "format array<struct<_id: string, _frameDuration: string, _width: int, _height: int>>, "
    "asset array<struct<_id: string, _name: string, _start: string, _hasVideo: string, _hasAudio: string, _src: string>>"
)


def rational(value: Column) -> Column:
    """``n/ds`` or ``x.ys`` as an exact (num, den); a missing value is 0."""
    v = F.regexp_replace(F.coalesce(F.trim(value), F.lit("0s")), "s$", "")
    parts = F.split(v, "/")
    whole = F.split(v, r"\.")
    digits = F.coalesce(F.get(whole, F.lit(1)), F.lit(""))
    plain = F.struct(F.concat(F.get(whole, F.lit(0)), digits).try_cast("bigint").alias("num"), F.pow(F.lit(10), F.length(digits)).cast("bigint").alias("den"))
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).try_cast("bigint").alias("num"), F.get(parts, F.lit(1)).try_cast("bigint").alias("den"))).otherwise(plain)


def _plus(a: Column, b: Column, sign: int = 1) -> Column:
    """Sum of two rationals, as exact decimals."""
    wide = lambda c: c.cast("decimal(38,0)")
    same = a["den"] == b["den"]
    return F.struct(
        F.when(same, wide(a["num"]) + sign * wide(b["num"])).otherwise(wide(a["num"] * b["den"]) + sign * wide(b["num"] * a["den"])).cast("bigint").alias("num"),
        F.when(same, a["den"]).otherwise(a["den"] * b["den"]).alias("den"),
    )


def _frames(value: Column, frame: Column) -> Column:
    """value ÷ frame duration, half to even: one integer division."""
    n, d = value["num"] * frame["den"], value["den"] * frame["num"]
    rest = F.pmod(n, d)
    floor = ((n - rest) / d).cast("bigint")
    return floor + F.when(rest * 2 > d, 1).when((rest * 2 == d) & (floor % 2 != 0), 1).otherwise(0)


def parse_fcpxml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spine elements and one level of connected lanes of (file, text) as clips, in exact rational time."""
    part = lambda tag: F.regexp_extract("text", rf"(?s)<{tag}[\s>].*</{tag}>", 0)
    rows = files.withColumns({"__seq": part("sequence"), "__res": part("resources")})
    rows = rows.withColumns({"s": F.from_xml("__seq", SEQUENCE), "r": F.from_xml("__res", RESOURCES)})
    formats = F.coalesce("r.format", F.array().cast("array<struct<_id:string,_frameDuration:string,_width:int,_height:int>>"))
    timed = F.filter(formats, lambda f: f["_frameDuration"].isNotNull())
    own = F.filter(timed, lambda f: f["_id"] == F.col("s._format"))
    chosen = F.when(F.size(own) > 0, F.get(own, F.lit(0))).when(F.size(timed) == 1, F.get(timed, F.lit(0)))
    rows = rows.withColumn("frame", rational(chosen["_frameDuration"])).withColumn("__ok", chosen.isNotNull())
    root = F.col("text").rlike(r"<fcpxml[\s>]")
    problems = [
        (~root, "root element is not fcpxml"), (root & (F.col("__seq") == ""), "no sequence element"), (root & (F.col("__seq") != "") & ~F.col("__ok"), "no matching format with a frame duration"),
    ]
    pos = rows.withColumn("pos", F.lit(0))
    wrong = None
    for test, text in problems:
        piece = bad(pos, test, F.lit(text))
        wrong = piece if wrong is None else wrong.unionByName(piece)
    good = rows.where(root & (F.col("__seq") != "") & F.col("__ok"))
    assets = good.select("file", F.explode("r.asset").alias("a")).select(
        "file", F.col("a._id").alias("ref"), F.col("a._name").alias("asset_name"), rational(F.col("a._start")).alias("asset_start"),
        (F.col("a._hasVideo") == "1").alias("has_video"), (F.col("a._hasAudio") == "1").alias("has_audio"), F.col("a._src").alias("source_file"),
    )
    def element(e: Column, tag: str, inner: list[str]) -> Column:
        fields = [F.lit(tag).alias("tag"), *[e[f"_{n}"].alias(n) for n in ("ref", "name", "offset", "duration", "start", "lane")]]
        if inner:
            fields.append(gathered(lambda k: e[k], inner, []).alias("children"))
        return F.struct(*fields)

    def gathered(read, kinds: list[str], inner: list[str]) -> Column:
        def listed(k: str) -> Column:
            return F.transform(read(k), lambda e: element(e, k, inner))

        lists = [listed(k) for k in kinds]
        kind = "struct<tag:string,ref:string,name:string,offset:string,duration:string,start:string,lane:string"
        kind = f"array<{kind}>>" if not inner else f"array<{kind},children:array<{kind}>>>>"
        return F.concat(*[F.coalesce(a, F.array().cast(kind)) for a in lists])

    outer = good.select("file", "frame", F.explode(gathered(lambda k: F.col("s.spine")[k], KINDS, KINDS[:-1])).alias("e")).select("file", "frame", "e.*")
    outer = outer.withColumns({"record": rational(F.col("offset")), "start": rational(F.col("start")), "duration": rational(F.col("duration"))})
    child = outer.select("file", "frame", "record", F.col("start").alias("p_start"), F.explode("children").alias("c")).where(F.col("c.lane").isNotNull())
    child = child.select("file", "frame", "record", "p_start", "c.*").withColumns(
        {"offset": rational(F.col("offset")), "start": rational(F.col("start")), "duration": rational(F.col("duration"))}
    )
    at = _plus(F.col("record"), _plus(F.col("offset"), F.col("p_start"), -1))
    cols = ["file", "frame", "tag", "ref", F.col("name").alias("el_name"), "duration", "start", "record", "lane"]
    clips = outer.where("tag <> 'gap'").select(*cols).unionByName(child.withColumn("record", at).select(*cols))
    c = clips.join(assets, ["file", "ref"], "left").withColumn("lane", F.coalesce(F.col("lane").try_cast("int"), F.lit(0)))
    zero = F.struct(F.lit(0).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"))
    c = c.withColumn("shift", F.coalesce("asset_start", zero))
    c = c.withColumns({"until": _plus(F.col("record"), F.col("duration")), "inside": _plus(F.col("start"), F.col("shift"), -1)})
    unknown = F.col("asset_name").isNull() & F.col("has_video").isNull()
    video = F.coalesce("has_video", unknown) | ~F.coalesce("has_audio", F.lit(False)) & ~F.coalesce("has_video", F.lit(False))
    sound = F.coalesce("has_audio", F.lit(False))
    both = F.array_compact(F.array(F.when(video, F.lit("video")), F.when(sound, F.lit("audio"))))
    kinds = F.when(F.col("tag") == "audio", F.array(F.lit("audio"))).when(F.col("tag") != "asset-clip", F.array(F.lit("video"))).when(
        F.col("lane") < 0, F.array(F.lit("audio"))
    ).otherwise(both)
    c = c.withColumns({
        "record_in": _frames(F.col("record"), F.col("frame")), "record_out": _frames(F.col("until"), F.col("frame")),
        "source_in": _frames(F.col("inside"), F.col("frame")), "kind": F.explode(kinds),
    })
    lane = F.col("lane")
    track = F.when(
        F.col("kind") == "audio", F.concat(F.lit("A"), F.when(lane == 0, 1).otherwise(F.greatest(F.lit(1), F.when(lane < 0, -lane).otherwise(lane + 1))).cast("string"))
    ).otherwise(F.concat(F.lit("V"), F.when(lane > 0, lane + 1).otherwise(1).cast("string")))
    name = F.coalesce(F.nullif("el_name", F.lit("")), F.nullif("asset_name", F.lit("")), "tag")
    out = c.select(
        "file", name.alias("name"), track.alias("track"), "kind", "source_in", (F.col("source_in") + F.col("record_out") - F.col("record_in")).alias("source_out"),
        "record_in", "record_out", F.coalesce(F.nullif("asset_name", F.lit("")), name).alias("source_name"), "source_file",
        F.when(F.col("asset_start.num") > 0, F.col("asset_start.num") / F.col("asset_start.den")).alias("media_start_s"), (F.col("frame.den") / F.col("frame.num")).alias("fps"),
    )
    return out, wrong


def read_fcpxml_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_fcpxml(corpus(spark, path))
