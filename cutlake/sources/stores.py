"""JSON stores: plans, clip reports, picture annotations, and routing by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.functions.columns import clamp
from cutlake.sources.lines import bad, corpus

# Formats, roles and limits.
PLAN_VERSION = 1
ROLES = ("opener", "build", "climax", "closer")
MAX_TAGS = 5
MARKED = r"(?i)(?:^|[^a-z0-9])(?:scene|sc|s)[ ._-]?(\d{1,4})([a-z]?)[ ._-]*(?:take|tk|t)[ ._-]?(\d{1,4})(?![0-9])"
BARE = r"(?i)^(\d{1,4})([a-z]?)\s*[-_]\s*(\d{1,4})$"
ENTRY_REQUIRED = {"clip_path": "string", "source_start": "double", "source_end": "double", "record_start": "double", "record_end": "double", "score": "double"}
ENTRY_OPTIONAL = {
    "transition": ("double", 0.0), "media_start": ("double", 0.0), "clip_duration": ("double", 0.0), "label": ("string", ""), "audio_lead": ("double", 0.0), "audio_lag": ("double", 0.0),
    "track": ("string", ""), "pinned": ("boolean", False), "peak_source": ("double", -1.0), "shot_size": ("string", ""), "reframe_focus": ("array<double>", None),
}
PLAN_SCALARS = ["music_start", "song_duration", "fade_in", "fade_out", "music_in", "music_out", "tempo"]


def parse_plans(files: DataFrame, version_key: str = "version") -> dict[str, DataFrame]:
    """Plan documents of (file, text): plans, entries, dips, gaps, phases, sfx and bad_rows.

    The version, music_path and duration are required, every other top-level field defaults. An entry with an
    unknown or missing field makes its plan malformed.
    """
    raw = F.from_json("text", "map<string, string>")
    fields = {**ENTRY_REQUIRED, **{k: v[0] for k, v in ENTRY_OPTIONAL.items()}}
    rows = files.withColumn("m", raw)
    get = lambda k: F.try_element_at("m", F.lit(k))
    entries = F.coalesce(F.from_json(get("entries"), "array<map<string, string>>"), F.array().cast("array<map<string,string>>"))
    rows = rows.withColumns({"__v": get(version_key).try_cast("int"), "__d": get("duration").try_cast("double"), "__e": entries})
    names = F.array(*[F.lit(n) for n in fields])
    needed = F.array(*[F.lit(n) for n in ENTRY_REQUIRED])
    odd = F.exists("__e", lambda e: (F.size(F.array_except(F.map_keys(e), names)) > 0) | (F.size(F.array_except(needed, F.map_keys(e))) > 0))
    problem = (
        F.when(F.col("m").isNull(), "not a JSON object").when(F.col("__v").isNull(), "the version key is missing").when(F.col("__v") != PLAN_VERSION, "unsupported plan version")
        .when(get("music_path").isNull() | F.col("__d").isNull(), "music_path and duration are required").when(odd, "malformed entry")
    )
    rows = rows.withColumns({"__bad": problem, "pos": F.lit(0)})
    good = rows.where(F.col("__bad").isNull())
    plans = good.select(
        F.col("file").alias("plan_id"), get("music_path").alias("music_path"), F.col("__d").alias("duration"),
        *[F.coalesce(get(c).try_cast("double"), F.lit(0.0)).alias(c) for c in PLAN_SCALARS], F.coalesce(F.from_json(get("notes"), "array<string>"), F.array().cast("array<string>")).alias("notes"),
    )
    each = good.select(F.col("file").alias("plan_id"), F.posexplode("__e").alias("slot", "e"))
    cell = lambda k: F.try_element_at("e", F.lit(k))
    cols = [cell(k).try_cast(t).alias(k) for k, t in ENTRY_REQUIRED.items()]
    for k, (t, default) in ENTRY_OPTIONAL.items():
        value = F.from_json(cell(k), "array<double>") if t.startswith("array") else cell(k).try_cast(t)
        cols.append((value if default is None else F.coalesce(value, F.lit(default))).alias(k))
    out = {"plans": plans, "entries": each.select("plan_id", F.col("slot").cast("bigint").alias("slot"), *cols)}
    for name, key, a, b in [("dips", "dips", "dip_start", "dip_len"), ("gaps", "music_gaps", "gap_start", "gap_end")]:
        spans = good.select(F.col("file").alias("plan_id"), F.explode(F.from_json(get(key), "array<array<double>>")).alias("x"))
        out[name] = spans.select("plan_id", F.get("x", F.lit(0)).alias(a), F.get("x", F.lit(1)).alias(b))
    phases = good.select(F.col("file").alias("plan_id"), F.posexplode(F.from_json(get("phases"), "array<array<string>>")).alias("i", "x"))
    out["phases"] = phases.select("plan_id", "i", F.get("x", F.lit(0)).cast("double").alias("span_start"), F.get("x", F.lit(1)).cast("double").alias("span_end"), F.get("x", F.lit(2)).alias("label"))
    cue = "array<struct<time: double, duration: double, kind: string, query: string, note: string, file: string, source_offset: double>>"
    out["sfx"] = good.select(F.col("file").alias("plan_id"), F.explode(F.from_json(get("sfx"), cue)).alias("c")).select(
        "plan_id", "c.time", F.col("c.duration").alias("length"), "c.kind", "c.query", "c.note", F.coalesce("c.file", F.lit("")).alias("file"), F.coalesce("c.source_offset", F.lit(0.0)).alias("source_offset")
    )
    out["bad_rows"] = bad(rows, F.col("__bad").isNotNull(), F.col("__bad"))
    return out


def read_plans(spark: SparkSession, path: str, version_key: str = "version") -> dict[str, DataFrame]:
    return parse_plans(corpus(spark, path), version_key)


MOMENT = (
    "struct<start: double, end: double, score: double, entry_motion: array<double>, exit_motion: array<double>, highlight: double, peak_time: double, label: string, "
    "tags: array<string>, role: string, hero: double, `group`: string, daylight: string, shot_size: string, entry_focus: array<double>, exit_focus: array<double>, phash: decimal(20,0), user_note: string, user_rating: int>"
)
REPORT = (
    "path string, duration double, usable_ratio double, media_start double, notes array<string>, scene_cuts array<double>, user_note string, "
    f"segments array<struct<start: double, end: double, label: string, score: double>>, moments array<{MOMENT}>"
)


def signed_hash(value: Column) -> Column:
    """An unsigned 64-bit hash as BIGINT: the same bits, so distances stay the same."""
    v = value.cast("decimal(20,0)")
    return F.when(v >= F.lit("9223372036854775808").cast("decimal(20,0)"), v - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(v).cast("bigint")


def parse_reports(files: DataFrame) -> dict[str, DataFrame]:
    """Report stores ``{path|mtime: report}`` of (file, text): clips, segments, moments and bad_rows; the newest report of a path wins.

    A store that is no object, a key without path and time and a value that is no report go to bad_rows (file, key, message).
    """
    read = files.select("file", F.from_json("text", "map<string, string>").alias("m"))
    each = read.select("file", F.explode("m").alias("key", "value"))
    cut = r"^(.*)\|([^|]*)$"
    each = each.select(
        "file", "key", F.regexp_extract("key", cut, 1).alias("path"), F.regexp_extract("key", cut, 2).try_cast("double").alias("mtime"),
        F.when(F.ltrim("value").startswith("{"), F.from_json("value", REPORT)).alias("r"),
    )
    named = F.coalesce((F.col("path") != "") & F.col("mtime").isNotNull(), F.lit(False))
    fault = F.when(~named, "malformed key").when(F.col("r").isNull(), "malformed report")
    bad = each.where(fault.isNotNull()).select("file", "key", fault.alias("message"))
    bad = bad.unionByName(read.where(F.col("m").isNull()).select("file", F.lit("").alias("key"), F.lit("malformed store").alias("message")))
    each = each.where(fault.isNull())
    newest = each.groupBy("path").agg(F.max("mtime").alias("mtime"), F.max_by("r", "mtime").alias("r"))
    n = lambda c, d: F.coalesce(c, F.lit(d))
    r = F.col("r")
    clips = newest.select(
        "path", "mtime", n(r["duration"], 0.0).alias("duration"), n(r["usable_ratio"], 0.0).alias("usable_ratio"), n(r["media_start"], 0.0).alias("media_start"),
        F.coalesce(r["notes"], F.array().cast("array<string>")).alias("notes"), F.coalesce(r["scene_cuts"], F.array().cast("array<double>")).alias("scene_cuts"), n(r["user_note"], "").alias("user_note"),
    )
    seg = newest.select("path", F.posexplode("r.segments").alias("i", "s")).select(
        "path", F.col("i").cast("bigint").alias("i"), n(F.col("s.start"), 0.0).alias("start_s"), n(F.col("s.end"), 0.0).alias("end_s"), n(F.col("s.label"), "").alias("label"), n(F.col("s.score"), 0.0).alias("score")
    )
    pair = lambda c, a, b, zero: F.when(F.size(c) == 2, F.struct(F.get(c, F.lit(0)).alias(a), F.get(c, F.lit(1)).alias(b))).otherwise(zero)
    still = F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    m = newest.select("path", F.posexplode("r.moments").alias("i", "m"))
    x = F.col("m")
    moments = m.select(
        F.col("path").alias("clip_path"), F.col("i").cast("bigint").alias("mid"), *[n(x[c], 0.0).alias(a) for c, a in (("start", "start_s"), ("end", "end_s"), ("score", "score"), ("highlight", "highlight"), ("hero", "hero"))],
        n(x["peak_time"], -1.0).alias("peak_time"), *[n(x[c], "").alias(a) for c, a in (("label", "label"), ("role", "role"), ("group", "grp"), ("daylight", "daylight"), ("shot_size", "shot_size"), ("user_note", "user_note"))],
        F.coalesce(x["tags"], F.array().cast("array<string>")).alias("tags"), pair(x["entry_motion"], "dx", "dy", still).alias("entry_motion"), pair(x["exit_motion"], "dx", "dy", still).alias("exit_motion"),
        pair(x["entry_focus"], "x", "y", None).alias("entry_focus"), pair(x["exit_focus"], "x", "y", None).alias("exit_focus"), F.coalesce(signed_hash(x["phash"]), F.lit(0).cast("bigint")).alias("phash"), n(x["user_rating"], 0).alias("user_rating"),
    )
    return {"clips": clips, "segments": seg, "moments": moments, "bad_rows": bad}


def read_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_reports(corpus(spark, path))


ANNOTATION_KEY = r"^(.*)\|([^|]*)\|([^|-]*)-([^|]*)\|([^|]*)$"


def clean_annotations(rows: DataFrame) -> DataFrame:
    """Validate annotation rows (key, label, role, hero, tags, grp); keys that cannot be read drop out."""
    key = F.regexp_replace("key", r"\|\d+f$", "")
    one = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    tags = F.array_distinct(F.filter(F.transform("tags", lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    number = lambda i: F.regexp_extract(key, ANNOTATION_KEY, i).try_cast("double")
    out = rows.select(
        F.regexp_extract(key, ANNOTATION_KEY, 1).alias("clip_path"), number(2).alias("mtime"), number(3).alias("start_s"), number(4).alias("end_s"), one(F.col("label")).alias("label"),
        F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("").alias("role"), clamp(F.coalesce(F.col("hero").try_cast("double"), F.lit(0.0)), 0.0, 1.0).alias("hero"),
        F.lower(one(F.col("grp"))).alias("grp"), F.coalesce(F.slice(tags, 1, MAX_TAGS), F.array().cast("array<string>")).alias("tags"),
    )
    return out.where((F.col("clip_path") != "") & F.col("mtime").isNotNull() & F.col("start_s").isNotNull() & F.col("end_s").isNotNull())


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    each = corpus(spark, path).select(F.explode(F.from_json("text", "map<string, string>")).alias("key", "value"))
    value = F.from_json("value", "label string, role string, hero string, tags array<string>, `group` string")
    return clean_annotations(each.withColumn("v", value).where("v is not null").select("key", "v.label", "v.role", "v.hero", "v.tags", F.col("v.group").alias("grp")))


def fresh(stored: DataFrame, inventory: DataFrame) -> DataFrame:
    """Stored results whose clip is still there and unchanged: (clip_path, mtime) equal to the inventory's."""
    return stored.join(inventory.select("clip_path", "mtime"), ["clip_path", "mtime"], "left_semi")


def pending(inventory: DataFrame, stored: DataFrame) -> DataFrame:
    """Clips of the inventory without a result for their present state."""
    return inventory.join(stored.select("clip_path", "mtime"), ["clip_path", "mtime"], "left_anti")


def scene_take(name: Column) -> Column:
    """(scene, take) from a file name; both empty when it follows no known pattern."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    hit = lambda p, s, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    marked, bare = stem.rlike(MARKED), F.trim(stem).rlike(BARE)
    get = lambda i: F.when(marked, hit(MARKED, stem, i)).when(bare, hit(BARE, F.trim(stem), i))
    scene = F.concat(get(1).cast("int").cast("string"), F.upper(F.coalesce(get(2), F.lit(""))))
    return F.struct(F.coalesce(scene, F.lit("")).alias("scene"), F.coalesce(get(3).cast("int").cast("string"), F.lit("")).alias("take"))


def scene_take_counts(files: DataFrame, name: str = "path", key: str = "folder") -> DataFrame:
    """Named takes per scene of a folder."""
    rows = files.withColumn("__s", scene_take(F.col(name))).where(F.col("__s.scene") != "")
    return rows.groupBy(key, F.col("__s.scene").alias("scene")).agg(F.count("*").alias("takes"))
