"""Timeline core: shot selection, cuts, extents, overlaps and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions.intervals import range_join
from cutlake.functions.ordered import attach, carry_forward, following, previous, running_sum, scan
from cutlake.functions.timecode import seconds_to_frames

CHUNK_FRAMES = 15_000  # ten minutes at 25 fps


def by_record(frame: str = "record_in", size: int = CHUNK_FRAMES) -> Column:
    return F.floor(F.col(frame) / size)


def select_shots(clips: DataFrame, track: str | None = None, key: str = "timeline_id") -> DataFrame:
    """The rows that count as shots: an explicit track, else V1 where a timeline has one, else all video."""
    if track is not None:
        return clips.where(F.col("track") == track)
    has = clips.groupBy(key).agg(F.max(F.col("track") == "V1").alias("__v1"))
    keep = F.when(F.col("__v1"), F.col("track") == "V1").otherwise(F.col("kind") == "video")
    return attach(clips, has, [key], by_record()).where(keep).drop("__v1")


def with_seconds(shots: DataFrame) -> DataFrame:
    return shots.withColumn("start_s", F.col("record_in") / F.col("fps")).withColumn(
        "length_s", (F.col("record_out") - F.col("record_in")) / F.col("fps")
    )


def with_cut_flag(shots: DataFrame, keys: list[str]) -> DataFrame:
    """``is_cut``: the shot starts at or before the end of the one before it."""
    out = scan(shots, keys, ["record_in", "clip_id"], by_record(), __back=previous("record_out"))
    return out.withColumn("is_cut", F.coalesce(F.col("record_in") <= F.col("__back"), F.lit(False))).drop("__back")


def cuts(shots: DataFrame, keys: list[str] = ["timeline_id"]) -> DataFrame:
    return with_cut_flag(shots, keys).where("is_cut").select(*keys, F.col("record_in").alias("cut_frame"))


def timeline_extent(clips: DataFrame, timelines: DataFrame | None = None, key: str = "timeline_id") -> DataFrame:
    """Length of every timeline in frames; timelines without clips have length 0."""
    out = clips.groupBy(key).agg(F.max("record_out").alias("duration_frames"))
    if timelines is None:
        return out
    return timelines.select(key).join(out, key, "left").select(
        key, F.coalesce("duration_frames", F.lit(0).cast("bigint")).alias("duration_frames")
    )


def transcript_extent(segments: DataFrame, key: str = "take_id") -> DataFrame:
    return segments.groupBy(key).agg(F.max("end_s").alias("duration_s"), F.count("*").alias("segments"))


def transcript_text(segments: DataFrame, key: str = "take_id") -> DataFrame:
    """One text per take: its lines joined in order, empty ones kept. A take's text is one value, so it is built in one task."""
    lines = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg", F.coalesce("text", F.lit("")).alias("text")))).alias("lines"))
    return lines.select(key, F.array_join(F.col("lines.text"), "\n").alias("text"))


def overlaps(
    clips: DataFrame, keys: list[str] = ["timeline_id", "track"], span: tuple[str, str] = ("record_in", "record_out"),
    row_id: str = "clip_id", width: float = 1000.0,
) -> DataFrame:
    """Pairs of rows of one track whose half-open ranges intersect."""
    lo, hi = span
    a = clips.select(*keys, F.col(row_id).alias("a_id"), F.col(lo).alias("a_in"), F.col(hi).alias("a_out"))
    b = clips.select(*keys, F.col(row_id).alias("b_id"), F.col(lo).alias("b_in"), F.col(hi).alias("b_out"))
    pairs = range_join(a, b, keys, ("a_in", "a_out"), ("b_in", "b_out"), width)
    meets = (F.col("a_in") < F.col("b_out")) & (F.col("b_in") < F.col("a_out")) & (F.col("a_id") < F.col("b_id"))
    return pairs.where(meets).select(*keys, "a_id", "b_id")


def _pack(ranges: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Lay source ranges back to back from frame 0; every row becomes a picture and a sound clip."""
    length = F.col("source_out") - F.col("source_in")
    packed = scan(ranges.withColumn("__len", length), keys, order, chunk, record_out=running_sum("__len"))
    tracks = F.array(
        F.struct(F.lit("V1").alias("track"), F.lit("video").alias("kind")),
        F.struct(F.lit("A1").alias("track"), F.lit("audio").alias("kind")),
    )
    return (
        packed.withColumn("record_in", F.col("record_out") - F.col("__len"))
        .withColumn("__t", F.explode(tracks))
        .select(*packed.drop("__len", "record_out").columns, "record_in", "record_out", "__t.track", "__t.kind")
    )


def pack_selects(
    selects: DataFrame, handles: float = 0.0, keys: list[str] = ["papercut_id"], order: str = "pos",
    block: int = 4096,
) -> DataFrame:
    """Ticked rows in file order as a timeline; ``handles`` widens every source range, the head stops at 0."""
    picked = selects.where("selected")
    ranges = picked.select(
        *keys, order, F.trim(F.substring("text", 1, 40)).alias("name"), "source_name", "fps",
        seconds_to_frames(F.greatest(F.lit(0.0), F.col("start_s") - handles), "fps").alias("source_in"),
        seconds_to_frames(F.col("end_s") + handles, "fps").alias("source_out"),
    )
    return _pack(ranges, keys, [order], F.floor(F.col(order) / block))


def pack_assembly(
    segments: DataFrame, takes: DataFrame, handles: float = 0.5, keys: list[str] = ["plan_id"],
    order: list[str] = ["scene_no", "seg"],
) -> DataFrame:
    """Chosen take segments as a timeline; the tail handle stops at the end of the take's transcript.

    ``takes`` has (take_id, duration_s), one row per take.
    """
    joined = segments.join(takes.select("take_id", F.col("duration_s").alias("__d")), "take_id", "left")
    head = F.greatest(F.lit(0.0), F.col("start_s") - handles)
    tail = F.col("end_s") + handles
    tail = F.when(F.col("__d") > 0, F.least(tail, F.col("__d"))).otherwise(tail)
    ranges = joined.select(
        *keys, *order, "take_id", F.substring("text", 1, 40).alias("name"), "fps",
        seconds_to_frames(head, "fps").alias("source_in"),
        seconds_to_frames(F.greatest(tail, head), "fps").alias("source_out"),
    )
    return _pack(ranges, keys, order, F.col(order[0]))


def scene_markers(packed: DataFrame, keys: list[str] = ["plan_id"], scene: str = "scene_no") -> DataFrame:
    """One marker per scene at the first record frame of its material."""
    return packed.groupBy(*keys, scene).agg(F.min("record_in").alias("frame"))


def scene_spans(markers: DataFrame, extents: DataFrame, key: str = "timeline_id") -> DataFrame:
    """Markers as scenes: (scene_no, heading, start_frame, end_frame), with an opening before the first one.

    ``extents`` is the output of :func:`timeline_extent`; a timeline without markers is one scene.
    """
    numbered = scan(
        markers, [key], ["frame", "name"], by_record("frame"),
        __i=running_sum(F.lit(1).cast("bigint")), __back=previous("frame"),
    )
    first = F.col("__back").isNull()
    unnamed = F.col("name").isNull() | (F.col("name") == "")
    title = F.when(unnamed, F.concat(F.lit("Scene "), F.col("__i"))).otherwise(F.col("name"))
    scenes = numbered.select(key, F.col("frame").alias("start_frame"), title.alias("heading"), F.lit(1).alias("__k"))
    opening = numbered.where(first & (F.col("frame") > 0)).select(
        key, F.lit(0).cast("bigint").alias("start_frame"), F.lit("Opening").alias("heading"), F.lit(0).alias("__k")
    )
    whole = extents.join(markers.select(key), key, "left_anti").select(
        key, F.lit(0).cast("bigint").alias("start_frame"), F.lit("Full cut").alias("heading"), F.lit(0).alias("__k")
    )
    everything = scenes.unionByName(opening).unionByName(whole)
    everything = scan(
        everything, [key], ["start_frame", "__k", "heading"], by_record("start_frame"),
        scene_no=running_sum(F.lit(1).cast("bigint")), __next=following("start_frame"),
    )
    spans = everything.join(extents, key)
    end = F.coalesce("__next", "duration_frames")
    return spans.select(key, "scene_no", "heading", "start_frame", end.alias("end_frame"))


def as_of(
    rows: DataFrame, events: DataFrame, keys: list[str], at: str, event_at: str, carried: list[str], width: float,
    order: list[str],
) -> DataFrame:
    """Give every row the latest event at or before it, by carrying events forward over the merged series.

    ``order`` breaks ties among rows; among events at the same place the last one in ``carried`` order wins.
    """
    e = events.select(
        *keys, F.col(event_at).alias("__at"), F.lit(0).alias("__kind"),
        F.struct(F.col(event_at).alias("__event_at"), *carried).alias("__event"),
    )
    r = rows.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row"))
    both = e.unionByName(r, allowMissingColumns=True)
    both = both.withColumn("__tie", F.coalesce(F.struct(*[F.col(f"__row.{o}") for o in order]), F.lit(None)))
    both = both.withColumn("__etie", F.struct(*[F.col(f"__event.{c}") for c in carried]))
    filled = scan(
        both, keys, ["__at", "__kind", "__etie", "__tie"], F.floor(F.col("__at") / width), __last=carry_forward("__event")
    )
    return filled.where("__kind = 1").select(
        "__row.*", *[F.col(f"__last.{c}").alias(c) for c in carried], F.col("__last.__event_at").alias(event_at)
    )
