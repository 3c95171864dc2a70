"""Timeline, footage, plan and take tables derived from the generic test tables.

``VIEWS`` holds the portable SQL text of every view; the SQL checks run on it. :class:`Tables` builds the same
rows with DataFrames, using the chunked scan so that a hot user, supplier or order does not end in one task.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.functions.ordered import row_index, running_sum, scan
from cutlake.functions.staging import settle, share_out

FPS = 25.0

VIEWS = {
    "b_clips": """
select user_id as timeline_id, event_id as clip_id, case when event_id % 10 = 0 then 'V2' else 'V1' end as track,
  rec_out - len as record_in, rec_out as record_out, event_id % 400 as source_in, event_id % 400 + len as source_out,
  concat('clip_', cast(event_id % 12 as varchar(10))) as source_file, event_type as name
from (select *, cast(sum(len + gap) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) - gap as bigint) as rec_out
  from (select *, cast(floor(value * 25e-1) as bigint) + 1 as len, case when event_type = 'error' then 75 else 0 end as gap from events) a) b
""",
    "b_markers": """
select timeline_id, record_in as frame, concat('scene ', cast(clip_id as varchar(10))) as name from b_clips where name = 'signup' and track = 'V1'
""",
    "b_frames": """
select user_id as clip_id, (rn - 1) * 5e-1 as t, least(25e1, value * 15e-1) as brightness, (event_id * 7 % 40) * 1e0 as sharpness,
  case when rn = 1 then 0e0 when event_id % 97 = 0 then 12e1 else (event_id * 13 % 60) / 3e0 end as motion, case when rn = 1 then 0e0 else (event_id * 11 % 50) / 5e0 end as residual,
  (event_id % 9 - 4) * 1e0 as dx, (event_id % 5 - 2) * 1e0 as dy, (event_id % 10) / 4e1 as clipped, (event_id % 7) / 5e1 as crushed, event_id * 2654435761 as phash
from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) a
""",
    "b_audio": """
select l_suppkey as clip_id, (rn - 1) * 5e-1 as t, l_discount * 2e0 as rms, l_tax / 2e1 as clipping, l_quantity / 5e1 as low_ratio
from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rn from lineitem) a
""",
    "b_entries": """
select plan_id, slot, clip_path, source_start, source_start + len as source_end, rec_end - len as record_start, rec_end as record_end, score, transition,
  source_start + len * (l_partkey % 5) / 4e0 as peak_source, case l_partkey % 4 when 0 then 'wide' when 1 then 'medium' when 2 then 'close' else '' end as shot_size
from (select *, sum(len) over (partition by plan_id order by slot rows between unbounded preceding and current row) as rec_end
  from (select l_orderkey as plan_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) - 1 as slot,
    concat('clip_', cast(l_suppkey % 20 as varchar(10))) as clip_path, (l_partkey % 60) * 1e0 as source_start, floor(l_quantity) / 8e0 as len,
    l_discount * 1e1 as score, case when l_returnflag = 'R' then 5e-1 else 0e0 end as transition, l_partkey from lineitem) a) b
""",
    "b_moments": """
select clip_path, mid, s as start_s, s + floor(p_size / 5e0) / 2e0 + 1e0 as end_s, score, highlight, hero, role, grp, daylight, shot_size, phash
from (select concat('clip_', cast(p_partkey % 20 as varchar(10))) as clip_path, p_partkey as mid, (p_partkey % 60) * 1e0 as s, p_size, (p_size % 50) / 5e1 as score,
  (p_partkey % 4) / 4e0 as highlight, (p_partkey % 11) / 1e1 as hero, case p_partkey % 5 when 0 then 'opener' when 1 then 'build' when 2 then 'climax' when 3 then 'closer' else '' end as role,
  p_brand as grp, case p_partkey % 4 when 0 then 'day' when 1 then 'golden' when 2 then 'night' else '' end as daylight,
  case p_partkey % 3 when 0 then 'wide' when 1 then 'medium' else 'close' end as shot_size, p_partkey * 2654435761 as phash from part) a
""",
    "b_segments": """
select conv_id as take_id, turn as seg, role as speaker, text, (e - length(text)) / 15e0 as start_s, e / 15e0 as end_s
from (select *, sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and current row) as e from conversations) a
""",
    "b_annotations": """
select doc_id as mid, lang as grp, source as tag, text as label, (doc_id % 11) / 1e1 as hero, (n_chars % 100) * 1e0 as start_s from documents
""",
    "b_beats": """
select user_id as track_id, rn - 1 as i, (rn - 1) * 5e-1 + (event_id % 3) / 1e2 as t, least(1e0, value / 1e2) as energy
from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) a
""",
}

_NEEDS = {"b_markers": ["b_clips"]}


def _steady(sql: str) -> str:
    """``round(x, 6)`` written as ``round((x) + 1e-9, 6)``: halves then fall the same way in both engines."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            return "".join(out) + sql[i:]
        k, depth = j + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _steady(sql[j + 6 : k - 1])
        if inner.endswith(", 6"):
            inner = f"({inner[:-3]}) + 1e-9, 6"
        out.append(sql[i:j] + f"round({inner})")
        i = k


def oracle(views: str, body: str) -> str:
    """A complete SQL statement: the named views as CTEs, then ``body`` (CTE definitions and a select)."""
    names: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    body = _steady(body.strip())
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    if not ctes:
        return f"with {body}" if not body.lower().startswith("select") else body
    glue = "\n" if body.lower().startswith("select") else ",\n"
    return f"with {ctes}{glue}{body}"


def hours(ts: str) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 3_600_000_000)


class Tables:
    """The bridge tables of one test directory, built on first use.

    Tables that take a running value to build are written once per query, as the stored tables they stand for.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        share_out(spark, path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def clips(self) -> DataFrame:
        e = self.read("events").select("user_id", "event_id", "event_type", "ts", "value")
        e = e.withColumn("len", F.floor(F.col("value") * 2.5) + 1)
        e = e.withColumn("gap", F.when(F.col("event_type") == "error", 75).otherwise(0).cast("bigint"))
        e = scan(e, ["user_id"], ["ts", "event_id"], hours("ts"), rec=running_sum(F.col("len") + F.col("gap")))
        out = F.col("rec") - F.col("gap")
        return settle(e.select(
            F.col("user_id").alias("timeline_id"),
            F.col("event_id").alias("clip_id"),
            F.when(F.col("event_id") % 10 == 0, "V2").otherwise("V1").alias("track"),
            (out - F.col("len")).alias("record_in"),
            out.alias("record_out"),
            (F.col("event_id") % 400).alias("source_in"),
            (F.col("event_id") % 400 + F.col("len")).alias("source_out"),
            F.concat(F.lit("clip_"), F.col("event_id") % 12).alias("source_file"),
            F.col("event_type").alias("name"),
            F.lit("video").alias("kind"),
            F.lit(FPS).alias("fps"),
        ))

    @cached_property
    def markers(self) -> DataFrame:
        c = self.clips.where((F.col("name") == "signup") & (F.col("track") == "V1"))
        return c.select("timeline_id", F.col("record_in").alias("frame"), F.concat(F.lit("scene "), "clip_id").alias("name"))

    @cached_property
    def _numbered_events(self) -> DataFrame:
        e = self.read("events").select("user_id", "event_id", "ts", "value")
        return scan(e, ["user_id"], ["ts", "event_id"], hours("ts"), rn=row_index())

    @cached_property
    def frames(self) -> DataFrame:
        e, i, first = self._numbered_events, F.col("event_id"), F.col("rn") == 1
        return settle(e.select(
            F.col("user_id").alias("clip_id"),
            ((F.col("rn") - 1) * 0.5).alias("t"),
            F.least(F.lit(250.0), F.col("value") * 1.5).alias("brightness"),
            (i * 7 % 40).cast("double").alias("sharpness"),
            F.when(first, 0.0).when(i % 97 == 0, 120.0).otherwise((i * 13 % 60) / 3.0).alias("motion"),
            F.when(first, 0.0).otherwise((i * 11 % 50) / 5.0).alias("residual"),
            (i % 9 - 4).cast("double").alias("dx"),
            (i % 5 - 2).cast("double").alias("dy"),
            ((i % 10) / 40.0).alias("clipped"),
            ((i % 7) / 50.0).alias("crushed"),
            (i * 2654435761).alias("phash"),
        ))

    @cached_property
    def beats(self) -> DataFrame:
        return settle(self._numbered_events.select(
            F.col("user_id").alias("track_id"),
            (F.col("rn") - 1).alias("i"),
            ((F.col("rn") - 1) * 0.5 + (F.col("event_id") % 3) / 100.0).alias("t"),
            F.least(F.lit(1.0), F.col("value") / 100.0).alias("energy"),
        ))

    @cached_property
    def audio(self) -> DataFrame:
        line = self.read("lineitem").select(
            "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity"
        )
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
        line = scan(line, ["l_suppkey"], order, F.floor(F.col("l_orderkey") / 65536), rn=row_index())
        return settle(line.select(
            F.col("l_suppkey").alias("clip_id"),
            ((F.col("rn") - 1) * 0.5).alias("t"),
            (F.col("l_discount") * 2.0).alias("rms"),
            (F.col("l_tax") / 20.0).alias("clipping"),
            (F.col("l_quantity") / 50.0).alias("low_ratio"),
        ))

    @cached_property
    def entries(self) -> DataFrame:
        line = self.read("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"
        )
        line = line.withColumn("len", F.floor("l_quantity") / 8.0)
        order = ["l_linenumber", "l_partkey", "l_extendedprice"]
        line = scan(
            line, ["l_orderkey"], order, F.floor(F.col("l_linenumber") / 1024), rn=row_index(), rec=running_sum("len")
        )
        size = F.col("l_partkey") % 4
        start = (F.col("l_partkey") % 60).cast("double")
        return settle(line.select(
            F.col("l_orderkey").alias("plan_id"),
            (F.col("rn") - 1).alias("slot"),
            F.concat(F.lit("clip_"), F.col("l_suppkey") % 20).alias("clip_path"),
            start.alias("source_start"),
            (start + F.col("len")).alias("source_end"),
            (F.col("rec") - F.col("len")).alias("record_start"),
            F.col("rec").alias("record_end"),
            (F.col("l_discount") * 10.0).alias("score"),
            F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0).alias("transition"),
            (start + F.col("len") * (F.col("l_partkey") % 5) / 4.0).alias("peak_source"),
            F.when(size == 0, "wide").when(size == 1, "medium").when(size == 2, "close").otherwise("").alias("shot_size"),
        ))

    @cached_property
    def moments(self) -> DataFrame:
        p = F.col("p_partkey")
        role, day, size = p % 5, p % 4, p % 3
        s = (p % 60).cast("double")
        return self.read("part").select("p_partkey", "p_size", "p_brand").select(
            F.concat(F.lit("clip_"), p % 20).alias("clip_path"),
            p.alias("mid"),
            s.alias("start_s"),
            (s + F.floor(F.col("p_size") / 5.0) / 2.0 + 1.0).alias("end_s"),
            ((F.col("p_size") % 50) / 50.0).alias("score"),
            ((p % 4) / 4.0).alias("highlight"),
            ((p % 11) / 10.0).alias("hero"),
            F.when(role == 0, "opener").when(role == 1, "build").when(role == 2, "climax").when(role == 3, "closer")
            .otherwise("").alias("role"),
            F.col("p_brand").alias("grp"),
            F.when(day == 0, "day").when(day == 1, "golden").when(day == 2, "night").otherwise("").alias("daylight"),
            F.when(size == 0, "wide").when(size == 1, "medium").otherwise("close").alias("shot_size"),
            (p * 2654435761).alias("phash"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        c = self.read("conversations")
        c = scan(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024), e=running_sum(F.length("text").cast("bigint")))
        return settle(c.select(
            F.col("conv_id").alias("take_id"),
            F.col("turn").alias("seg"),
            F.col("role").alias("speaker"),
            "text",
            ((F.col("e") - F.length("text")) / 15.0).alias("start_s"),
            (F.col("e") / 15.0).alias("end_s"),
        ))

    @cached_property
    def annotations(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").alias("mid"),
            F.col("lang").alias("grp"),
            F.col("source").alias("tag"),
            F.col("text").alias("label"),
            ((F.col("doc_id") % 11) / 10.0).alias("hero"),
            (F.col("n_chars") % 100).cast("double").alias("start_s"),
        )
