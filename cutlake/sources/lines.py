"""Text corpora as rows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_CHUNK = 4096


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a folder: (file, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("text")
    )


def to_lines(files: DataFrame) -> DataFrame:
    """(file, text) as (file, pos, line), positions from 1."""
    rows = files.select("file", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))
    return rows.select("file", (F.col("pos") + 1).cast("bigint").alias("pos"), "line")


def by_line() -> Column:
    return F.floor(F.col("pos") / LINES_PER_CHUNK)


def bad(df: DataFrame, where: Column, message: Column) -> DataFrame:
    """Rows a reader cannot use: (file, pos, message)."""
    return df.where(where).select("file", F.col("pos").cast("bigint").alias("pos"), message.alias("message"))
