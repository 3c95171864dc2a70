"""Words, normalisation and similarity of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions.columns import col

# Filler sounds dropped before lines are compared; shortest word part that may match as a prefix.
FILLERS = ("uh", "um", "äh", "ähm", "eh", "hm")
MIN_PREFIX = 3
WORD = r"[\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """Lower-cased words: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def normalize(text: str | Column) -> Column:
    """Lower case, punctuation to spaces, filler sounds removed, one space between words."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.filter(parts, lambda w: ~w.isin(*FILLERS) & (w != "")), " ")


def levenshtein_ratio(a: str | Column, b: str | Column) -> Column:
    """1 − edit distance over the longer length; 0 when either side is empty."""
    x, y = F.length(col(a)), F.length(col(b))
    return F.when((x > 0) & (y > 0), 1 - F.levenshtein(col(a), col(b)) / F.greatest(x, y)).otherwise(F.lit(0.0))


def prefix_matches(tokens: DataFrame, vocabulary: DataFrame, keys: list[str] = []) -> DataFrame:
    """Pairs (token, word) where one is a prefix of the other, the shorter at least three letters, or both are equal.

    Both sides are distinct lists of words; they meet on their first three letters, so no word is compared with
    the whole vocabulary.
    """
    t = tokens.select(*keys, "token").distinct().withColumn("__k", F.substring("token", 1, MIN_PREFIX))
    v = vocabulary.select(*keys, "word").distinct().withColumn("__k", F.substring("word", 1, MIN_PREFIX))
    pairs = t.join(v, [*keys, "__k"])
    a, b = F.col("token"), F.col("word")
    long_a, long_b = F.length(a) >= MIN_PREFIX, F.length(b) >= MIN_PREFIX
    hit = (a == b) | (long_a & F.startswith(b, a)) | (long_b & F.startswith(a, b))
    return pairs.where(hit).select(*keys, "token", "word")
