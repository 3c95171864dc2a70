"""Quality rules for take transcripts, judged per take and per host folder.

A take has its own measures (words, symbols, repeated lines and word windows). Rules on them fail or pass; failures are
counted per host (the source a take came from), the rates are shrunk towards all hosts' with a beta prior fitted to
the hosts themselves, and a host whose shrunk rate is too high takes its takes with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cutlake.functions.staging import settle
from cutlake.llm.common import attach, others, small_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five measures of one text, in the order of :data:`MEASURES`; all zero for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeats = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen, covered = Counter(windows), bytearray(n)
            for i, window in enumerate(windows):
                if seen[window] > 1:
                    covered[i : i + 3] = b"\x01\x01\x01"
            repeats = sum(covered)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


@F.pandas_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")


def take_measures(takes: DataFrame) -> DataFrame:
    """``takes`` (text and any further columns) with the measures of every whole text and ``base_failed``.

    ``base_failed``: fewer than 50 words, or more than half of the words stand in three-word windows that the text
    repeats. Null and empty texts have zero words and fail. Extra columns named like a result are replaced.
    """
    made = [*MEASURES, "base_failed"]
    takes = small_batches(takes)
    out = takes.select("text", *others(takes, ["text"], made), _measures("text").alias("__m"))
    out = out.select("text", *others(out, ["text"], made), *[F.col(f"__m.{m}").alias(m) for m in MEASURES])
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def rule_failures(noise: float) -> dict[str, Column]:
    """The rules that count against a host."""
    return {
        "short": F.col("n_words") < 50,
        "repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * 50,
        "noise": F.col("n_symbols") > F.col("n_words") * F.lit(noise),
    }


def host_verdicts(measured: DataFrame, noise: float = 1.0, max_rate: float = 0.75) -> DataFrame:
    """One row per ``source_name``: takes, failures of each rule, of any rule, shrunk rate ``host_rate``, ``host_failed``.

    The beta prior comes from the hosts' own rates by the method of moments: mean m, and variance v less the sampling
    variance expected at each host's size, give the prior strength m(1-m)/v - 1, held within 1 and 10,000. Hosts that
    differ no more than chance would get the full 10,000. A small host is thus judged mostly by the mean of all, a
    large one by itself. Null is a host of its own. No takes: no rows.
    """
    rules = rule_failures(noise)
    flags = measured.select("source_name", *[c.cast("bigint").alias(f"{k}_fails") for k, c in rules.items()])
    counts = flags.groupBy("source_name").agg(
        F.count("*").alias("n_takes"), *[F.sum(f"{k}_fails").alias(f"{k}_fails") for k in rules],
        F.sum(F.greatest(*[f"{k}_fails" for k in rules])).alias("fails"),
    )
    counts = settle(counts)
    rate = F.col("fails") / F.col("n_takes")
    # One row: sums over all hosts.
    row = counts.agg(
        F.avg(rate).alias("m"), F.avg(rate * rate).alias("m2"), F.avg(F.lit(1.0) / F.col("n_takes")).alias("inv"),
    ).first()
    mean = row["m"] or 0.0
    chance = mean * (1 - mean)
    spread = (row["m2"] or 0.0) - mean * mean - chance * (row["inv"] or 0.0)
    strength = min(10_000.0, max(1.0, chance / spread - 1)) if spread > 1e-12 else 10_000.0
    shrunk = (F.col("fails") + F.lit(mean * strength)) / (F.col("n_takes") + F.lit(strength))
    return counts.withColumn("host_rate", F.round(shrunk, 6)).withColumn("host_failed", F.col("host_rate") > max_rate)


def judge_takes(takes: DataFrame, noise: float = 1.0, max_rate: float = 0.75) -> DataFrame:
    """Every take with its measures, ``base_failed``, its host's ``host_rate`` and the verdict ``kept``.

    ``takes``: source_name (the host), text, and any further columns, which pass through (unless named like a result).
    A take is kept if it passes its own base rules and its host is not rejected. Repeated rows are judged each.
    """
    made = [*MEASURES, "base_failed", "host_rate", "kept"]
    measured = take_measures(takes.select("source_name", "text", *others(takes, ["source_name", "text"], made)))
    light = settle(measured.select("source_name", *MEASURES))
    verdicts = host_verdicts(light, noise, max_rate).select("source_name", "host_rate", F.col("host_failed").alias("__failed"))
    out = attach(measured, verdicts, ["source_name"], F.struct(*[F.col(m) for m in MEASURES], F.length("text")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("__failed")).drop("__failed")
