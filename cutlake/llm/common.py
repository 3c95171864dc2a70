"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white space characters; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"

#: Up to so many rows a small table is broadcast, beyond it the join shuffles on salted keys.
SMALL_ROWS = 200_000


#: Rows of an Arrow batch: texts are of any length, and a Python worker holds a batch or two at a time.
BATCH_ROWS = 400


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends whole texts to Python in batches of :data:`BATCH_ROWS` at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def others(df: DataFrame, needed: list[str], made: list[str]) -> list[str]:
    """Columns of ``df`` that pass through: neither needed nor named like a result (results win over clashing extra columns)."""
    taken = {c.lower() for c in [*needed, *made]}
    return [f"`{c}`" for c in df.columns if c.lower() not in taken and not c.startswith("__")]


def n_words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def attach(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, salts: int = 32) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` of one row per key, where a key may hold a third of the rows.

    The table is counted: up to :data:`SMALL_ROWS` it is broadcast, so the rows stay where they are. A larger one is
    repeated ``salts`` times and joined on (key, salt), so that no key lands in one task; ``spread`` is the expression
    of ``rows`` whose hash is the salt. Keys match null-safely.
    """
    table = table.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    if table.count() <= SMALL_ROWS:
        out = rows.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("__st", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = rows.withColumn("__sr", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*same, F.col("__sr") == F.col("__st")]).drop("__sr", "__st")
    return out.drop(*[f"__k_{k}" for k in keys])
