"""Written intermediate tables: they cut lineage where several branches of a plan reuse one result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Input bytes for each shuffle partition, and bytes of shuffled rows a task is given. Both count compressed rows, which a task may sort several times.
PARTITION_BYTES, TASK_BYTES = 8 << 20, 16 << 20


def share_out(spark: SparkSession, path: str) -> None:
    """Let the number of shuffle partitions follow the size of the tables under ``path``, so that a task's share does not grow with them.

    The session's own number is raised where it is too small, never lowered; what turns out to be little is put together by Spark again.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    if size // PARTITION_BYTES > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(size // PARTITION_BYTES))
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "67108864b":  # Spark's default: nobody has chosen a size
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else a folder of the warehouse, which is shared as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of it.

    Branches that use the result read only the columns they need, and a lost executor costs a re-read instead
    of a recomputation of everything upstream.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Remove every stage this application has written; call it when no result that reads them is needed any more."""
    jvm, folder = spark.sparkContext._jvm, shared_folder(spark)
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/stage-{spark.sparkContext.applicationId}-*")) or []:
        fs.delete(found.getPath(), True)
