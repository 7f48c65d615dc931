"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: A word is a run of bytes other than blank and the ASCII separators 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lowers the rows per Arrow batch, so that a batch of long texts stays small.

    Spark reads this setting when a plan starts, after the operator has
    returned, so the lower value stays in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the decimal digits of an id; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary"))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession, size: int, each: int = 128 << 20) -> int:
    """Tasks for an exchange fed by ``size`` bytes: the session's number, or one per ``each`` bytes if that is more."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def bucketed(df: DataFrame, key: str, buckets: int = 0) -> DataFrame:
    """Writes ``df`` once in the shared folder, bucketed by ``key``.

    Joins on the key then move the other side only. The table keeps a name of
    its own in the session's catalogue. Without ``buckets`` their number is the
    session's number of shuffle partitions.
    """
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    buckets = buckets or partitions(spark, 0)
    df.write.bucketBy(buckets, key).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)
