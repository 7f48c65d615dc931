"""JSON-lines and run-document readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORRUPT = "_corrupt_record"


class CorruptInput(ValueError):
    """A line could not be parsed against its schema."""


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parsed lines plus the text of bad ones; blank lines vanish.

    Lines are parsed as a column: the JSON source would judge a line only by
    the columns a query happens to read.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(parsed.alias("_line")).select("_line.*")


def numbered_bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, last_line, text) of each unparseable line.

    A line's place is its file block and its order inside the split. Only bad
    lines are joined to per-block line counts, so nothing is sorted globally.
    """
    probe = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("text"),
    )
    blocks = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )
    parsed = F.from_json("text", probe, {"columnNameOfCorruptRecord": CORRUPT})
    bad = lines.where((F.trim("text") != "") & parsed[CORRUPT].isNotNull())
    earlier = blocks.alias("e")
    here = bad.join(blocks.drop("n"), ["file", "block"]).alias("b")
    placed = (
        here.join(earlier, F.col("b.file") == F.col("e.file"))
        .groupBy("b.file", "b.block", "b.seq", "b.text", "b.first_seq")
        .agg(
            F.sum(F.when(F.col("e.block") < F.col("b.block"), F.col("e.n")).otherwise(0)).alias("before"),
            F.sum("e.n").alias("total"),
        )
    )
    line = F.col("before") + F.col("seq") - F.col("first_seq") + 1
    return placed.select(
        "file", line.alias("line"), (line == F.col("total")).alias("last_line"), "text"
    )


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every non-blank line must parse; otherwise raise, naming the first bad line."""
    frame = read_lines(spark, path, schema)
    if frame.where(F.col(CORRUPT).isNotNull()).select(CORRUPT).head(1):
        first = numbered_bad_lines(spark, path, schema).orderBy("file", "line").head()
        raise CorruptInput(f"invalid JSON line at {first['file']}:{first['line']}")
    return frame.drop(CORRUPT)


def read_tolerant(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """(good rows, one-row count of dropped lines) for append-only state."""
    frame = read_lines(spark, path, schema)
    good = frame.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    dropped = frame.select(F.count_if(F.col(CORRUPT).isNotNull()).alias("dropped_lines"))
    return good, dropped


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerates a torn final line per file; a bad line elsewhere raises."""
    frame = read_lines(spark, path, schema)
    if frame.where(F.col(CORRUPT).isNotNull()).select(CORRUPT).head(1):
        inner = (
            numbered_bad_lines(spark, path, schema)
            .where(~F.col("last_line"))
            .orderBy("file", "line")
            .head()
        )
        if inner:
            raise CorruptInput(f"invalid JSON line at {inner['file']}:{inner['line']}")
    return frame.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_run_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One nested document per file, e.g. album + import run; a broken file fails the read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
