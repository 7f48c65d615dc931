"""Global row numbers that never gather the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import pinned


def dense_index(df: DataFrame, order: Sequence[Column], alias: str, start: int = 0) -> DataFrame:
    """Adds ``alias`` = start, start+1, ... in the given total order.

    A range sort spreads rows over partitions (ties are split by later keys,
    so one hot leading value does no harm). The sorted rows are pinned by a
    reliable checkpoint because range bounds come from a sample and could
    differ between two evaluations. Each partition is then numbered from its
    own counter plus the count of rows before it; the offsets table has one
    row per partition.
    """
    ordered = pinned(df.orderBy(*order))
    # monotonically_increasing_id = partition << 33 | row number in partition
    local = ordered.select("*", F.monotonically_increasing_id().alias("_mid"))
    partition = F.shiftright("_mid", 33)
    counts = local.groupBy(partition.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    row = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = local.withColumn("_pid", partition).join(F.broadcast(offsets), "_pid")
    return numbered.withColumn(
        alias, (row + F.col("_off") + F.lit(start)).cast("bigint")
    ).drop("_mid", "_pid", "_off")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    ``min_by`` over a struct combines on the map side, so a key holding most
    of the rows shrinks to one row per task before the shuffle; a window would
    sort all of it in one task. Order columns must be ascending and not null.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*key, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, key: Sequence[str], sequence: str) -> DataFrame:
    """Last row per key by an explicit, unique sequence column."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def top_rank(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key; Spark adds a per-task group limit first."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def index_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], alias: str
) -> DataFrame:
    """0-based place of each row inside its group, whatever the group sizes.

    Numbers the whole table by (group, order) and subtracts the group's first
    number, so a group holding most rows is still sorted by many tasks.
    """
    numbered = dense_index(df, [*[F.col(g) for g in group], *order], "_i")
    first = numbered.groupBy(*group).agg(F.min("_i").alias("_first"))
    return numbered.join(first, list(group)).withColumn(
        alias, F.col("_i") - F.col("_first")
    ).drop("_i", "_first")
