"""Continuous fold of an append-only log to its latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.snapshots import publish_layer


def fold_stream(
    spark: SparkSession,
    log_path: str,
    schema: T.StructType,
    table_root: str,
    checkpoint: str,
    *,
    key: Sequence[str],
    sequence: str,
    kind: str | None = None,
    file_format: str = "json",
):
    """Start the fold over the files of ``log_path``; restarts resume.

    Each micro-batch publishes a layer with the latest rows of its own keys;
    the table is not read for it. A replayed batch gives the same rows, so
    at-least-once delivery is enough. ``snapshots.read_current`` merges the
    layers, and every few batches they are folded into one.
    """
    source = spark.readStream.schema(schema).format(file_format).load(log_path)
    if kind is not None:
        source = source.where(F.col("type") == kind)

    def apply(batch: DataFrame, _epoch: int) -> None:
        publish_layer(batch, table_root, key, sequence)

    return (
        source.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
