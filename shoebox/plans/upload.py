"""Upload planning: what is already there, what is still pending."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import upload_fingerprint
from ..operators.numbering import keep_last


def uploaded(ledger: DataFrame, *, account_id: str, profile: str, bucket: str, bucket_created_at: str) -> DataFrame:
    """Latest fingerprint per object for exactly this target."""
    ours = ledger.where(
        (F.col("type") == "uploaded")
        & (F.col("account_id") == account_id)
        & (F.col("profile") == profile)
        & (F.col("bucket") == bucket)
        & (F.col("bucket_created_at") == bucket_created_at)
        & (F.coalesce("object_key", F.lit("")) != "")
        & (F.coalesce("upload_fingerprint", F.lit("")) != "")
    ).select("object_key", "upload_fingerprint", "seq")
    return keep_last(ours, ["object_key"], "seq").drop("seq")


def with_fingerprint(plan: DataFrame) -> DataFrame:
    return plan.withColumn(
        "upload_fingerprint",
        upload_fingerprint(F.col("sha256"), F.col("content_type"), F.col("cache_control")),
    )


def ledger_matches(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Plan rows the ledger says were uploaded with the same content and headers."""
    return with_fingerprint(plan).join(ledger, ["object_key", "upload_fingerprint"], "left_semi")


def verified(candidates: DataFrame, remote: DataFrame) -> DataFrame:
    """Keys whose remote copy has the planned size and hash."""
    return candidates.join(
        remote.select("object_key", "bytes", "sha256"), ["object_key", "bytes", "sha256"], "left_semi"
    ).select("object_key")


def pending(plan: DataFrame, ledger: DataFrame, remote: DataFrame, *, force: bool = False) -> DataFrame:
    """The plan minus objects both in the ledger and verified remotely."""
    if force:
        return plan
    return plan.join(verified(ledger_matches(plan, ledger), remote), "object_key", "left_anti").select(
        *plan.columns
    )


def totals(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
    )


def preview(plan: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(first n by key, one-row count of the others)."""
    more = plan.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return plan.orderBy("object_key").limit(n), more
