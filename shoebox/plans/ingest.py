"""Incremental ingest: what to build, build once per content, manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys
from ..functions.coerce import captured_at
from ..functions.hashing import object_key, photo_id, set_digest, source_signature
from ..functions.text import natural_key, nfc
from ..operators.numbering import dense_index, keep_first, keep_last

METADATA_FIELDS = ("camera_make", "camera_model", "lens_model")
METADATA_NUMBERS = ("iso", "aperture", "exposure_seconds", "focal_length_mm")


# The settings that decide what is built, in the order in which they are hashed.
PROFILE_VERSION, TOOL_VERSION = 1, "1.0.0"


def derivative_settings(
    *, album_id: str, prefix: str, image_format: str, thumb_size: int, thumb_quality: int, display_size: int,
    display_quality: int, encoder: dict[str, str] | None = None,
) -> dict:
    """Everything that changes the derivatives of a source, encoder versions included."""
    encoder = encoder or {}
    return {
        "profile_version": PROFILE_VERSION,
        "tool_version": TOOL_VERSION,
        "encoder": {part: encoder.get(part, "not-loaded") for part in ("sharp", "libvips")},
        "album_id": album_id,
        "prefix": prefix,
        "thumb": {"max_edge": thumb_size, "format": image_format, "quality": thumb_quality},
        "display": {"max_edge": display_size, "format": image_format, "quality": display_quality},
        "auto_orient": True,
        "colorspace": "srgb",
        "source_metadata_preserved": False,
        "cache_control": keys.IMMUTABLE_CACHE,
    }


def profile_fingerprint(settings: dict) -> str:
    """SHA-256 of the settings as compact JSON in their own order."""
    text = json.dumps(settings, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def sign_inventory(inventory: DataFrame, settings: dict) -> DataFrame:
    """Adds ``signature`` to (relative_path, bytes, mtime_ms).

    It names the source as it lies there and the settings it is built with, so
    a changed setting finds no completed entry and everything is built anew.
    """
    profile = F.lit(profile_fingerprint(settings))
    return inventory.withColumn("signature", source_signature(nfc(F.col("relative_path")), F.col("bytes"), F.col("mtime_ms"), profile))


def latest_state(log: DataFrame, key: str = "signature", sequence: str = "seq") -> DataFrame:
    """Last completed entry per signature of the append-only state."""
    done = log.where((F.col("type") == "completed") & F.col(key).isNotNull())
    return keep_last(done, [key], sequence)


def split_work(inventory: DataFrame, state: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resumed, to build).

    ``inventory`` carries ``signature``; ``state`` one row per signature with
    the keys and sizes of its two objects; ``objects`` is (object_key, bytes).
    An input is resumed when both objects exist with the recorded sizes.
    """
    have = objects.select("object_key", "bytes").distinct()
    wanted = state.select(
        "signature",
        F.explode(
            F.array(
                F.struct(F.col("thumb_key").alias("object_key"), F.col("thumb_bytes").alias("bytes")),
                F.struct(F.col("display_key").alias("object_key"), F.col("display_bytes").alias("bytes")),
            )
        ).alias("o"),
    ).select("signature", "o.*")
    missing = wanted.join(have, ["object_key", "bytes"], "left_anti").select("signature").distinct()
    complete = state.join(missing, "signature", "left_anti")
    resumed = inventory.join(complete.select("signature"), "signature", "left_semi")
    return resumed, inventory.join(complete.select("signature"), "signature", "left_anti")


def distinct_content(files: DataFrame, sha: str = "sha256", path: str = "path") -> DataFrame:
    """One file per content to build from: the smallest path."""
    return keep_first(files, [sha], [F.col(path)])


def fan_out(files: DataFrame, built: DataFrame, sha: str = "sha256") -> DataFrame:
    """Give every path the result built once for its content."""
    return files.join(built, sha)


def metadata_struct() -> Column:
    """Allow-listed metadata; numbers must be finite, the rest is dropped."""
    from ..functions.coerce import finite_number

    return F.struct(
        *[F.col(f"meta.{f}").alias(f) for f in METADATA_FIELDS],
        *[finite_number(F.col(f"meta.{f}").cast("string")).alias(f) for f in METADATA_NUMBERS],
    )


def photo_records(files: DataFrame, media: DataFrame, *, album_id: str, prefix: str) -> DataFrame:
    """Manifest rows from an inventory and a per-content media table.

    ``files``: sha256, path, file_name, bytes, mtime_ms, birthtime_ms.
    ``media``: sha256, dimensions, derivative hashes and sizes, hints, ``meta``.
    """
    joined = files.join(media, "sha256")
    taken = captured_at(
        F.col("meta.date_original"), F.col("meta.date_created"), F.col("mtime_ms"), F.col("birthtime_ms")
    )
    key = lambda kind: object_key(
        prefix, F.col("sha256"), kind, F.col(f"{kind}_sha256"), F.col("format")
    )
    return joined.withColumn("_t", taken).select(
        photo_id(F.col("sha256")).alias("id"),
        F.lit(album_id).alias("album_id"),
        F.col("sha256").alias("source_fingerprint"),
        F.col("file_name").alias("original_filename"),
        F.col("bytes").alias("source_bytes"),
        "source_width", "source_height",
        F.date_trunc("MILLISECOND", F.col("_t.value")).alias("captured_at"),
        F.col("_t.source").alias("captured_at_source"),
        F.lit("image").alias("media_type"),
        F.lit(True).alias("published"),
        key("thumb").alias("thumb_key"), "thumb_sha256", "thumb_width", "thumb_height", "thumb_bytes",
        key("display").alias("display_key"), "display_sha256",
        F.col("display_width").alias("width"), F.col("display_height").alias("height"), "display_bytes",
        "blur_data_url", "dominant_color",
        metadata_struct().alias("metadata"),
        F.col("path").alias("source_path"),
    )


def file_order() -> list[Column]:
    """Dated pictures by time, then natural file name, then id."""
    return [
        F.col("captured_at").asc_nulls_last(), natural_key(F.col("original_filename")), F.col("id"),
    ]


def unique_pictures(records: DataFrame) -> DataFrame:
    """Exact duplicates collapse to the record with the smallest source path."""
    return keep_first(records, ["id"], [F.col("source_path")])


def album_manifest(records: DataFrame) -> DataFrame:
    """Unique pictures with dense positions 0..n-1 in album order."""
    numbered = dense_index(unique_pictures(records), file_order(), "album_position")
    return numbered.withColumn("album_position", F.col("album_position").cast("int")).drop("source_path")


def manifest_digest(manifest: DataFrame) -> DataFrame:
    flat = manifest.select(
        *[F.to_json(c).alias(c) if c == "metadata" else F.col(c) for c in manifest.columns]
    )
    return set_digest(flat, sorted(flat.columns), alias="manifest_sha256")


def run_counters(outcomes: DataFrame, *, limited: bool = False) -> DataFrame:
    """One row: discovered, imported, skipped, failed, completeness, status.

    ``outcomes`` has one row per input with outcome built, resumed or failed,
    and its photo id where there is one.
    """
    is_ = lambda v: F.count_if(F.col("outcome") == v)
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("discovered_count"),
        F.countDistinct(F.when(F.col("outcome") != "failed", F.col("photo_id"))).alias("imported_count"),
        is_("resumed").alias("skipped_count"),
        is_("failed").alias("failed_count"),
    )
    return counts.select(
        "*",
        ((F.col("failed_count") == 0) & F.lit(not limited)).alias("complete_source_set"),
        F.when(F.col("failed_count") > 0, "completed_with_errors").otherwise("completed").alias("status"),
    )


def run_document(manifest: DataFrame, counters: DataFrame) -> DataFrame:
    """Counters joined with the manifest's size and time range: one row."""
    span = manifest.agg(
        F.count(F.lit(1)).alias("photo_count"),
        F.min("captured_at").alias("captured_at_min"),
        F.max("captured_at").alias("captured_at_max"),
    )
    return span.crossJoin(F.broadcast(counters))


def upload_plan(manifest: DataFrame, object_root: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per photo: thumbnail and display object. ``keep``: columns of the photo to carry along."""
    entry = lambda kind: F.struct(
        F.lit(kind).alias("kind"),
        F.col(f"{kind}_key").alias("object_key"),
        F.col(f"{kind}_sha256").alias("sha256"),
        F.col(f"{kind}_bytes").cast("bigint").alias("bytes"),
    )
    return (
        manifest.select(
            F.col("id").alias("photo_id"), F.explode(F.array(entry("thumb"), entry("display"))).alias("e"), *keep
        )
        .select("photo_id", "e.*", *keep)
        .select(
            "photo_id", F.lit(None).cast("string").alias("person_id"), "kind", "object_key",
            F.concat(F.lit(object_root.rstrip("/") + "/"), "object_key").alias("local_path"),
            keys.content_type(F.col("object_key")).alias("content_type"),
            F.lit(keys.IMMUTABLE_CACHE).alias("cache_control"), "sha256", "bytes", *keep,
        )
    )
