"""Declared schemas of the catalog, manifests and review workspace.

Nothing is inferred from JSON: every reader is given one of these.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


METADATA = _struct(
    camera_make=_S, camera_model=_S, lens_model=_S,
    iso=_D, aperture=_D, exposure_seconds=_D, focal_length_mm=_D,
)

ALBUMS = _struct(
    id=_S, slug=_S, title=_S, description=_S, cover_photo_id=_S, default_sort=_S,
    photo_count=_L, captured_at_min=_TS, captured_at_max=_TS,
    created_at=_TS, updated_at=_TS,
)

IMPORT_RUNS = _struct(
    id=_S, album_id=_S, status=_S, tool_version=_S, profile_fingerprint=_S,
    manifest_sha256=_S, discovered_count=_L, imported_count=_L, skipped_count=_L,
    failed_count=_L, complete_source_set=_B, started_at=_TS, completed_at=_TS,
    created_at=_TS, updated_at=_TS,
)

# Written to pictures.ndjson; the catalog adds imported_run_id and row times.
MANIFEST_PHOTO = _struct(
    id=_S, album_id=_S, source_fingerprint=_S, original_filename=_S,
    source_bytes=_L, source_width=_I, source_height=_I,
    captured_at=_TS, captured_at_source=_S, album_position=_I, media_type=_S,
    published=_B,
    thumb_key=_S, thumb_sha256=_S, thumb_width=_I, thumb_height=_I, thumb_bytes=_L,
    display_key=_S, display_sha256=_S, width=_I, height=_I, display_bytes=_L,
    blur_data_url=_S, dominant_color=_S, metadata=METADATA,
)

PICTURES = T.StructType(
    [f for f in MANIFEST_PHOTO.fields]
    + [
        T.StructField("imported_run_id", _S, True),
        T.StructField("created_at", _TS, True),
        T.StructField("updated_at", _TS, True),
    ]
)

RUN_DOCUMENT = _struct(
    schema_version=_I,
    generated_at=_TS,
    tool_version=_S,
    album=_struct(
        id=_S, slug=_S, title=_S, description=_S, default_sort=_S, photo_count=_L,
        captured_at_min=_TS, captured_at_max=_TS,
    ),
    import_run=_struct(
        id=_S, album_id=_S, status=_S, tool_version=_S, profile_fingerprint=_S,
        manifest_sha256=_S, discovered_count=_L, imported_count=_L, skipped_count=_L,
        failed_count=_L, complete_source_set=_B, started_at=_TS, completed_at=_TS,
    ),
)

UPLOAD_PLAN = _struct(
    photo_id=_S, person_id=_S, kind=_S, object_key=_S, local_path=_S,
    content_type=_S, cache_control=_S, sha256=_S, bytes=_L,
)

UPLOAD_LEDGER = _struct(
    seq=_L, type=_S, account_id=_S, profile=_S, bucket=_S, bucket_created_at=_S,
    object_key=_S, upload_fingerprint=_S,
)

PEOPLE = _struct(
    id=_S, album_id=_S, slug=_S, display_name=_S, avatar_key=_S, avatar_sha256=_S,
    avatar_width=_I, avatar_height=_I, created_at=_TS, updated_at=_TS,
)

PHOTO_PEOPLE = _struct(photo_id=_S, person_id=_S)

# Review workspace ----------------------------------------------------------

REVIEW_PICTURES = _struct(
    id=_S, album_position=_I, source_fingerprint=_S, display_relpath=_S,
    display_sha256=_S, width=_I, height=_I, scan_key=_S, scan_status=_S,
    attempt_count=_I, face_count=_I, scan_error=_S, processed_at=_S,
)

REVIEW_PEOPLE = _struct(id=_S, display_name=_S, name_key=_S, created_at=_S, updated_at=_S)

CLUSTERS = _struct(
    id=_S, origin=_S, status=_S, person_id=_S, representative_face_id=_S,
    revision=_I, reviewed_at=_S, created_at=_S, updated_at=_S,
)

FACES = T.StructType(
    _struct(
        id=_S, photo_id=_S, cluster_id=_S, person_id=_S, ordinal=_I,
        bbox_x=_D, bbox_y=_D, bbox_width=_D, bbox_height=_D, landmarks_json=_S,
        detection_score=_D, width_px=_I, height_px=_I, quality=_S, quality_score=_D,
        embedding=T.ArrayType(T.FloatType()), embedding_dim=_I,
        crop_relpath=_S, crop_sha256=_S, status=_S, revision=_I,
        created_at=_S, updated_at=_S,
    ).fields
)

CANNOT_LINKS = _struct(face_id_a=_S, face_id_b=_S, reason=_S, created_at=_S)

SUGGESTIONS = _struct(
    cluster_id_a=_S, cluster_id_b=_S, similarity_max=_D, similarity_median=_D,
    similarity_min=_D, status=_S, created_at=_S,
)

ACTIONS = _struct(
    id=_L, client_mutation_id=_S, action_type=_S, payload_json=_S, inverse_json=_S,
    created_at=_S, undone_at=_S,
)

# The before-image columns kept per table for undo.
MUTABLE_FACE_COLUMNS = ("id", "cluster_id", "person_id", "status", "revision", "updated_at")
MUTABLE_CLUSTER_COLUMNS = (
    "id", "origin", "status", "person_id", "representative_face_id", "revision",
    "reviewed_at", "created_at", "updated_at",
)
