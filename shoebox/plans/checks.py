"""Rule sets for the catalog, manifests, upload plans and the workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys
from ..functions.packing import packed, unpacked
from ..functions.coerce import MAX_SAFE_INTEGER
from ..operators import workspace as reads
from ..operators.rules import Checked, RuleViolation, broken_rules, compare_fields, duplicates, union_all, violations
from ..operators.tables import set_differences


def _null_or(column: str, ok: Column) -> Column:
    return F.col(column).isNull() | ok


# The names and bounds in the rules below are those of the catalog's file format.


def photo_rules() -> dict[str, Column]:
    c = F.col
    rules = {
        "captured_at_source": c("captured_at_source").isin("exif", "filesystem", "unknown"),
        "media_type": c("media_type") == "image",
        "album_position": c("album_position") >= 0,
        "source_bytes": c("source_bytes") >= 0,
        "dominant_color": _null_or("dominant_color", c("dominant_color").rlike(r"\A#[0-9a-fA-F]{6}\z")),
        "blur_data_url": _null_or("blur_data_url", c("blur_data_url").like("data:image/%;base64,%")),
    }
    for name in (
        "source_width", "source_height", "thumb_width", "thumb_height", "thumb_bytes",
        "width", "height", "display_bytes",
    ):
        rules[name] = c(name) > 0
    return rules


def album_rules() -> dict[str, Column]:
    c = F.col
    return {
        "default_sort": c("default_sort").isin(
            "captured_at_asc", "captured_at_desc", "album_position_asc", "album_position_desc"
        ),
        "photo_count": c("photo_count") >= 0,
        "time_range": c("captured_at_min").isNull() | c("captured_at_max").isNull()
        | (c("captured_at_min") <= c("captured_at_max")),
    }


def run_rules() -> dict[str, Column]:
    return {
        "status": F.col("status").isin("running", "completed", "completed_with_errors", "failed"),
        **{
            name: F.col(name) >= 0
            for name in ("discovered_count", "imported_count", "skipped_count", "failed_count")
        },
    }


def catalog_violations(pictures: DataFrame, albums: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(rule, key, violations): all constraints of the catalog, each table read once.

    With ``runs``, pictures and runs must refer to runs and albums that exist;
    a picture may have no run.
    """
    photo_refs = {"photo_album": ["album_id"]}
    album_offers = {"photo_album": ["id"]}
    tables = []
    if runs is not None:
        photo_refs["photo_run"] = ["imported_run_id"]
        album_offers["run_album"] = ["id"]
        tables.append(Checked(
            runs, F.col("id"), {**run_rules(), "run_album_set": F.col("album_id").isNotNull()},
            unique={"run_id_unique": ["id"]}, references={"run_album": ["album_id"]}, offers={"photo_run": ["id"]},
        ))
    tables += [
        Checked(
            pictures, F.col("id"), photo_rules(),
            unique={
                "photo_id_unique": ["id"], "thumb_key_unique": ["thumb_key"], "display_key_unique": ["display_key"],
                "album_source_unique": ["album_id", "source_fingerprint"],
            },
            references=photo_refs,
        ),
        Checked(albums, F.col("id"), album_rules(), unique={"album_id_unique": ["id"], "album_slug_unique": ["slug"]}, offers=album_offers),
    ]
    return broken_rules(*tables)


def avatar_rule(prefix: str) -> Column:
    """All avatar fields absent, or all present and agreeing with each other."""
    c = F.col
    fields = ("avatar_key", "avatar_sha256", "avatar_width", "avatar_height")
    none = c(fields[0]).isNull() & c(fields[1]).isNull() & c(fields[2]).isNull() & c(fields[3]).isNull()
    key = keys.parse_avatar_key(c("avatar_key"), prefix)
    good = (
        F.length("avatar_key").between(1, 1024)
        & (key["person_id"] == c("id"))
        & keys.matches(c("avatar_sha256"), keys.SHA256)
        & (key["sha"] == F.substring("avatar_sha256", 1, 20))
        & (c("avatar_width") > 0)
        & (c("avatar_height") > 0)
    )
    return none | F.coalesce(good, F.lit(False))


def face_rules() -> dict[str, Column]:
    c = F.col
    unit = lambda name: c(name).between(0, 1)
    return {
        "ordinal": c("ordinal") >= 0,
        "bbox_x": unit("bbox_x"), "bbox_y": unit("bbox_y"),
        "bbox_width": (c("bbox_width") > 0) & (c("bbox_width") <= 1),
        "bbox_height": (c("bbox_height") > 0) & (c("bbox_height") <= 1),
        "detection_score": unit("detection_score"),
        "quality_score": unit("quality_score"),
        "width_px": c("width_px") > 0, "height_px": c("height_px") > 0,
        "quality": c("quality").isin("clusterable", "manual_only"),
        "status": c("status").isin(*reads.STATES),
        "labeled_has_person": (c("status") == "labeled") == c("person_id").isNotNull(),
        "embedding_dim": F.when(c("embedding").isNull(), c("embedding_dim").isNull()).otherwise(
            F.coalesce(F.size("embedding") == c("embedding_dim"), F.lit(False))
        ),
    }


def workspace_violations(faces: DataFrame, clusters: DataFrame, people: DataFrame, cannot_links: DataFrame) -> DataFrame:
    ordered = {"pair_order": F.col("face_id_a") < F.col("face_id_b"),
               "reason": F.col("reason").isin("same_photo", "manual_split", "absent")}
    cluster_ok = {
        "cluster_labeled_has_person": (F.col("status") == "labeled") == F.col("person_id").isNotNull(),
        "cluster_status": F.col("status").isin(*reads.STATES),
    }
    return broken_rules(
        Checked(
            faces, F.col("id"), face_rules(), unique={"photo_ordinal_unique": ["photo_id", "ordinal"]},
            references={"face_cluster": ["cluster_id"], "face_person": ["person_id"]},
        ),
        Checked(clusters, F.col("id"), cluster_ok, offers={"face_cluster": ["id"]}),
        Checked(people, F.col("id"), offers={"face_person": ["id"]}),
        Checked(
            cannot_links, F.concat_ws("|", "face_id_a", "face_id_b"), ordered,
            unique={"link_unique": ["face_id_a", "face_id_b"]},
        ),
    )


# Manifests ---------------------------------------------------------------------

# The columns of the file contract.
MANIFEST_REQUIRED = (
    "id", "album_id", "source_fingerprint", "original_filename", "source_bytes", "source_width",
    "source_height", "captured_at", "captured_at_source", "album_position", "media_type", "published",
    "thumb_key", "thumb_sha256", "thumb_width", "thumb_height", "thumb_bytes", "display_key",
    "display_sha256", "width", "height", "display_bytes", "blur_data_url", "dominant_color", "metadata",
)


#: Fixed value: the version of run documents that is understood.
DOCUMENT_VERSION = 1


def run_document_violations(documents: DataFrame) -> DataFrame:
    """(rule, key, violations) of run documents: version, ids, slug, completeness; the key is the run id."""
    c = F.col
    rules = {
        "schema_version": c("schema_version") == DOCUMENT_VERSION,
        "album_id": keys.matches(c("album.id"), keys.RUN_ID),
        "album_slug": F.length("album.slug") > 0,
        "run_id": keys.matches(c("import_run.id"), keys.RUN_ID),
        "complete_source_set": c("import_run.complete_source_set").isNotNull(),
    }
    return broken_rules(Checked(documents, c("import_run.id"), rules, unique={"run_id_unique": ["import_run.id"]}))


def manifest_violations(
    manifest: DataFrame, *, album_id: str, expected_count: int, expected_digest: str | None = None,
    actual_digest: str | None = None, required: tuple[str, ...] = (),
) -> DataFrame:
    """Missing columns, digest, count, album, duplicate ids and positions."""
    absent = [c for c in required if c not in manifest.columns]
    if absent:
        raise RuleViolation(f"manifest is missing {', '.join(absent)}")
    if expected_digest is not None and expected_digest != actual_digest:
        raise RuleViolation("manifest digest mismatch")
    size = manifest.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected_count).select(
        F.lit("count").alias("rule"), F.col("n").cast("string").alias("key")
    )
    return union_all(
        size,
        violations(manifest, F.col("id"), {"album": F.col("album_id") == album_id}),
        duplicates(manifest, ["id"], "duplicate_id"),
        duplicates(manifest, ["album_position"], "duplicate_position"),
    )


def scan_manifest_violations(manifest: DataFrame, sources: DataFrame, displays: DataFrame) -> DataFrame:
    """Derived ids, bare names, dense positions, sizes against inventories.

    ``sources`` is (file_name, bytes), ``displays`` (object_key, bytes).
    """
    c = F.col
    own = {
        "derived_id": c("id") == F.concat(F.lit("p_"), F.substring("source_fingerprint", 1, 32)),
        "source_fingerprint": keys.matches(c("source_fingerprint"), keys.SHA256),
        "bare_filename": ~c("original_filename").rlike("/") & (F.length("original_filename") > 0),
    }
    base = {
        **{rule: c(f"_{rule}") for rule in own},
        "source_present": c("_source").isNotNull(),
        "source_size": c("_source").isNull() | (c("_source") == c("source_bytes")),
        "display_present": c("_display").isNotNull(),
        "display_size": c("_display").isNull() | (c("_display") == c("display_bytes")),
    }
    # What a row says by itself is decided before the joins; digests and texts stay behind.
    mine = manifest.select(
        packed(c("id")).alias("_id"), "original_filename", "display_key", "source_bytes", "display_bytes",
        *[ok.alias(f"_{rule}") for rule, ok in own.items()],
    )
    joined = mine.join(
        displays.select(c("object_key").alias("display_key"), c("bytes").alias("_display")).hint("merge"), "display_key", "left"
    ).drop("display_key").join(
        sources.select(c("file_name").alias("original_filename"), c("bytes").alias("_source")).hint("merge"), "original_filename", "left"
    )
    dense = manifest.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("album_position").alias("d"),
        F.min("album_position").alias("lo"), F.max("album_position").alias("hi"),
    ).where((c("n") > 0) & ~((c("d") == c("n")) & (c("lo") == 0) & (c("hi") == c("n") - 1))).select(
        F.lit("dense_positions").alias("rule"), c("n").cast("string").alias("key")
    )
    twice = duplicates(manifest.select(packed(c("id")).alias("id")), ["id"], "duplicate_id", unpacked)
    return union_all(violations(joined, unpacked(c("_id")), base), twice, dense)


def run_is_complete(run: DataFrame) -> DataFrame:
    ok = (F.col("status") == "completed") & F.col("complete_source_set") & (F.col("failed_count") == 0)
    return violations(run, F.col("id"), {"complete_successful_run": ok})


def digest_check(manifest: DataFrame, files: DataFrame, path: str, sha: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose file hash differs or is missing, one-row verified totals)."""
    have = files.select(F.col("path").alias(path), F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"))
    joined = manifest.join(have, path, "left")
    bad = joined.where(~F.col(sha).eqNullSafe(F.col("_sha"))).select(path, sha, F.col("_sha").alias("actual"))
    good = joined.where(F.col(sha) == F.col("_sha")).agg(
        F.count(F.lit(1)).alias("verified"), F.coalesce(F.sum("_bytes"), F.lit(0)).cast("bigint").alias("bytes")
    )
    return bad, good


def upload_rules(prefix: str, private_root: str) -> dict[str, Column]:
    """One boolean per rule of an upload plan row with its parsed keys."""
    c = F.col
    photo, avatar = c("_photo"), c("_avatar")
    is_photo, is_avatar = photo.isNotNull(), avatar.isNotNull()
    embedded = F.coalesce(photo["sha"], avatar["sha"])
    suffix = F.coalesce(photo["ext"], F.lit("webp"))
    photo_identity = (
        c("person_id").isNull()
        & (c("photo_id") == F.concat(F.lit("p_"), photo["photo_hash"]))
        & (photo["shard"] == F.substring(photo["photo_hash"], 1, 2))
        & (c("kind") == photo["kind"])
    )
    avatar_identity = (
        c("photo_id").isNull() & (c("person_id") == avatar["person_id"]) & (c("kind") == "avatar")
    )
    present = F.lit(True)
    for name in ("kind", "object_key", "local_path", "content_type", "cache_control", "sha256", "bytes"):
        present = present & c(name).isNotNull()
    return {
        "required": present,
        "safe_key": c("object_key").startswith(f"{prefix}/") & ~keys.unsafe_key(c("object_key")),
        "known_key": is_photo | is_avatar,
        "identity": F.when(is_photo, photo_identity).when(is_avatar, avatar_identity).otherwise(True),
        "absolute_path": c("local_path").startswith("/"),
        "private_avatar": ~is_avatar
        | (keys.private_crop_path(c("local_path"), private_root) & (keys.extension(c("local_path")) == "webp")),
        "sha256": keys.matches(c("sha256"), keys.SHA256),
        "key_hash": embedded.isNull() | c("sha256").startswith(embedded),
        "content_type": c("content_type").isin("image/avif", "image/jpeg", "image/webp"),
        "content_type_matches": embedded.isNull() | (c("content_type") == keys.content_type(F.concat(F.lit("x."), suffix))),
        "cache_control": c("cache_control") == keys.IMMUTABLE_CACHE,
        "bytes": (c("bytes") > 0) & (c("bytes") <= MAX_SAFE_INTEGER),
    }


def upload_violations(plan: DataFrame, *, prefix: str, private_root: str) -> DataFrame:
    # Parsed once per row, in a projection of its own.
    parsed = plan.withColumn("_photo", keys.parse_photo_key(F.col("object_key"), prefix)).withColumn(
        "_avatar", keys.parse_avatar_key(F.col("object_key"), prefix)
    )
    return broken_rules(Checked(
        parsed, F.col("object_key"), upload_rules(prefix, private_root), unique={"duplicate_key": ["object_key"]}
    ))


def avatar_source_violations(
    avatars: DataFrame, crops: DataFrame, dimensions: DataFrame, *, root: str, side: int
) -> DataFrame:
    """Chosen crops against the crop inventory and the decoded dimensions.

    ``avatars``: person_id, crop_relpath, crop_sha256. ``crops``:
    relative_path, bytes, sha256. ``dimensions``: relative_path, width, height.
    """
    c = F.col
    joined = avatars.join(
        crops.select(c("relative_path").alias("crop_relpath"), c("bytes").alias("_bytes"), c("sha256").alias("_sha")),
        "crop_relpath", "left",
    ).join(
        dimensions.select(c("relative_path").alias("crop_relpath"), c("width").alias("_w"), c("height").alias("_h")),
        "crop_relpath", "left",
    )
    full = F.concat(F.lit(root.rstrip("/") + "/"), c("crop_relpath"))
    return violations(
        joined, c("person_id"),
        {
            "person_id": keys.matches(c("person_id"), keys.PERSON_ID),
            "path": c("crop_relpath").startswith("crops/") & keys.private_crop_path(full, root),
            "present": c("_bytes") >= 1,
            "sha256": c("_sha") == c("crop_sha256"),
            "square_side": (c("_w") == side) & (c("_h") == side),
        },
    )


# Workspace consistency ------------------------------------------------------------

def consistency_violations(
    pictures: DataFrame, faces: DataFrame, clusters: DataFrame, cannot_links: DataFrame, suggestions: DataFrame
) -> DataFrame:
    """(rule, key, violations): what a stored workspace must satisfy across tables.

    Face counts, representatives, clusters' photos and vector lengths come out
    of one reading of each table; identities and links need joins.
    ``cannot_links`` are the exceptions to the links of each photo's faces,
    which are counted, never paired.
    """
    c = F.col
    face_ok = {}
    if "embedding" in faces.columns:
        face_ok["embedding_length"] = c("embedding").isNull() | (F.size("embedding") == c("embedding_dim"))
    # Faces offer themselves as representatives only where clusters name some.
    asked = not clusters.where(c("representative_face_id").isNotNull()).isEmpty()
    tables = broken_rules(
        Checked(pictures, c("id"), claims={"face_count": ([F.when(c("scan_status") == "complete", c("id"))], c("face_count"))}),
        Checked(
            faces, c("id"), face_ok, unique={"one_face_per_photo": ["cluster_id", "photo_id"]},
            counted={"face_count": ["photo_id"]}, offers={"representative": ["id", "cluster_id"]} if asked else {},
        ),
        Checked(
            clusters, c("id"), {"representative": c("representative_face_id").isNotNull()},
            references={"representative": ["representative_face_id", "id"]},
        ),
    )
    placed = reads.placed_exceptions(cannot_links, faces)
    blocked = suggestions.join(
        reads.linked_cluster_pairs(suggestions, faces, placed), ["cluster_id_a", "cluster_id_b"], "left_semi"
    ).select(F.lit("suggestion_blocked").alias("rule"), F.concat_ws("|", "cluster_id_a", "cluster_id_b").alias("key"))
    named = clusters.where(c("status") == "labeled").select(packed(c("id")).alias("_c"), packed(c("person_id")).alias("_p"))
    judged = faces.where(reads.labelable(c("status"))).select(
        packed(c("cluster_id")).alias("_c"), packed(c("id")).alias("_face"), packed(c("person_id")).alias("_own"), (c("status") != "labeled").alias("_open")
    )
    wrong = judged.join(named.hint("merge"), "_c").where(c("_open") | ~c("_own").eqNullSafe(c("_p"))).select(
        F.lit("labeled_identity").alias("rule"), unpacked(c("_face")).alias("key")
    )
    totals = reads.link_completeness(pictures, faces, placed).where(c("expected") != c("actual")).select(
        F.lit("links_complete").alias("rule"), F.concat_ws("|", "expected", "actual").alias("key")
    )
    each = [blocked, wrong, totals]
    if placed is not None:
        each.append(
            placed.where((c("reason") == "same_photo") & (c("photo_id_a") != c("photo_id_b")))
            .select(F.lit("link_one_photo").alias("rule"), F.concat_ws("|", "face_id_a", "face_id_b").alias("key"))
        )
    return tables.unionByName(union_all(*each).withColumn("violations", F.lit(1).cast("bigint")))


def crop_differences(faces: DataFrame, crops: DataFrame) -> DataFrame:
    return set_differences(
        faces.select(F.col("crop_relpath").alias("path")), crops.select(F.col("relative_path").alias("path")), ["path"]
    )


def changed_settings(stored: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Names of run settings that differ between two one-row tables."""
    keyed = lambda df: df.select(F.lit(1).alias("k"), *[F.col(f).cast("string").alias(f) for f in fields])
    return compare_fields(keyed(stored), keyed(current), ["k"], fields).select("field")


def changed_pictures(expected: DataFrame, stored: DataFrame) -> DataFrame:
    return compare_fields(
        expected, stored, ["album_position"], ["id", "source_fingerprint", "display_sha256", "scan_key"]
    )


# Bulk ignore --------------------------------------------------------------------

def outside_targets(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Unreviewed faces outside unreviewed clusters."""
    targets = clusters.where(F.col("status") == "unreviewed").select(F.col("id").alias("cluster_id"))
    return faces.where(F.col("status") == "unreviewed").join(targets, "cluster_id", "left_anti")


def protected_digest(people: DataFrame, clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """One digest over all rows a bulk ignore may not change."""
    from ..functions.hashing import set_digest

    kept = F.col("status").isin("labeled", "unknown")
    parts = [
        set_digest(people, ["id", "display_name", "name_key", "created_at", "updated_at"], alias="p"),
        set_digest(clusters.where(kept), ["id", "status", "person_id", "revision", "reviewed_at", "updated_at"], alias="c"),
        set_digest(faces.where(kept), ["id", "cluster_id", "person_id", "status", "revision", "updated_at"], alias="f"),
    ]
    joined = parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))
    return joined.select(F.sha2(F.concat_ws("\n", "p", "c", "f").cast("binary"), 256).alias("protected_digest"))


def bulk_ignore_preflight(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """(rule, key) of conditions that forbid a bulk ignore."""
    state = reads.target_state(clusters, faces)
    rules = {
        "empty_clusters": F.col("empty_clusters") == 0,
        "mixed_statuses": (F.col("labeled_faces") == 0) & (F.col("unknown_faces") == 0) & (F.col("ignored_faces") == 0),
        "counts_agree": F.col("target_faces") == F.col("unreviewed_faces"),
    }
    outside = outside_targets(faces, clusters).select(
        F.lit("unreviewed_outside").alias("rule"), F.col("id").alias("key")
    )
    return union_all(violations(state, F.lit("targets"), rules), outside)


def bulk_ignore_result(before: dict, after: dict) -> list[str]:
    """Names of broken postconditions between two sets of status counts.

    Each argument: {"clusters": {status: n}, "faces": {status: n}, "digest": hex}.
    """
    broken = []
    if before["digest"] != after["digest"]:
        broken.append("protected_rows")
    for table in ("clusters", "faces"):
        b, a = before[table], after[table]
        if a["labeled"] != b["labeled"] or a["unknown"] != b["unknown"]:
            broken.append(f"{table}_protected_counts")
        if a["unreviewed"]:
            broken.append(f"{table}_remaining")
        if a["ignored"] != b["ignored"] + b["unreviewed"]:
            broken.append(f"{table}_ignored_delta")
    return broken
