"""Reviewed people and their photo links, ready to publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import keys
from ..functions.hashing import avatar_key, person_slug, set_digest
from ..operators import workspace as reads
from ..operators.rules import RuleViolation, duplicates, require_none, union_all, violations


@dataclass(frozen=True)
class Export:
    people: DataFrame
    photo_people: DataFrame
    avatar_uploads: DataFrame
    review: DataFrame


def review_summary(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    f = faces.agg(
        F.count_if(F.col("status") == "unknown").alias("unknown_faces"),
        F.count_if(F.col("status") == "ignored").alias("ignored_faces"),
        F.count_if(F.col("status") == "labeled").alias("labeled_faces"),
        F.count(F.lit(1)).alias("total_faces"),
    )
    c = clusters.agg(F.count_if(F.col("status") == "unreviewed").alias("unreviewed_clusters"))
    return c.crossJoin(F.broadcast(f))


def exported_people(
    people: DataFrame, faces: DataFrame, clusters: DataFrame, *, prefix: str, side: int
) -> DataFrame:
    """People with labeled faces and a best avatar; nothing biometric."""
    stats = reads.person_stats(people, faces).select("person_id", "photo_count")
    avatars = reads.best_avatars(faces, clusters)
    return (
        people.select("id", "display_name")
        .join(stats.withColumnRenamed("person_id", "id"), "id")
        .join(avatars.withColumnRenamed("person_id", "id"), "id")
        .select(
            "id", person_slug(F.col("id")).alias("slug"), "display_name", "photo_count",
            avatar_key(prefix, F.col("id"), F.col("crop_sha256")).alias("avatar_key"),
            F.col("crop_sha256").alias("avatar_sha256"),
            F.lit(side).alias("avatar_width"), F.lit(side).alias("avatar_height"),
            "face_id", "crop_relpath",
        )
    )


def avatar_uploads(people: DataFrame, crops: DataFrame, crop_root: str) -> DataFrame:
    """One upload per exported person; sizes come from the crop inventory."""
    sized = crops.select(F.col("relative_path").alias("crop_relpath"), "bytes")
    return people.join(sized, "crop_relpath").select(
        F.lit(None).cast("string").alias("photo_id"), F.col("id").alias("person_id"),
        F.lit("avatar").alias("kind"), F.col("avatar_key").alias("object_key"),
        F.concat(F.lit(crop_root.rstrip("/") + "/"), "crop_relpath").alias("local_path"),
        F.lit("image/webp").alias("content_type"), F.lit(keys.IMMUTABLE_CACHE).alias("cache_control"),
        F.col("avatar_sha256").alias("sha256"), "bytes",
    )


def export_rules(people: DataFrame, links: DataFrame, uploads: DataFrame, faces: DataFrame, prefix: str) -> DataFrame:
    """(rule, key) of everything that must not be in an export."""
    planned = uploads.select(
        F.col("person_id").alias("id"), F.col("object_key").alias("_key"), F.col("sha256").alias("_sha")
    )
    joined = people.join(planned, "id", "left")
    sha = F.col("avatar_sha256")
    rules = {
        "person_id": keys.matches(F.col("id"), keys.PERSON_ID),
        "upload_key": F.col("avatar_key") == F.col("_key"),
        "upload_sha": sha == F.col("_sha"),
        "square": (F.col("avatar_width") == F.col("avatar_height")) & (F.col("avatar_width") >= 1),
        "sha": keys.matches(sha, keys.SHA256),
        "key_names_sha": F.col("avatar_key").endswith(
            F.concat(F.lit("/avatar-"), F.substring(sha, 1, 20), F.lit(".webp"))
        ),
    }
    orphan = links.join(people.select(F.col("id").alias("person_id")), "person_id", "left_anti")
    return union_all(
        violations(joined, F.col("id"), rules),
        duplicates(people, ["id"], "unique_person"),
        duplicates(people, ["avatar_key"], "unique_avatar"),
        duplicates(uploads, ["person_id"], "one_avatar"),
        duplicates(links, ["photo_id", "person_id"], "unique_link"),
        orphan.select(F.lit("link_person").alias("rule"), F.col("person_id").alias("key")),
        reads.mixed_clusters(faces).select(F.lit("mixed_cluster").alias("rule"), F.col("cluster_id").alias("key")),
    )


def export_preview(people: DataFrame, faces: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an export would hold: (people by name with their counts, one row of totals)."""
    stats = reads.person_stats(people, faces).orderBy(F.lower("display_name"), "person_id")
    return stats, reads.association_count(faces).crossJoin(F.broadcast(review_summary(faces, clusters)))


def build_export(
    people: DataFrame, faces: DataFrame, clusters: DataFrame, pictures: DataFrame, crops: DataFrame, *,
    prefix: str, side: int, crop_root: str, clustered: bool, allow_incomplete: bool = False,
) -> Export:
    """Assemble and check an export, or raise."""
    review = review_summary(faces, clusters)
    if not clustered:
        raise RuleViolation("clustering has not completed")
    if not allow_incomplete:
        left = review.head()["unreviewed_clusters"]
        if left:
            raise RuleViolation(f"{left} clusters still require review")
    chosen = exported_people(people, faces, clusters, prefix=prefix, side=side)
    links = reads.associations(faces, pictures)
    uploads = avatar_uploads(chosen, crops, crop_root)
    require_none(export_rules(chosen, links, uploads, faces, prefix), "export check failed")
    return Export(chosen.drop("face_id", "crop_relpath"), links, uploads, review)


def artifact_digest(people: DataFrame, links: DataFrame) -> DataFrame:
    """One digest over both tables, independent of row order."""
    p = set_digest(people, sorted(people.columns), alias="people")
    l = set_digest(links, sorted(links.columns), alias="links")
    return p.crossJoin(F.broadcast(l)).select(
        F.sha2(F.concat_ws("\n", "people", "links").cast("binary"), 256).alias("artifact_sha256")
    )
