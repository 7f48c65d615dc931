"""Stage an import run, publish it behind a guard, replace people links."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys
from ..operators.rules import RuleViolation, require_none
from ..operators.tables import delete_keys, insert_missing, upsert
from .checks import MANIFEST_REQUIRED, manifest_violations, run_document_violations


@dataclass(frozen=True)
class Catalog:
    albums: DataFrame
    import_runs: DataFrame
    pictures: DataFrame
    people: DataFrame | None = None
    photo_people: DataFrame | None = None


def upsert_albums(albums: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """New albums start with no pictures; counts of existing ones stay."""
    totals = {"photo_count": F.lit(0), "captured_at_min": F.lit(None), "captured_at_max": F.lit(None)}
    kept = ("photo_count", "captured_at_min", "captured_at_max", "created_at", "cover_photo_id")
    return upsert(
        albums, incoming, ["id"],
        keep=[c for c in kept if c in albums.columns],
        defaults={**totals, "created_at": now}, computed={"updated_at": now},
    )


def upsert_runs(runs: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """A (re)started run is running, with nothing imported and no end."""
    return upsert(
        runs, incoming, ["id"], keep=["album_id", "created_at"],
        defaults={"created_at": now},
        computed={
            "status": F.lit("running"), "imported_count": F.lit(0),
            "completed_at": F.lit(None), "updated_at": now,
        },
    )


def stage_pictures(pictures: DataFrame, manifest: DataFrame, run_id: str, now: Column) -> DataFrame:
    """New pictures enter unpublished; known ones refresh all but id and visibility."""
    incoming = manifest.withColumn("imported_run_id", F.lit(run_id)).withColumn("published", F.lit(False))
    return upsert(
        pictures, incoming, ["id"], keep=["published", "created_at"],
        defaults={"created_at": now}, computed={"updated_at": now},
    )


def staged_count(pictures: DataFrame, album_id: str, run_id: str) -> DataFrame:
    return pictures.agg(
        F.count_if((F.col("album_id") == album_id) & (F.col("imported_run_id") == run_id)).alias("staged")
    )


def publish_run(
    pictures: DataFrame, runs: DataFrame, *, album_id: str, run_id: str, expected: int,
    authoritative: bool, now: Column,
) -> DataFrame:
    """Show the run's pictures once all are staged; if authoritative, hide the rest.

    The guard reads two one-row results before any new version is built.
    """
    run = runs.where((F.col("id") == run_id) & (F.col("album_id") == album_id)).head()
    if run is None:
        raise RuleViolation(f"import run {run_id} is missing for album {album_id}")
    if authoritative and not (
        run["complete_source_set"] is True and run["failed_count"] == 0
    ):
        raise RuleViolation("authoritative sync needs a complete, successful run")
    staged = staged_count(pictures, album_id, run_id).head()["staged"]
    if staged != expected:
        raise RuleViolation(f"import run {run_id} staged {staged} pictures; expected {expected}")
    return visibility_after(pictures, album_id, run_id, authoritative, now)


def visibility_after(
    pictures: DataFrame, album_id: str, run_id: str, authoritative: bool, now: Column
) -> DataFrame:
    """Visibility as two column expressions; no join and no shuffle."""
    here = F.col("album_id") == album_id
    ours = F.col("imported_run_id").eqNullSafe(F.lit(run_id))
    shown = F.when(here & ours, True)
    if authoritative:
        shown = shown.when(here & ~ours, False)
    shown = shown.otherwise(F.col("published"))
    changed = ~shown.eqNullSafe(F.col("published"))
    out = pictures.withColumn("_shown", shown)
    if "updated_at" in pictures.columns:
        out = out.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at")))
    return out.withColumn("published", F.col("_shown")).drop("_shown")


def album_rollup(pictures: DataFrame) -> DataFrame:
    """Count and time range of published pictures per album."""
    return pictures.where(F.col("published")).groupBy("album_id").agg(
        F.count(F.lit(1)).alias("photo_count"),
        F.min("captured_at").alias("captured_at_min"),
        F.max("captured_at").alias("captured_at_max"),
    )


def refresh_albums(albums: DataFrame, pictures: DataFrame, now: Column, album_id: str | None = None) -> DataFrame:
    """Recompute stored counts of one album, or of all."""
    totals = album_rollup(pictures).select(
        F.col("album_id").alias("id"), F.struct("photo_count", "captured_at_min", "captured_at_max").alias("_t")
    )
    touched = F.lit(True) if album_id is None else F.col("id") == album_id
    joined = albums.join(totals, "id", "left")
    fresh = {
        "photo_count": F.coalesce("_t.photo_count", F.lit(0)),
        "captured_at_min": F.col("_t.captured_at_min"),
        "captured_at_max": F.col("_t.captured_at_max"),
        "updated_at": now,
    }
    return joined.select(
        *[
            F.when(touched, fresh[c]).otherwise(F.col(c)).cast(albums.schema[c].dataType).alias(c)
            if c in fresh else F.col(c)
            for c in albums.columns
        ]
    )


def close_run(
    runs: DataFrame, run_id: str, *, status: str, imported: int, failed: int, completed_at: Column, now: Column
) -> DataFrame:
    ours = F.col("id") == run_id
    final = {
        "status": F.lit(status), "imported_count": F.lit(imported), "failed_count": F.lit(failed),
        "completed_at": completed_at, "updated_at": now,
    }
    return runs.select(
        *[
            F.when(ours, final[c]).otherwise(F.col(c)).cast(runs.schema[c].dataType).alias(c)
            if c in final else F.col(c)
            for c in runs.columns
        ]
    )


def open_run_document(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(albums, import runs) of checked run documents; a broken one is refused."""
    require_none(run_document_violations(documents), "run document")
    return documents.select("album.*"), documents.select("import_run.*")


def import_manifest(
    catalog: Catalog, album: DataFrame, run: DataFrame, manifest: DataFrame, *,
    authoritative: bool = False, now: Column, expected_digest: str | None = None, actual_digest: str | None = None,
    required: tuple[str, ...] = MANIFEST_REQUIRED,
) -> Catalog:
    """Setup, stage, guarded publish and refresh for one run document.

    The manifest is checked before anything is staged: columns, digest, the
    count the run document states, album, unique ids and positions.
    """
    header = run.head()
    album_id, run_id = header["album_id"], header["id"]
    if not all(re.fullmatch(keys.RUN_ID, x or "") for x in (album_id, run_id)):
        raise RuleViolation("an album or run id holds other than letters, digits, dots, dashes or underscores")
    if header["complete_source_set"] is None:
        raise RuleViolation("the run does not say whether its source set is complete")
    if authoritative and not (
        header["complete_source_set"] is True and header["status"] == "completed" and header["failed_count"] == 0
    ):
        raise RuleViolation("authoritative sync needs a complete, successful run")
    found = manifest_violations(
        manifest, album_id=album_id, expected_count=header["imported_count"], expected_digest=expected_digest,
        actual_digest=actual_digest, required=required,
    ).head()
    if found is not None:
        raise RuleViolation(f"manifest breaks rule {found['rule']}: {found['key']}")
    expected = header["imported_count"]
    albums = upsert_albums(catalog.albums, album, now)
    runs = upsert_runs(catalog.import_runs, run, now)
    staged = stage_pictures(catalog.pictures, manifest, run_id, now)
    pictures = publish_run(
        staged, runs, album_id=album_id, run_id=run_id, expected=expected,
        authoritative=authoritative, now=now,
    )
    return replace(
        catalog,
        albums=refresh_albums(albums, pictures, now, album_id),
        pictures=pictures,
        import_runs=close_run(
            runs, run_id, status=header["status"], imported=expected, failed=header["failed_count"],
            completed_at=F.lit(header["completed_at"]), now=now,
        ),
    )


# People --------------------------------------------------------------------

def upsert_people(people: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """Refresh people by id; the album of a known person never moves."""
    defaults = {} if now is None else {"created_at": now}
    computed = {} if now is None else {"updated_at": now}
    return upsert(
        people, incoming, ["id"], keep=[c for c in ("album_id", "created_at") if c in people.columns],
        defaults=defaults, computed=computed,
    )


def strangers(incoming: DataFrame, pictures: DataFrame, album_id: str) -> DataFrame:
    """Incoming links whose photo is missing or belongs to another album."""
    ours = pictures.where(F.col("album_id") == album_id).select(F.col("id").alias("photo_id"))
    return incoming.join(ours, "photo_id", "left_anti")


def stale_links(links: DataFrame, pictures: DataFrame, incoming: DataFrame, album_id: str) -> DataFrame:
    """Stored links of this album that the incoming set no longer has."""
    ours = pictures.where(F.col("album_id") == album_id).select(F.col("id").alias("photo_id"))
    return links.join(ours, "photo_id", "left_semi").join(
        incoming.select("photo_id", "person_id"), ["photo_id", "person_id"], "left_anti"
    )


def stale_people(people: DataFrame, incoming_people: DataFrame, album_id: str) -> DataFrame:
    """This album's people outside the incoming list; an empty list means all."""
    return people.where(F.col("album_id") == album_id).join(
        incoming_people.select("id"), "id", "left_anti"
    )


def replace_people(
    catalog: Catalog, incoming_people: DataFrame, incoming_links: DataFrame, *,
    album_id: str, manifest_sha256: str, now: Column | None = None,
) -> Catalog:
    """Replace an album's people and links by a reviewed export, or raise."""
    run = catalog.import_runs.where(
        (F.col("album_id") == album_id)
        & (F.col("status") == "completed")
        & (F.col("manifest_sha256") == manifest_sha256)
    )
    if run.isEmpty():
        raise RuleViolation("the export does not match a completed import")
    if not strangers(incoming_links, catalog.pictures, album_id).isEmpty():
        raise RuleViolation("the export contains a photo outside its album")
    people = upsert_people(catalog.people, incoming_people, now)
    gone = stale_links(catalog.photo_people, catalog.pictures, incoming_links, album_id)
    links = delete_keys(catalog.photo_people, gone, ["photo_id", "person_id"])
    links = insert_missing(links, incoming_links.select("photo_id", "person_id"), ["photo_id", "person_id"])
    leaving = stale_people(people, incoming_people, album_id)
    people = delete_keys(people, leaving, ["id"])
    links = delete_keys(links, leaving.select(F.col("id").alias("person_id")), ["person_id"])
    _guard_counts(catalog, people, links, incoming_people, incoming_links, album_id)
    return replace(catalog, people=people, photo_people=links)


def _guard_counts(catalog, people, links, incoming_people, incoming_links, album_id) -> None:
    avatar = [F.col(c).isNotNull() for c in ("avatar_key", "avatar_sha256", "avatar_width", "avatar_height")]
    complete = avatar[0] & avatar[1] & avatar[2] & avatar[3]
    found = people.where((F.col("album_id") == album_id) & complete).count()
    expected = incoming_people.count()
    if found != expected:
        raise RuleViolation(f"person import found {found}, expected {expected}")
    ours = catalog.pictures.where(F.col("album_id") == album_id).select(F.col("id").alias("photo_id"))
    found = links.join(ours, "photo_id", "left_semi").count()
    expected = incoming_links.select("photo_id", "person_id").distinct().count()
    if found != expected:
        raise RuleViolation(f"link import found {found}, expected {expected}")
