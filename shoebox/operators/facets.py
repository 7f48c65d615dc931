"""People facets of the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.packing import packed, unpacked
from ..functions.text import accent_fold, accent_insensitive_contains

PEOPLE_COLUMNS = ("id", "slug", "display_name", "avatar_key", "avatar_width", "avatar_height")


def with_person(pictures: DataFrame, links: DataFrame, people: DataFrame, slug: str) -> DataFrame:
    """Pictures linked to the person with this slug in the photo's own album.

    The slug filter reaches the people scan and the semi join keeps photo rows
    single. No broadcast is forced: one person may be linked to a third of all
    pictures, so the size is left to the adaptive planner.
    """
    chosen = people.where(F.col("slug") == slug).select(
        F.col("id").alias("person_id"), F.col("album_id")
    )
    linked = links.join(chosen, "person_id").select(F.col("photo_id").alias("id"), "album_id")
    return pictures.join(linked, ["id", "album_id"], "left_semi")


def facet_total(pictures: DataFrame) -> DataFrame:
    return pictures.agg(F.count(F.lit(1)).alias("photo_count"))


def stored_total(albums: DataFrame, album_id: str) -> DataFrame:
    """The album's stored count, 0 when the album is missing: always one row."""
    return albums.where(F.col("id") == album_id).agg(
        F.coalesce(F.max("photo_count"), F.lit(0)).alias("photo_count")
    )


def people_in_published_pictures(
    people: DataFrame, links: DataFrame, pictures: DataFrame
) -> DataFrame:
    """people x links x published pictures of the person's own album (inner)."""
    there = _links_shown(links, pictures.where(F.col("published")))
    named = people.withColumn("_p", packed(F.col("id"))).withColumnRenamed("id", "person_id")
    rest = [c for c in people.columns if c not in ("id", "album_id")]
    return there.join(named.hint("merge"), ["_p", "album_id"]).select("person_id", "album_id", unpacked(F.col("_photo")).alias("photo_id"), *rest)


def _links_shown(links: DataFrame, shown: DataFrame) -> DataFrame:
    """(_photo, _p, album_id): links of these pictures, ids as bytes.

    Joined by sorted merges: the planner takes columns made from short keys
    for small, and would send a table of them through the driver.
    """
    mine = links.select(packed(F.col("photo_id")).alias("_photo"), packed(F.col("person_id")).alias("_p"))
    return mine.join(shown.select(packed(F.col("id")).alias("_photo"), "album_id").hint("merge"), "_photo")


def people_counts(
    people: DataFrame, links: DataFrame, pictures: DataFrame, album_id: str | None = None
) -> DataFrame:
    """Photo count per person, people without a published photo left out.

    Links are counted per person id before people's columns are joined, so the
    shuffle carries (id, partial count) only and a person with a third of all
    links costs one partial row per task.
    """
    here = people if album_id is None else people.where(F.col("album_id") == album_id)
    shown = pictures.where(F.col("published"))
    if album_id is not None:
        shown = shown.where(F.col("album_id") == album_id)
    counted = _links_shown(links, shown).groupBy("_p", "album_id").agg(F.count("_photo").alias("photo_count"))
    joined = here.join(
        counted, (packed(here["id"]) == counted["_p"]) & (here["album_id"] == counted["album_id"])
    )
    return joined.select(*[here[c] for c in PEOPLE_COLUMNS if c in here.columns], "photo_count")


def listing_order(people: DataFrame) -> DataFrame:
    return people.orderBy(F.lower("display_name"), "display_name", "id")


def featured_first(
    people: DataFrame, pins: Sequence[str], *, order: Sequence[str], fold: bool = False
) -> DataFrame:
    """Pinned names in list order, then everyone else as ordered.

    Of several rows with one pinned name only the last in order stays; the
    pick combines on the map side, so a very common name does not gather.
    """
    name = accent_fold(F.col("display_name")) if fold else F.lower(F.trim("display_name"))
    pin = F.array_position(F.array(*[F.lit(p) for p in pins]), name)
    marked = people.withColumn("_pin", pin)
    kept = [c for c in people.columns]
    pinned = (
        marked.where(F.col("_pin") > 0)
        .groupBy("_pin")
        .agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_row"))
        .select("_row.*", "_pin")
    )
    rest = marked.where(F.coalesce(F.col("_pin"), F.lit(0)) == 0).withColumn(
        "_pin", F.lit(1 << 20).cast("bigint")
    )
    return pinned.unionByName(rest).orderBy("_pin", *order).drop("_pin")


def search_people(people: DataFrame, query: str) -> DataFrame:
    """Accent- and case-insensitive substring search; an empty query keeps all."""
    if not query.strip():
        return people
    return people.where(accent_insensitive_contains(F.col("display_name"), query))


def facet_exists(counts: DataFrame, slug: str) -> DataFrame:
    """One row: is the requested facet in the listing?"""
    return counts.agg(F.coalesce(F.bool_or(F.col("slug") == slug), F.lit(False)).alias("facet_exists"))
