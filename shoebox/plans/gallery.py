"""Catalog listings: one photo page, the people list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import keys, signing
from ..functions.cursor import SORTS, Cursor, decode_cursor, encode_cursor, is_seed, is_slug
from ..functions.text import iso_millis
from ..operators import facets, paging
from ..operators.rules import require_none, violations

DEFAULT_PAGE = 60
MAX_PAGE = 120


@dataclass(frozen=True)
class Links:
    """How object keys become signed links."""

    base_url: str
    secret: bytes
    ttl_seconds: int = signing.DEFAULT_TTL_SECONDS


@dataclass(frozen=True)
class Page:
    pictures: list[dict]
    total: int
    next_cursor: str | None
    media_expires_at: int


def _links(df: DataFrame, links: Links, now_seconds: float, **urls: str) -> DataFrame:
    expires = signing.expiry(F.lit(float(now_seconds)), F.lit(links.ttl_seconds))
    out = df.withColumn("media_expires_at", expires)
    for name, key in urls.items():
        encoded = keys.encode_segments(F.col(key))
        out = out.withColumn(
            name, signing.signed_url(links.base_url, encoded, F.col("media_expires_at"), links.secret)
        )
    return out


def clamp_limit(raw: object, default: int = DEFAULT_PAGE) -> int:
    """Requested page size within 1..120; anything unreadable is the default."""
    try:
        return max(1, min(MAX_PAGE, int(raw)))
    except (TypeError, ValueError):
        return default


def list_pictures(
    pictures: DataFrame,
    albums: DataFrame,
    people: DataFrame,
    photo_people: DataFrame,
    *,
    album_id: str,
    links: Links,
    now_seconds: float,
    limit: int = DEFAULT_PAGE,
    sort: str = "album",
    cursor: str | None = None,
    person: str | None = None,
    seed: str | None = None,
) -> Page:
    """One page. At most 121 rows come to the driver: limit + 1 tells whether
    more follow, and only the visible ones are returned."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError("Invalid page size")
    if sort not in SORTS:
        raise ValueError("Invalid sort")
    if person is not None and not is_slug(person):
        raise ValueError("Invalid person slug")
    if sort == "shuffle" and not is_seed(seed):
        raise ValueError("Invalid shuffle seed")
    seed = seed if sort == "shuffle" else None
    after = None if cursor is None else decode_cursor(cursor, sort, person, seed)

    shown = paging.published_in_album(pictures, album_id)
    if person is not None:
        shown = facets.with_person(shown, photo_people, people, person)
        total = facets.facet_total(shown)
    else:
        total = facets.stored_total(albums, album_id)
    rows = paging.page(shown, sort, limit + 1, seed=seed, cursor=after)
    listed = _links(
        paging.gallery_projection(rows).withColumn("captured_at", iso_millis(F.col("captured_at"))),
        links, now_seconds, thumb_url="thumb_key", display_url="display_key",
    ).withColumn("shuffle_key", paging.shuffle_key(seed or "", F.col("id")))
    fetched = [r.asDict() for r in listed.collect()]
    visible = fetched[:limit]
    following = None
    if len(fetched) > limit:
        last = visible[-1]
        following = encode_cursor(
            Cursor(
                sort=sort, id=last["id"], person=person, seed=seed,
                position=None if sort == "shuffle" else last["album_position"],
                captured_at=last["captured_at_cursor"] if sort in ("newest", "oldest") else None,
                shuffle_key=last["shuffle_key"] if sort == "shuffle" else None,
            )
        )
    expires = (
        pictures.sparkSession.range(1)
        .select(signing.expiry(F.lit(float(now_seconds)), F.lit(links.ttl_seconds)))
        .head()[0]
    )
    fields = ("id", "thumb_url", "display_url", "width", "height", "captured_at", "original_filename", "blur_data_url")
    return Page(
        pictures=[{k: row[k] for k in fields} for row in visible],
        total=int(total.head()[0]),
        next_cursor=following,
        media_expires_at=int(expires),
    )


def person_rules(prefix: str) -> dict:
    """Listing checks: ids, slug, name, count, all-or-none avatar fields."""
    avatar = keys.parse_avatar_key(F.col("avatar_key"), prefix)
    complete = (
        (avatar["person_id"] == F.col("id")) & (F.col("avatar_width") > 0) & (F.col("avatar_height") > 0)
    )
    absent = (
        F.col("avatar_key").isNull() & F.col("avatar_width").isNull() & F.col("avatar_height").isNull()
    )
    return {
        "id": F.length("id").between(1, 512),
        "slug": keys.valid_slug(F.col("slug")),
        "display_name": F.length(F.trim("display_name")) > 0,
        "photo_count": F.col("photo_count") >= 1,
        "avatar": F.coalesce(complete, F.lit(False)) | absent,
    }


def list_people(
    people: DataFrame,
    photo_people: DataFrame,
    pictures: DataFrame,
    *,
    album_id: str,
    prefix: str,
    links: Links,
    now_seconds: float,
) -> DataFrame:
    """The people of one album with counts and signed avatars, in list order."""
    counts = facets.people_counts(people, photo_people, pictures, album_id)
    require_none(violations(counts, F.col("id"), person_rules(prefix)), "invalid person")
    return facets.listing_order(_links(counts, links, now_seconds, avatar_url="avatar_key")).drop(
        "avatar_key"
    )


def earliest_expiry(pages: DataFrame, column: str = "media_expires_at") -> DataFrame:
    """Smallest positive expiry over pages; invalid values do not count."""
    return pages.agg(F.min(F.when(F.col(column) > 0, F.col(column))).alias("earliest_expiry"))


def joined_pages(pages: DataFrame, page: str, position: str, key: str = "id") -> DataFrame:
    """Concatenated pages with repeats removed and one running index.

    The first appearance of a key wins.
    """
    from ..operators.numbering import dense_index, keep_first

    unique = keep_first(pages, [key], [F.col(page), F.col(position)])
    return dense_index(unique, [F.col(page), F.col(position), F.col(key)], "global_index")
