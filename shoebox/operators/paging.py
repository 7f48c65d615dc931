"""Keyset paging: orders, page predicates, single pages and all boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cursor import SORTS, Cursor, cursor_column
from ..functions.text import iso_micros
from .numbering import dense_index

GALLERY_COLUMNS = (
    "id", "original_filename", "captured_at", "album_position", "width", "height",
    "thumb_key", "display_key", "blur_data_url",
)


def published_in_album(pictures: DataFrame, album_id: str) -> DataFrame:
    return pictures.where((F.col("album_id") == album_id) & F.col("published"))


def gallery_projection(pictures: DataFrame) -> DataFrame:
    """The nine listed columns plus the microsecond text of the capture time."""
    present = [c for c in GALLERY_COLUMNS if c in pictures.columns]
    return pictures.select(*present, iso_micros(F.col("captured_at")).alias("captured_at_cursor"))


def shuffle_key(seed: str, id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id))


def sort_columns(sort: str, seed: str | None = None) -> list[Column]:
    """Total order of each listing; missing capture times always come last."""
    tail = [F.col("album_position").asc(), F.col("id").asc()]
    if sort == "album":
        return tail
    if sort == "newest":
        return [F.col("captured_at").desc_nulls_last(), *tail]
    if sort == "oldest":
        return [F.col("captured_at").asc_nulls_last(), *tail]
    if sort == "shuffle":
        return [shuffle_key(seed, F.col("id")).asc(), F.col("id").asc()]
    raise ValueError(f"sort must be one of {SORTS}")


def after_pair(first: Column, second: Column, first_value: Column, second_value: Column) -> Column:
    """(first, second) > (values), spelled so Parquet can skip row groups."""
    return (first >= first_value) & (
        (first > first_value) | ((first == first_value) & (second > second_value))
    )


def after_cursor(cursor: Cursor) -> Column:
    """Rows strictly after the cursor in its own sort order."""
    id, last_id = F.col("id"), F.lit(cursor.id)
    if cursor.sort == "shuffle":
        return after_pair(shuffle_key(cursor.seed, id), id, F.lit(cursor.shuffle_key), last_id)
    position = after_pair(F.col("album_position"), id, F.lit(cursor.position), last_id)
    if cursor.sort == "album":
        return position
    taken = F.col("captured_at")
    if cursor.captured_at is None:
        return taken.isNull() & position
    last = F.to_timestamp(F.lit(cursor.captured_at))
    beyond = taken < last if cursor.sort == "newest" else taken > last
    return taken.isNull() | beyond | ((taken == last) & position)


def page(
    pictures: DataFrame,
    sort: str,
    limit: int,
    *,
    seed: str | None = None,
    cursor: Cursor | None = None,
) -> DataFrame:
    """Up to ``limit`` rows: Spark plans this as one top-k, not a full sort."""
    rows = pictures if cursor is None else pictures.where(after_cursor(cursor))
    return rows.orderBy(*sort_columns(sort, seed)).limit(limit)


def page_boundaries(
    pictures: DataFrame,
    sort: str,
    page_size: int,
    *,
    seed: str | None = None,
    person: str | None = None,
) -> DataFrame:
    """(page_no, rows, last_id, next_cursor) of every page at once.

    Walking cursors costs one query per page; this numbers the rows once by a
    range-partitioned sort and keeps each page's last row. The final page has
    no cursor.
    """
    keep = pictures.select("id", "album_position", "captured_at")
    index = dense_index(keep, sort_columns(sort, seed), "i")
    encoded = cursor_column(
        sort,
        F.col("id"),
        position=F.col("album_position"),
        captured_at_micros=iso_micros(F.col("captured_at")),
        seed=seed,
        shuffle_key=shuffle_key(seed or "", F.col("id")),
        person=person,
    )
    pages = (
        index.withColumn("page_no", F.floor(F.col("i") / page_size).cast("bigint"))
        .groupBy("page_no")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max_by(F.struct("id", "album_position", "captured_at"), "i").alias("last"),
        )
        .select("page_no", "rows", "last.*")
    )
    total = index.agg(F.count(F.lit(1)).alias("total"))
    ended = F.col("page_no") * page_size + F.col("rows") == F.col("total")
    return pages.crossJoin(F.broadcast(total)).select(
        "page_no", "rows", F.col("id").alias("last_id"),
        F.when(~ended, encoded).alias("next_cursor"),
    )
