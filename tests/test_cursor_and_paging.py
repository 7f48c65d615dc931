from __future__ import annotations

import base64
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.functions.cursor import Cursor, InvalidCursor, decode_cursor, encode_cursor
from shoebox.operators import paging
from shoebox.plans import gallery
from shoebox.workload.roles import SEED

KEY = "a" * 32


def raw(body: object) -> str:
    text = body if isinstance(body, str) else json.dumps(body, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).rstrip(b"=").decode()


@pytest.mark.parametrize(
    "cursor",
    [
        Cursor("album", "p1", position=7),
        Cursor("album", "p1", position=0, person="person-a1"),
        Cursor("newest", "p1", position=7, captured_at="2024-01-02T03:04:05.678901Z"),
        Cursor("oldest", "p1", position=7, captured_at=None, person="x-y"),
        Cursor("shuffle", "é1", seed=SEED, shuffle_key=KEY),
    ],
)
def test_round_trip(cursor):
    text = encode_cursor(cursor)
    assert "=" not in text
    assert decode_cursor(text, cursor.sort, cursor.person, cursor.seed) == cursor


GOOD = {"v": 2, "s": "album", "f": None, "p": 1, "i": "x"}


@pytest.mark.parametrize(
    "text",
    [
        "", "a" * 1025, "not base64!", raw("nope"), raw([1]), raw({**GOOD, "v": 1}), raw({**GOOD, "v": True}),
        raw({**GOOD, "s": "newest"}), raw({**GOOD, "extra": 1}), raw({k: v for k, v in GOOD.items() if k != "f"}),
        raw({**GOOD, "p": -1}), raw({**GOOD, "p": 2**31}), raw({**GOOD, "p": 1.5}), raw({**GOOD, "p": True}),
        raw({**GOOD, "i": ""}), raw({**GOOD, "i": "a\0b"}), raw({**GOOD, "i": "x" * 513}), raw({**GOOD, "f": "person-z"}),
        raw(GOOD) + "=", raw(GOOD)[:-1],
    ],
)
def test_bad_cursors(text):
    with pytest.raises(InvalidCursor):
        decode_cursor(text, "album")


def test_cursor_is_bound_to_its_listing():
    shuffled = encode_cursor(Cursor("shuffle", "x", seed=SEED, shuffle_key=KEY))
    for args in (("shuffle", None, "f" * 16), ("shuffle", None, None), ("album", None, None), ("shuffle", "person-a", SEED)):
        with pytest.raises(InvalidCursor):
            decode_cursor(shuffled, *args)
    for bad in ("2024-13-01T00:00:00Z", "2024-01-01", "2024-01-01T00:00:00.1234567Z"):
        with pytest.raises(InvalidCursor):
            decode_cursor(raw({"v": 2, "s": "newest", "f": None, "t": bad, "p": 1, "i": "x"}), "newest")


def make_pictures(spark, n=57):
    rng = random.Random(5)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(n):
        taken = None if i % 4 == 0 else start + timedelta(microseconds=rng.randrange(20) * 333)
        rows.append((f"p_{rng.randrange(10**6):06d}", "a", f"f{i}.jpg", taken, rng.randrange(9), i % 10 != 3))
    base = spark.createDataFrame(
        rows, "id string, album_id string, original_filename string, captured_at timestamp, album_position int, published boolean"
    )
    return base.select(
        "*", F.lit(10).alias("width"), F.lit(20).alias("height"), F.concat(F.lit("t/"), "id").alias("thumb_key"),
        F.concat(F.lit("d/"), "id").alias("display_key"), F.lit(None).cast("string").alias("blur_data_url"),
    )


@pytest.mark.parametrize("sort", ["album", "newest", "oldest", "shuffle"])
def test_walk_visits_every_row_once_in_order(spark, sort):
    pictures = make_pictures(spark).cache()
    seed = SEED if sort == "shuffle" else None
    albums = spark.createDataFrame([("a", 51)], "id string, photo_count long")
    links = gallery.Links("https://m.example/", b"k" * 32)
    empty = spark.createDataFrame([], schemas.PEOPLE)
    bridge = spark.createDataFrame([], schemas.PHOTO_PEOPLE)
    seen, cursor = [], None
    while True:
        page = gallery.list_pictures(
            pictures, albums, empty, bridge, album_id="a", links=links, now_seconds=1000.0, limit=7, sort=sort, cursor=cursor, seed=seed
        )
        assert page.total == 51 and page.media_expires_at == 1200 + 21600
        seen += [p["id"] for p in page.pictures]
        cursor = page.next_cursor
        if cursor is None:
            break
    shown = pictures.where("published")
    expected = [r["id"] for r in shown.orderBy(*paging.sort_columns(sort, seed)).collect()]
    assert seen == expected
    boundaries = paging.page_boundaries(shown, sort, 7, seed=seed).orderBy("page_no").collect()
    assert [b["last_id"] for b in boundaries] == [expected[min(i + 6, len(expected) - 1)] for i in range(0, len(expected), 7)]
    assert boundaries[-1]["next_cursor"] is None
    assert decode_cursor(boundaries[0]["next_cursor"], sort, None, seed).id == expected[6]


def test_signed_links_of_a_page_verify(spark):
    from shoebox.functions.signing import verified_expiry

    pictures = make_pictures(spark, 5)
    secret = b"s" * 32
    page = gallery.list_pictures(
        pictures, spark.createDataFrame([], "id string, photo_count long"), spark.createDataFrame([], schemas.PEOPLE),
        spark.createDataFrame([], schemas.PHOTO_PEOPLE), album_id="a", links=gallery.Links("https://m.example", secret), now_seconds=1000.0,
    )
    assert page.total == 0
    urls = spark.createDataFrame([(p["thumb_url"],) for p in page.pictures], "u string")
    checked = urls.select(
        verified_expiry(F.col("u"), F.lit(1000), secret).alias("ok"),
        verified_expiry(F.col("u"), F.lit(page.media_expires_at), secret).alias("late"),
        verified_expiry(F.concat("u", F.lit("x")), F.lit(1000), secret).alias("forged"),
        verified_expiry(F.col("u"), F.lit(1000), b"t" * 32).alias("other"),
    ).collect()
    assert all(r["ok"] == page.media_expires_at and r["late"] is None and r["forged"] is None and r["other"] is None for r in checked)


def test_person_page(spark):
    pictures = make_pictures(spark, 12)
    people = spark.createDataFrame([("q", "a", "person-q", "Quinn"), ("z", "b", "person-q", "Zed")], "id string, album_id string, slug string, display_name string")
    some = [r["id"] for r in pictures.where("published").limit(3).collect()]
    bridge = spark.createDataFrame([(i, "q") for i in some] + [(some[0], "z")], "photo_id string, person_id string")
    page = gallery.list_pictures(
        pictures, spark.createDataFrame([], "id string, photo_count long"), people, bridge, album_id="a",
        links=gallery.Links("https://m.example", b"s" * 32), now_seconds=0.0, person="person-q",
    )
    assert page.total == 3 and sorted(p["id"] for p in page.pictures) == sorted(some)


def test_list_people_checks_avatars(spark):
    from shoebox.operators.rules import RuleViolation

    pid = "person_" + "a" * 32
    shape = "id string, album_id string, slug string, display_name string, avatar_key string, avatar_width int, avatar_height int"
    good = (pid, "a", "person-a", "Ann", f"g/people/{pid}/avatar-{'b' * 20}.webp", 320, 320)
    plain = ("person_" + "c" * 32, "a", "person-c", "bob", None, None, None)
    pictures = spark.createDataFrame([("p1", "a", True), ("p2", "a", False)], "id string, album_id string, published boolean")
    bridge = spark.createDataFrame([("p1", pid), ("p2", pid), ("p1", plain[0])], "photo_id string, person_id string")
    args = dict(album_id="a", prefix="g", links=gallery.Links("https://m.example", b"s" * 32), now_seconds=0.0)
    listed = gallery.list_people(spark.createDataFrame([good, plain], shape), bridge, pictures, **args).collect()
    assert [(r["display_name"], r["photo_count"], r["avatar_url"] is not None) for r in listed] == [("Ann", 1, True), ("bob", 1, False)]
    with pytest.raises(RuleViolation):
        gallery.list_people(spark.createDataFrame([good[:4] + (None, 320, None), plain], shape), bridge, pictures, **args)


def test_limits_and_expiry(spark):
    from shoebox.functions.signing import expiry

    assert [gallery.clamp_limit(x) for x in ("5", "0", "999", "x", None)] == [5, 1, 120, 60, 60]
    row = spark.range(1).select(
        expiry(F.lit(300.0), F.lit(600)).alias("a"), expiry(F.lit(301.0), F.lit(5)).alias("b"), expiry(F.lit(0.0), F.lit(90000)).alias("c")
    ).head()
    assert (row["a"], row["b"], row["c"]) == (900, 600 + 21600, 21600)


def test_patterns_match_whole_values(spark):
    from shoebox.functions import keys, signing

    rows = spark.createDataFrame([("abc",), ("abc\n",), ("a" * 64,), ("a" * 64 + "\n",)], "v string")
    slug = [r[0] for r in rows.select(keys.valid_slug(F.col("v"))).collect()]
    digest = [r[0] for r in rows.select(keys.matches(F.col("v"), keys.SHA256)).collect()]
    assert slug == [True, False, True, False] and digest == [False, False, True, False]
    secret = b"s" * 32
    url = F.concat(F.lit("https://x/a?expires=99&signature="), signing.link_signature(F.lit("a"), F.lit(99), secret), F.col("v"))
    ends = spark.createDataFrame([("",), ("\n",)], "v string").select(signing.verified_expiry(url, F.lit(1), secret))
    assert [r[0] for r in ends.collect()] == [99, None]
