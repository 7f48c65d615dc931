"""Opaque page cursors: a small driver-side codec and its column twin."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, functions as F

from . import keys
from .signing import base64url
from .text import ISO_TEXT

# Fixed values of the cursor format: names of the sorts and bounds of its fields.
SORTS = ("album", "newest", "oldest", "shuffle")
MAX_POSITION = 2**31 - 1
MAX_ENCODED = 1024
MAX_ID = 512


class InvalidCursor(ValueError):
    """The cursor is malformed or belongs to another listing."""


@dataclass(frozen=True)
class Cursor:
    """Last row of a page. Only the fields of its sort are set."""

    sort: str
    id: str
    position: int | None = None
    captured_at: str | None = None
    seed: str | None = None
    shuffle_key: str | None = None
    person: str | None = None


def _require(condition: bool) -> None:
    if not condition:
        raise InvalidCursor("Invalid cursor")


def is_slug(value: object) -> bool:
    return isinstance(value, str) and len(value) <= 128 and bool(re.fullmatch(keys.SLUG, value))


def is_seed(value: object) -> bool:
    return isinstance(value, str) and bool(re.fullmatch(keys.SEED, value))


def _is_position(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= MAX_POSITION


def _is_time(value: object) -> bool:
    if value is None:
        return True
    if not (isinstance(value, str) and len(value) <= 64 and re.fullmatch(ISO_TEXT, value)):
        return False
    try:
        datetime.fromisoformat(value)
    except ValueError:
        return False
    return True


def _payload(cursor: Cursor) -> dict[str, object]:
    head = {"v": 2, "s": cursor.sort, "f": cursor.person}
    if cursor.sort == "shuffle":
        return {**head, "r": cursor.seed, "k": cursor.shuffle_key, "i": cursor.id}
    if cursor.sort == "album":
        return {**head, "p": cursor.position, "i": cursor.id}
    return {**head, "t": cursor.captured_at, "p": cursor.position, "i": cursor.id}


def _check(cursor: Cursor) -> None:
    _require(cursor.sort in SORTS)
    _require(isinstance(cursor.id, str) and 0 < len(cursor.id) <= MAX_ID and "\0" not in cursor.id)
    _require(cursor.person is None or is_slug(cursor.person))
    if cursor.sort == "shuffle":
        _require(is_seed(cursor.seed))
        _require(
            isinstance(cursor.shuffle_key, str)
            and bool(re.fullmatch("[a-f0-9]{32}", cursor.shuffle_key))
        )
    else:
        _require(_is_position(cursor.position))
        _require(cursor.sort == "album" or _is_time(cursor.captured_at))


def encode_cursor(cursor: Cursor) -> str:
    _check(cursor)
    body = json.dumps(_payload(cursor), separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(body.encode()).rstrip(b"=").decode()


def decode_cursor(
    text: str, sort: str, person: str | None = None, seed: str | None = None
) -> Cursor:
    """Decode and bind to the listing being continued, or raise."""
    _require(sort in SORTS and (person is None or is_slug(person)))
    _require(is_seed(seed) if sort == "shuffle" else seed is None)
    _require(isinstance(text, str) and bool(re.fullmatch(r"[A-Za-z0-9_-]{1,%d}" % MAX_ENCODED, text)))
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        body = json.loads(raw.decode())
    except ValueError:
        raise InvalidCursor("Invalid cursor") from None
    _require(base64.urlsafe_b64encode(raw).rstrip(b"=").decode() == text)
    _require(isinstance(body, dict) and body.get("v") == 2 and not isinstance(body["v"], bool))
    cursor = Cursor(
        sort=sort,
        id=body.get("i"),
        position=body.get("p"),
        captured_at=body.get("t"),
        seed=body.get("r"),
        shuffle_key=body.get("k"),
        person=body.get("f"),
    )
    _check(cursor)
    _require(body.get("s") == sort and cursor.person == person and cursor.seed == seed)
    _require(set(body) == set(_payload(cursor)))
    return cursor


def cursor_column(
    sort: str,
    id: Column,
    *,
    position: Column | None = None,
    captured_at_micros: Column | None = None,
    seed: str | None = None,
    shuffle_key: Column | None = None,
    person: str | None = None,
) -> Column:
    """Encoded cursor per row, equal to :func:`encode_cursor`."""
    fields = [F.lit(2).alias("v"), F.lit(sort).alias("s"), F.lit(person).cast("string").alias("f")]
    if sort == "shuffle":
        fields += [F.lit(seed).alias("r"), shuffle_key.alias("k")]
    else:
        if sort != "album":
            fields.append(captured_at_micros.alias("t"))
        fields.append(position.cast("int").alias("p"))
    fields.append(id.alias("i"))
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return base64url(F.encode(body, "UTF-8"))
