"""Ids as short bytes, for joins and groups that shuffle many of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: First byte of an id that is kept as its text; others hold the length of what leads the digits.
PLAIN = 255


def packed(id: Column) -> Column:
    """An id as bytes, equal where ids are equal, and half as long.

    Most ids are a word, an underscore and an even number of lower-case
    hexadecimal digits: two digits become a byte. Any other text is kept as it
    is behind a mark, so no two ids have the same bytes. Null stays null.
    """
    head, digits = F.substring_index(id, "_", 1), F.substr(id, F.instr(id, "_") + F.lit(1))
    # Told never to be null, so that a key without nulls gets no filter that would make it again.
    bytes_of = lambda text: F.coalesce(F.unhex(text), F.lit(b""))
    short = F.lower(F.hex(bytes_of(digits))) == digits
    size = F.octet_length(head)
    packs = (F.instr(id, "_") > 0) & (size < PLAIN) & short
    mark = bytes_of(F.lpad(F.hex(F.when(packs, size).otherwise(PLAIN)), 2, "0"))
    return F.concat(mark, F.when(packs, F.concat(head.cast("binary"), bytes_of(digits))).otherwise(id.cast("binary")))


def as_text(id: Column) -> Column:
    """An id as bytes that ``unpacked`` reads, but not shortened: cheap, for ids that are rarely sent."""
    return F.concat(F.lit(bytes([PLAIN])), id.cast("string").cast("binary"))


def unpacked(value: Column) -> Column:
    """The id that ``packed`` made the bytes of."""
    size = F.conv(F.hex(F.substring(value, 1, 1)), 16, 10).cast("int")
    rest = F.substr(value, F.lit(2))
    digits = F.lower(F.hex(F.substr(value, size + F.lit(2))))
    return F.when(size == PLAIN, rest.cast("string")).otherwise(F.concat(F.substr(value, F.lit(2), size).cast("string"), F.lit("_"), digits))
