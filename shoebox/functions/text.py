"""Names, natural file order, time text and escaping."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .keys import whole

DIACRITIC = regex.compile(r"\p{Diacritic}")
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ISO_TEXT = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z"


@pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@pandas_udf(StringType())
def accent_fold(values: pd.Series) -> pd.Series:
    """Decompose, drop diacritics, lower-case, trim."""

    def fold(value: str) -> str:
        return DIACRITIC.sub("", unicodedata.normalize("NFD", value)).lower().strip()

    return values.map(fold, na_action="ignore")


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, ISO_MICROS)


def iso_millis(ts: Column) -> Column:
    """Millisecond text; ``date_format`` truncates the extra digits."""
    return F.date_format(ts, ISO_MILLIS)


def valid_iso(text: Column) -> Column:
    return F.coalesce(
        text.rlike(whole(ISO_TEXT)) & (F.length(text) <= 64) & F.try_to_timestamp(text).isNotNull(),
        F.lit(False),
    )


def natural_key(name: Column) -> Column:
    """Sort key for 'IMG_9 < IMG_10', case folded.

    A digit run becomes its length without leading zeros, in five digits, and
    its digits, so runs of any length compare as numbers.
    """
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"))

    def keyed(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, keyed), "")


def name_key(name: Column) -> Column:
    return F.lower(name)


def first_name(
    raw: Column, *, aliases: Mapping[str, str] | None = None, normalize: bool = True
) -> Column:
    """Display name: NFKC, trimmed, inner spaces collapsed, first word, alias.

    ``normalize=False`` keeps the expression free of Python for ASCII input.
    A result outside 1..120 characters is null.
    """
    text = nfkc(raw) if normalize else raw
    collapsed = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    word = F.split(collapsed, " ")[0]
    if aliases:
        pairs = [F.lit(x) for pair in sorted(aliases.items()) for x in pair]
        word = F.coalesce(F.create_map(*pairs)[name_key(word)], word)
    return F.when(F.length(word).between(1, 120), word)


def accent_insensitive_contains(text: Column, query: str) -> Column:
    """Substring test through a collation, with no Python in the plan."""
    return F.contains(
        F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(query.strip()), "UNICODE_CI_AI")
    )


def escape_like(query: str) -> str:
    return query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_contains(text: Column, query: str) -> Column:
    """Literal, case-insensitive ``LIKE %query%`` with its wildcards escaped."""
    return F.lower(text).like(f"%{escape_like(query.lower())}%")


def human_bytes(size: Column) -> Column:
    """'512 B', '1.5 KiB' ... up to TiB, one decimal above bytes."""
    amount = size.cast("double")
    # The unit names of the printed sizes.
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    text = F.concat(size.cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in enumerate(units[1:], start=1):
        scaled = F.format_string("%.1f", amount / float(1024**power))
        text = F.when(amount >= float(1024**power), F.concat(scaled, F.lit(f" {unit}"))).otherwise(
            text
        )
    return text
