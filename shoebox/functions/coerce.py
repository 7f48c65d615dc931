"""Lax numeric, JSON and capture-time coercions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_SAFE_INTEGER = 2**53 - 1


def finite_number(text: Column, *, explicit_null_is_zero: Column | None = None) -> Column:
    """Double when the text is a finite number, else null.

    ``explicit_null_is_zero`` marks rows whose source held a written null,
    which counts as 0; an absent value stays null.
    """
    number = F.expr("try_cast(NULL as double)") if text is None else text.try_cast("double")
    finite = F.when(
        ~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number
    )
    if explicit_null_is_zero is None:
        return finite
    return F.when(explicit_null_is_zero, F.lit(0.0)).otherwise(finite)


def safe_integer(text: Column, *, minimum: int | None = None) -> Column:
    """Bigint when the text is an integer within 2**53-1, else null."""
    number = text.try_cast("bigint")
    good = F.abs(number) <= MAX_SAFE_INTEGER
    if minimum is not None:
        good = good & (number >= minimum)
    return F.when(good, number)


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def status_from_flags(
    status: Column, ignored: Column, unknown: Column, display_name: Column | None = None
) -> Column:
    """Given status if it is a known one, else derived from flags and name."""
    derived = F.when(F.coalesce(ignored, F.lit(False)), "ignored").when(
        F.coalesce(unknown, F.lit(False)), "unknown"
    )
    if display_name is not None:
        derived = derived.when(F.length(F.coalesce(display_name, F.lit(""))) > 0, "labeled")
    chosen = F.lower(F.coalesce(status, derived.otherwise("unreviewed")))
    return F.when(
        chosen.isin("unreviewed", "labeled", "unknown", "ignored"), chosen
    ).otherwise("unreviewed")


def crop_side(config_json: Column) -> Column:
    """crop.side_px from lax JSON when it is an integer within 64..1024."""
    side = F.get_json_object(config_json, "$.crop.side_px").try_cast("int")
    return F.when(side.between(64, 1024), side)


def captured_at(
    exif_original: Column, exif_created: Column, mtime_ms: Column, birthtime_ms: Column
) -> Column:
    """struct(value, source): first valid EXIF time, else file time.

    The birth time counts only where the modification time is not positive.
    """
    exif = F.coalesce(F.try_to_timestamp(exif_original), F.try_to_timestamp(exif_created))
    file_ms = F.when(mtime_ms > 0, mtime_ms).otherwise(birthtime_ms)
    file_time = F.timestamp_millis(file_ms.cast("bigint"))
    return F.struct(
        F.coalesce(exif, file_time).alias("value"),
        F.when(exif.isNotNull(), "exif")
        .when(file_time.isNotNull(), "filesystem")
        .otherwise("unknown")
        .alias("source"),
    )


def half_even_round(value: Column, scale: int) -> Column:
    """Banker's rounding, the rule used wherever rounded values decide ties."""
    return F.bround(value, scale)
