"""Set-based table changes: a DataFrame in, the next version out.

Plain Parquet has no MERGE or UPDATE. Each change is a join plus ``when`` and
the result is published as a new snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def upsert(
    old: DataFrame,
    new: DataFrame,
    key: Sequence[str],
    *,
    keep: Sequence[str] = (),
    defaults: Mapping[str, Column] | None = None,
    computed: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Insert new keys and refresh existing ones in one full outer join.

    ``keep`` columns hold their old value where the row exists. ``defaults``
    fill columns on insert only. ``computed`` expressions replace a column on
    every incoming row and may read ``_old.x``, ``_new.x``.
    """
    defaults, computed = dict(defaults or {}), dict(computed or {})
    columns = old.columns
    o = old.select(*key, F.struct(*columns).alias("_old"))
    n = new.select(*key, F.struct(*new.columns).alias("_new"))
    joined = o.join(n, list(key), "full_outer")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(name: str) -> Column:
        kind = old.schema[name].dataType
        before = F.col(f"_old.`{name}`")
        incoming = F.col(f"_new.`{name}`") if name in new.columns else before
        if name in computed:
            incoming = computed[name]
        elif name in defaults:
            incoming = F.when(has_old, incoming).otherwise(defaults[name])
        if name in keep:
            incoming = F.when(has_old, before).otherwise(incoming)
        return F.when(has_new, incoming).otherwise(before).cast(kind).alias(name)

    return joined.select(*[value(c) for c in columns])


def patch(
    table: DataFrame, changes: DataFrame, key: str, assignments: Mapping[str, Column], gone: Column | None = None
) -> DataFrame:
    """Rows found in ``changes`` (unique by key) get the assignments.

    Expressions read the table's columns plainly and the change's as ``_c.x``.
    Found rows for which ``gone`` is true leave, in the same join.
    """
    c = changes.select(F.col(key), F.struct(*changes.columns).alias("_c"))
    joined = table.join(c, key, "left")
    hit = F.col("_c").isNotNull()
    if gone is not None:
        joined = joined.where(~(hit & gone))
    return joined.select(
        *[
            F.when(hit, assignments[name]).otherwise(F.col(name)).cast(table.schema[name].dataType).alias(name)
            if name in assignments
            else F.col(name)
            for name in table.columns
        ]
    )


def delete_keys(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*key), list(key), "left_anti").select(*table.columns)


def insert_missing(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert rows whose key is not there yet; copies in the input collapse."""
    fresh = rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")
    return table.unionByName(fresh.select(*[c for c in table.columns if c in fresh.columns]), True)


def set_differences(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., side) for keys on one side only; empty means the sets agree."""
    e = expected.select(*key).distinct().withColumn("_e", F.lit(True))
    a = actual.select(*key).distinct().withColumn("_a", F.lit(True))
    side = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    return e.join(a, list(key), "full_outer").select(*key, side.alias("side")).where(
        F.col("side").isNotNull()
    )
