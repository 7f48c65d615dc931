"""Data-quality rules: each returns the rows that break it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.packing import as_text, packed, unpacked

SCHEMA = "rule string, key string"


class RuleViolation(ValueError):
    """A guard found rows that must not exist."""


def violations(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, key) for each row and each rule that is not plainly true.

    All rules run in one pass over the table; a null outcome counts as broken.
    """
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def duplicates(df: DataFrame, columns: Sequence[str], rule: str, text: Callable[[Column], Column] | None = None) -> DataFrame:
    """(rule, key) once per value of ``columns`` that occurs more than once; ``text`` writes a value out."""
    text = text or (lambda value: value.cast("string"))
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(
            F.lit(rule).alias("rule"),
            F.concat_ws("|", *[text(F.col(c)) for c in columns]).alias("key"),
        )
    )


def orphans(
    child: DataFrame, child_key: Column, parent: DataFrame, child_column: str, parent_column: str,
    rule: str,
) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    ids = parent.select(F.col(parent_column).alias("_pk"))
    missing = child.where(F.col(child_column).isNotNull()).join(
        ids, F.col(child_column) == F.col("_pk"), "left_anti"
    )
    return missing.select(F.lit(rule).alias("rule"), child_key.cast("string").alias("key"))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# One-pass rules ------------------------------------------------------------------

#: What a value is held against: nothing, a single row, a row that offers it, a stated number.
_ROW, _UNIQUE, _REFERENCE, _CLAIM = range(4)
Values = Sequence[Column | str]


@dataclass(frozen=True)
class Checked:
    """A table with all it must satisfy by itself and together with others.

    rules: conditions of a row, broken where not plainly true; a row that
    breaks one is named by ``key``. unique: values that no two rows share.
    references: values that some row of the set must list under the same name
    in ``offers``. counted: values that count this row; ``claims`` states for
    a value how many rows of the set count it. A value holding a null asks and
    offers nothing, so a null column makes a constraint optional.
    """

    rows: DataFrame
    key: Column
    rules: Mapping[str, Column] = field(default_factory=dict)
    unique: Mapping[str, Values] = field(default_factory=dict)
    references: Mapping[str, Values] = field(default_factory=dict)
    offers: Mapping[str, Values] = field(default_factory=dict)
    counted: Mapping[str, Values] = field(default_factory=dict)
    claims: Mapping[str, tuple[Values, Column]] = field(default_factory=dict)


def _fact(rule: str, kind: int, value: Column, own: Column | int, offered: int) -> Column:
    own = own if isinstance(own, Column) else F.lit(own)
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), value.alias("value"),
        own.cast("bigint").alias("own"), F.lit(offered).cast("bigint").alias("offered"),
    )


def _facts(table: Checked) -> DataFrame:
    def value(parts: Values) -> Column:
        return F.array(*[packed((F.col(c) if isinstance(c, str) else c).cast("string")) for c in parts])

    def where_set(rule: str, kind: int, parts: Values, own: Column | int, offered: int) -> Column:
        columns = [F.col(c) if isinstance(c, str) else c for c in parts]
        known = columns[0].isNotNull()
        for c in columns[1:]:
            known = known & c.isNotNull()
        return F.when(known, _fact(rule, kind, value(parts), own, offered))

    facts = [
        F.when(~F.coalesce(ok, F.lit(False)), _fact(rule, _ROW, F.array(as_text(table.key)), 1, 0))
        for rule, ok in table.rules.items()
    ]
    facts += [where_set(rule, _UNIQUE, parts, 1, 0) for rule, parts in table.unique.items()]
    facts += [where_set(rule, _REFERENCE, parts, 1, 0) for rule, parts in table.references.items()]
    facts += [where_set(rule, _REFERENCE, parts, 0, 1) for rule, parts in table.offers.items()]
    facts += [where_set(rule, _CLAIM, parts, 1, 0) for rule, parts in table.counted.items()]
    # A claim takes its number off again; an unknown number can never come out even.
    facts += [
        where_set(rule, _CLAIM, parts, F.coalesce(-number.cast("bigint"), F.lit(1 << 40)), 1)
        for rule, (parts, number) in table.claims.items()
    ]
    return table.rows.select(F.explode(F.array_compact(F.array(*facts))).alias("_f")).select("_f.*")


def broken_rules(*tables: Checked) -> DataFrame:
    """(rule, key, violations) of a set of tables, each of them read once.

    A row says all it contributes in one explode; one aggregate, combined
    before the shuffle, sets uses, offers and claims of a value off against
    each other. So a value that a third of all rows refer to is one row per
    task, and no table is joined. ``key`` is the row's own for row rules and
    the value otherwise, several columns joined by ``|``; ``violations`` is
    the number of rows at fault, one for a repeated value or a false claim.
    """
    own, offered = F.col("own"), F.col("offered")
    sums = (
        union_all(*[_facts(t) for t in tables])
        .groupBy("rule", "kind", "value")
        .agg(F.sum("own").alias("own"), F.sum("offered").alias("offered"))
    )
    fault = (
        F.when(F.col("kind") == _ROW, own)
        .when(F.col("kind") == _UNIQUE, (own > 1).cast("bigint"))
        .when(F.col("kind") == _REFERENCE, F.when(offered == 0, own).otherwise(0))
        .otherwise(((offered > 0) & (own != 0)).cast("bigint"))
    )
    # Ids went through the shuffle as bytes.
    texts = F.transform("value", unpacked)
    key = F.when(F.size("value") == 1, texts[0]).otherwise(F.concat_ws("|", texts))
    return sums.select("rule", key.alias("key"), fault.alias("violations")).where(F.col("violations") > 0)


def rule_counts(found: DataFrame) -> DataFrame:
    """Rows at fault per rule."""
    each = F.sum("violations") if "violations" in found.columns else F.count(F.lit(1))
    return found.groupBy("rule").agg(each.alias("violations"))


def require_none(found: DataFrame, what: str) -> None:
    """Raise with one example if any violation exists; stops at the first."""
    row = found.head(1)
    if row:
        raise RuleViolation(f"{what}: {row[0].asDict()}")


def compare_fields(
    left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """(key..., field) per null-safe difference, 'missing' for one-sided keys."""
    a = left.select(*key, F.struct(*fields).alias("_a"))
    b = right.select(*key, F.struct(*fields).alias("_b"))
    both = a.join(b, list(key), "full_outer")
    one_sided = F.col("_a").isNull() | F.col("_b").isNull()
    differing = F.array_compact(
        F.array(
            *[
                F.when(~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), F.lit(f))
                for f in fields
            ]
        )
    )
    names = F.when(one_sided, F.array(F.lit("missing"))).otherwise(differing)
    return both.select(*key, F.explode(names).alias("field"))
