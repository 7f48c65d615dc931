"""Connected components and a bounded prefilter, both in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

BITMAP_BITS = 1 << 23


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Root (the smallest node reachable) of every node on an edge.

    edges: a, b. Alternates large-star and small-star steps until each
    component is a star. A step is one minimum per node and one join, so no
    node's neighbours are ever gathered; the number of edges never grows.
    Returns node, root for all nodes but the roots. A step halves the depth of
    a component at least; running out of ``rounds`` raises, since the roots
    would be wrong.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut_lineage(e, "edges")
    for _ in range(rounds):
        if e.isEmpty():
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        # Large star: neighbours above a node go to the least of all its neighbours and itself.
        e = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its neighbours below it go to the least of them.
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(low, "a")
        e = cut_lineage(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(),
            "edges",
        )
        # Done when no root has a root and every node has one.
        if e.join(e.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty() and (
            e.groupBy("a").count().where("count > 1").isEmpty()
        ):
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))


def _words(keys: DataFrame, key: str) -> DataFrame:
    return (
        keys.select(_slot(key).alias("_slot"))
        .groupBy(F.shiftright("_slot", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 as int))")).alias("_bits"))
    )


def _hit() -> Column:
    return F.expr("shiftrightunsigned(_bits, cast(_slot % 64 as int)) & 1") == 1


def likely(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` may be among the keys, before a join that settles it.

    The keys set bits of a map of fixed size, at most 131,072 rows of 64 bits
    and so safe to broadcast at any scale. It only spares the join's shuffle
    rows that cannot match; with very many keys it passes more of them.
    """
    marked = rows.withColumn("_slot", _slot(column)).withColumn("_word", F.shiftright("_slot", 6))
    return marked.join(F.broadcast(_words(keys, key)), "_word").where(_hit()).select(*rows.columns)


def without(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` is not among the keys; nulls stay.

    Rows the bitmap of ``likely`` clears stay where they are; only the others
    are shuffled to settle them.
    """
    marked = rows.withColumn("_slot", _slot(column)).withColumn("_word", F.shiftright("_slot", 6))
    found = marked.join(F.broadcast(_words(keys, key)), "_word", "left")
    hit = F.coalesce(_hit(), F.lit(False)) & F.col(column).isNotNull()
    clear = found.where(~hit).select(*rows.columns)
    asked = found.where(hit).select(*rows.columns)
    return clear.unionByName(asked.join(keys.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti"))
