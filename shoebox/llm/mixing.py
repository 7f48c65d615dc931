"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import dense_index
from ..session import cut_lineage
from .common import WORD


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: sid, source, source_size, docs, square, weight, target.

    sized: source, size and n, the documents that share the row.
    Sources are numbered by code point, null last; weights repeat along that
    order. ``share`` times all sizes is dealt by weight; a target stops at
    ``cap`` times its source's size and the excess goes to the others. Each
    round is one aggregate over the sources, so their number may be large.
    """
    per_source = sized.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("square"),
    )
    numbered = dense_index(per_source, [F.col("source").asc_nulls_last()], "sid")
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    numbered = cut_lineage(
        numbered.withColumn("weight", F.element_at(dealt, (F.col("sid") % len(weights) + 1).cast("int"))), "sources"
    )
    limit = cap * F.col("source_size")
    total = numbered.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = 0.0, -1
    while True:
        full = (limit <= F.col("weight") * level) if capped >= 0 else F.lit(False)
        row = numbered.agg(
            F.sum(F.when(full, limit).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        if row["full"] == capped or not row["open"]:
            break
        level, capped = max(level, (total - row["given"]) / row["open"]), row["full"]
    return numbered.withColumn("target", F.least(limit, F.col("weight") * level).cast("double"))


def tilted_rate(tilt: Column, size: Column, scale: Column, cap: float) -> Column:
    """Copies of a document: exp(tilt * size / scale), at most ``cap``."""
    power = F.least(tilt * size / scale, F.lit(math.log(cap)))
    return F.when(power >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(power))


def solve_tilts(
    sizes: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-7, rounds: int = 60
) -> DataFrame:
    """Adds ``tilt`` to sources: the maximiser of the dual of entropy balancing.

    Among all rates between 0 and ``cap`` that meet the token constraint of
    their source, those of least relative entropy to one copy each have the
    form ``tilted_rate``. The dual is concave with one unknown per source, its
    gradient is target minus taken tokens. Every round is one Newton step for
    all sources at once, from sums over ``sizes`` (sid, size, n: the documents
    of a source that share a size), with bisection wherever Newton leaves the
    bracket known so far. A target at the cap needs no tilt but infinity,
    written as 1e300. Running out of ``rounds`` raises.
    """
    scale = F.when(F.col("source_size") > 0, F.col("square") / F.col("source_size")).otherwise(1.0)
    full = (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)) & (F.col("source_size") > 0)
    state = sources.select(
        "sid", "source", "source_size", "docs", "target", scale.alias("scale"),
        F.when(full, F.lit(1e300)).otherwise(
            F.coalesce(F.log(F.try_divide("target", "source_size")), F.lit(0.0))
        ).alias("tilt"),
        F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), full.alias("settled"),
    )
    state = cut_lineage(state, "tilts")
    for _ in range(rounds):
        rate = tilted_rate(F.col("tilt"), F.col("size"), F.col("scale"), cap)
        tokens = F.col("n") * F.col("size")
        moments = (
            sizes.join(state.where(~F.col("settled")).select("sid", "tilt", "scale"), "sid")
            .groupBy("sid")
            .agg(
                F.sum(tokens * rate).alias("taken"),
                F.sum(F.when(rate < cap, tokens * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("target") - F.col("taken")
        low = F.when(gap > 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.least("high", "tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + F.when(F.col("slope") > 0, gap / F.col("slope"))
        # Without a finite bracket on the far side, the step is bounded instead.
        middle = (
            F.when((low > -1e9) & (high < 1e9), (low + high) / 2)
            .when(gap > 0, F.col("tilt") + F.greatest(F.lit(1.0), F.abs("tilt")))
            .otherwise(F.col("tilt") - F.greatest(F.lit(1.0), F.abs("tilt")))
        )
        inside = newton.isNotNull() & (newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) <= F.abs(middle - F.col("tilt")) * 4)
        done = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        state = cut_lineage(
            state.join(moments, "sid", "left").select(
                "sid", "source", "source_size", "docs", "target", "scale",
                F.when(F.col("settled") | F.col("taken").isNull() | done, F.col("tilt"))
                .otherwise(F.when(inside, newton).otherwise(middle)).alias("tilt"),
                F.coalesce(low, F.col("low")).alias("low"), F.coalesce(high, F.col("high")).alias("high"),
                (F.col("settled") | F.col("taken").isNull() | done).alias("settled"),
            ),
            "tilts",
        )
        if state.where(~F.col("settled")).isEmpty():
            break
    else:
        raise RuntimeError(f"some source misses its target after {rounds} rounds")
    # Sums of doubles may differ in their last bits between runs; nine digits do not.
    return state.withColumn("tilt", F.when(F.col("tilt") < 1e300, F.round("tilt", 9)).otherwise(F.col("tilt")))


def round_rates(units: DataFrame, cap: int, unit_rows: int = 256) -> DataFrame:
    """Copies of each unit (sid, doc_id, size, n, rate) by error diffusion.

    The units of a source are dealt into buckets of about ``unit_rows`` by a
    hash. A bucket is folded from its largest to its smallest document; each
    takes the number of copies nearest to its rate plus what the larger ones
    left over, so a bucket misses its sum by half of its smallest document at
    most, where caps allow.
    """
    buckets = F.ceil(F.col("docs") / unit_rows)
    item = F.struct(
        (-F.col("size")).alias("order"), F.xxhash64("doc_id").alias("h"), "doc_id", "size", "n", "rate"
    )
    grouped = (
        units.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.greatest(buckets, F.lit(1))))
        .groupBy("sid", "bucket")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )

    def step(state: Column, x: Column) -> Column:
        size, n = x["size"], x["n"]
        wanted = state["left"] + n * x["rate"] * size
        copies = F.when(size > 0, F.greatest(F.lit(0), F.least(n * cap, F.round(wanted / size).cast("bigint")))).otherwise(
            F.lit(0).cast("bigint")
        )
        row = F.struct(x["doc_id"].alias("doc_id"), size.alias("size"), n.alias("n"), copies.alias("copies"))
        return F.struct((wanted - copies * size).alias("left"), F.concat(state["out"], F.array(row)).alias("out"))

    kind = dict(units.dtypes)["doc_id"]
    start = F.expr(
        f"named_struct('left', 0.0D, 'out', cast(array() as array<struct<doc_id:{kind},size:bigint,n:bigint,copies:bigint>>))"
    )
    folded = grouped.select("sid", F.inline(F.aggregate("items", start, step)["out"]))
    return folded


def mix_sources(
    docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2
) -> DataFrame:
    """Copies of every document so that each source's words come near its target.

    docs: doc_id, text, source; other columns are ignored. Returns one row per
    input row: doc_id, size, source, source_size, target, rate, copies, taken.
    A null text has size 0 and is never taken; a null source is a source of
    its own, the last; repeated rows each get their own copies (an equal
    number, or one more for some of them); an empty table gives no rows.
    """
    sized = cut_lineage(
        docs.select(
            "doc_id", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), "source"
        ).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")),
        "sizes",
    )
    sources = cut_lineage(source_targets(sized, weights, share, cap), "targets")
    ids = sources.select("sid", F.col("source").alias("_source"))
    keyed = cut_lineage(sized.join(ids, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source"), "keyed")
    sizes = cut_lineage(keyed.groupBy("sid", "size").agg(F.sum("n").alias("n")), "histogram")
    tilts = solve_tilts(sizes, sources, float(cap))
    rate = tilted_rate(F.col("tilt"), F.col("size"), F.col("scale"), float(cap))
    units = keyed.join(tilts.select("sid", "docs", "tilt", "scale"), "sid").withColumn("rate", rate)
    settled = round_rates(units, cap)
    # Equal rows come back as one row each; the first ones get the odd copies.
    rows = settled.select("*", F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("place", "_one"))
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("place") < F.col("copies") % F.col("n")).cast("bigint")
    return (
        rows.withColumn("copies", own)
        .join(tilts.select("sid", "source", "source_size", "target", "tilt", "scale"), "sid")
        .select(
            "doc_id", "size", "source", "source_size", "target", rate.alias("rate"), "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mix_documents(
    docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2
) -> DataFrame:
    """The mix itself: every document as often as ``mix_sources`` takes it, all columns.

    Rows that share doc_id, source and size share their copies; where these do
    not divide evenly, a hash of the row's place decides who gets one more. A
    null or empty text has no words and is never taken; columns keep their
    names and values, whatever they are called; an empty table gives no rows.
    """
    mixed = mix_sources(docs, weights=weights, share=share, cap=cap)
    many = mixed.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    many = cut_lineage(many.where("copies > 0").select(*[F.col(c).alias(f"mixed_{c}") for c in ("doc_id", "source", "size", "rows", "copies")]), "copies")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("mixed_rows"))
    own = F.floor(F.col("mixed_copies") / F.col("mixed_rows")) + (place < F.col("mixed_copies") % F.col("mixed_rows")).cast("bigint")
    # The row travels as one value, so that its names meet no others.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", size.alias("size"))
    # One row per document: it grows with the corpus, so it is shuffled at every size.
    met = rows.join(
        many.hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("mixed_doc_id")) & F.col("source").eqNullSafe(F.col("mixed_source")) & (F.col("size") == F.col("mixed_size")),
    )
    taken = met.select("row", F.when(F.col("mixed_rows") == 1, F.col("mixed_copies")).otherwise(own).alias("own")).where("own > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("own"))).alias("copy")).select("row.*")
