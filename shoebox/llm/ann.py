"""Nearest neighbours by a block matrix join with int8 product tiles."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import compute_partitions, cut_lineage

#: Float products of int8 values are exact while a sum stays below 2^24.
EXACT_DIMS = (1 << 24) // (127 * 127)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of what they stand for, and of what is lost."""
    scale = np.abs(x).max(axis=1) / 127.0
    # A scale below the smallest normal double cannot be divided by; it loses the row.
    safe = np.where(scale > 1e-300, scale, 1.0)
    q = np.rint(x / safe[:, None]).clip(-127, 127).astype(np.int8)
    kept = q.astype(np.float64) * safe[:, None]
    return q, safe, np.sqrt((kept**2).sum(axis=1)), np.sqrt(((x - kept) ** 2).sum(axis=1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exactly, in slices of dimensions."""
    out = np.zeros((len(a), len(b)), np.float64)
    for start in range(0, a.shape[1], EXACT_DIMS):
        part = slice(start, start + EXACT_DIMS)
        out += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in doubles, summed in the order of the components."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def tile_best(
    q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, rows: int = 256
) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """The k best (score, -id) of a data block for each query, exactly.

    |x.y - tile| <= |x'| |e_y| + |e_x| |y|, where x' is what the int8 row
    stands for and e what it loses. A pair survives when its upper bound
    reaches the k-th best lower bound. Equal vectors are scored once and
    stand for their k + 1 smallest ids.
    """
    order = np.lexsort((d_ids, *d.T[::-1])) if len(d) else np.arange(0)
    d_ids, d = d_ids[order], d[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]).any(axis=1)])
    counts = np.diff(np.r_[first, len(d)])
    u = d[first]
    qd, sd, nd, ed = quantised(u)
    full = np.sqrt((u**2).sum(axis=1))
    weight = np.minimum(counts, k + 1)
    for start in range(0, len(q), rows):
        part = q[start : start + rows]
        qq, sq, nq, eq = quantised(part)
        near = int8_products(qq, qd) * sq[:, None] * sd
        slack = (nq[:, None] * ed + eq[:, None] * full) * (1 + 1e-9) + 1e-12 * nq[:, None] * nd
        low = near - slack
        if len(u) > k + 1:
            # One more than k: one of them may be the query itself.
            floor = np.partition(low, len(u) - k - 1, axis=1)[:, len(u) - k - 1]
        else:
            floor = np.full(len(part), -np.inf)
        at, column = np.nonzero(near + slack >= floor[:, None])
        score = products(part[at], u[column])
        edge = np.searchsorted(at, np.arange(len(part) + 1))
        for i in range(len(part)):
            own = q_ids[start + i]
            found = range(edge[i], edge[i + 1])
            pairs = (
                (score[j], -int(v))
                for j in found
                for v in d_ids[first[column[j]] : first[column[j]] + weight[column[j]]]
                if v != own
            )
            yield int(own), heapq.nlargest(k, pairs)


def _packed(vectors: DataFrame, block: Column, name: str) -> DataFrame:
    """One row per block: its ids and its matrix as bytes."""

    def pack(t: pa.Table) -> pa.Table:
        flat = t["vector"].combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        return pa.table(
            {
                "dims": t["dims"][:1],
                name: t[name][:1],
                f"{name}_ids": pa.array([t["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                f"{name}_rows": pa.array([values.tobytes()], pa.binary()),
            }
        )

    return (
        vectors.withColumn(name, block)
        .groupBy("dims", name)
        .applyInArrow(pack, f"dims int, {name} bigint, {name}_ids binary, {name}_rows binary")
    )


def nearest(
    vectors: DataFrame, queries: Column, *, k: int = 20, block_rows: int = 4096
) -> DataFrame:
    """Each query's k nearest rows by inner product.

    vectors: vec_id, embedding; other columns are ignored. ``queries`` is a
    predicate on vec_id. Returns query_id, rank, vec_id, score, nearest first,
    ties to the smaller id. Null ids and vectors that are null, empty, zero or
    hold null or non-finite components take no part; repeated equal rows count
    once; vectors of other lengths than the query's are not its candidates; an
    empty table gives no rows.

    Both sides are packed into blocks of about ``block_rows`` by a hash; every
    query block meets every data block once, in a grid of tasks, so a block is
    copied once per block of the other side and never row by row.
    """
    spark = vectors.sparkSession
    doubles = F.col("embedding").cast("array<double>")
    clean = cut_lineage(
        vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select(F.col("vec_id").cast("bigint"), doubles.alias("vector"), F.size("embedding").alias("dims"))
        .distinct(),
        "vectors",
    )
    asked = clean.where(queries)
    n, m = clean.count(), asked.count()
    data_blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_rows))
    dealt = F.xxhash64("vec_id", "vector")
    data = _packed(clean, F.pmod(dealt, F.lit(data_blocks)), "d")
    ask = _packed(asked, F.pmod(dealt, F.lit(query_blocks)), "q")
    # Stripes of data blocks per query block: enough tasks, few partial results.
    stripes = max(1, min(data_blocks, -(-4 * compute_partitions(spark) // query_blocks)))
    data = data.withColumn("stripe", F.pmod(F.col("d"), F.lit(stripes)))
    left = data.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))))
    right = ask.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stripes - 1).cast("bigint"))))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        held = None

        def flush() -> pa.RecordBatch:
            rows = [(own, -v, s) for own, best in heaps.items() for s, v in best]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                ["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for row in range(batch.num_rows):
                dims, at = batch["dims"][row].as_py(), batch["q"][row].as_py()
                if held != (dims, at):
                    if heaps:
                        yield flush()
                    heaps, held = {}, (dims, at)
                raw = {c: batch[c][row].as_buffer() for c in ("q_ids", "q_rows", "d_ids", "d_rows")}
                ids = {c: np.frombuffer(raw[f"{c}_ids"], "<i8") for c in "qd"}
                mat = {c: np.frombuffer(raw[f"{c}_rows"], "<f8").reshape(-1, dims) for c in "qd"}
                for own, best in tile_best(ids["q"], mat["q"], ids["d"], mat["d"], k):
                    known = heaps.get(own)
                    heaps[own] = best if known is None else heapq.nlargest(k, set(known) | set(best))
        if heaps:
            yield flush()

    met = left.join(right, ["dims", "q", "stripe"]).select("dims", "q", "q_ids", "q_rows", "d_ids", "d_rows")
    partial = met.sortWithinPartitions("dims", "q").mapInArrow(tiles, "query_id bigint, vec_id bigint, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = partial.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
