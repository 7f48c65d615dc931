"""Near-duplicates by circulant MinHash, banding and exact verification in tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import bucketed, small_batches
from .components import components, likely, without
from .textpack import hash_words, mix, shingles, slices, word_bounds

UNIVERSE = 1 << 22
NO_ID = (1 << 63) - 1
#: Shingles and units that one side of a tile may hold.
TILE_SHINGLES, TILE_UNITS = 1 << 18, 512


@lru_cache(maxsize=1)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations: sigma spreads shingles, pi is read at shifted places.

    Coordinate k of a signature is the least pi[(sigma(x) + k) mod D] over a
    set's shingles x, so one row of the sliding view holds all shifts of x.
    """
    rng = np.random.default_rng(20240607)
    sigma = rng.permutation(UNIVERSE).astype(np.uint32)
    pi = rng.permutation(UNIVERSE).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.r_[pi, pi[:coordinates]], coordinates)


def signature(shingle_hashes: np.ndarray, coordinates: int) -> np.ndarray:
    sigma, shifted = permutations(coordinates)
    place = sigma[(shingle_hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    parts = [shifted[place[j : j + 4096]].min(axis=0) for j in range(0, len(place), 4096)]
    return parts[0] if len(parts) == 1 else np.min(parts, axis=0)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates, different for every band."""
    n, coordinates = signatures.shape
    parts = signatures.reshape(n, coordinates // rows, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, coordinates // rows + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix((key ^ parts[:, :, j]) * np.uint64(0x9FB21C651E98DF25))
    return key.view(np.int64)


def set_id(shingle_hashes: np.ndarray) -> int:
    """A 64-bit hash of a set, whatever the order: equal sets are one unit."""
    mixed = mix(shingle_hashes.copy())
    with np.errstate(over="ignore"):
        total = mixed.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(mixed)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, unit (null without shingles) and band keys of every text; columns after doc_id and text stay."""
    small_batches(docs.sparkSession)
    coordinates = bands * rows
    more = docs.columns[2:]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, units, keys = [], [], []
            for start, end, data, offsets in slices(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets)
                s, bound = shingles(hash_words(data, starts, ends), first, size)
                n = np.diff(bound)
                own = [s[bound[i] : bound[i + 1]] for i in np.flatnonzero(n)]
                found = band_keys(np.stack([signature(x, coordinates) for x in own]), rows) if own else []
                at = 0
                for i in range(end - start):
                    counts.append(int(n[i]))
                    units.append(set_id(own[at]) if n[i] else None)
                    keys.append(found[at] if n[i] else None)
                    at += bool(n[i])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()), pa.array(units, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                    *[batch[c] for c in more],
                ],
                ["doc_id", "n_shingles", "unit", "bands", *more],
            )

    kept = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in more)
    return docs.select(F.col("doc_id").cast("bigint"), "text", *more).mapInArrow(
        look, f"doc_id bigint, n_shingles bigint, unit bigint, bands array<bigint>{kept}"
    )


def unit_sets(docs: DataFrame, size: int) -> DataFrame:
    """unit, n, set (sorted 64-bit hashes as bytes) of every text with shingles."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(batch.column(0)):
                starts, ends, first = word_bounds(data, offsets)
                s, bound = shingles(hash_words(data, starts, ends), first, size)
                own = [s[bound[i] : bound[i + 1]] for i in np.flatnonzero(np.diff(bound))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(x) for x in own], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in own], pa.binary())],
                    ["unit", "set"],
                )

    return docs.select("text").mapInArrow(look, "unit bigint, set binary")


def tile_links(
    left: list[np.ndarray], right: list[np.ndarray] | None, share: tuple[int, int], width: int = 2048
) -> list[tuple[int, int]]:
    """A spanning forest of the links of a tile; indices count left, then right.

    Links are the pairs with share[1] * |A & B| >= share[0] * |A | B|: all pairs
    of ``left``, or pairs across when there is a right side. Intersections are
    exact: products of 0/1 matrices over the shingles that units share.
    """
    units = left + (right or [])
    n = np.array([len(x) for x in units], np.int64)
    value = np.concatenate(units)
    owner = np.repeat(np.arange(len(units)), n)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    times = np.diff(np.r_[first, len(value)])
    column = np.cumsum(np.repeat(times > 1, times) & np.isin(np.arange(len(value)), first)) - 1
    shared = np.repeat(times > 1, times)
    owner, column = owner[shared], column[shared]
    rows = len(left)
    common = np.zeros((rows, len(units) if right is None else len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((len(units), width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1.0
        common += part[:rows] @ (part if right is None else part[rows:]).T
    common = common.astype(np.int64)
    other = n if right is None else n[rows:]
    linked = share[1] * common >= share[0] * (n[:rows, None] + other[None] - common)
    whole = np.zeros((len(units), len(units)), bool)
    if right is None:
        whole[:] = linked
    else:
        whole[:rows, rows:] = linked
        whole[rows:, :rows] = linked.T
    forest, seen = [], np.zeros(len(units), bool)
    for root in range(len(units)):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            at = stack.pop()
            new = np.flatnonzero(whole[at] & ~seen)
            seen[new] = True
            forest += [(at, int(x)) for x in new]
            stack += new.tolist()
    return forest


def _verify(tiles: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) of tiles (tile, side, unit): a forest per tile."""

    def check(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        units = t["unit"].to_numpy()
        raw = [np.frombuffer(x.as_buffer(), "<u8") for x in t["set"]]
        order = np.lexsort((units, side))
        sides = [[raw[i] for i in order if side[i] == s] for s in (0, 1)]
        found = tile_links(sides[0], sides[1] or None, share) if sides[0] else []
        units = units[order]
        return pa.table({"a": pa.array([units[x] for x, _ in found], pa.int64()), "b": pa.array([units[y] for _, y in found], pa.int64())})

    return tiles.join(sets, "unit").select("tile", "side", "unit", "set").groupBy("tile").applyInArrow(check, "a bigint, b bigint")


def link_components(docs: DataFrame, *, size: int, share: tuple[int, int], bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, unit, component_id, root of every document; see ``near_duplicates``.

    root is a unit that names the component, null without shingles. Columns
    after doc_id and text stay.
    """
    drawn = cut_lineage(sketch(docs, size, bands, rows), "sketches")
    units = cut_lineage(
        drawn.where(F.col("unit").isNotNull()).groupBy("unit").agg(
            F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")
        ),
        "units",
    )
    exploded = units.select("unit", "n", F.explode("bands").alias("key"))
    # Bands that group the same units are one bucket.
    buckets = (
        exploded.groupBy("key")
        .agg(F.count(F.lit(1)).alias("units"), F.min("unit").alias("low"), F.max("unit").alias("high"), F.bit_xor("unit").alias("all"), F.sum("n").alias("total"))
        .where("units > 1").groupBy("units", "low", "high", "all", "total").agg(F.min("key").alias("key"))
    )
    buckets = cut_lineage(buckets.select("key", "units", "total"), "buckets")
    members = likely(exploded, "key", buckets, "key").join(buckets, "key")
    # A bucket beyond one tile is cut by size, since linked sets differ little in size, and by hash.
    step = math.log(share[1] / share[0]) * 1.001
    large = (F.col("units") > TILE_UNITS) | (F.col("total") > TILE_SHINGLES)
    group = F.when(large, F.floor(F.log("n") / step)).otherwise(F.lit(-1)).cast("int")
    members = cut_lineage(members.select("key", "unit", "n", group.alias("class")), "members")
    fits = F.greatest(F.lit(1), F.least(F.lit(TILE_UNITS), F.floor(F.lit(TILE_SHINGLES) / F.exp((F.col("class") + 1) * step))))
    classes = members.groupBy("key", "class").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "parts", F.when(F.col("class") < 0, F.lit(1)).otherwise(F.ceil(F.col("count") / fits)).cast("bigint")
    )
    chunk = F.pmod(F.xxhash64("unit"), F.col("parts"))
    members = cut_lineage(members.join(classes.drop("count"), ["key", "class"]).select("key", "class", chunk.alias("chunk"), "unit"), "chunks")
    wanted = members.select("unit").distinct().join(units.select("unit", "id"), "unit")
    ids = wanted.select("id").distinct()
    found = likely(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "text"), "id", ids, "id").join(ids, "id", "left_semi")
    sets = unit_sets(found, size).join(wanted.select("unit"), "unit", "left_semi").groupBy("unit").agg(F.first("set").alias("set"))
    # Every round of tiles reads sets by unit: they are dealt out once.
    sets = bucketed(sets, "unit")

    tile = lambda *c: F.xxhash64("key", *c)
    own = members.select(tile("class", "chunk").alias("tile"), F.lit(0).alias("side"), "unit")
    links = cut_lineage(_verify(own, sets, share), "links")
    # Buckets of several chunks: first neighbours in a chain, then all pairs of
    # chunks that are not already one component.
    chunks = members.groupBy("key", "class", "chunk").agg(F.count(F.lit(1)).alias("units"))
    numbered = cut_lineage(
        chunks.where("class >= 0").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("class", "chunk"))), "numbered"
    )
    other = numbered.select("key", F.col("class").alias("class2"), F.col("chunk").alias("chunk2"), F.col("place").alias("place2"))
    pairs = numbered.join(other, "key").where("place < place2 and class2 <= class + 1")
    if not pairs.isEmpty():
        for chained in (True, False):
            roots = components(links)
            rooted = members.where("class >= 0").join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn(
                "root", F.coalesce("root", "unit")
            )
            state = rooted.groupBy("key", "class", "chunk").agg(F.min("root").alias("low"), F.max("root").alias("high"))
            second = state.select("key", *[F.col(c).alias(f"{c}2") for c in ("class", "chunk", "low", "high")])
            todo = pairs.where("place2 = place + 1" if chained else "place2 > place + 1")
            todo = todo.join(state, ["key", "class", "chunk"]).join(second, ["key", "class2", "chunk2"])
            todo = todo.where("not (low = high and low2 = high2 and low = low2)")
            todo = cut_lineage(todo.select("key", "class", "chunk", "class2", "chunk2", tile("class", "chunk", "class2", "chunk2").alias("tile")), "todo")
            sides = todo.select("key", "class", "chunk", "tile", F.lit(0).alias("side")).union(
                todo.select("key", F.col("class2"), F.col("chunk2"), "tile", F.lit(1))
            )
            more = sides.join(members, ["key", "class", "chunk"]).select("tile", "side", "unit")
            links = cut_lineage(links.union(_verify(more, sets, share)), "links")
    roots = components(links)
    rooted = units.select("unit", "id").join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    by_unit = rooted.join(least, "root").select("unit", "component", "root")
    more = docs.columns[2:]
    named = drawn.select("doc_id", "n_shingles", "unit", *more).join(by_unit, "unit", "left")
    component = F.when(F.col("unit").isNull(), F.col("doc_id")).otherwise(F.nullif("component", F.lit(NO_ID)))
    return named.select("doc_id", "n_shingles", "unit", component.alias("component_id"), "root", *more)


def near_duplicates(
    docs: DataFrame, *, size: int = 5, share: tuple[int, int] = (80, 100), bands: int = 50, rows: int = 6
) -> DataFrame:
    """Components of documents whose sets of word shingles are nearly equal.

    docs: doc_id, text; other columns are ignored. Words are runs between
    ASCII blanks, with A-Z lowered; a text shorter than ``size`` words has one
    shingle. Two documents are linked when the intersection of their sets is
    at least share[0]/share[1] of the union. Returns one row per input row:
    doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links, itself included), kept (doc_id = component_id).

    Candidates share a band of their signatures: at the threshold a pair is
    missed with probability (1 - s^rows)^bands, by default 2e-7. Equal sets
    are one unit beforehand. Every pair of different units in a bucket is then
    decided on the full sets, in tiles of matrices; nothing is capped. Null
    texts and texts without words link with nothing. Rows with a null doc_id
    take part but name no component; where no row of a component has an id,
    component_id is null and kept is true. An empty table gives no rows.
    """
    found = link_components(docs.select("doc_id", "text"), size=size, share=share, bands=bands, rows=rows)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_per_group(
    docs: DataFrame, *, size: int = 5, share: tuple[int, int] = (80, 100), bands: int = 50, rows: int = 6
) -> DataFrame:
    """One document of each component of ``near_duplicates``, with all its columns.

    The one of smallest doc_id stays (null last, then by the text's hash). A
    row is told by its doc_id and its text: where a doc_id stands with two
    texts, each shares the fate of its own text, and rows without doc_id go
    and stay like any other. Of rows that repeat a doc_id and its text one
    stays; texts without words link with nothing. Columns keep their names and
    values, whatever they are called; very long texts are hashed whole; an
    empty table stays empty.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws(
        "|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(text).cast("string"), F.xxhash64(F.lit(1), text).cast("string")
    )
    found = link_components(docs.select("doc_id", "text", key.alias("key")), size=size, share=share, bands=bands, rows=rows)
    # Rows of one key share everything else.
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("doc_id"), F.min("root").alias("root"))
    keys = cut_lineage(keys, "keys")
    linked = keys.where("root IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    winners = linked.groupBy("root").agg(first).select("first.key")
    losers = cut_lineage(linked.join(winners, "key", "left_anti").select("key"), "losers")
    # The row travels as one value, so that its names meet no others.
    whole = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    stay = without(whole, "key", losers, "key")
    again = keys.where("times > 1 AND (doc_id IS NOT NULL OR root IS NOT NULL)").select("key")
    if again.isEmpty():
        return stay.select("row.*")
    once = without(stay, "key", again, "key")
    several = likely(stay, "key", again, "key").join(again, "key", "left_semi")
    return once.select("row.*").unionByName(several.groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
