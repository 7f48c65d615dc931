"""Hash-derived identities and order-free set digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def photo_id(source_sha256: Column) -> Column:
    return F.concat(F.lit("p_"), F.substring(source_sha256, 1, 32))


def object_key(
    prefix: str, source_sha256: Column, kind: str, derivative_sha256: Column, extension: Column
) -> Column:
    """prefix/<2 hex shard>/<photo id>/<kind>-<20 hex>.<extension>."""
    return F.concat(
        F.lit(f"{prefix}/"),
        F.substring(source_sha256, 1, 2),
        F.lit("/"),
        photo_id(source_sha256),
        F.lit(f"/{kind}-"),
        F.substring(derivative_sha256, 1, 20),
        F.lit("."),
        extension,
    )


def avatar_key(prefix: str, person_id: Column, sha256: Column) -> Column:
    return F.concat(
        F.lit(f"{prefix}/people/"), person_id, F.lit("/avatar-"),
        F.substring(sha256, 1, 20), F.lit(".webp"),
    )


def person_slug(person_id: Column) -> Column:
    return F.concat(
        F.lit("person-"), F.substring(F.regexp_replace(person_id, "^person_", ""), 1, 12)
    )


def person_id_from_name_key(name_key: Column) -> Column:
    """Deterministic stand-in for a random person id."""
    return F.concat(F.lit("person_"), F.substring(sha256_hex(name_key), 1, 32))


def nul_fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL.

    ``concat_ws`` would silently drop nulls and shift fields, so a null part
    makes the whole fingerprint null.
    """
    joined = parts[0].cast("string")
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("\0"), part.cast("string"))
    return sha256_hex(joined)


def source_signature(path_nfc: Column, size: Column, mtime_ms: Column, profile: Column) -> Column:
    return nul_fingerprint(path_nfc, size, mtime_ms.cast("bigint"), profile)


def upload_fingerprint(sha256: Column, content_type: Column, cache_control: Column) -> Column:
    return nul_fingerprint(sha256, content_type, cache_control)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in sorted order and nulls written out."""
    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]),
        {"ignoreNullFields": "false"},
    )


def canonical_sha256(**fields: Column) -> Column:
    return sha256_hex(canonical_json(**fields))


#: Hex digits of a row's hash that name a node, level by level, up to the root.
LEVELS = (12, 8, 4, 0)


def _row_hash(columns: Sequence[str]) -> Column:
    return sha256_hex(canonical_json(**{c: F.col(c).cast("string") for c in columns}))


def row_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(top, h, t): the hash of each distinct row, its token, hash and number of copies, and the number of the node below the root.

    Hashes are dealt by that node, as bytes, half as long as their text.
    Copies in a batch are one row before, so they cannot fill a node.
    """
    row_hash = sha256_hex(canonical_json(**{c: F.col(c).cast("string") for c in columns}))
    hashes = df.select(F.unhex(row_hash).alias("b")).mapInArrow(_collapsed, "top int, b binary, n long")
    counted = hashes.repartition("top").groupBy("top", "b").agg(F.sum("n").alias("n"))
    return counted.select("top", F.lower(F.hex("b")).alias("h"), "n").select("top", "h", F.concat(F.col("h"), F.lit(":"), F.col("n").cast("string")).alias("t"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(top, b, n): each batch's distinct hashes and how often they come; top: their first four digits."""
    for batch in batches:
        if batch.num_rows:
            counts = batch["b"].value_counts()
            hashes = counts.field("values")
            first = np.frombuffer(b"".join(hashes.to_pylist()), np.uint8).reshape(len(hashes), -1)[:, :2].astype(np.int32)
            top = first[:, 0] * 256 + first[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(top, pa.int32()), hashes, counts.field("counts")], ["top", "b", "n"])


def _level(nodes: DataFrame, digits: int, *within: str) -> DataFrame:
    """(h, t) of the nodes one level up: a prefix, and the digest of what lies below it."""
    below = nodes.select(*within, F.substring("h", 1, digits).alias("h") if digits else F.lit("").alias("h"), "t")
    joined = below.groupBy(*within, "h").agg(sha256_hex(F.array_join(F.sort_array(F.collect_list("t")), "\n")).alias("d"))
    return joined.select(*within, "h", F.concat("h", F.lit("="), "d").alias("t"), "d")


def digest_nodes(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """(prefix, digest) of one level of the tree, ``digits`` being one of LEVELS.

    Two versions of a table differ below exactly the prefixes whose digests
    differ, and the nodes of tables without a prefix in common are a union.

    All levels but the root are made where ``row_tokens`` has dealt the hashes,
    without another shuffle.
    """
    nodes = row_tokens(df, columns)
    for level in LEVELS[: LEVELS.index(digits) + 1]:
        nodes = _level(nodes, level, "top") if level else _level(nodes, 0)
    return nodes.select(F.col("h").alias("prefix"), F.col("d").alias("digest"))


def set_digest(df: DataFrame, columns: Sequence[str], *, alias: str = "digest") -> DataFrame:
    """One-row digest of a multiset of rows, independent of their order.

    The root of a tree over the rows' hashes, of one shape for every size. A
    node joins its children's digests: at most 16**4 of them, below the last
    level as many rows as share 48 bits of their hash, few in any table.
    """
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return digest_nodes(df, columns, 0).agg(F.coalesce(F.min("digest"), empty).alias(alias))
