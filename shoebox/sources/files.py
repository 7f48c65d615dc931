"""File inventories and content fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import keys
from ..functions.text import natural_key
from ..operators.numbering import dense_index
from ..session import compute_partitions


def _files(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )


def inventory(
    spark: SparkSession, root: str, extensions: Sequence[str] = keys.IMAGE_EXTENSIONS
) -> DataFrame:
    """(path, relative_path, file_name, bytes, modified_at), contents unread.

    Spark's listing skips empty files, names starting with '.' and also those
    starting with '_'.
    """
    files = _files(spark, root).select("path", "length", "modificationTime")
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return files.where(keys.extension(F.col("path")).isin(*extensions)).select(
        "path",
        F.substring(bare, len(base) + 1, 1 << 20).alias("relative_path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` files in natural path order (a top-k, not a full sort)."""
    return files.orderBy(natural_key(F.col("relative_path")), "relative_path").limit(limit)


def _open(path: str):
    """A stream over a listed file: local disks, or whatever pyarrow's file systems reach (hdfs, s3, gs)."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or "/" in scheme:
        return pafs.LocalFileSystem().open_input_stream("/" + (rest or path).lstrip("/"))
    authority, _, name = rest.lstrip("/").partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    files, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return files.open_input_stream(f"{base.rstrip('/')}/{name}")


def hash_files(listed: DataFrame, *, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(path, bytes, sha256) of listed files, (path, bytes), read in pieces.

    Files are dealt to tasks by size, the largest first and one to each task in
    turn, and hashed as they stream by: a file of any size takes one piece of
    memory. ``bytes`` is what was read, for comparison with the listing.
    """
    spark = listed.sparkSession
    tasks = compute_partitions(spark)
    dealt = dense_index(listed.select("path", "bytes"), [F.col("bytes").desc(), F.col("path")], "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                digest, size = hashlib.sha256(), 0
                with _open(path) as stream:
                    while piece := stream.read(chunk_bytes):
                        digest.update(piece)
                        size += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([size]), pa.array([digest.hexdigest()])], ["path", "bytes", "sha256"]
                )

    shared = dealt.repartitionById(tasks, F.pmod(F.col("place"), F.lit(tasks)).cast("int"))
    return shared.mapInArrow(read, "path string, bytes long, sha256 string")


def fingerprints(
    spark: SparkSession, root: str, extensions: Sequence[str] = keys.IMAGE_EXTENSIONS
) -> DataFrame:
    """(path, bytes, sha256) of every accepted file; no other file is opened."""
    return hash_files(inventory(spark, root, extensions))
