"""Media columns: texts kept as 8-bit sound in ZIP archives, read by a Spark data source.

``write_archives`` stores each payload as a WAV member (8-bit samples, mono) of
a ZIP archive in the shared folder. ``ArchiveSource`` plans byte ranges over
the archives, streams the members of a range through Arrow and repeats a
failed member by its offset, without the rest of its range.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import scratch_path
from .common import small_batches

UNIT = 192
RATE = 8000
HEADER = 44


def padded(data: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of the unit."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def to_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit samples, one channel. The header holds lengths only."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload


def from_wav(media: bytes) -> bytes:
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or len(media) != HEADER + n:
        raise ValueError("not an 8-bit mono WAV member")
    return media[HEADER:]


def features(payload: bytes) -> str:
    """Level, spread, zero crossings and the energy shares of four bands."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128.0
    frames = x.reshape(-1, UNIT)
    power = (np.abs(np.fft.rfft(frames - frames.mean(axis=1, keepdims=True), axis=1)) ** 2).sum(axis=0)[1:]
    bands = power.reshape(4, -1).sum(axis=1)
    share = bands / bands.sum() if bands.sum() > 0 else bands
    crossings = float(np.mean(np.diff(np.signbit(x - x.mean())) != 0)) if len(x) > 1 else 0.0
    values = [float(x.mean()), float(x.std()), crossings, *map(float, share)]
    return ";".join(f"{v:.4f}" for v in values)


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder any executor can reach (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, archive_bytes: int = 64 << 20) -> str:
    """Stores every row of docs (doc_id, text) and returns the folder.

    Each task fills archives of about ``archive_bytes`` under names of its own
    attempt. The listing of archives is written by Spark after its tasks have
    ended, so archives of lost or repeated attempts are never read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "archives")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        fs.create_dir(path, recursive=True)
        sink = archive = name = None
        members = 0
        listed: list[tuple[str, int, int]] = []

        def close() -> None:
            archive.close()
            size = sink.tell()
            sink.close()
            listed.append((name, size, members))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if archive is None:
                    name, members = f"{uuid.uuid4().hex}.zip", 0
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, allowZip64=True, compresslevel=1)
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                info = zipfile.ZipInfo(f"{members:08d}.wav")
                info.compress_type = zipfile.ZIP_DEFLATED
                info.comment = json.dumps({"doc_id": doc_id, "n_bytes": len(data)}).encode()
                archive.writestr(info, to_wav(padded(data)), compresslevel=1)
                members += 1
                if sink.tell() >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in listed], pa.string()), pa.array([x[1] for x in listed], pa.int64()), pa.array([x[2] for x in listed], pa.int64())],
            ["archive", "size", "members"],
        )

    listing = docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(store, "archive string, size bigint, members bigint")
    listing.write.parquet(f"{folder}/listing")
    return folder


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, retries: int, batch_bytes: int):
        self.folder, self.range_bytes, self.retries, self.batch_bytes = folder, range_bytes, retries, batch_bytes

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of every listed archive; the listing has one row per archive, not per member."""
        fs, path = _place(self.folder)
        listed = pads.dataset(f"{path}/listing", filesystem=fs, format="parquet").to_table(["archive", "size"])
        return [
            ByteRange(name, start, min(size, start + self.range_bytes))
            for name, size in sorted(zip(listed["archive"].to_pylist(), listed["size"].to_pylist()))
            for start in range(0, size, self.range_bytes)
        ]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        """Members whose first byte lies in the range, found in the archive's own directory."""
        if partition is None:
            return
        fs, path = _place(self.folder)
        where = f"{path}/{partition.archive}"
        with fs.open_input_file(where) as file, zipfile.ZipFile(file) as archive:
            wanted = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        ids: list[int | None] = []
        sizes: list[int] = []
        media: list[bytes] = []
        held, source = 0, None
        for member in wanted:
            for attempt in range(self.retries + 1):
                try:
                    if source is None:
                        source = zipfile.ZipFile(fs.open_input_file(where))
                    data = source.read(member)  # checks the member's CRC
                    break
                except (OSError, EOFError, zipfile.BadZipFile, zipfile.zlib.error) as error:
                    source = None  # opened anew: only this member, at its offset, is read again
                    if attempt == self.retries:
                        raise OSError(f"{where}: member at offset {member.header_offset} cannot be read") from error
            about = json.loads(member.comment)
            ids.append(about["doc_id"])
            sizes.append(about["n_bytes"])
            media.append(data)
            held += len(data)
            if held >= self.batch_bytes:
                yield self._batch(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield self._batch(ids, sizes, media)

    @staticmethod
    def _batch(ids, sizes, media) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
        )


class ArchiveSource(DataSource):
    """Format ``archive_media``; options folder, rangeBytes, retries, batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "doc_id bigint, n_bytes bigint, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(
            self.options["folder"], int(self.options.get("rangeBytes", 8 << 20)), int(self.options.get("retries", 3)),
            int(self.options.get("batchBytes", 4 << 20)),
        )


def read_archives(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("archive_media").option("folder", folder)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text as sound, reads it back and describes what was read.

    docs: doc_id, text; other columns are ignored. One row per input row:
    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, media. A null or empty text is 192 blanks. Equal
    texts give equal values; repeated rows are stored each.
    """
    stored = read_archives(docs.sparkSession, write_archives(docs))

    @F.pandas_udf("string")
    def feature(column):
        return column.map(lambda media: features(from_wav(bytes(media))))

    return (
        stored.withColumn("feature", feature("media"))
        .withColumn("payload", F.expr(f"substring(media, {HEADER + 1})"))
        .select(
            "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_sha256"),
            F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
            F.octet_length("media").cast("bigint").alias("media_bytes"),
            F.sha2("media", 256).alias("media_sha256"), "feature", "media",
        )
    )
