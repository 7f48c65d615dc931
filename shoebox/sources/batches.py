"""Numbered batches of lines in few files, written and read by a Spark data source.

Every task writes the batches it holds one after the other into one file, with
an index of where each begins. The commit names the files of the attempts that
Spark accepted in one listing: before that a reader sees nothing, and files of
lost or repeated attempts are never read. The listing has one entry per task,
so the driver's part does not grow with the batches.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LISTING = "batches.json"
INDEX_SCHEMA = "batch_no long, file string, start long, bytes long, rows long, sha256 string"


class DamagedBatch(RuntimeError):
    """A batch's bytes are not those that were written."""


def _location(path: str):
    scheme, far, rest = path.partition("://")
    if far and scheme != "file":
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), rest if far else path.removeprefix("file:")


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote."""

    file: str
    first: int
    last: int
    batches: int


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, base = _location(self.path)
        files.create_dir(f"{base}/data", recursive=True)
        name = f"data/{uuid.uuid4().hex}"
        lines: list[bytes] = []
        number = first = None
        batches = start = 0
        with files.open_output_stream(f"{base}/{name}.lines") as data, files.open_output_stream(f"{base}/{name}.index") as index:

            def close() -> None:
                nonlocal batches, start
                text = b"".join(lines)
                data.write(text)
                entry = {
                    "batch_no": number, "file": name, "start": start, "bytes": len(text), "rows": len(lines),
                    "sha256": hashlib.sha256(text).hexdigest(),
                }
                index.write(json.dumps(entry).encode() + b"\n")
                batches, start = batches + 1, start + len(text)
                lines.clear()

            for rows in iterator:
                for batch_no, value in zip(rows["batch_no"].to_pylist(), rows["value"].to_pylist()):
                    if batch_no is None or value is None:
                        raise ValueError("a line needs a batch number and a text")
                    if batch_no != number:
                        if number is not None:
                            if batch_no < number:
                                raise ValueError("lines must come in the order of their batches")
                            close()
                        number = batch_no
                        first = number if first is None else first
                    lines.append(value.encode() + b"\n")
            if number is not None:
                close()
        if number is None:
            files.delete_file(f"{base}/{name}.lines")
            files.delete_file(f"{base}/{name}.index")
            return Part("", 0, 0, 0)
        return Part(name, first, number, batches)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = _location(self.path)
        parts = sorted((m for m in messages if m is not None and m.batches), key=lambda p: p.first)
        for before, after in zip(parts, parts[1:]):
            if after.first <= before.last:
                raise ValueError(f"batch {after.first} was written by two tasks")
        if files.get_file_info(f"{base}/{LISTING}").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} holds batches already")
        files.create_dir(base, recursive=True)
        hidden = f"{base}/.{LISTING}-{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write(json.dumps([asdict(p) for p in parts]).encode())
        files.move(hidden, f"{base}/{LISTING}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = _location(self.path)
        for part in messages:
            if part is not None and part.batches:
                files.delete_file(f"{base}/{part.file}.lines")
                files.delete_file(f"{base}/{part.file}.index")


def _listing(path: str) -> list[Part]:
    files, base = _location(path)
    with files.open_input_stream(f"{base}/{LISTING}") as listed:
        return [Part(**p) for p in json.loads(listed.read())]


class BatchReader(DataSourceReader):
    """One partition per written file; files without an asked batch are not opened."""

    def __init__(self, path: str, first: int | None, last: int | None) -> None:
        self.path, self.first, self.last = path, first, last

    def _asked(self, first: int, last: int) -> bool:
        return (self.last is None or first <= self.last) and (self.first is None or last >= self.first)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.file) for p in _listing(self.path) if self._asked(p.first, p.last)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        files, base = _location(self.path)
        with files.open_input_stream(f"{base}/{partition.value}.index") as index, files.open_input_file(f"{base}/{partition.value}.lines") as data:
            for entry in map(json.loads, index.read().splitlines()):
                if not self._asked(entry["batch_no"], entry["batch_no"]):
                    continue
                text = data.read_at(entry["bytes"], entry["start"])
                if hashlib.sha256(text).hexdigest() != entry["sha256"]:
                    raise DamagedBatch(f"batch {entry['batch_no']} of {self.path}")
                values = text.decode().split("\n")[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([entry["batch_no"]] * len(values), pa.int64()), pa.array(range(1, len(values) + 1), pa.int64()), pa.array(values, pa.string())],
                    ["batch_no", "line_no", "value"],
                )


class NumberedBatches(DataSource):
    """Options when reading: ``first`` and ``last`` batch number, both included."""

    @classmethod
    def name(cls) -> str:
        return "numbered_batches"

    def schema(self) -> str:
        return "batch_no long, line_no long, value string"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are written once; take a new path")
        return BatchWriter(self.options["path"])

    def reader(self, schema) -> BatchReader:
        asked = [None if self.options.get(n) is None else int(self.options[n]) for n in ("first", "last")]
        return BatchReader(self.options["path"], *asked)


def numbered_batches(df: DataFrame, position: str, size: int = 250, largest: int | None = None) -> DataFrame:
    """Adds batch_no = floor(position / size) + 1 for dense positions.

    ``largest`` refuses bigger batches than a receiver takes; by default any size goes.
    """
    if size < 1 or (largest is not None and size > largest):
        raise ValueError("a batch holds at least one row and no more than its receiver takes")
    return df.withColumn("batch_no", (F.floor(F.col(position) / size) + 1).cast("bigint"))


def write_batches(df: DataFrame, path: str, position: str, size: int = 250) -> None:
    """The rows as JSON lines in batches of ``size`` by dense positions, to a path not yet in use.

    A range shuffle gives each task whole batches that follow each other. A
    task holds one batch in memory. Rows are not deduplicated; a null position
    is refused. An empty table leaves an empty listing.
    """
    df.sparkSession.dataSource.register(NumberedBatches)
    numbered = numbered_batches(df, position, size).select(
        "batch_no", F.col(position).alias("_at"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    )
    ordered = numbered.repartitionByRange("batch_no").sortWithinPartitions("batch_no", "_at")
    ordered.select("batch_no", "value").write.format("numbered_batches").mode("append").save(path)


def read_batches(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(batch_no, line_no, value) of committed batches; bytes are checked against their hash."""
    spark.dataSource.register(NumberedBatches)
    reader = spark.read.format("numbered_batches")
    for name, value in (("first", first), ("last", last)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(path)


def batch_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each committed batch lies, with its size and hash, one row per batch."""
    parts = [f"{path}/{p.file}.index" for p in _listing(path)]
    shape = spark.read.schema(INDEX_SCHEMA)
    return shape.json(parts) if parts else spark.createDataFrame([], INDEX_SCHEMA)
