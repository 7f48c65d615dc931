from __future__ import annotations

import hashlib
import zipfile
import zlib

import pyarrow.fs as pafs
import pytest

from shoebox.llm import media
from tests.llm.texts import edge_docs, real_docs


def want(text):
    data = (text or "").encode()
    payload = data + b" " * ((-len(data)) % 192 if data else 192)
    wav = media.to_wav(payload)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(data), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(wav), sha(wav), media.features(payload)


@pytest.mark.parametrize("make", [edge_docs, lambda s: real_docs(s, 60)])
def test_round_trip(spark, make):
    frame = make(spark)
    rows = media.media_features(frame).drop("media").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    expected = [(r["doc_id"], *want(r["text"])) for r in frame.collect()]
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


def test_small_ranges_and_archives_lose_nothing(spark):
    frame = real_docs(spark, 80)
    folder = media.write_archives(frame.repartition(3), archive_bytes=20_000)
    reader = media.ArchiveReader(folder, 5_000, 2, 4_000)
    assert len(reader.partitions()) > 20
    got = media.read_archives(spark, folder, rangeBytes=5_000, batchBytes=4_000).collect()
    assert sorted((r["doc_id"], bytes(r["media"])) for r in got) == sorted(
        (r["doc_id"], media.to_wav(media.padded(r["text"].encode()))) for r in frame.collect()
    )


def test_a_member_is_read_again_by_itself(spark, monkeypatch):
    folder = media.write_archives(real_docs(spark, 30).coalesce(1))
    reader = media.ArchiveReader(folder, 1 << 30, 2, 1 << 20)
    (part,) = reader.partitions()
    whole, fails, read = sum(b.num_rows for b in reader.read(part)), {}, zipfile.ZipFile.read

    def flaky(self, member, *rest):
        fails[member.header_offset] = fails.get(member.header_offset, 0) + 1
        if fails[member.header_offset] == 1 and len(fails) % 3 == 0:
            raise OSError("lost")
        return read(self, member, *rest)

    monkeypatch.setattr(zipfile.ZipFile, "read", flaky)
    assert sum(b.num_rows for b in reader.read(part)) == whole == 30
    assert max(fails.values()) == 2 and sum(fails.values()) < 45
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="offset"):
        list(reader.read(part))


def test_damaged_bytes_are_noticed(spark):
    folder = media.write_archives(real_docs(spark, 5).coalesce(1))
    reader = media.ArchiveReader(folder, 1 << 30, 1, 1 << 20)
    (part,) = reader.partitions()
    fs, path = pafs.FileSystem.from_uri(folder)
    with open(f"{path}/{part.archive}", "r+b") as f:
        f.seek(200)
        f.write(b"\0\0\0\0")
    with pytest.raises(OSError):
        list(reader.read(part))


def test_empty_table(spark):
    assert media.media_features(edge_docs(spark).limit(0)).count() == 0
