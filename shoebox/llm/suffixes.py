"""Removal of repeated byte strings by sorting suffixes deep-shallow.

A byte goes when a string of ``length`` bytes covering it also starts in a
document with a smaller id. Each such string (window) belongs to its anchor,
the 24-byte gram of least hash in it, so equal windows have equal anchors
wherever they stand. Windows in a row with one anchor form a run. Only runs
whose anchor stands in two documents are sorted, by bucket of the anchor:
first by two words of eight bytes, then blind tries order what is still tied.
An anchor with many different runs is wide: its windows are sent one by one to
the buckets of their own hashes, so that only equal windows meet.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import bucketed, small_batches
from .katz import expand, planes, squeeze, unplanes
from .textpack import mix, slices

GRAM = 24
BLOCK_BYTES, BUCKET_BYTES, SEGMENT = 12 << 20, 8 << 20, 1 << 20
WIDE_RUNS = 4096
NO_ID = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)


def _loads(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place of the data, as little-endian words."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


RUN = np.dtype([("anchor", "<u8"), ("start", "<i8"), ("windows", "u1"), ("at", "u1")])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Runs of windows of all texts: hash of the anchor, first window, number
    of windows and place of the anchor after the first window."""
    out = []
    whole = np.ones(len(data), bool)  # places where a window does not leave its text
    for back in range(1, length):
        at = offsets[1:] - back
        whole[at[at >= offsets[:-1]]] = False
    span = length - GRAM + 1
    for base in range(0, len(data), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        w = _loads(part)
        grams = len(part) - GRAM + 1
        h = mix(w[:grams] * np.uint64(0x9E3779B97F4A7C15) ^ mix(w[8 : grams + 8] * np.uint64(0xC2B2AE3D27D4EB4F) ^ mix(w[16 : grams + 16].copy())))
        # Least hash of each window; the place in the low bits tells which, the leftmost of ties.
        low = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :]) if span > reach else low
        anchor = (low[:n] & _PLACE).astype(np.int64)
        s = np.flatnonzero(whole[base : base + n])
        if not len(s):
            continue
        anchor = anchor[s]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)])
        found = np.zeros(len(first), RUN)
        # Least hashes crowd near zero; mixed once more they spread over the buckets.
        found["anchor"], found["start"] = mix(h[anchor[first]]), base + s[first]
        found["windows"], found["at"] = np.diff(np.r_[first, len(s)]), anchor[first] - s[first]
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, RUN)


def hash_spans(words: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from the loads of their buffer."""
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, int(size.max()) if len(size) else 0, 8):
        left = np.clip(size - at, 0, 8)
        on = np.flatnonzero(left)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - left[on]).astype(np.uint64))
        h[on] = mix((h[on] ^ (words[starts[on] + at] & mask)) * np.uint64(0x9FB21C651E98DF25))
    return h


# ---- deep-shallow sorting -------------------------------------------------


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Indices of equal strings together, in the order of the strings (all of one length).

    Inner nodes know only at which byte their strings part. A string goes down
    without looking at the bytes between, is compared once with the leaf it
    reaches, and is put where the two really differ.
    """
    root: list = [None, [0]]  # leaf: [None, indices]; inner: [depth, {byte: node}]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        if s == other:
            node[1].append(i)
            continue
        depth = next(k for k, (x, y) in enumerate(zip(s, other)) if x != y)
        up, node = None, root
        while node[0] is not None and node[0] < depth:
            up, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [None, [i]]
            continue
        new = [depth, {other[depth]: node, s[depth]: [None, [i]]}]
        if up is None:
            root = new
        else:
            up[1][s[up[0]]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out.append(node[1])
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow(buffer: bytes, starts: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rank of each string within all, ordered by group, then bytes; equal strings share a rank.

    Strings of a group have one length, at least 16. Two rounds of multikey
    quicksort with eight-byte keys part them to the shallow depth; each set
    that is still tied goes through a blind trie.
    """
    words = _loads(np.frombuffer(buffer, np.uint8))
    label = group.astype(np.int64)
    order = np.argsort(label, kind="stable")
    tied = np.ones(len(order), bool)
    rank = np.zeros(len(order), np.int64)
    for depth in (0, 8):
        some = order[tied]
        key = words[starts[some] + depth].byteswap()
        some = some[np.lexsort((key, label[some]))]
        order[tied] = some
        key = words[starts[order] + depth]
        new = np.r_[True, (label[order][1:] != label[order][:-1]) | (key[1:] != key[:-1])] if len(order) else np.zeros(0, bool)
        rank[order] = np.cumsum(new) - 1
        label = rank.copy()
        count = np.bincount(label) if len(label) else np.zeros(0, np.int64)
        tied = count[label[order]] > 1
    # Ranks get room for the strings of each tied set, then the tries fill it in.
    place = np.zeros(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, len(order)])) if len(order) else rank
    for lo, hi in zip(first, np.r_[first[1:], len(order)]):
        if hi - lo > 1:
            members = order[lo:hi].tolist()
            at = lo
            for same in blind_trie([buffer[starts[m] + 16 : starts[m] + size[m]] for m in members]):
                for k in same:
                    rank[members[k]] = at
                at += len(same)
    return rank


def settle(runs: np.ndarray, ids: np.ndarray, content: bytes, length: int) -> np.ndarray:
    """Bits of the windows of each run that also stand at a smaller id.

    Equal runs are settled as whole strings. Where an anchor has several
    different runs, their windows are sorted one by one, by how the anchor
    lies in them.
    """
    windows, at = runs["windows"].astype(np.int64), runs["at"].astype(np.int64)
    size = windows + length - 1
    starts = np.cumsum(size) - size
    shape = np.stack([runs["anchor"].view("<i8"), at, windows], axis=1)
    _, group = np.unique(shape, axis=0, return_inverse=True)
    rank = deep_shallow(content, starts, size, group.reshape(-1))
    least = np.full(len(runs), NO_ID)
    np.minimum.at(least, rank, ids)
    full = (np.int64(1) << windows) - 1
    bits = np.where(ids > least[rank], full, 0)
    # One run stands for all equal ones.
    _, chosen = np.unique(rank, return_index=True)
    anchors, of_anchor, different = np.unique(runs["anchor"][chosen], return_inverse=True, return_counts=True)
    chosen = chosen[different[of_anchor] > 1]
    if len(chosen):
        n = windows[chosen]
        run = np.repeat(chosen, n)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        # Windows are equal only at the same place relative to the same anchor.
        where = np.stack([runs["anchor"][run].view("<i8"), at[run] - nth], axis=1)
        _, group = np.unique(where, axis=0, return_inverse=True)
        found = deep_shallow(content, starts[run] + nth, np.full(len(run), length), group.reshape(-1))
        first = np.full(len(run), NO_ID)
        np.minimum.at(first, found, least[rank[run]])
        own = np.zeros(len(runs), np.int64)
        np.bitwise_or.at(own, rank[run], np.where(least[rank[run]] > first[found], np.int64(1) << nth, 0))
        bits |= own[rank]
    return bits


# ---- blocks and buckets ---------------------------------------------------


class Block:
    """Texts of a block with their ids; runs, and the items (runs, or windows of wide anchors) that are sent to buckets."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int):
        self.ids, self.data, self.offsets, self.length = ids, data, offsets, length
        self.runs = runs_of(data, offsets, length)
        self.doc = np.searchsorted(offsets, self.runs["start"], "right") - 1
        self.anchors, self.of_anchor = np.unique(self.runs["anchor"] >> np.uint64(16), return_inverse=True)

    def several(self) -> np.ndarray:
        """Anchors that stand at two ids or more within the block."""
        own = self.ids[self.doc]
        low, high = np.full(len(self.anchors), NO_ID), np.full(len(self.anchors), -NO_ID)
        np.minimum.at(low, self.of_anchor, own)
        np.maximum.at(high, self.of_anchor, own)
        return low < high

    def different(self) -> np.ndarray:
        """How many different runs of the block each anchor has, at most 65,535."""
        count = np.bincount(self.of_anchor, minlength=len(self.anchors))
        # Below eight the number of all runs will do.
        many = np.flatnonzero(count[self.of_anchor] > 8)
        runs = self.runs[many]
        content = hash_spans(_loads(self.data), runs["start"], runs["windows"].astype(np.int64) + self.length - 1)
        order = np.lexsort((content, self.of_anchor[many]))
        c, anchor = content[order], self.of_anchor[many][order]
        new = np.r_[True, (c[1:] != c[:-1]) | (anchor[1:] != anchor[:-1])] if len(c) else np.zeros(0, bool)
        count[anchor] = 0
        np.add.at(count, anchor[new], 1)
        return np.minimum(count, 65535).astype("<u2")

    def choose(self, shared: np.ndarray, wide: np.ndarray) -> None:
        """Takes the runs with shared anchors, those of wide ones as windows; equal items of the block become one, with the least id."""
        words = _loads(self.data)
        taken = np.flatnonzero(shared[self.of_anchor])
        apart = wide[self.of_anchor[taken]]
        whole, cut = taken[~apart], taken[apart]
        n = self.runs["windows"][cut].astype(np.int64)
        single = np.zeros(n.sum(), RUN)
        single["start"] = np.repeat(self.runs["start"][cut] - (np.cumsum(n) - n), n) + np.arange(len(single))
        single["windows"] = 1
        # A window takes its own hash as the anchor; all that equal it are wide too.
        single["anchor"] = hash_spans(words, single["start"], np.full(len(single), self.length))
        self.items = items = np.concatenate([self.runs[whole], single])
        self.own = own = self.ids[np.r_[self.doc[whole], np.repeat(self.doc[cut], n)]]
        content = hash_spans(words, items["start"], items["windows"].astype(np.int64) + self.length - 1)
        order = np.lexsort((own, content, items["windows"], items["at"], items["anchor"]))
        r, c = items[order], content[order]
        new = np.r_[True, (r["anchor"][1:] != r["anchor"][:-1]) | (c[1:] != c[:-1]) | (r["at"][1:] != r["at"][:-1]) | (r["windows"][1:] != r["windows"][:-1])] if len(r) else np.zeros(0, bool)
        self.sent = items[order[new]]
        self.stands_for = np.zeros(len(order), np.int64)
        self.stands_for[order] = np.cumsum(new) - 1
        self.sent_ids = own[order[new]]

    def remove(self, bits: np.ndarray) -> np.ndarray:
        """Which bytes go, from the bits of the sent items."""
        items = self.items
        full = (np.int64(1) << items["windows"].astype(np.int64)) - 1
        mine = np.where(self.own > self.sent_ids[self.stands_for], full, bits[self.stands_for])
        change = np.zeros(len(self.data) + 1, np.int32)
        for nth in range(int(items["windows"].max()) if len(items) else 0):
            s = items["start"][(mine >> nth) & 1 > 0] + nth
            np.add.at(change, s, 1)
            np.add.at(change, s + self.length, -1)
        return np.cumsum(change[:-1], dtype=np.int32) > 0


def _text_block(batch: pa.RecordBatch, row: int, length: int) -> Block:
    ids = np.array(batch["ids"][row].as_py(), np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch["texts"][row].as_py()), np.uint8)
    return Block(ids, data, expand(batch["bounds"][row].as_py(), "<i8"), length)


TEXT_SCHEMA = "block bigint, bucket bigint, ids array<bigint>, nulls array<boolean>, bounds binary, texts binary, anchors binary, several binary, different binary"


def anchor_blocks(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Per block one row of its texts (bucket -1) and one row per bucket of its distinct anchors."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in TEXT_SCHEMA.split(", ")]

    def flush(ids: list, parts: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        block_id = uuid.uuid4().int >> 65
        data, offsets = np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]
        own = [NO_ID if i is None else i for i in ids]
        block = Block(np.array(own, np.int64), data, offsets, length)
        texts = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
        rows = [(block_id, -1, own, [i is None for i in ids], squeeze(offsets), texts, None, None, None)]
        several, different = block.several(), block.different()
        edge = np.searchsorted((block.anchors >> np.uint64(48 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        for b in range(1 << bits):
            part = slice(edge[b], edge[b + 1])
            # Sorted values, as differences, need fewer bytes.
            rows.append((block_id, b, None, None, None, None, planes(np.diff(block.anchors[part], prepend=np.uint64(0)), 6), squeeze(np.packbits(several[part])), squeeze(different[part])))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, sizes, held = [], [], [], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for start, end, data, offsets in slices(batch.column(1)):
                ids += own[start:end]
                parts.append(data)
                sizes.append(np.diff(offsets))
                held += len(data)
                if held >= BLOCK_BYTES:
                    yield flush(ids, parts, sizes)
                    ids, parts, sizes, held = [], [], [], 0
        if ids:
            yield flush(ids, parts, sizes)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(look, TEXT_SCHEMA)


def shared_anchors(anchors: DataFrame, wide_runs: int = WIDE_RUNS) -> DataFrame:
    """block, bucket, shared, wide: which of the block's anchors stand at two ids anywhere, and which of all have more than ``wide_runs`` runs to send."""

    def merge(t: pa.Table) -> pa.Table:
        own = [np.cumsum(unplanes(x.as_py(), 6), dtype=np.uint64) for x in t["anchors"]]
        several = [np.unpackbits(expand(x.as_py(), "u1"), count=len(a)).astype(bool) for x, a in zip(t["several"], own)]
        every = np.concatenate(own)
        distinct, at, count = np.unique(every, return_inverse=True, return_counts=True)
        # Two blocks may hold one id twice; such anchors are sorted for nothing, and settled right.
        shared = (count > 1) | (np.bincount(at, weights=np.concatenate(several), minlength=len(distinct)) > 0)
        runs = np.concatenate([expand(x.as_py(), "<u2") for x in t["different"]])
        wide = np.bincount(at, weights=runs, minlength=len(distinct)) > wide_runs
        cut = lambda marks: np.split(marks[at], np.cumsum([len(a) for a in own])[:-1])
        return pa.table({
            "block": t["block"], "bucket": t["bucket"],
            "shared": pa.array([squeeze(np.packbits(p)) for p in cut(shared)], pa.binary()),
            "wide": pa.array([squeeze(np.packbits(p)) for p in cut(wide)], pa.binary()), "n": pa.array([len(a) for a in own], pa.int64()),
        })

    return anchors.groupBy("bucket").applyInArrow(merge, "block bigint, bucket bigint, shared binary, wide binary, n bigint")


def _by_block(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", *columns))).alias(name))


def _marks(batch: pa.RecordBatch, row: int) -> Iterator[np.ndarray]:
    """Which anchors of the block are shared, and which are wide."""
    parts = batch["anchors"][row].as_py()
    for name in ("shared", "wide"):
        yield np.concatenate([np.unpackbits(expand(a[name], "u1"), count=a["n"]).astype(bool) for a in parts])


def run_rows(texts: DataFrame, marks: DataFrame, length: int, bits: int) -> DataFrame:
    """block, bucket and the sent items of the bucket: shapes, ids and bytes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _text_block(batch, row, length)
                block.choose(*_marks(batch, row))
                runs, out = block.sent, []
                edge = np.searchsorted((runs["anchor"] >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
                for b in np.flatnonzero(np.diff(edge)):
                    part = runs[edge[b] : edge[b + 1]]
                    size = part["windows"].astype(np.int64) + length - 1
                    at = np.repeat(part["start"] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    out.append((batch["block"][row].as_py(), int(b), squeeze(part[["anchor", "windows", "at"]].astype(SENT)), squeeze(block.sent_ids[edge[b] : edge[b + 1]]), squeeze(block.data[at])))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["block", "bucket", "runs", "ids", "content"])

    joined = texts.join(marks, "block").select("block", "ids", "bounds", "texts", "anchors")
    return joined.mapInArrow(send, "block bigint, bucket bigint, runs binary, ids binary, content binary")


SENT = np.dtype([("anchor", "<u8"), ("windows", "u1"), ("at", "u1")])


def settled_runs(rows: DataFrame, length: int) -> DataFrame:
    """block, bucket, bits: the answers to each block's sent items, in their order."""

    def merge(t: pa.Table) -> pa.Table:
        runs = [expand(x.as_py(), SENT) for x in t["runs"]]
        ids = np.concatenate([expand(x.as_py(), "<i8") for x in t["ids"]])
        content = b"".join(zstandard.ZstdDecompressor().decompress(x.as_py()) for x in t["content"])
        every = np.concatenate(runs)
        # Runs of the same anchors are settled together, some at a time, which bounds the windows at hand.
        order = np.argsort(every["anchor"], kind="stable")
        size = every["windows"].astype(np.int64) + length - 1
        starts = np.cumsum(size) - size
        bits = np.zeros(len(every), np.int64)
        anchor = every["anchor"][order]
        lo = 0
        while lo < len(order):
            hi = min(len(order), lo + 20_000)
            if hi < len(order):
                hi = int(np.searchsorted(anchor, anchor[hi - 1], "right"))
            some = order[lo:hi]
            text = b"".join([content[starts[i] : starts[i] + size[i]] for i in some.tolist()])
            bits[some] = settle(every[some], ids[some], text, length)
            lo = hi
        parts = np.split(bits, np.cumsum([len(r) for r in runs])[:-1])
        return pa.table({"block": t["block"], "bucket": t["bucket"], "bits": pa.array([squeeze(p) for p in parts], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(merge, "block bigint, bucket bigint, bits binary")


def remove_repeats(docs: DataFrame, *, length: int = 50, bucket_bytes: int = BUCKET_BYTES, wide_runs: int = WIDE_RUNS) -> DataFrame:
    """Every text without the bytes that repeat a smaller document.

    docs: doc_id, text; other columns are ignored. Texts are UTF-8 bytes, null
    counts as empty; windows never cross texts and are judged on the input.
    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, kept (the remaining bytes, which may cut a
    character). Repeated rows of one doc_id do not remove each other; a null
    doc_id counts as larger than any. An empty table gives no rows.
    ``length`` is 40 to 55; ``bucket_bytes`` and ``wide_runs`` change no result.
    """
    if not GRAM + 16 <= length <= GRAM + 31:
        raise ValueError("length must be between 40 and 55")
    own = docs.select("doc_id", "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    coded = bucketed(anchor_blocks(own, length, bits), "block")
    texts = coded.where("bucket = -1").select("block", "ids", "nulls", "bounds", "texts")
    shared = cut_lineage(shared_anchors(coded.where("bucket >= 0").select("block", "bucket", "anchors", "several", "different"), wide_runs), "shared")
    marks = _by_block(shared, "anchors", "shared", "wide", "n")
    answers = cut_lineage(settled_runs(run_rows(texts, marks, length, bits), length), "settled")
    replies = _by_block(answers, "replies", "bits")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            for row in range(batch.num_rows):
                block = _text_block(batch, row, length)
                block.choose(*_marks(batch, row))
                replies = batch["replies"][row].as_py() or []
                bits_ = np.concatenate([expand(a["bits"], "<i8") for a in replies]) if replies else np.zeros(0, np.int64)
                gone = block.remove(bits_)
                starts = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
                first = block.offsets[:-1][np.diff(block.offsets) > 0]
                starts[first] = gone[first]
                edges = block.offsets[:-1][np.diff(block.offsets) > 0]
                count = lambda x: np.add.reduceat(x, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64)
                removed, spans = np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids), np.int64)
                filled = np.diff(block.offsets) > 0
                removed[filled], spans[filled] = count(gone), count(starts)
                nulls, out, held = batch["nulls"][row].as_py(), [], 0
                for i in range(len(block.ids)):
                    a, b = int(block.offsets[i]), int(block.offsets[i + 1])
                    kept = block.data[a:b][~gone[a:b]].tobytes()
                    out.append((None if nulls[i] else int(block.ids[i]), b - a, int(removed[i]), int(spans[i]), hashlib.sha256(kept).hexdigest(), kept))
                    held += b - a
                    if held >= 4 << 20 or i == len(block.ids) - 1:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names)
                        out, held = [], 0

    joined = texts.join(marks, "block").join(replies, "block", "left").select("ids", "nulls", "bounds", "texts", "anchors", "replies")
    return joined.mapInArrow(
        finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
