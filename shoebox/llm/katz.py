"""Language-model scores by Katz backoff over words.

Order two: a word after the word before it, backing off to the word alone.
Counts are Good-Turing discounted and the backoff weights make every history's
distribution sum to one over the training vocabulary and the unknown word.

Texts are taken in blocks of about a million tokens. A block sends each
distinct word and each distinct pair once, as packed arrays, to the bucket of
its hash; hot histories are spread over several buckets by the second word.
The buckets hold the partitioned count tables and answer each block in the
order of its question; the block then adds up its documents token by token.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import bucketed, partitions, small_batches
from .textpack import hash_words, mix, slices, word_bounds

#: Hashes of the end of a text and of what stands before its first word.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Counts above K are not discounted.
K = 5
BLOCK_TOKENS = 1_000_000
#: Bytes of text per bucket, and training tokens of one history beyond which it is spread.
BUCKET_BYTES, HOT_TOKENS = 8 << 20, 2_000_000


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _rows(columns: list[tuple[str, pa.DataType]], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in columns], [n for n, _ in columns])


def discounts(counts: list[int]) -> np.ndarray:
    """Factors of counts 1 to K from the number of types with counts 1 to K + 1.

    Katz's form of Good-Turing. Where the types are too few for it to give
    falling mass (a factor outside (0, 1)), half a count is taken off instead.
    """
    n = np.array([0, *counts], float)
    out = np.ones(K + 1)
    out[0] = 0.0
    rest = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out[r] = good if 0.0 < good < 1.0 else (r - 0.5) / r
    return out


@dataclass
class Unigram:
    """P(word) by its training count; count 0 is the unknown word, as one word."""

    total: int
    types: int
    factor: np.ndarray
    unknown: float

    @classmethod
    def of(cls, counts: list[int], total: int, types: int) -> Unigram:
        factor = discounts(counts)
        lost = sum(n * r * (1 - factor[r]) for r, n in enumerate(counts[:K], 1))
        if lost <= 0:  # nothing rare: half a count is set aside
            return cls(total, types, np.ones(K + 1), 0.5 / (total + 0.5))
        return cls(total, types, factor, lost / total)

    def p(self, count: np.ndarray) -> np.ndarray:
        count = np.asarray(count, float)
        scale = self.total if self.unknown != 0.5 / (self.total + 0.5) else self.total + 0.5
        low = np.minimum(count, K).astype(np.int64)
        seen = np.where(count <= K, self.factor[low], 1.0) * count / max(scale, 1)
        return np.where(count > 0, seen, self.unknown)


def ascending(x: np.ndarray) -> bytes:
    """Sorted values as differences, whose high bytes are mostly zero."""
    return planes(np.diff(x, prepend=np.uint64(0)), 8)


def unascending(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, 8), dtype=np.uint64)


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


WORD_ROWS = [
    ("block", pa.int64()), ("bucket", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ("bounds", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()),
]
WORD_SCHEMA = "block bigint, bucket bigint, doc_ids array<bigint>, held array<boolean>, bounds binary, tokens binary, words binary, counts binary"


def word_blocks(docs: DataFrame, bits: int) -> DataFrame:
    """docs: doc_id, text, held. Per block one row of its texts (bucket -1) and
    one row per bucket of its words: sorted hashes and their training counts."""
    small_batches(docs.sparkSession)

    def flush(ids: list, held: list, parts: list[np.ndarray]) -> list[dict]:
        h = np.concatenate(parts)
        length = np.array([len(p) for p in parts], np.int64)
        words, local = np.unique(h, return_inverse=True)
        train = np.repeat(~np.array(held, bool), length)
        counts = np.bincount(local, weights=train, minlength=len(words)).astype(np.int64)
        block = uuid.uuid4().int >> 65
        rows = [{
            "block": block, "bucket": -1, "doc_ids": ids, "held": held,
            "bounds": squeeze(np.r_[0, np.cumsum(length)]), "tokens": planes(local, 4), "words": ascending(words),
        }]
        edge = np.searchsorted(bucket_of(words, bits), np.arange((1 << bits) + 1))
        for b in range(1 << bits):
            part = slice(edge[b], edge[b + 1])
            if edge[b] < edge[b + 1]:
                rows.append({"block": block, "bucket": b, "words": ascending(words[part]), "counts": squeeze(counts[part])})
        return rows

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, parts, size = [], [], [], 0
        for batch in batches:
            own, out_ = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for start, end, data, offsets in slices(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets)
                h = hash_words(data, starts, ends)
                for i in range(end - start):
                    parts.append(np.r_[h[first[i] : first[i + 1]], END])
                    size += len(parts[-1])
                ids += own[start:end]
                held += out_[start:end]
                if size >= BLOCK_TOKENS:
                    yield _rows(WORD_ROWS, flush(ids, held, parts))
                    ids, held, parts, size = [], [], [], 0
        if parts:
            yield _rows(WORD_ROWS, flush(ids, held, parts))

    return docs.select(F.col("doc_id").cast("bigint"), "text", "held").mapInArrow(look, WORD_SCHEMA)


def word_counts(words: DataFrame, bits: int) -> DataFrame:
    """The word table by bucket, as answers to blocks: block, bucket, counts and
    numbers of the block's words in their order; block -1 has the table's own
    figures (types with counts 1 to K + 1, all tokens, all types). A word's number
    is its place in its bucket times the buckets, plus the bucket: numbers are
    dense, so pairs of them are short to send and never taken for one another."""

    def merge(t: pa.Table) -> pa.Table:
        own = [unascending(x.as_py()) for x in t["words"]]
        all_words = np.concatenate(own)
        all_counts = np.concatenate([expand(x.as_py(), "<i8") for x in t["counts"]])
        order = np.argsort(all_words)
        distinct, first = np.unique(all_words[order], return_index=True)
        total = np.add.reduceat(all_counts[order], first) if len(first) else np.zeros(0, np.int64)
        figures = [int((total == r).sum()) for r in range(1, K + 2)] + [int(total.sum()), int((total > 0).sum())]
        bucket = t["bucket"][0].as_py()
        rows = []
        for b, w in zip(t["block"].to_pylist(), own):
            at = np.searchsorted(distinct, w)
            rows.append({"block": b, "bucket": bucket, "counts": planes(total[at], 6), "ids": planes((at << bits) + bucket, 8)})
        rows.append({"block": -1, "bucket": bucket, "figures": figures})
        kinds = [("block", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("ids", pa.binary()), ("figures", pa.list_(pa.int64()))]
        return pa.Table.from_batches([_rows(kinds, rows)])

    return words.groupBy("bucket").applyInArrow(merge, "block bigint, bucket bigint, counts binary, ids binary, figures array<bigint>")


PAIR_ROWS = [("bucket", pa.int64()), ("block", pa.int64()), ("histories", pa.binary()), ("pairs", pa.binary())]
PAIR_SCHEMA = "bucket bigint, block bigint, histories binary, pairs binary"



def planes(x: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of integers, byte by byte, which compresses better."""
    return squeeze(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def unplanes(data: bytes, width: int) -> np.ndarray:
    raw = expand(data, "u1").reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view("<u8")


@dataclass
class Block:
    """A block's texts: bounds, tokens as places among its words, the words'
    training counts and numbers (then that of a text's beginning), the end's place."""

    bounds: np.ndarray
    local: np.ndarray
    count: np.ndarray
    names: np.ndarray
    end: int

    @classmethod
    def of(cls, row: dict) -> Block:
        answers = row["answers"].as_py()
        count = np.concatenate([unplanes(a["counts"], 6) for a in answers]).astype(np.int64)
        names = np.concatenate([*(unplanes(a["ids"], 8) for a in answers), [BEGIN]])
        end = int(np.searchsorted(unascending(row["words"].as_py()), END))
        return cls(expand(row["bounds"].as_py(), "<i8"), unplanes(row["tokens"].as_py(), 4).astype(np.int32), count, names, end)


@dataclass
class BlockPairs:
    """The distinct pairs of a block, ordered by bucket, history and word.

    first, second: places of both words among the block's words (the last place
    stands for the beginning of a text); edge: bounds of ``buckets``; hot:
    whether the pair's history is spread; of_token: the pair of every token;
    head: first pair of every run of one history in one bucket.
    """

    first: np.ndarray
    second: np.ndarray
    edge: np.ndarray
    hot: np.ndarray
    of_token: np.ndarray
    head: np.ndarray
    buckets: np.ndarray

    @classmethod
    def of(cls, block: Block, bits: int, hot_tokens: int) -> BlockPairs:
        bounds, local, names = block.bounds, block.local, block.names
        before = np.r_[np.int32(0), local[:-1]]
        before[bounds[:-1]] = len(names) - 1
        key, of_token = np.unique(before.astype(np.int64) * len(names) + local, return_inverse=True)
        first, second = (x.astype(np.int32) for x in np.divmod(key, len(names)))
        del key, before
        # How often a history occurs in training tells how far it is spread, alike in all
        # blocks; every text has one beginning as it has one end.
        uses = np.r_[block.count, block.count[block.end]]
        spread = np.maximum(1, -(-uses // hot_tokens)).astype(np.uint64)
        part = mix(names[second]) % spread[first]
        part *= np.uint64(0x9E3779B97F4A7C15)
        part += names[first]
        bucket = bucket_of(mix(part), bits).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        first, second, bucket = first[order], second[order], bucket[order]
        head = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (bucket[1:] != bucket[:-1])])
        edge = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        return cls(first, second, edge, spread[first] > 1, place[of_token], head, bucket[edge[:-1]])


def pair_blocks(blocks: DataFrame, bits: int, hot_tokens: int) -> DataFrame:
    """Each block's distinct pairs by bucket: history, word, that word's count
    and how often the pair stands in the block's training texts.

    A block names a pair once, so what is sent is at most one entry per token,
    and a bucket that none of the block's pairs belong to gets no row.
    """

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch[n][r] for n in ("block", "held", "bounds", "tokens", "words", "answers")}
                block = Block.of(row)
                pairs = BlockPairs.of(block, bits, hot_tokens)
                train = np.repeat(~np.array(row["held"].as_py(), bool), np.diff(block.bounds))
                times = np.bincount(pairs.of_token, weights=train, minlength=len(pairs.first)).astype(np.int64)
                size = np.diff(np.r_[pairs.head, len(pairs.first)])
                own = np.searchsorted(pairs.head, pairs.edge)
                out = []
                for k, bucket in enumerate(pairs.buckets.tolist()):
                    some, heads = slice(*pairs.edge[k : k + 2]), slice(*own[k : k + 2])
                    at, w = pairs.head[heads], pairs.second[some]
                    out.append({
                        "bucket": bucket, "block": row["block"].as_py(),
                        "histories": _join([planes(block.names[pairs.first[at]], 8), planes(size[heads], 4), planes(pairs.hot[at], 1)]),
                        "pairs": _join([planes(block.names[w], 8), planes(block.count[w], 6), planes(times[some], 4)]),
                    })
                    if len(out) >= 64:
                        yield _rows(PAIR_ROWS, out)
                        out = []
                if out:
                    yield _rows(PAIR_ROWS, out)

    return blocks.select("block", "held", "bounds", "tokens", "words", "answers").mapInArrow(pair_up, PAIR_SCHEMA)


def _join(parts: list[bytes]) -> bytes:
    head = np.array([len(p) for p in parts], "<u8").tobytes()
    return head + b"".join(parts)


def _split(data: bytes, n: int) -> list[bytes]:
    size, at, out = np.frombuffer(data[: 8 * n], "<u8"), 8 * n, []
    for s in size.tolist():
        out.append(data[at : at + s])
        at += s
    return out


ANSWER_ROWS = [
    ("block", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("halves", pa.binary()), ("asked", pa.binary()),
    ("stats", pa.binary()), ("figures", pa.list_(pa.int64())),
]
ANSWER_SCHEMA = "block bigint, bucket bigint, counts binary, halves binary, asked binary, stats binary, figures array<bigint>"
#: A history: tokens after it, types after it by count 1 to K, sum of (tokens of types above K), P of the types.
STATS = np.dtype([("h", "<u8"), ("hot", "u1"), ("tokens", "<i8"), ("types", "<u4", (K,)), ("p", "<f8")])


def pair_counts(pairs: DataFrame, unigram: Unigram) -> DataFrame:
    """The pair table by bucket, as answers to blocks in the order they asked in.

    counts: training counts of the pairs; halves: for each history twice what
    its counts are divided by; asked and stats: those histories of which the
    block has an unseen pair or which are spread, and their figures. Block -1
    has the bucket's figures (types with counts 1 to K + 1) and, as stats, its
    parts of spread histories.
    """

    def merge(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        # Blocks in one order, so that sums of doubles do not depend on arrival.
        rows = np.argsort(t["block"].to_numpy(), kind="stable").tolist()
        heads = [_split(t["histories"][i].as_py(), 3) for i in rows]
        heads = [(unplanes(h, 8), unplanes(n, 4).astype(np.int64), unplanes(hot, 1)) for h, n, hot in heads]
        packed = [_split(t["pairs"][i].as_py(), 3) for i in rows]
        size = [int(n.sum()) for _, n, _ in heads]
        name = np.concatenate([np.repeat(h, n) for h, n, _ in heads])
        spread = np.concatenate([np.repeat(hot, n) for _, n, hot in heads])
        word, count, times = (np.concatenate([unplanes(p[j], width) for p in packed]) for j, width in enumerate((8, 6, 4)))
        del packed
        order = np.lexsort((word, name))
        h, w = name[order], word[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
        del w
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        first = order[new]
        c = np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new))
        h = h[new]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        history = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(first)]))
        stats = np.zeros(len(head), STATS)
        stats["h"], stats["hot"] = h[head], spread[first][head]
        stats["tokens"] = np.add.reduceat(c, head)
        for r in range(1, K + 1):
            stats["types"][:, r - 1] = np.add.reduceat((c == r).astype(np.int64), head)
        stats["p"] = np.add.reduceat(np.where(c > 0, unigram.p(count[first]), 0.0), head)
        # All counts above K: half a count is set aside.
        halves = 2 * stats["tokens"] + (stats["types"].sum(axis=1) == 0)
        out, end = [], np.cumsum(size)
        for i, own, hi, n in zip(rows, heads, end.tolist(), size):
            k = kind[hi - n : hi]
            start = np.cumsum(own[1]) - own[1]
            mine = history[k[start]]
            unseen = np.add.reduceat((c[k] == 0).astype(np.int64), start) > 0
            asked = np.flatnonzero((stats["hot"][mine] > 0) | (unseen & (stats["tokens"][mine] > 0)))
            out.append({
                "block": t["block"][i].as_py(), "bucket": bucket, "counts": planes(c[k], 6), "halves": planes(halves[mine], 7),
                "asked": planes(asked, 4), "stats": squeeze(stats[mine[asked]]),
            })
        parts = stats[stats["hot"] > 0]
        out.append({"block": -1, "bucket": bucket, "stats": parts.tobytes(), "figures": [int((c == r).sum()) for r in range(1, K + 2)]})
        return pa.Table.from_batches([_rows(ANSWER_ROWS, out)])

    return pairs.groupBy("bucket").applyInArrow(merge, ANSWER_SCHEMA)


def history_weights(stats: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the tokens to divide by, and of the backoff weight, per history.

    The weight is what the discounts leave, over what the word alone gives to
    words not seen after the history. A history without tokens has weight one.
    """
    r = np.arange(1, K + 1)
    left = (stats["types"] * r * (1 - factor[1:])).sum(axis=1)
    rich = stats["types"].sum(axis=1) == 0
    after = stats["tokens"] + 0.5 * rich
    free = np.where(rich, 0.5, left) / np.maximum(after, 0.5)
    weight = np.where(stats["tokens"] > 0, free / np.maximum(1 - stats["p"], 1e-12), 1.0)
    return np.log10(np.maximum(after, 0.5)), np.log10(weight)


def score_texts(
    docs: DataFrame, held: Column, *, bucket_bytes: int = BUCKET_BYTES, hot_tokens: int = HOT_TOKENS
) -> DataFrame:
    """Base and Katz log10 probabilities of every text under a model of the rest.

    docs: doc_id, text; other columns are ignored. Rows where ``held`` is true
    do not teach the model. Returns one row per input row: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score. A null text counts as
    empty, that is one end; repeated rows count each; without any training row
    every token is unknown (base_score 0 per token); an empty table gives no
    rows. ``bucket_bytes`` sets the number of buckets and ``hot_tokens`` when a
    history is spread; neither changes a result.
    """
    marked = docs.select("doc_id", "text", held.alias("held"))
    size = marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, int(np.ceil(np.log2(max(1, size / bucket_bytes)))))
    tasks = partitions(docs.sparkSession, size)
    coded = bucketed(word_blocks(marked, bits), "block", tasks)
    words = coded.where("bucket >= 0").select("block", "bucket", "words", "counts").repartition(tasks, "bucket")
    answers = cut_lineage(word_counts(words, bits), "word_counts")
    add = lambda frame, n: [x or 0 for x in frame.agg(*[F.sum(F.col("figures")[i]) for i in range(n)]).first()]
    *types, total, distinct = add(answers.where("block = -1"), K + 3)
    unigram = Unigram.of(types, total, distinct)
    grouped = answers.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "ids"))).alias("answers"))
    texts = coded.where("bucket = -1").select("block", "doc_ids", "held", "bounds", "tokens", "words")
    blocks = texts.join(grouped.hint("shuffle_hash"), "block")
    pairs = pair_blocks(blocks, bits, hot_tokens).repartition(tasks, "bucket")
    found = cut_lineage(pair_counts(pairs, unigram), "pair_counts")
    tables = found.where("block = -1")
    factor = discounts(add(tables, K + 1))

    # Spread histories: their parts are added up and go back to the buckets that hold a part.
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw in zip(batch["bucket"].to_pylist(), batch["stats"].to_pylist()):
                s = np.frombuffer(raw, STATS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * len(s), pa.int64()), pa.array(s["h"].view("<i8")), pa.array(s["tokens"]), pa.array(s["p"])]
                    + [pa.array(s["types"][:, r].astype(np.int64)) for r in range(K)],
                    ["bucket", "h", "tokens", "p", *[f"t{r}" for r in range(K)]],
                )

    kinds = ", ".join(f"t{r} bigint" for r in range(K))
    part = tables.select("bucket", "stats").mapInArrow(parts, f"bucket bigint, h bigint, tokens bigint, p double, {kinds}")
    whole = part.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("tokens", "p", *[f"t{r}" for r in range(K)])])
    hot = part.select("bucket", "h").join(whole, "h").groupBy("bucket").agg(
        F.collect_list(F.struct("h", "tokens", "p", *[f"t{r}" for r in range(K)])).alias("hot")
    )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = batch["stats"].to_pylist()
            for r, known in enumerate(batch["hot"].to_pylist()):
                if not known:
                    continue
                by_name, own = {x["h"]: x for x in known}, expand(stats[r], STATS).copy()
                for i in np.flatnonzero(own["hot"]):
                    x = by_name[int(own["h"][i : i + 1].view("<i8")[0])]
                    own[i] = (own["h"][i], 1, x["tokens"], tuple(x[f"t{j}"] for j in range(K)), x["p"])
                stats[r] = squeeze(own)
            yield pa.RecordBatch.from_arrays(
                [batch[n] for n in ("block", "bucket", "counts", "halves", "asked")] + [pa.array(stats, pa.binary())],
                ["block", "bucket", "counts", "halves", "asked", "stats"],
            )

    told = (
        found.where("block >= 0").select("block", "bucket", "counts", "halves", "asked", "stats").join(hot, "bucket", "left")
        .mapInArrow(complete, "block bigint, bucket bigint, counts binary, halves binary, asked binary, stats binary")
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "halves", "asked", "stats"))).alias("told"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch[n][r] for n in ("doc_ids", "held", "bounds", "tokens", "words", "answers", "told")}
                block = Block.of(row)
                pairs = BlockPairs.of(block, bits, hot_tokens)
                bounds, local, count = block.bounds, block.local, block.count
                told_ = row["told"].as_py()
                c = np.concatenate([unplanes(x["counts"], 6) for x in told_]).astype(np.int64)
                halves = [unplanes(x["halves"], 7) for x in told_]
                at = np.cumsum([0] + [len(x) for x in halves])
                asked = np.concatenate([unplanes(x["asked"], 4).astype(np.int64) + lo for x, lo in zip(told_, at)])
                after = np.log10(np.maximum(np.concatenate(halves) / 2.0, 0.5))
                weight = np.zeros(len(after))
                after[asked], weight[asked] = history_weights(np.concatenate([expand(x["stats"], STATS) for x in told_]), factor)
                history = np.repeat(np.arange(len(after)), np.diff(np.r_[pairs.head, len(c)]))
                kept = np.where(c > K, 1.0, factor[np.minimum(c, K)])
                share = np.log10(np.where(c > 0, c * kept, 1.0)) - after[history]
                value = np.where(c > 0, share, np.log10(unigram.p(count[pairs.second])) + weight[history])
                n, start = len(bounds) - 1, bounds[:-1]
                base = np.log10((count + 1) / (unigram.total + unigram.types + 1.0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(row["held"].as_py(), pa.bool_()), pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat(count[local] > 0, start, dtype=np.int64)), pa.array(np.full(n, total)),
                        pa.array(np.add.reduceat(base[local], start)), pa.array(np.add.reduceat(value[pairs.of_token], start)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.join(told.hint("shuffle_hash"), "block").drop("block").mapInArrow(finish, schema)
