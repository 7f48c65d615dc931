"""Packing documents into sequences of tokens by the sum-of-squares rule."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import small_batches
from .textpack import slices

END = 2
TAIL = ".,;:!?%$&*#\")(-"
#: Letters of ASCII and Latin-1, lowered.
LATIN = "".join(sorted({c.lower() for c in map(chr, range(256)) if c.isalpha()}))
ENDING = np.zeros(256, bool)
ENDING[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes a cached run takes besides its letters and ids: two objects and their place in the table.
ENTRY = 220
#: Bytes of text cut into runs at a time; a longer text is a slice of its own.
SLICE = 8 << 20


def halves(runs: pa.Array) -> pa.Array:
    """Each run in two: up to its last letter or digit if only ``TAIL`` follows, and the rest.

    No match of the tokenizer spans the two. Only endings in ASCII and Latin-1 are
    cut, about which all versions of Unicode agree; of others the rest is empty.
    """
    width = "<i8" if pa.types.is_large_string(runs.type) else "<i4"
    _, at, body = runs.buffers()
    edges = np.frombuffer(at, width, len(runs) + 1, runs.offset * int(width[2]))
    data = np.frombuffer(body, np.uint8) if body is not None and len(body) else np.zeros(1, np.uint8)
    cut = edges[:-1] + pc.binary_length(pc.ascii_rtrim(runs, characters=TAIL)).to_numpy()
    last, lead = data[np.maximum(cut - 1, 0)], data[np.maximum(cut - 2, 0)]
    word = ENDING[last] | ((lead == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7))
    both = np.empty(2 * len(runs) + 1, width)
    both[::2], both[1::2] = edges, np.where(word & (cut > edges[:-1]), cut, edges[1:])
    return pa.Array.from_buffers(runs.type, 2 * len(runs), [None, pa.py_buffer(both), body])


class WordTokens:
    """Token ids of texts, as little-endian 32-bit bytes.

    The tokenizer lowers letters and drops blanks and line feeds, and its
    matches never cross them, so the ids of a text are those of its runs
    between them in turn. Arrow cuts slices of texts into runs and numbers the
    different ones; only those are looked at here, and Arrow strings their ids
    together. Runs seen before come from a cache, emptied when it
    takes ``limit`` bytes, ``ENTRY`` for each run and the run itself. A run of letters is one match whose last token, and no
    other, ends a word: many of them are encoded as one text and cut there. So
    is the punctuation that follows, unless the last letter normalises to a mark.
    """

    def __init__(self, path: str, limit: int = 128 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # The same model without rules that leave lower-case letters of Latin-1 as they are.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = [*LATIN, LATIN]
        if self._batch(self.bare, probe) != self._batch(self.tokenizer, probe):
            self.bare = self.tokenizer
        self.known: dict[str, bytes] = {}
        self.apart: dict[str, bool] = {}
        self.weight = 0

    def _batch(self, tokenizer, letters: list[str]) -> dict[str, bytes]:
        """Ids of runs of letters, encoded as one text and cut at the ends of words."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cut) != len(letters):  # a letter that normalises to a letter and a mark
            return {word: self._one(word) for word in letters}
        data = ids.tobytes()
        return {word: data[start:end] for word, start, end in zip(letters, [0, *cut], cut)}

    def _learn(self, fresh: list[str]) -> None:
        known, latin, plain, other, parts = self.known, set(), set(), [], []
        for word in fresh:
            base = word.rstrip(TAIL)
            tail = word[len(base) :]
            small = base.isascii() or max(base) <= "\xff"
            if base.isalpha() and (small or not tail or self._ends_match(base[-1])):
                low = base.lower() if small else base
                if tail or low != word:
                    parts.append((word, low, tail))
                if low not in known:
                    (latin if small else plain).add(low)
                if tail and tail not in known:
                    known[tail] = self._one(tail)
            else:
                other.append(word)
        for tokenizer, letters in ((self.bare, list(latin)), (self.tokenizer, list(plain))):
            for start in range(0, len(letters), 1000):
                known.update(self._batch(tokenizer, letters[start : start + 1000]))
        for word, low, tail in parts:
            known[word] = known[low] + known[tail] if tail else known[low]
        for start in range(0, len(other), 10_000):
            part = other[start : start + 10_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[word] = np.array(got.ids, "<u4").tobytes()

    def _ends_match(self, letter: str) -> bool:
        """Whether no match spans the letter and what follows it, as with one that normalises to end in a mark."""
        if letter not in self.apart:
            self.apart[letter] = self._one(letter + ".") == self._one(letter) + self._one(".")
        return self.apart[letter]

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = column.fill_null("")
        for start, end, _, _ in slices(column, SLICE):
            yield from self._slice(column.slice(start, end - start))

    def _slice(self, column: pa.Array) -> Iterator[bytes]:
        if self.weight > self.limit:
            self.known, self.weight = {}, 0
        runs = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = runs.flatten().dictionary_encode()
        parts = halves(coded.dictionary).dictionary_encode()
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        fresh = [i for i, data in enumerate(found) if data is None]
        if fresh:
            before, new = len(self.known), [words[i] for i in fresh]
            self._learn(new)
            for i, word in zip(fresh, new):
                found[i] = self.known[word]
            # A run's ids take about as much as its letters.
            self.weight += ENTRY * (len(self.known) - before) + 2 * sum(map(len, new))
        ids = pa.array(found, pa.large_binary()).take(parts.indices)
        whole = np.ascontiguousarray(np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[::2])
        ids = pa.Array.from_buffers(ids.type, len(whole) - 1, [None, pa.py_buffer(whole), ids.buffers()[2]])
        ids = ids.take(coded.indices)
        _, at, body = ids.buffers()
        bounds = np.frombuffer(at, "<i8", len(ids) + 1)
        first = runs.offsets.to_numpy()
        cuts = bounds[first - first[0]].tolist()
        data = memoryview(body) if body is not None else memoryview(b"")
        for start, end in zip(cuts, cuts[1:]):
            yield data[start:end].tobytes()


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One cache per Python worker, kept between its tasks."""
    return WordTokens(path)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows with small batches put together to at most ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end: int = END) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens.

    A document is its ids and one end; it is cut after every full window, so
    each id lies in exactly one piece. A null text is its end alone.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for batch in gathered(batches):
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc_id, data in zip(ids, words.encode(batch.column(1))):
                data += last
                total = len(data) // 4
                for start in range(0, total, window):
                    piece = data[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def sum_of_squares(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order.

    ``level[h]`` counts the open sequences filled to h. Each length goes to the
    level where the sum of the squared counts ends up least (an empty sequence
    is level 0, a full one counts no more); ties go to the fullest level.
    """
    level = np.zeros(window + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    started = 0
    for i, s in enumerate(lengths.tolist()):
        best, cost = 0, 2 * int(level[s]) + 1 if s < window else 0
        if s < window:
            # Levels 1 .. window - s can take the piece; the last of them gets full.
            from_ = level[1 : window - s + 1]
            change = 2 * (level[1 + s :] - from_) + 2
            change[-1] = 1 - 2 * from_[-1]
            change[from_ == 0] = np.iinfo(np.int64).max
            at = len(change) - 1 - int(change[::-1].argmin())
            if change[at] <= cost:
                best = at + 1
        if best:
            number = open_at[best].pop()
            level[best] -= 1
        else:
            number, started = started, started + 1
        sequence[i], offset[i] = number, best
        if best + s < window:
            level[best + s] += 1
            open_at[best + s].append(number)
    return sequence, offset


def pack_pieces(pieces: DataFrame, window: int, task_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset. Pieces are dealt evenly over tasks of about
    ``task_rows``, whatever their ids; each task packs its own sequences, the
    longest pieces first, in an order that does not depend on their arrival.
    """
    tasks = max(1, -(-pieces.count() // task_rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = sum_of_squares(t["length"].to_numpy(), window)
        first = TaskContext.get().partitionId() << 40
        t = t.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=50_000)

    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return pieces.repartition(tasks).mapInArrow(pack, kinds)


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, window: int = 4096) -> DataFrame:
    """Pieces of all documents with their places in sequences of ``window`` tokens.

    docs: doc_id, text; other columns are ignored. Returns doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts
    are one end each; repeated rows are packed each; no document is left out;
    an empty table gives no rows. ``tokenizer`` is the path of a tokenizers
    file that drops blanks and line feeds.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer or default_tokenizer(), window), "pieces")
    return pack_pieces(pieces, window)
