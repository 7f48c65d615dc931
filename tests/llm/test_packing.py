from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from shoebox.llm.packing import WordTokens, default_tokenizer, pack_documents, sum_of_squares
from tests.llm.texts import edge_docs, real_docs


def check(frame, window=4096):
    got = pack_documents(frame, window=window).collect()
    tokenizer = WordTokens(default_tokenizer()).tokenizer
    want = []
    for r in frame.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(r["doc_id"], s, len(p := ids[s : s + window]), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), window)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= window for v in filled.values())
    return filled


def test_pieces_and_sequences(spark):
    filled = check(real_docs(spark, 200))
    padding = sum(4096 - v for v in filled.values())
    assert padding / (4096 * len(filled)) < 0.05


def test_edge_cases(spark):
    check(edge_docs(spark))
    check(edge_docs(spark), window=16)
    assert pack_documents(edge_docs(spark).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_rule_equals_a_plain_search(lengths):
    window, open_, plain = 12, [], []
    for s in lengths:
        count = lambda h: sum(1 for _, f in open_ if f == h)  # noqa: B023, E731

        def squares(h):
            levels = [count(x) for x in range(window)]
            if h:
                levels[h] -= 1
            if h + s < window:
                levels[h + s] += 1
            return sum(x * x for x in levels)

        choice = min([0, *{f for _, f in open_ if f + s <= window}], key=lambda h: (squares(h), -h))
        if choice:
            at = max(i for i, (_, f) in enumerate(open_) if f == choice)
            number, _ = open_.pop(at)
        else:
            number = 1 + max((p[0] for p in plain), default=-1)
        plain.append((number, choice))
        if choice + s < window:
            open_.append((number, choice + s))
    sequence, offset = sum_of_squares(np.array(lengths, np.int64), window)
    assert [o for _, o in plain] == offset.tolist() and [n for n, _ in plain] == sequence.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé \n\t'sS.,!1½ßΣक़ख़े́Å🙂<|>-"), max_size=20), max_size=5))
def test_cached_tokens_equal_the_tokenizers(texts):
    words = WORDS
    for text, data in zip(texts, words.encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


WORDS = WordTokens(default_tokenizer(), limit=50)


class Counted(dict):
    asked = 0

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_equal_runs_are_looked_up_once():
    words = WordTokens(default_tokenizer())
    words.known = Counted()
    texts = ["Equal runs, after each other. " * 2000] * 10
    for text, data in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.known.asked < 100  # of 120,000 runs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aZ7éÀµ×÷ªß'sS.,-\"@—ДдΣİ\u0958कJ\u030c\u0338=\U0002ebf0 \n\t"), max_size=25), max_size=6), st.booleans())
def test_columns_and_tails_equal_the_tokenizers(texts, large):
    column = pa.array(["left out", *texts], pa.large_string() if large else pa.string()).slice(1)
    got = list(WORDS.encode(column))
    assert len(got) == len(texts)
    for text, data in zip(texts, got):
        assert np.frombuffer(data, "<u4").tolist() == WORDS.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_texts_in_several_slices(monkeypatch):
    from shoebox.llm import packing

    texts = ["", "one long text, " * 50, None, "", "short.", "two (words)", ""]
    whole = list(WORDS.encode(pa.array(texts)))
    monkeypatch.setattr(packing, "SLICE", 10)
    assert list(WORDS.encode(pa.array(texts))) == whole and whole[0] == whole[2] == b""


def test_gathered_batches_keep_rows_and_order():
    from shoebox.llm.packing import gathered

    batches = [pa.record_batch({"n": pa.array(range(10 * i, 10 * i + k), pa.int64())}) for i, k in enumerate([3, 0, 10, 1, 2])]
    for limit in (0, 30, 120, 10_000):
        got = list(gathered(iter(batches), limit))
        assert [n for b in got for n in b.column(0).to_pylist()] == [n for b in batches for n in b.column(0).to_pylist()]
        assert all(b.nbytes <= max(limit, 80) for b in got)
    assert len(got) == 1 and not list(gathered(iter([])))
