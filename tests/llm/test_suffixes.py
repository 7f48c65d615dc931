from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shoebox.llm import suffixes
from shoebox.llm.suffixes import blind_trie, deep_shallow, remove_repeats
from tests.llm.texts import edge_docs, real_docs


def brute(rows, length=50):
    first, out = {}, []
    ids = [suffixes.NO_ID if i is None else i for i, _ in rows]
    for i, (_, text) in zip(ids, rows):
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            first[w] = min(first.get(w, i), i)
    for i, (doc, text) in zip(ids, rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < i:
                gone[s : s + length] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(data) else 0
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(frame, **options):
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    got = [(*tuple(r)[:5], bytes(r["kept"])) for r in remove_repeats(frame, **options).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(brute(rows, options.get("length", 50)), key=key)


def test_equals_brute_force(spark):
    check(real_docs(spark, 120).repartition(4), bucket_bytes=4000)


def test_edge_cases(spark, monkeypatch):
    check(edge_docs(spark))
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    check(edge_docs(spark).repartition(5), length=44)
    assert remove_repeats(edge_docs(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(edge_docs(spark), length=60)


def test_overlapping_repeats_of_two_letters(spark):
    rng = np.random.default_rng(8)
    piece = lambda n: "".join(rng.choice(list("ab"), n))
    shared = [piece(int(n)) for n in rng.integers(40, 90, 8)]
    rows = [(int(i), "".join(shared[int(k)] if k < 8 else piece(13) for k in rng.integers(0, 11, 9))) for i in rng.integers(0, 25, 40)]
    rows += [(50, "a" * 300), (51, "a" * 120 + "b" + "a" * 49), (52, "ab" * 90)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_wide_anchors_are_spread(spark):
    rng = np.random.default_rng(5)
    around = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 150))
    passage = around() + around()
    rows = [(i, around() + passage + around()) for i in range(400)] + [(400, passage[:70]), (401, twice := around()), (402, twice)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(frame, wide_runs=30)
    coded = suffixes.anchor_blocks(frame, 50, 4).cache()
    texts = coded.where("bucket = -1").select("block", "ids", "nulls", "bounds", "texts")
    most = {}
    for limit in (10**6, 30):
        shared = suffixes.shared_anchors(coded.where("bucket >= 0"), limit)
        sent = suffixes.run_rows(texts, suffixes._by_block(shared, "anchors", "shared", "wide", "n"), 50, 4).collect()
        anchors = np.concatenate([suffixes.expand(bytes(r["runs"]), suffixes.SENT)["anchor"] for r in sent])
        most[limit] = np.unique(anchors, return_counts=True)[1].max()
    coded.unpersist()
    assert most[10**6] > 300 and most[30] <= 30


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=6), min_size=1, max_size=30))
def test_blind_trie_sorts(parts):
    strings = [p.ljust(6, b"\0") for p in parts]
    found = blind_trie(strings)
    assert [strings[g[0]] for g in found] == sorted(set(strings))
    assert all(len({strings[i] for i in g}) == 1 for g in found) and sorted(i for g in found for i in g) == list(range(len(strings)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=20, max_size=20)), min_size=1, max_size=40))
def test_deep_shallow_ranks(items):
    buffer = "".join(t for _, t in items).encode()
    starts, size = np.arange(len(items)) * 20, np.full(len(items), 20)
    rank = deep_shallow(buffer, starts, size, np.array([g for g, _ in items]))
    order = sorted(items)
    assert rank.tolist() == [order.index(x) for x in items]
