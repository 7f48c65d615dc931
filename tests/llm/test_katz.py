"""Katz scores against a plain model with dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shoebox.llm.common import crc_of_id
from shoebox.llm.katz import K, discounts, score_texts
from tests.llm.texts import edge_docs, real_docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, held):
    """doc_id, text rows -> list of (doc_id, held, n, known, N, base, score), and the model's parts."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) + ["</end>"] for _, t in rows]
    train = [x for x, h in zip(tokens, held) if not h]
    uni = Counter(w for x in train for w in x)
    total, types = sum(uni.values()), len(uni)
    bi = Counter(p for x in train for p in zip(["<begin>"] + x, x))
    du = discounts([sum(1 for c in uni.values() if c == r) for r in range(1, K + 2)])
    db = discounts([sum(1 for c in bi.values() if c == r) for r in range(1, K + 2)])
    lost = sum(c * (1 - du[c]) for c in uni.values() if c <= K)

    def p1(w):
        if lost <= 0:
            return uni[w] / (total + 0.5) if uni[w] else 0.5 / (total + 0.5)
        return (du[uni[w]] if uni[w] <= K else 1) * uni[w] / total if uni[w] else lost / total

    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c

    def p2(h, w):
        seen = after.get(h)
        if not seen:
            return p1(w)
        n = sum(seen.values())
        rich = all(c > K for c in seen.values())
        share = lambda c: c / (n + 0.5) if rich else (db[c] if c <= K else 1) * c / n
        if w in seen:
            return share(seen[w])
        return (1 - sum(map(share, seen.values()))) / (1 - sum(map(p1, seen))) * p1(w)

    out = []
    for (i, _), x, h in zip(rows, tokens, held):
        base = sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in x)
        score = sum(math.log10(p2(a, w)) for a, w in zip(["<begin>"] + x, x))
        out.append((i, h, len(x), sum(uni[w] > 0 for w in x), total, base, score))
    return out, p1, p2, uni, after


def compare(frame, **options):
    got = score_texts(frame, crc_of_id() % 7 == 2, **options).collect()
    known = frame.select("doc_id", "text", (crc_of_id() % 7 == 2).alias("h")).collect()
    want, p1, p2, uni, after = plain([tuple(r)[:2] for r in known], [r["h"] for r in known])
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-6)
    return p1, p2, uni, after


def test_matches_plain_model(spark):
    frame = real_docs(spark, 150)
    p1, p2, uni, after = compare(frame)
    # Every distribution sums to one over the words and the unknown word.
    words = [*uni, "no such word"]
    assert sum(map(p1, words)) == pytest.approx(1)
    for history in list(after)[:20]:
        assert sum(p2(history, w) for w in words) == pytest.approx(1)


def test_buckets_and_spread_histories_do_not_change_scores(spark):
    frame = real_docs(spark, 60)
    compare(frame.repartition(5), bucket_bytes=20_000, hot_tokens=40)


def test_edge_cases(spark):
    frame = edge_docs(spark)
    compare(frame)
    assert score_texts(frame.limit(0), F.lit(False)).count() == 0
    assert score_texts(frame, F.lit(True)).where("n_known > 0").count() == 0
