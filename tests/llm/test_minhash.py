from __future__ import annotations

import re

import numpy as np
import pytest

from shoebox.llm import minhash
from shoebox.llm.components import components
from tests.llm.texts import edge_docs, real_docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, size):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, size, share):
    sets, root = sets_of(rows, size), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and share[1] * len(a & b) >= share[0] * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((doc, len(sets[i]), component, doc == component))
    return out


def check(frame, **options):
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    size, share = options.get("size", 5), options.get("share", (80, 100))
    got = [tuple(r) for r in minhash.near_duplicates(frame, **options).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    assert sorted(got, key=key) == sorted(brute(rows, size, share), key=key)


def test_equals_brute_force(spark):
    check(real_docs(spark, 200), size=3, share=(85, 100), bands=40, rows=7)


def test_edge_cases(spark):
    check(edge_docs(spark))
    assert minhash.near_duplicates(edge_docs(spark).limit(0)).count() == 0
    kept = minhash.keep_one_per_group(edge_docs(spark)).collect()
    # Both rows of document 1 are one; 2 repeats 1; 7 repeats 6; rows without an id stay.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, i) for i in (1, 3, 4, 5, 6, 8, 9)] + [(True, 0), (True, 0)]


@pytest.mark.parametrize("units", [4, 512])
def test_large_groups_in_many_tiles(spark, monkeypatch, units):
    """A chain of variants, each near its neighbours only, next to a look-alike family that is no link."""
    monkeypatch.setattr(minhash, "TILE_UNITS", units)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(words, 120))
    rows = []
    for i in range(60):
        base = base.copy()
        base[int(rng.integers(120))] = words[int(rng.integers(4000))]
        rows.append((i, " ".join(base)))
    head = list(rng.choice(words, 70))
    rows += [(100 + i, " ".join(head + list(rng.choice(words, 50)))) for i in range(30)]
    rows += [(200 + i, rows[7][1]) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), size=3, share=(85, 100), bands=40, rows=7)


def test_tiles_equal_plain_pairs():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**62, 300).astype(np.uint64)
    units = [np.unique(rng.choice(pool[:k], 60)) for k in (70, 80, 90, 70, 75, 300, 300)]

    def links(pairs):
        return {(i, j) for i, j in pairs if 100 * len(np.intersect1d(units[i], units[j])) >= 40 * len(np.union1d(units[i], units[j]))}

    def classes(pairs):
        root = list(range(7))
        for _ in range(7):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    forest = minhash.tile_links(units, None, (40, 100), width=16)
    assert classes(forest) == classes(links([(i, j) for i in range(7) for j in range(i)])) and len(forest) < 7
    across = minhash.tile_links(units[:3], units[3:], (40, 100))
    assert classes(across) == classes(links([(i, j) for i in range(3) for j in range(3, 7)]))


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
