from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from shoebox.llm.ann import int8_products, nearest, quantised, tile_best


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), None)
    out = set()
    for q, a in good:
        if q % 20:
            continue
        found = []
        for d, b in good:
            if d != q and len(a) == len(b):
                s = 0.0
                for x, y in zip(a, b):
                    s += x * y
                found.append((-s, d))
        out |= {(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])}
    return out


def test_equals_brute_force_with_ties_nulls_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # one very common vector
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [1.0] * 15), (2080, [None] + [1.0] * 15)]
    rows += [(2100, []), (2120, [1.0, 2.0]), (2140, [2.0, -1.0]), (None, rows[3][1]), rows[5], (2160, [1e-320] * 16), (2180, [1e150] * 16)]
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = nearest(frame, F.col("vec_id") % 20 == 0, k=5, block_rows=64).collect()
    assert {tuple(r) for r in got} == brute(rows, 5) and len(got) == len(brute(rows, 5))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(frame, F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 2500)) * 50, rng.normal(size=(40, 2500))
    qa, sa, na, ea = quantised(a)
    qb, sb, nb, eb = quantised(b)
    assert (int8_products(qa, qb) == qa.astype(np.int64) @ qb.astype(np.int64).T).all()
    slack = na[:, None] * eb + ea[:, None] * np.sqrt((b**2).sum(axis=1))
    assert (np.abs(a @ b.T - int8_products(qa, qb) * sa[:, None] * sb) <= slack + 1e-9).all()


def test_tile_returns_all_when_there_are_few():
    v = np.eye(3)
    best = dict(tile_best(np.array([0]), v[:1], np.array([0, 1, 2]), v, 20))
    assert best[0] == [(0.0, -1), (0.0, -2)]
