from __future__ import annotations

import math

import numpy as np
import pytest

from shoebox.llm.whitening import spectrum, whiten


def plain(vectors, components):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    c = off / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return (off**2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(v)


def as_matrix(rows, components):
    """Rows of one vector come in a bunch of components; repeated ids keep their own."""
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append(r)
    return [sorted(by[c + 1], key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation)) for c in range(components)]


def test_equals_the_plain_computation(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 12)) * np.linspace(3, 0.4, 12) + rng.normal(size=12)).astype(np.float32).tolist()
    rows = list(enumerate(good)) + [(0, good[0]), (0, good[0]), (None, good[7]), (900, [0.0] * 12)]
    bad = [(901, None), (902, []), (903, [math.nan] * 12), (904, [math.inf] + [1.0] * 11), (905, [None] + [1.0] * 11)]
    frame = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows + bad], "vec_id long, embedding array<float>, index string, x int, row double")
    got = whiten(frame, components=8, block_rows=64).collect()
    deviation, white, explained = plain([v for _, v in rows], 8)
    ids = [i for i, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (ids[k] is None, ids[k] or 0, deviation[k]))
    for c, part in enumerate(as_matrix(got, 8)):
        assert [r.vec_id for r in part] == [ids[k] for k in order]
        assert [r.deviation for r in part] == [deviation[k] for k in order] and {r.n for r in part} == {len(rows)}
        mine, want = np.array([r.whitened for r in part]), white[order, c]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert part[0].explained == pytest.approx(explained[c], rel=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert len(got) == 8 * len(rows)


def test_blocks_of_columns_and_of_rows(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(40, 1100)).astype(np.float32).tolist()
    got = whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(3), components=3, block_rows=16)
    _, white, explained = plain(vectors, 3)
    for c, part in enumerate(as_matrix(got.collect(), 3)):
        mine = np.array([r.whitened for r in part])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-7
        assert part[0].explained == pytest.approx(explained[c], rel=1e-7)


def test_without_variance_there_is_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)
    rows = whiten(line).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 9 and rows[0].explained == pytest.approx(1)


def test_each_length_is_whitened_on_its_own(spark):
    rows = [(i, [float(i % 3), float(i % 5)]) for i in range(30)] + [(100 + i, [float(i)]) for i in range(4)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted({(r.n, r.component) for r in got}) == [(4, 1), (30, 1), (30, 2)]


def test_spectrum_leaves_rounding_out():
    values, vectors = spectrum(np.diag([4.0, 1e-20, 9.0]), 32)
    assert values.tolist() == [9.0, 4.0] and vectors.shape == (3, 2)
