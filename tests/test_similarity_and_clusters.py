from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators.agglomerate import member_digest
from shoebox.operators.numbering import dense_index, index_in_group, keep_first, keep_last
from shoebox.operators import agglomerate, similarity, suggest
from shoebox.operators.similarity import Grid, similar_pairs
from shoebox.plans import cluster, scan


def make_vectors(seed, n=90, dim=6, pictures=40, hot=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    if hot:
        v[:hot] = v[0] + 0.02 * rng.normal(size=(hot, dim))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    return [(f"f{i:04d}", f"p{int(rng.integers(pictures))}", [float(x) for x in v[i]], float(i % 7) / 7) for i in range(n)]


SCHEMA = "id string, photo_id string, embedding array<float>, quality_score double"


def similarities(rows):
    m = np.array([r[2] for r in rows], dtype=np.float64)
    return np.clip(m @ m.T, -1, 1)


def greedy(rows, seed, floor):
    """The sequential rule, one edge after another."""
    s = similarities(rows)
    n = len(rows)
    member = {i: [i] for i in range(n)}
    home = list(range(n))
    edges = sorted(
        (-round(s[i, j], 6), rows[i][0], rows[j][0], i, j)
        for i, j in itertools.combinations(range(n), 2) if s[i, j] >= seed
    )
    for *_x, i, j in edges:
        a, b = home[i], home[j]
        if a == b:
            continue
        if {rows[x][1] for x in member[a]} & {rows[x][1] for x in member[b]}:
            continue
        if min(round(s[x, y], 6) for x in member[a] for y in member[b]) < floor:
            continue
        member[a] += member.pop(b)
        for x in member[a]:
            home[x] = a
    return {frozenset(rows[x][0] for x in m) for m in member.values()}


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 0), (3, 30)])
def test_clusters_equal_the_sequential_rule(spark, seed, hot):
    rows = make_vectors(seed, hot=hot)
    faces = spark.createDataFrame(rows, SCHEMA)
    limits = cluster.Thresholds(seed=0.6, floor=0.3, suggest=0.3)
    assignment, _pairs = cluster.cluster_faces(faces, limits, block_rows=16)
    found: dict[str, set[str]] = {}
    for r in assignment.collect():
        found.setdefault(r["cluster_id"], set()).add(r["id"])
    assert {frozenset(m) for m in found.values()} == greedy(rows, 0.6, 0.3)


def chain(n, prefix="x"):
    """Merges one after another: each next edge is weaker, all cross pairs reach the floor."""
    return [
        (f"{prefix}{i:03d}", f"{prefix}{j:03d}", 0.99 - 0.01 * j if j == i + 1 else 0.5)
        for i in range(n) for j in range(i + 1, n)
    ]


def test_a_round_writes_only_around_the_clusters_that_moved(spark, monkeypatch):
    """Hundreds of pairs that never merge are written once and carried."""
    written = []
    append = agglomerate._Parts.append

    def spy(self, df):
        out = append(self, df)
        written.append(({"t"} <= set(out.columns) and "links" in out.columns, out.count()))
        return out

    monkeypatch.setattr(agglomerate._Parts, "append", spy)
    still = [(f"s{i}", f"t{i}", 0.7) for i in range(100)] + [(f"s{i}", f"t{j}", 0.4) for i in range(100) for j in range(0, 100, 9) if i != j]
    pairs = spark.createDataFrame(chain(8) + still, "id_a string, id_b string, similarity double")
    merged = {r["id"]: r["root"] for r in agglomerate.agglomerate(pairs, seed=0.6, floor=0.4).collect()}
    assert {merged[f"x{i:03d}"] for i in range(8)} == {"x000"} and merged["t5"] == "s5"
    sizes = [n for is_pairs, n in written if is_pairs]
    assert len(sizes) >= 7 and sizes[0] > 1000
    assert sizes[2:] == sorted(sizes[2:], reverse=True) and sizes[2] < 30 and sizes[-1] == 0


def test_parts_are_merged_into_one_on_long_chains(spark, monkeypatch):
    monkeypatch.setattr(agglomerate, "MAX_PARTS", 3)
    pairs = chain(9, "a") + chain(6, "b") + [("a000", "b000", 0.65)]
    frame = spark.createDataFrame(pairs, "id_a string, id_b string, similarity double")
    roots = {r["id"]: r["root"] for r in agglomerate.agglomerate(frame, seed=0.6, floor=0.4).collect()}
    assert roots == {f"a{i:03d}": "a000" for i in range(9)} | {f"b{i:03d}": "b000" for i in range(6)}


@pytest.mark.parametrize("group_rows", [4096, 20])
def test_near_copies_do_not_take_a_round_each(spark, monkeypatch, group_rows):
    """One cluster takes the copies one by one; parts too large for a task are cut by nearness."""
    rounds = []
    append = agglomerate._Parts.append

    def spy(self, df):
        rounds.append("since" in df.columns)
        return append(self, df)

    monkeypatch.setattr(agglomerate._Parts, "append", spy)
    monkeypatch.setattr(agglomerate, "GROUP_ROWS", group_rows)
    rows = make_vectors(5, n=70, hot=40)
    # Each copy is a little farther from the first than the one before.
    away = np.array(rows[0][2])
    for i in range(40):
        v = away + 0.004 * i * np.eye(len(away))[i % 3]
        rows[i] = (rows[i][0], f"p{1000 + i // 2}", [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], rows[i][3])
    assignment, _pairs = cluster.cluster_faces(spark.createDataFrame(rows, SCHEMA), cluster.Thresholds(seed=0.6, floor=0.3, suggest=0.3), block_rows=16)
    found: dict[str, set[str]] = {}
    for r in assignment.collect():
        found.setdefault(r["cluster_id"], set()).add(r["id"])
    assert {frozenset(m) for m in found.values()} == greedy(rows, 0.6, 0.3)
    if group_rows > len(rows):
        assert sum(rounds) < 12


def test_settled_clusters_follow_the_rule():
    """Starting from clusters of several rows, and with ties, as one edge after another does."""
    rng = np.random.default_rng(9)
    for _trial in range(20):
        n = int(rng.integers(4, 40))
        v = rng.normal(size=(3, 6))[rng.integers(0, 3, n)] + rng.normal(size=(n, 6)) * rng.choice([0.0, 0.05, 0.4])
        v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        rows = [(f"f{i:03d}", f"p{int(rng.integers(n))}", [float(x) for x in v[i]]) for i in range(n)]
        same = np.array([int(r[1][1:]) for r in rows])
        may, order = agglomerate._first_edges(v.astype(np.float64), np.arange(n), same, 0.6, 300000, 300000)
        root = agglomerate.merged_rows(may, order)
        assert {frozenset(f"f{i:03d}" for i in range(n) if root[i] == r) for r in root} == greedy(rows, 0.6, 0.3)


def test_connected_parts(spark):
    pairs = [(f"n{i:02d}", f"n{j:02d}") for i, j in [(9, 1), (9, 2), (9, 3), (4, 5), (5, 6), (6, 7), (7, 8), (10, 11), (12, 12)]]
    found = {r["c"]: r["part"] for r in agglomerate.connected_parts(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert found == {f"n{i:02d}": "n01" for i in (1, 2, 3, 9)} | {f"n{i:02d}": "n04" for i in range(4, 9)} | {"n10": "n10", "n11": "n10"}


def test_no_edges_means_singletons(spark):
    faces = spark.createDataFrame([("a", "p1", [1.0, 0.0], 0.1), ("b", "p2", [0.0, 1.0], 0.2)], SCHEMA)
    assignment, _ = cluster.cluster_faces(faces)
    assert assignment.select("cluster_id").distinct().count() == 2


@pytest.mark.parametrize("block_rows", [8, 64, 1024])
def test_pairs_equal_brute_force(spark, block_rows):
    rows = make_vectors(7, n=300, hot=120)
    s = similarities(rows)
    expected = {
        (rows[i][0], rows[j][0]) for i, j in itertools.combinations(range(300), 2) if s[i, j] >= 0.5 and rows[i][1] != rows[j][1]
    }
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = similar_pairs(vectors, 0.5, block_rows=block_rows, distinct_on="photo_id").collect()
    assert len(found) == len(expected)
    assert {(r["id_a"], r["id_b"]) for r in found} == expected


@pytest.mark.parametrize("threshold,tasks", [(-1.0, 3), (0.0, 28), (0.9, 28), (1.1, 6)])
def test_pairs_at_any_threshold_and_grid(spark, threshold, tasks):
    rows = make_vectors(8, n=200, hot=50)
    s = similarities(rows)
    found = similar_pairs(spark.createDataFrame(rows, SCHEMA).repartition(5), threshold, block_rows=7, tasks=tasks).collect()
    assert {(r["id_a"], r["id_b"]): round(r["similarity"], 9) for r in found} == {
        (rows[i][0], rows[j][0]): round(s[i, j], 9) for i, j in itertools.combinations(range(200), 2) if s[i, j] >= threshold
    }
    assert len(found) == len({(r["id_a"], r["id_b"]) for r in found})


def test_no_vectors_no_pairs(spark):
    assert similar_pairs(spark.createDataFrame([], SCHEMA), 0.5).count() == 0


@pytest.mark.parametrize("tasks", [1, 8, 45, 1000])
def test_a_block_has_about_root_two_tasks_copies(spark, tasks):
    splits = np.full(50, 4)
    grid = Grid.of(splits, np.ones((50, 50), bool), tasks)
    assert tasks <= len(grid.cells) <= tasks + grid.stripes
    blocks = spark.range(200).withColumn("stripe", grid.stripe(F.col("id")))
    copies = blocks.join(grid.deals(spark), "stripe").groupBy("id").count()
    assert {r["count"] for r in copies.collect()} == {grid.stripes} and abs(grid.stripes - np.sqrt(2 * tasks)) <= 1.5
    sizes = [r["count"] for r in blocks.groupBy("stripe").count().collect()]
    assert len(sizes) == grid.stripes and max(sizes) - min(sizes) <= 1
    # Stripes out of reach never meet.
    assert len(Grid.of(splits, np.eye(50, dtype=bool), tasks).cells) <= 2 * grid.stripes


def test_vectors_travel_packed_in_blocks(spark, monkeypatch):
    """One row per block is copied, with no list of targets per vector."""
    written = []
    cut = similarity.cut_lineage
    monkeypatch.setattr(similarity, "cut_lineage", lambda df, label: written.append(cut(df, label)) or written[-1])
    rows = make_vectors(9, n=300)
    similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.9, block_rows=10, tasks=28).collect()
    blocks = written[0].collect()
    assert sum(len(b["ids"]) for b in blocks) == 300 and max(len(b["ids"]) for b in blocks) < 60
    assert "targets" not in written[0].columns


def test_only_pairs_the_bound_lets_pass_are_multiplied(spark, monkeypatch):
    """With a spectrum that falls, the leading directions leave few pairs to the full product."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 64)) * np.r_[np.ones(12) * 3, np.ones(52) * 0.05]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    basis = np.linalg.svd(v.astype(float), full_matrices=False)[2][: similarity.LEADING].T
    raw = lambda part: {
        "matrix": part.tobytes(), "center": np.eye(64)[0].tobytes(), "radius": np.pi, "ids": list(range(len(part))), "same": [""] * len(part),
    }
    a, b = (similarity._Block(raw(part), 64, basis) for part in (v[:200], v[200:]))
    full = v[:200].astype(float) @ v[200:].astype(float).T
    bound = a.head @ b.head.T + np.outer(a.rest, b.rest)
    assert (bound >= full - 1e-12).all() and (bound >= 0.8).sum() <= (full >= 0.8).sum() * 1.5 + 50
    found = {(int(x), int(y)) for i, j, _v in similarity.tile_pairs(a, b, 0.8, False) for x, y in zip(i, j)}
    assert found == set(zip(*map(lambda t: t.tolist(), np.nonzero(full >= 0.8))))


@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_pair_statistics_are_exact(spark, chunk_rows):
    rows = make_vectors(11, n=60)
    s = similarities(rows)
    home = {r[0]: f"c{i % 4}" for i, r in enumerate(rows)}
    groups = {c: [i for i, r in enumerate(rows) if home[r[0]] == c] for c in set(home.values())}
    groups["c3"] = groups["c3"][:2]
    placed = [(rows[i][0], c) for c, members in groups.items() for i in members]
    assignment = spark.createDataFrame(placed, "id string, cluster_id string")
    candidates = spark.createDataFrame(list(itertools.combinations(sorted(groups), 2)), "cluster_id_a string, cluster_id_b string")
    got = suggest.pair_statistics(candidates, spark.createDataFrame(rows, SCHEMA), assignment, chunk_rows=chunk_rows).collect()
    assert len(got) == 6
    for r in got:
        values = s[np.ix_(groups[r["cluster_id_a"]], groups[r["cluster_id_b"]])]
        assert r["similarity_max"] == pytest.approx(values.max(), abs=1e-12)
        assert r["similarity_median"] == pytest.approx(np.median(values), abs=1e-12)
        assert r["similarity_min"] == pytest.approx(values.min(), abs=1e-12)


@pytest.mark.parametrize("bins,tasks", [(4, 1), (4, 28), (4096, 6)])
def test_medians_of_large_pairs_are_bisected(spark, monkeypatch, bins, tasks):
    """Few bins need many rounds; ties, equal values and uneven sizes come out exactly."""
    monkeypatch.setattr(suggest, "BINS", bins)
    monkeypatch.setattr(suggest, "TILE_VALUES", 64)
    rows = make_vectors(13, n=120, hot=50)
    s = similarities(rows)
    groups = {"a": range(0, 25), "b": range(25, 50), "c": range(50, 117), "d": [117], "e": [118, 119]}
    same = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    more = [(f"g{i}", "p", same, 0.1) for i in range(12)]
    placed = [(rows[i][0], c) for c, members in groups.items() for i in members]
    placed += [(r[0], "x" if i < 6 else "y") for i, r in enumerate(more)]
    wanted = [p for p in itertools.combinations("abcde", 2)] + [("y", "x")]
    got = suggest.pair_statistics(
        spark.createDataFrame(wanted, "cluster_id_a string, cluster_id_b string"), spark.createDataFrame(rows + more, SCHEMA),
        spark.createDataFrame(placed, "id string, cluster_id string"), chunk_rows=4, tasks=tasks,
    ).collect()
    assert {(r["cluster_id_a"], r["cluster_id_b"]) for r in got} == set(wanted) and len(got) == len(wanted)
    for r in got:
        a, b = r["cluster_id_a"], r["cluster_id_b"]
        values = np.ones(1) if a == "y" else s[np.ix_(groups[a], groups[b])]
        assert r["similarity_max"] == pytest.approx(values.max(), abs=1e-12)
        assert r["similarity_median"] == pytest.approx(np.median(values), abs=1e-12)
        assert r["similarity_min"] == pytest.approx(values.min(), abs=1e-12)


def test_a_cluster_is_not_copied_for_each_of_its_candidates(spark, monkeypatch):
    sent = []
    meet = suggest._meet
    monkeypatch.setattr(suggest, "_meet", lambda stripes, parts, *a: sent.append((stripes.count(), parts.select("lo", "hi").distinct().count(), parts.count())) or meet(stripes, parts, *a))
    rows = make_vectors(14, n=150)
    placed = [(r[0], f"c{i // 3:02d}") for i, r in enumerate(rows)]
    wanted = list(itertools.combinations(sorted({c for _i, c in placed}), 2))
    got = suggest.pair_statistics(
        spark.createDataFrame(wanted, "cluster_id_a string, cluster_id_b string"), spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame(placed, "id string, cluster_id string"), tasks=10,
    )
    assert got.count() == len(wanted) == 1225
    (stripes, cells, parts), *more = sent
    assert stripes == 5 and cells <= 15 and parts >= 1225 and len(more) <= 4


def test_candidates_are_made_once(spark):
    """However many steps read them; small clusters lie whole in a stripe, so nothing is counted in bins."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = make_vectors(15, n=150)
    placed = [(r[0], f"c{i // 3:02d}") for i, r in enumerate(rows)]
    wanted = spark.createDataFrame(list(itertools.combinations(sorted({c for _i, c in placed}), 2)), "cluster_id_a string, cluster_id_b string")
    got = suggest.pair_statistics(
        wanted.mapInArrow(count, wanted.schema), spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(placed, "id string, cluster_id string"), tasks=10,
    )
    assert got.count() == made.value == 1225


def test_a_task_sends_the_best_edges_of_a_cluster(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suggest, "HELD_ENDS", 16)
    rng = np.random.default_rng(2)
    rows = [(f"c{i % 3}", float(-rng.integers(5)) / 10, f"a{int(rng.integers(50))}", f"b{i:03d}") for i in range(200)]
    names = ["c", "k", "cluster_id_a", "cluster_id_b"]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 10]]) for i in range(4)], names) for at in range(0, 200, 10)]
    sent = [tuple(r.values()) for b in suggest._best_ends(4)(iter(batches)) for r in b.to_pylist()]
    assert sorted(sent) == sorted(r for c in ("c0", "c1", "c2") for r in sorted(x for x in rows if x[0] == c)[:4])


def test_suggestions_respect_pictures_and_links(spark):
    v = [[1.0, 0.0], [0.9, float(np.sqrt(0.19))], [0.8, 0.6], [0.7, float(np.sqrt(0.51))]]
    faces = spark.createDataFrame([(f"f{i}", f"p{i % 3}", v[i], 0.5) for i in range(4)], SCHEMA)
    placed = faces.select("id", F.concat(F.lit("c"), F.substring("id", 2, 1)).alias("cluster_id"))
    pairs = similar_pairs(faces, 0.3)
    links = spark.createDataFrame([("f1", "f2", "manual_split", "t")], "face_id_a string, face_id_b string, reason string, created_at string")
    limits = cluster.Thresholds(suggest=0.3, per_cluster=5)
    got = {(r["cluster_id_a"], r["cluster_id_b"]) for r in cluster.merge_suggestions(faces, placed, pairs, links, limits).collect()}
    # c0 and c3 share photo p0; c1 and c2 must stay apart.
    assert got == {("c0", "c1"), ("c0", "c2"), ("c1", "c3"), ("c2", "c3")}
    few = suggest.top_edges(
        spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.7)], "cluster_id_a string, cluster_id_b string, similarity_max double"), 1
    ).collect()
    assert {(r["cluster_id_a"], r["cluster_id_b"]) for r in few} == {("a", "b"), ("a", "c")}


def test_a_large_group_is_digested_in_pieces(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(agglomerate, "PIECE_IDS", 7)
    rows = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 5 + 2).alias("g"), F.concat(F.lit("é"), "id").alias("id")).repartition(9)
    want = {}
    for r in rows.collect():
        want.setdefault(r["g"], []).append(r["id"])
    got = {r["g"]: r["digest"] for r in member_digest(rows, "g").collect()}
    assert got == {g: hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest() for g, ids in want.items()}


def test_group_ids_have_one_formula(spark):
    rows = spark.range(50).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("id"))
    import hashlib

    exact = member_digest(rows, "g").head()["digest"]
    assert exact == hashlib.sha256("\n".join(sorted(str(i) for i in range(50))).encode()).hexdigest()
    again = member_digest(rows.orderBy(F.desc("id")), "g").head()["digest"]
    other = member_digest(rows.where("id <> '3'"), "g").head()["digest"]
    assert exact == again and exact != other


def brute_suppression(boxes, threshold):
    def iou(a, b):
        w = max(0.0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        h = max(0.0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        union = a[4] * a[5] + b[4] * b[5] - w * h
        return w * h / union if union > 0 else 0.0

    order = sorted(boxes, key=lambda b: (-round(b[6], 6), -round(b[4] * b[5], 4), round(b[3], 4), round(b[2], 4), b[1]))
    kept = []
    for b in order:
        if all(k[0] != b[0] or iou(k, b) < threshold for k in kept):
            kept.append(b)
    return {b[1] for b in kept}


@pytest.mark.parametrize("group_rows", [4096, 5])
def test_suppression_equals_brute_force(spark, group_rows):
    rng = np.random.default_rng(3)
    boxes = [
        (f"p{int(rng.integers(4))}", f"d{i:03d}", *[float(x) for x in rng.uniform(0, 120, 2)], *[float(x) for x in np.exp(rng.uniform(1, 4.5, 2))], float(rng.integers(20)) / 20)
        for i in range(160)
    ]
    frame = spark.createDataFrame(boxes, "photo_id string, det_id string, x double, y double, w double, h double, score double")
    got = {r["det_id"] for r in scan.suppress_overlaps(frame, minimum_px=0.0, group_rows=group_rows).collect()}
    assert got == brute_suppression(boxes, 0.35)
    large = scan.suppress_overlaps(frame, minimum_px=24.0, group_rows=group_rows).collect()
    assert all(min(r["w"], r["h"]) >= 24 for r in large)


@pytest.mark.parametrize("wide,high", [(30, 4000), (4000, 30), (500, 500)])
def test_crowded_pictures_of_any_shape(spark, wide, high):
    """Columns, rows and squares of boxes of very different sizes, by rounds of grid joins."""
    rng = np.random.default_rng(wide)
    boxes = [
        ("p", f"d{i:03d}", float(rng.uniform(0, wide)), float(rng.uniform(0, high)), *[float(x) for x in np.exp(rng.uniform(0, 6, 2))], float(rng.integers(9)) / 9)
        for i in range(250)
    ]
    boxes += [("p", f"e{i:03d}", b[2] + 1, b[3] + 1, b[4] * 1.1, b[5] * 0.8, 0.5) for i, b in enumerate(boxes[:60])]
    frame = spark.createDataFrame(boxes, "photo_id string, det_id string, x double, y double, w double, h double, score double")
    got = {r["det_id"] for r in scan.suppress_overlaps(frame, minimum_px=0.0, group_rows=10).collect()}
    assert got == brute_suppression(boxes, 0.35)


def test_a_column_of_boxes_is_spread_over_cells(spark):
    boxes = [("p", f"d{i:04d}", 5.0, 20.0 * i, 30.0, 10.0, 0.5) for i in range(400)]
    frame = spark.createDataFrame(boxes, "photo_id string, det_id string, x double, y double, w double, h double, score double")
    pairs = scan._overlaps(frame.withColumn("rank", F.struct("det_id")), 0.35)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "gy" in plan and pairs.count() == 0


def test_suppression_paths_agree_at_the_edge(spark):
    boxes = [("p", "a", 0.0, 0.0, 1000.0, 10.0, 0.9), ("p", "b", 0.0, 0.0, 10000.0, 10.0, 0.8)]
    boxes += [(f"q{k}", d, 0.0, 0.0, 0.1**k * w, 7.0, s) for k in range(-3, 4) for d, w, s in (("a", 3.0, 0.9), ("b", 30.0, 0.8), ("c", 300.0, 0.7))]
    frame = spark.createDataFrame(boxes, "photo_id string, det_id string, x double, y double, w double, h double, score double")
    kept = [
        {(r["photo_id"], r["det_id"]) for r in scan.suppress_overlaps(frame, threshold=0.1, minimum_px=0.0, group_rows=g).collect()}
        for g in (4096, 1)
    ]
    assert kept[0] == kept[1] and ("p", "b") not in kept[0]


def test_numbering(spark):
    rows = spark.range(0, 1000, numPartitions=7).select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("g"))
    got = dense_index(rows, [F.col("g"), F.col("id").desc()], "i").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(1000))
    assert [(r["g"], r["id"]) for r in got] == sorted(((r["g"], r["id"]) for r in got), key=lambda t: (t[0], -t[1]))
    inside = index_in_group(rows, ["g"], [F.col("id")], "n").collect()
    for g in range(3):
        mine = sorted((r["id"], r["n"]) for r in inside if r["g"] == g)
        assert [n for _id, n in mine] == list(range(len(mine)))
    assert keep_first(rows, ["g"], [F.col("id")]).count() == 3
    assert {r["id"] for r in keep_last(rows, ["g"], "id").collect()} == {max(r["id"] for r in got if r["g"] == g) for g in range(3)}


def test_face_ids_and_scale_plan(spark):
    pictures = spark.createDataFrame([("a", 4000, 3000), ("b", 800, 600)], "id string, width int, height int")
    plan = {(r["id"], r["scaled_width"], r["scaled_height"]) for r in scan.scale_plan(pictures, [640, 1280, 2560]).collect()}
    assert plan == {("a", 640, 480), ("a", 1280, 960), ("a", 2560, 1920), ("b", 640, 480), ("b", 800, 600)}
    one = spark.range(1).select(
        scan.face_id(F.lit("k"), F.lit(0), [F.lit(0.1)] * 4, F.array(F.lit(0.5))).alias("a"),
        scan.face_id(F.lit("k"), F.lit(1), [F.lit(0.1)] * 4, F.array(F.lit(0.5))).alias("b"),
    ).head()
    assert one["a"].startswith("f_") and len(one["a"]) == 34 and one["a"] != one["b"]


def test_a_run_is_skipped_only_when_nothing_changed(spark):
    faces = spark.createDataFrame([("a", "unreviewed", None, [1.0]), ("b", "unreviewed", None, [0.5])], "id string, status string, person_id string, embedding array<float>")
    clusters = spark.createDataFrame([("c",)], "id string")
    key = cluster.embedding_set_digest(faces).head()[0]
    assert cluster.may_skip(faces, clusters, key, key) == "matching_cluster_run_key"
    assert cluster.may_skip(faces, clusters.limit(0), key, key) is None
    changed = faces.withColumn("embedding", F.array(F.lit(0.5).cast("float")))
    other = cluster.embedding_set_digest(changed).head()[0]
    assert other != key and cluster.may_skip(faces, clusters, key, other) is None
    assert cluster.may_skip(faces.withColumn("status", F.lit("ignored")), clusters, None, key) == "human_review_exists"


def test_cluster_table_picks_the_best_face(spark):
    faces = spark.createDataFrame([("a", 0.2), ("b", 0.9), ("c", 0.9)], "id string, quality_score double")
    placed = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, cluster_id string")
    row = cluster.cluster_table(faces, placed).head()
    assert (row["id"], row["representative_face_id"], row["face_count"]) == ("x", "b", 3)
