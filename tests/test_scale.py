"""Plans and bytes of jobs that must not grow faster than their tables."""

from __future__ import annotations

from shoebox.operators import workspace as reads


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_proposals_broadcast_no_table(spark, roles):
    """Columns made from short keys look small to the planner, which sent whole lists through the driver."""
    found = reads.label_proposals(roles.clusters, roles.people, roles.suggestions)
    assert "Broadcast" not in plan(found)
    # A repeated suggestion stays repeated; a person without name is not proposed.
    twice = reads.label_proposals(roles.clusters, roles.people, roles.suggestions.union(roles.suggestions))
    assert twice.distinct().count() <= found.distinct().count() and twice.count() > twice.distinct().count()
    nameless = roles.people.withColumn("display_name", reads.F.lit(""))
    assert reads.label_proposals(roles.clusters, nameless, roles.suggestions).isEmpty()


def test_a_layer_of_faces_has_the_changing_columns_only(spark):
    from shoebox.operators.layers import Layered

    base = spark.createDataFrame([(str(i), "open", "x" * 64) for i in range(4)], "id string, status string, crop string")
    table = Layered(base, ("id",), changing=("status",)).patched(spark.createDataFrame([("1", "done"), ("9", "done")], "id string, status string"))
    assert table.layers().columns == ["_key", "_at", "status"]
    assert {(r.id, r.status, len(r.crop)) for r in table.view().collect()} == {("0", "open", 64), ("1", "done", 64), ("2", "open", 64), ("3", "open", 64)}
    # A later layer wins, nulls too.
    table = table.patched(spark.createDataFrame([("1", None), ("2", "gone")], "id string, status string"))
    assert {r.id: r.status for r in table.view().collect()} == {"0": "open", "1": None, "2": "gone", "3": "open"}


def test_a_decision_writes_narrow_faces_once(spark, roles, monkeypatch):
    """Images, layer and new clusters come from one written copy of the faces' changing columns."""
    from shoebox.plans import review
    from shoebox.workload.review import _now

    taken = []
    cut = review.cut_lineage
    monkeypatch.setattr(review, "cut_lineage", lambda df, label="table", *more: taken.append((label, df.columns)) or cut(df, label, *more))
    every = roles.clusters.select(reads.F.col("id").alias("cluster_id"))
    out = review.set_clusters(roles.workspace, every, "unknown", mutation_id="mutation-1", now=_now())
    assert [c for label, c in taken if label == "images"] == [] and not {"crop_relpath", "crop_sha256"} & set(dict(taken)["taken"])
    assert "crop_sha256" not in str(out.layers["faces"].layers().schema) and out.faces.columns == roles.faces.columns


def test_row_hashes_are_shuffled_as_bytes(spark):
    """A backup is compared by digests of all its rows: 32 bytes each are shuffled, not 64 digits."""
    from shoebox.functions.hashing import row_tokens

    found = row_tokens(spark.createDataFrame([("a",), ("a",), ("b",)], "v string"), ["v"])
    assert "sha2" in plan(found) and "unhex" in plan(found)
    assert sorted(len(r.t) for r in found.collect()) == [66, 66] and {r.t[64:] for r in found.collect()} == {":1", ":2"}


def test_a_backup_tells_its_fingerprint_once(spark, monkeypatch, tmp_path):
    from shoebox.plans import backup

    empty = spark.range(0)
    monkeypatch.setattr(backup.snapshots, "publish", lambda *a, **b: 1)
    monkeypatch.setattr(backup.snapshots, "create_once", lambda *a: True)
    monkeypatch.setattr(backup, "_read", lambda *a: "copy")
    monkeypatch.setattr(backup, "broken_references", lambda ws: empty)
    told = []
    monkeypatch.setattr(backup, "fingerprint", lambda ws: told.append(ws) or spark.createDataFrame([("faces.ignored", "1")], "fact string, value string"))
    ws = type("Ws", (), {n: empty for n in backup.TABLES})()
    copy, facts = backup._verified(ws, str(tmp_path))
    assert copy == "copy" and told == ["copy", ws] and facts.collect()[0].value == "1" and len(told) == 2


def test_clusters_are_recomputed_from_one_aggregate(spark, roles):
    """Empty clusters leave in the join that brings the new state; before, their faces were aggregated twice."""
    from shoebox.plans import review
    from shoebox.workload.review import _now

    every = roles.clusters.select(reads.F.col("id").alias("cluster_id"))
    found = review.recompute_clusters(roles.clusters, roles.faces.where("status <> 'ignored'"), every, _now())
    assert plan(found).count("partial_min_by(") == 1
    left = roles.faces.where("status <> 'ignored'").select("cluster_id").distinct().count()
    assert found.count() == left and found.where("representative_face_id IS NULL").isEmpty()


def test_clusters_write_no_pairs_below_the_seed(spark, monkeypatch):
    """At a low floor most pairs reach it; before, all of them were written and shuffled."""
    from shoebox.plans import cluster
    from test_similarity_and_clusters import SCHEMA, greedy, make_vectors

    written = {}
    cut = cluster.cut_lineage
    monkeypatch.setattr(cluster, "cut_lineage", lambda df, label: written.setdefault(label, cut(df, label)))
    rows = make_vectors(5, n=60)
    limits = cluster.Thresholds(seed=0.7, floor=-0.2, suggest=0.3)
    assignment, pairs = cluster.cluster_faces(spark.createDataFrame(rows, SCHEMA), limits, block_rows=16)
    assert written["similar"].where("similarity < 0.7").isEmpty() and not written["similar"].isEmpty()
    assert not pairs.where("similarity < 0.3").isEmpty()
    found = {}
    for r in assignment.collect():
        found.setdefault(r["cluster_id"], set()).add(r["id"])
    assert {frozenset(m) for m in found.values()} == greedy(rows, 0.7, -0.2)


def test_least_similarities_are_exact(spark, monkeypatch):
    """Tiles smaller than a pair, groups of all sizes, members that may not share a group."""
    import itertools

    from shoebox.operators import similarity
    from test_similarity_and_clusters import SCHEMA, make_vectors, similarities

    monkeypatch.setattr(similarity, "CROSS_VALUES", 40)
    rows = make_vectors(6, n=40, pictures=30)
    s = similarities(rows)
    home = [i * i % 11 for i in range(40)]
    groups = {g: [i for i in range(40) if home[i] == g] for g in set(home)}
    asked = list(itertools.combinations(sorted(map(str, groups)), 2))
    found = similarity.CrossPairs(spark.createDataFrame(rows, SCHEMA), "photo_id", 6).least(
        spark.createDataFrame(asked, "a string, b string"), spark.createDataFrame([(r[0], str(g)) for r, g in zip(rows, home)], "id string, c string")
    )
    apart = [(a, b) for a, b in asked if not {rows[i][1] for i in groups[int(a)]} & {rows[i][1] for i in groups[int(b)]}]
    assert {(r.a, r.b): round(r.similarity, 9) for r in found.collect()} == {
        (a, b): round(min(s[i, j] for i in groups[int(a)] for j in groups[int(b)]), 9) for a, b in apart
    }
    assert 0 < len(apart) < len(asked)


def test_small_cluster_pairs_are_multiplied_together(monkeypatch):
    """One product and one median for all pairs of equal sizes; before, a step for each pair."""
    import numpy as np

    from shoebox.operators import suggest

    rng = np.random.default_rng(3)
    left, right = (rng.normal(size=(400, 8)).astype(np.float32) / 9 for _side in "ab")
    size = np.array([1, 3, 4, 4] * 30)
    at = np.cumsum(size) - size
    i, j = (x.ravel() for x in np.meshgrid(np.arange(120), np.arange(120)))
    calls, median = [], np.median
    monkeypatch.setattr(suggest.np, "median", lambda v, axis=None: calls.append(len(v)) or median(v, axis=axis))
    n, least, greatest, middle = suggest._whole(left, right, (at[i], size[i], at[j], size[j]))
    assert sum(calls) == 14400 and len(calls) < 50
    for k in range(0, 14400, 97):
        v = left[at[i[k]] : at[i[k]] + size[i[k]]].astype(float) @ right[at[j[k]] : at[j[k]] + size[j[k]]].astype(float).T
        assert n[k] == v.size and np.allclose([least[k], greatest[k], middle[k]], [v.min(), v.max(), median(v)], atol=1e-12)


def test_a_digest_shuffles_its_rows_once(spark):
    """All levels of the tree but the root are made where the hashes were dealt."""
    from shoebox.functions.hashing import _collapsed, digest_nodes

    df = spark.createDataFrame([(f"r{i}",) for i in range(50)], "v string")
    for digits in (12, 8, 4):
        assert plan(digest_nodes(df, ["v"], digits)).count("Exchange hashpartitioning") == 1
    import pyarrow as pa

    one, other = bytes(range(32)), bytes(reversed(range(32)))
    batch = pa.RecordBatch.from_arrays([pa.array([one] * 500 + [other] + [one] * 7, pa.binary())], ["b"])
    rows = [r for b in _collapsed(iter([batch])) for r in b.to_pylist()]
    assert rows == [{"top": 1, "b": one, "n": 507}, {"top": 31 * 256 + 30, "b": other, "n": 1}]


def test_the_whole_workspace_shuffles_keys_not_ids(spark, roles):
    """Faces get the state of their clusters before any id is made of their keys."""
    ws = roles.whole_workspace
    text = plan(ws.faces)
    assert "Join [l_partkey" in text and "Join [cluster_id" not in text
    assert ws.faces.columns == roles.faces.columns and ws.clusters.columns == roles.clusters.columns
    owners = {r["id"]: (r["status"], r["person_id"]) for r in roles.clusters.collect()}
    faces = ws.faces.select("cluster_id", "status", "person_id").collect()
    assert len(faces) == roles.faces.count() and all(owners[r[0]] == (r[1], r[2]) for r in faces)


def test_no_face_is_sent_to_links_that_are_not_there(spark, roles):
    faces = spark.createDataFrame([("a", "p", "c"), ("b", "p", "d"), ("e", "q", "d")], "id string, photo_id string, cluster_id string")
    none = spark.createDataFrame([], "face_id_a string, face_id_b string, reason string")
    assert reads.placed_exceptions(none, faces) is None
    some = spark.createDataFrame([("a", "e", "manual_split"), ("a", "b", "absent")], none.schema)
    placed, pairs = reads.placed_exceptions(some, faces), spark.createDataFrame([("c", "d")], "cluster_id_a string, cluster_id_b string")
    assert reads.linked_cluster_pairs(pairs, faces, placed).collect() == reads.linked_cluster_pairs(pairs, faces, some).collect() != []
    # Written once: nobody joins the faces for them again.
    assert reads._pairs_of(placed, faces, "photo_id") is placed
