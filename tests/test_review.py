"""The review fixture graph: eight pictures, seven clusters, nine faces."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.operators import workspace as reads
from shoebox.operators.rules import RuleViolation
from shoebox.plans import checks, export, review

NOW = "2030-01-01T00:00:00.000Z"
FACES = [
    ("label", "label", "label", 0), ("split_a", "split", "split_a", 0), ("split_b", "split", "split_b", 0),
    ("merge_a", "merge_a", "merge_a", 0), ("merge_b", "merge_b", "merge_b", 0),
    ("blocked_a", "blocked_a", "blocked_shared", 0), ("blocked_b", "blocked_b", "blocked_shared", 1),
    ("state_a", "state", "state_a", 0), ("state_b", "state", "state_b", 0),
]


def hid(prefix, text, n):
    return f"{prefix}_{hashlib.sha256(text.encode()).hexdigest()[:n]}"


def face(x):
    return hid("f", "face:" + x, 32)


def group(x):
    return hid("c", "cluster:" + x, 24)


def photo(x):
    return hid("p", "photo:" + x, 32)


@pytest.fixture()
def ws(spark):
    def table(rows, schema):
        names = schema.names
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).coalesce(1)

    pictures = [p for p in dict.fromkeys(f[2] for f in FACES)]
    faces = [
        dict(
            id=face(n), photo_id=photo(p), cluster_id=group(c), ordinal=o, bbox_x=0.15, bbox_y=0.2, bbox_width=0.3,
            bbox_height=0.4, landmarks_json="{}", detection_score=0.9, width_px=320, height_px=320, quality="clusterable",
            quality_score=0.7 + 0.02 * i, crop_relpath=f"crops/{face(n)}.webp", crop_sha256="0" * 64, status="unreviewed",
            revision=0, created_at="t0", updated_at="t0",
        )
        for i, (n, c, p, o) in enumerate(FACES)
    ]
    clusters = [
        dict(id=group(c), origin="automatic", status="unreviewed", revision=0, created_at="t0", updated_at="t0")
        for c in dict.fromkeys(f[1] for f in FACES)
    ]
    a, b = sorted([face("blocked_a"), face("blocked_b")])
    pair = lambda x, y: dict(zip(("cluster_id_a", "cluster_id_b"), sorted([group(x), group(y)])))
    return review.Workspace(
        pictures=table(
            [dict(id=photo(p), album_position=i + 1, scan_status="complete", face_count=sum(f[2] == p for f in FACES)) for i, p in enumerate(pictures)],
            schemas.REVIEW_PICTURES,
        ),
        people=table([], schemas.REVIEW_PEOPLE), clusters=table(clusters, schemas.CLUSTERS), faces=table(faces, schemas.FACES),
        cannot_links=table([dict(face_id_a=a, face_id_b=b, reason="same_photo", created_at="t0")], schemas.CANNOT_LINKS),
        suggestions=table(
            [
                dict(pair("merge_a", "merge_b"), similarity_max=0.94, similarity_median=0.91, similarity_min=0.87, status="pending", created_at="t0"),
                dict(pair("split", "label"), similarity_max=0.83, similarity_median=0.79, similarity_min=0.73, status="rejected", created_at="t0"),
            ],
            schemas.SUGGESTIONS,
        ),
        actions=table([], schemas.ACTIONS), images=spark.createDataFrame([], review.IMAGES),
    )


def now():
    return F.lit(NOW)


def commands(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split())).coalesce(1)


def state(ws):
    return {r["id"]: (r["status"], r["person_id"], r["revision"]) for r in ws.clusters.collect()}


def snapshot(ws):
    return {
        "faces": {tuple(r) for r in ws.faces.select(*schemas.MUTABLE_FACE_COLUMNS).collect()},
        "clusters": {tuple(r) for r in ws.clusters.collect()},
        "people": {tuple(r) for r in ws.people.collect()},
        "links": {tuple(r) for r in ws.cannot_links.collect()},
        "suggestions": {tuple(r) for r in ws.suggestions.collect()},
    }


def label(spark, ws, name="Álex  Smith", cluster="label", mutation="mutation-1"):
    return review.label_clusters(ws, commands(spark, [(group(cluster), name)], "cluster_id name"), mutation_id=mutation, now=now())


def test_label_creates_a_person_and_undo_removes_it(spark, ws):
    before = snapshot(ws)
    out = label(spark, ws)
    person = out.people.head()
    assert (person["display_name"], person["name_key"]) == ("Álex", "álex")
    assert state(out)[group("label")] == ("labeled", person["id"], 1)
    # A replayed mutation and a repeated label change nothing.
    assert label(spark, out) is out
    assert label(spark, out, mutation="mutation-2") is out
    undone, kind = review.undo_last(out, now())
    assert kind == "label_cluster" and snapshot(undone) == before
    assert review.undo_last(undone, now())[1] is None


def test_same_name_reuses_the_person_and_aliases_apply(spark, ws):
    out = label(spark, ws, " robin ", "label", "mutation-1")
    out = label(spark, out, "ROBIN", "split", "mutation-2")
    assert out.people.count() == 1
    out = review.label_clusters(
        out, commands(spark, [(group("state"), "Mo")], "cluster_id name"), mutation_id="mutation-3", now=now(), aliases={"mo": "Morris"}
    )
    assert sorted(r["display_name"] for r in out.people.collect()) == ["Morris", "robin"]
    stats = {r["display_name"]: (r["photo_count"], r["face_count"]) for r in reads.person_stats(out.people, out.faces).collect()}
    assert stats == {"robin": (3, 3), "Morris": (2, 2)}
    with pytest.raises(review.ReviewConflict):
        label(spark, out, "   ", "merge_a", "mutation-4")
    with pytest.raises(review.ReviewConflict):
        label(spark, out, "Ann", "no_such", "mutation-5")


def test_batch_label_is_all_or_nothing(spark, ws):
    out = label(spark, ws)
    person = out.people.head()["id"]
    batch = lambda w, names, m: review.batch_label(
        w, commands(spark, [(group(n), person) for n in names], "cluster_id person_id"), mutation_id=m, now=now()
    )
    done = batch(out, ["split", "merge_a", "label"], "mutation-2")
    assert [state(done)[group(x)][0] for x in ("split", "merge_a", "label")] == ["labeled"] * 3
    assert state(done)[group("label")] == state(out)[group("label")]
    unknown = review.set_clusters(out, commands(spark, [(group("state"),)], "cluster_id"), "unknown", mutation_id="mutation-3", now=now())
    with pytest.raises(review.ReviewConflict):
        batch(unknown, ["split", "state"], "mutation-4")
    other = label(spark, out, "Bea", "merge_b", "mutation-5")
    with pytest.raises(review.ReviewConflict):
        batch(other, ["merge_b"], "mutation-6")


def test_split_and_undo(spark, ws):
    before = snapshot(ws)
    cut = commands(spark, [(group("split"), face("split_a"))], "cluster_id face_id")
    out = review.split_clusters(ws, cut, mutation_id="mutation-1", now=now())
    new_id = "c_manual_" + hashlib.sha256(face("split_a").encode()).hexdigest()[:32]
    assert state(out)[new_id] == ("unreviewed", None, 1) and state(out)[group("split")][2] == 1
    assert {(r["reason"]) for r in out.cannot_links.collect()} == {"same_photo", "manual_split"}
    assert out.suggestions.count() == 1
    undone, _kind = review.undo_last(out, now())
    assert snapshot(undone) == before
    everything = commands(spark, [(group("split"), face("split_a")), (group("split"), face("split_b"))], "cluster_id face_id")
    foreign = commands(spark, [(group("split"), face("label"))], "cluster_id face_id")
    for bad in (everything, foreign):
        with pytest.raises(review.ReviewConflict):
            review.split_clusters(ws, bad, mutation_id="mutation-2", now=now())
    # Split faces may not be merged again.
    with pytest.raises(review.ReviewConflict):
        review.merge_clusters(
            out, commands(spark, [("g", group("split")), ("g", new_id)], "merge_group cluster_id"), mutation_id="mutation-3", now=now()
        )


def test_merge_and_undo(spark, ws):
    before = snapshot(ws)
    both = commands(spark, [("g", group("merge_a")), ("g", group("merge_b"))], "merge_group cluster_id")
    out = review.merge_clusters(ws, both, mutation_id="mutation-1", now=now())
    target, source = sorted([group("merge_a"), group("merge_b")])
    assert state(out)[target] == ("unreviewed", None, 2) and source not in state(out)
    merged = out.clusters.where(F.col("id") == target).head()
    assert merged["origin"] == "manual" and merged["representative_face_id"] == face("merge_b")
    assert out.suggestions.count() == 1
    assert snapshot(review.undo_last(out, now())[0]) == before
    blocked = commands(spark, [("g", group("blocked_a")), ("g", group("blocked_b"))], "merge_group cluster_id")
    with pytest.raises(review.ReviewConflict):
        review.merge_clusters(ws, blocked, mutation_id="mutation-2", now=now())
    # Labeled with unreviewed becomes unreviewed; two people are refused.
    named = label(spark, ws, "Ann", "merge_a", "mutation-3")
    mixed = review.merge_clusters(named, both, mutation_id="mutation-4", now=now())
    assert state(mixed)[target][0] == "unreviewed"
    two = label(spark, named, "Bea", "merge_b", "mutation-5")
    with pytest.raises(review.ReviewConflict):
        review.merge_clusters(two, both, mutation_id="mutation-6", now=now())


def test_unknown_and_recovery_touch_the_right_faces(spark, ws):
    one = commands(spark, [(face("state_a"),)], "face_id")
    target = commands(spark, [(group("state"),)], "cluster_id")
    out = review.set_faces(ws, one, "ignored", mutation_id="mutation-1", now=now())
    assert state(out)[group("state")][0] == "unreviewed"
    out = review.set_clusters(out, target, "unknown", mutation_id="mutation-2", now=now())
    status = lambda w: {r["id"]: r["status"] for r in w.faces.collect()}
    assert (status(out)[face("state_a")], status(out)[face("state_b")]) == ("ignored", "unknown")
    assert state(out)[group("state")][0] == "unknown"
    back = review.set_clusters(out, target, "unreviewed", mutation_id="mutation-3", now=now())
    assert (status(back)[face("state_a")], status(back)[face("state_b")]) == ("ignored", "unreviewed")
    gone = review.set_clusters(out, target, "ignored", mutation_id="mutation-4", now=now())
    assert state(gone)[group("state")][0] == "ignored"
    with pytest.raises(review.ReviewConflict):
        label(spark, gone, "Ann", "state", "mutation-5")


def test_ignore_all(spark, ws):
    out = label(spark, ws)
    out = review.set_clusters(out, commands(spark, [(group("state"),)], "cluster_id"), "unknown", mutation_id="mutation-2", now=now())
    counts = lambda w: {
        "clusters": {r["status"]: r["n"] for r in reads.status_histogram(w.clusters).collect()},
        "faces": {r["status"]: r["n"] for r in reads.status_histogram(w.faces).collect()},
        "digest": checks.protected_digest(w.people, w.clusters, w.faces).head()[0],
    }
    assert checks.bulk_ignore_preflight(out.clusters, out.faces).isEmpty()
    done, report = review.ignore_unreviewed(out, mutation_id="mutation-3", now=now())
    row = report.head()
    assert (row["target_clusters"], row["ignored_faces"]) == (5, 6)
    assert checks.bulk_ignore_result(counts(out), counts(done)) == []
    assert review.high_watermark(done).head()[0] == 3
    assert snapshot(review.undo_last(done, now())[0]) == snapshot(out)
    same, _report = review.ignore_unreviewed(done, mutation_id="mutation-4", now=now())
    assert same is done
    broken = counts(done)
    broken["faces"]["unreviewed"] = 1
    assert "faces_remaining" in checks.bulk_ignore_result(counts(out), broken)


def test_reads(spark, ws):
    out = label(spark, ws)
    summary = reads.cluster_summary(out.clusters, out.faces, out.pictures, out.people)
    queue = [r["id"] for r in reads.review_queue(summary).collect()]
    assert queue[0] in (group("split"), group("state")) and queue[-1] == group("label")
    assert reads.filter_clusters(summary, "labeled", "lex").count() == 1
    assert reads.filter_clusters(summary, "all", "%").count() == 0
    board = reads.scoreboard(out.pictures, out.faces, out.clusters).head()
    assert (board["pictures"], board["total_faces"], board["labeled_faces"], board["unreviewed_clusters"]) == (8, 9, 1, 6)
    top = reads.top_suggestions(out.suggestions).collect()
    assert {r["cluster_id"] for r in top} == {group("merge_a"), group("merge_b")}
    named = label(spark, out, "Bea", "merge_a", "mutation-2")
    proposal = reads.label_proposals(named.clusters, named.people, named.suggestions).collect()
    assert {(r["cluster_id"], r["target_id"]) for r in proposal} == {
        (group("merge_a"), group("merge_b")), (group("merge_b"), group("merge_b"))
    }
    assert checks.consistency_violations(
        out.pictures, out.faces, review.recompute_clusters(out.clusters, out.faces, out.clusters.select(F.col("id").alias("cluster_id")), now()),
        out.cannot_links, out.suggestions,
    ).isEmpty()


def test_export(spark, ws):
    out = label(spark, ws, "Ann", "split")
    out, _ = review.ignore_unreviewed(out, mutation_id="mutation-9", now=now())
    crops = out.faces.select(
        F.col("crop_relpath").alias("relative_path"), F.lit(10).cast("long").alias("bytes"), F.col("crop_sha256").alias("sha256")
    )
    args = dict(prefix="g", side=320, crop_root="/private", clustered=True)
    done = export.build_export(out.people, out.faces, out.clusters, out.pictures, crops, **args)
    person = done.people.head()
    assert set(done.people.columns) == {"id", "slug", "display_name", "photo_count", "avatar_key", "avatar_sha256", "avatar_width", "avatar_height"}
    assert (person["display_name"], person["photo_count"]) == ("Ann", 2)
    assert done.photo_people.count() == 2
    assert done.avatar_uploads.head()["local_path"].endswith(face("split_b") + ".webp")
    assert checks.upload_violations(done.avatar_uploads, prefix="g", private_root="/private").isEmpty()
    with pytest.raises(RuleViolation):
        export.build_export(ws.people, ws.faces, ws.clusters, ws.pictures, crops, **args)
    tampered = done.avatar_uploads.withColumn("sha256", F.lit("1" * 64))
    assert not export.export_rules(
        export.exported_people(out.people, out.faces, out.clusters, prefix="g", side=320), done.photo_people, tampered, out.faces, "g"
    ).isEmpty()
    dims = crops.select("relative_path", F.lit(320).alias("width"), F.lit(319).alias("height"))
    avatars = reads.best_avatars(out.faces, out.clusters)
    bad = checks.avatar_source_violations(avatars, crops, dims, root="/private", side=320)
    assert [r["rule"] for r in bad.collect()] == ["square_side"]


def pairwise(faces, exceptions):
    """The relation written out: who is linked with whom."""
    links = {frozenset((a[0], b[0])) for a in faces for b in faces if a[0] < b[0] and a[2] == b[2]}
    for a, b, reason in exceptions:
        (links.discard if reason == "absent" else links.add)(frozenset((a, b)))
    return links


def test_links_are_counted_as_if_every_pair_were_stored(spark):
    import itertools
    import random

    rng = random.Random(6)
    faces = [(f"f{i:02d}", f"c{rng.randrange(7)}", f"p{rng.randrange(9)}") for i in range(60)]
    some = rng.sample(list(itertools.combinations([f[0] for f in faces], 2)), 60)
    photo = {f[0]: f[2] for f in faces}
    exceptions = [(a, b, "absent" if photo[a] == photo[b] else "manual_split") for a, b in some]
    for n in ("f00", "f01"):  # repeated pairs of a photo change nothing
        exceptions += [(*sorted((n, x)), "same_photo") for x, p in photo.items() if p == photo[n] and x != n and (*sorted((n, x)), "absent") not in exceptions]
    exceptions = list(dict.fromkeys(exceptions))
    links = pairwise(faces, exceptions)
    home = {f[0]: f[1] for f in faces}
    frame = spark.createDataFrame(faces, "id string, cluster_id string, photo_id string")
    odd = spark.createDataFrame([(*e, "t") for e in exceptions], schemas.CANNOT_LINKS)
    for table, there in ((odd, links), (None, pairwise(faces, []))):
        crossing = {}
        for pair in there:
            ends = tuple(sorted({home[x] for x in pair}))
            if len(ends) == 2:
                crossing[ends] = crossing.get(ends, 0) + 1
        every = list(itertools.combinations([f"c{i}" for i in range(7)], 2))
        asked = spark.createDataFrame([(b, a) if i % 3 == 0 else (a, b) for i, (a, b) in enumerate(every)], "cluster_id_a string, cluster_id_b string")
        got = {tuple(sorted((r["cluster_id_a"], r["cluster_id_b"]))): r["links"] for r in reads.linked_cluster_pairs(asked, frame, table).collect()}
        assert got == crossing
        groups = [("x", "c0"), ("x", "c1"), ("x", "c2"), ("y", "c3"), ("y", "c4"), ("z", "c5")]
        want = {}
        for g, members in itertools.groupby(groups, lambda t: t[0]):
            inside = {c for _g, c in members}
            want[g] = sum(n for ends, n in crossing.items() if set(ends) <= inside)
        got = {r["group"]: r["links"] for r in reads.linked_groups(spark.createDataFrame(groups, "group string, cluster_id string"), frame, table).collect()}
        assert got == {g: n for g, n in want.items() if n}
        pictures = spark.createDataFrame([(p, 3) for p in sorted(set(photo.values()))], "id string, face_count int")
        row = reads.link_completeness(pictures, frame, table).head()
        within = sum(len({photo[x] for x in pair}) == 1 for pair in there)
        assert (row["expected"], row["actual"]) == (27, within)


def test_no_pair_of_faces_is_formed_by_checks_merges_and_scans(spark, ws, monkeypatch):
    """A photo of very many faces costs one row per cluster, not one per pair."""
    def never(*_args):
        raise AssertionError("pairs were written out")

    monkeypatch.setattr(reads, "same_photo_links", never)
    monkeypatch.setattr(reads, "crossing_links", never)
    none = ws.cannot_links.limit(0)
    crowd = ws.faces.where(F.col("id") == face("label")).crossJoin(spark.range(3000).withColumnRenamed("id", "n"))
    crowd = crowd.select(*[F.concat("id", F.col("n").cast("string")).alias("id") if c == "id" else F.concat(F.lit("c"), F.col("n") % 1000).alias(c) if c == "cluster_id" else F.col(c) for c in ws.faces.columns])
    wide = replace_ws(ws, faces=crowd, cannot_links=none)
    assert checks.consistency_violations(wide.pictures, crowd, wide.clusters, none, wide.suggestions).where("rule = 'suggestion_blocked'").isEmpty()
    linked = reads.linked_groups(spark.createDataFrame([("g", "c1"), ("g", "c2")], "group string, cluster_id string"), crowd)
    assert linked.head()["links"] == 9
    blocked = commands(spark, [("g", group("blocked_a")), ("g", group("blocked_b"))], "merge_group cluster_id")
    with pytest.raises(review.ReviewConflict):
        review.merge_clusters(replace_ws(ws, cannot_links=none), blocked, mutation_id="mutation-2", now=now())


def replace_ws(ws, **changes):
    from dataclasses import replace

    return replace(ws, **changes)


def test_a_decision_writes_its_rows_only(spark, ws, monkeypatch):
    """Bytes written grow with the decision, undo included; reads merge the layers."""
    from shoebox.operators import layers

    written = []
    write = layers.Layered._write

    def spy(self, rows):
        out = write(self, rows)
        written.append((self.key, spark.read.parquet(out.paths[-1]).count() if out.paths else None))
        return out

    monkeypatch.setattr(layers.Layered, "_write", spy)
    many = ws.faces.where(F.col("id") == face("label")).crossJoin(spark.range(500).withColumnRenamed("id", "n"))
    many = many.select(*[F.concat(F.lit("g"), "n").alias(c) if c == "id" else F.concat(F.lit("d"), "n").alias(c) if c in ("cluster_id", "photo_id") else F.col(c) for c in ws.faces.columns])
    ws = replace_ws(ws, faces=ws.faces.unionByName(many))
    before = snapshot(ws)
    out = label(spark, ws, "Ann", "split", "mutation-1")
    # Two faces, one cluster, one person, one action, four images.
    assert sorted(n for _k, n in written) == [1, 1, 1, 2, 4]
    undone, _kind = review.undo_last(out, now())
    assert max(n for _k, n in written) == 4 and snapshot(undone) == before
    again = label(spark, undone, "Bea", "split", "mutation-2")
    assert {r["display_name"] for r in again.people.collect()} == {"Bea"} and again.faces.count() == 509
    # The plan of a read does not grow with the layers.
    joins = [str(w.faces._jdf.queryExecution().optimizedPlan().toString()).count("Join") for w in (out, undone, again)]
    assert len(set(joins)) == 1


def test_layers_are_folded_into_a_new_base(spark, monkeypatch):
    from shoebox.operators import layers

    monkeypatch.setattr(layers, "MAX_LAYERS", 2)
    base = spark.createDataFrame([(i, f"v{i}", None) for i in range(5)], "id long, v string, w array<int>")
    table, want = layers.Layered(base, ("id",)), {i: f"v{i}" for i in range(5)}
    for step in range(6):
        after = table.view().where(F.col("id") != step).withColumn("v", F.when(F.col("id") == step + 1, F.lit(f"s{step}")).otherwise(F.col("v")))
        after = after.union(spark.createDataFrame([(10 + step, "new", [step])], "id long, v string, w array<int>"))
        table = table.changed(after, spark.createDataFrame([(str(k),) for k in (step, step + 1, 10 + step)], "key string"))
        want.pop(step, None)
        want.update({step + 1: f"s{step}"} if step + 1 in want else {})
        want[10 + step] = "new"
        assert {r["id"]: r["v"] for r in table.view().collect()} == want and len(table.paths) <= 2
        assert table.view().schema == base.schema or table.view().columns == base.columns


def test_actions_tell_their_commands_and_replays(spark, ws):
    import json

    out = label(spark, ws)
    assert review.outcome(ws, out, "mutation-1") == review.Outcome(1, False)
    told = json.loads(out.actions.head()["payload_json"])
    assert told["commands"] == 1 and len(told["digest"]) == 64
    again = label(spark, out)
    assert review.outcome(out, again, "mutation-1") == review.Outcome(1, True) and again.actions.count() == 1
    # Named so already: nothing to log under a new id.
    same = label(spark, out, mutation="mutation-2")
    assert review.outcome(out, same, "mutation-2") == review.Outcome(None) and same.actions.count() == 1
    marked = review.set_clusters(out, commands(spark, [(group("split"),)], "cluster_id"), "unknown", mutation_id="mutation-3", now=now())
    told = json.loads(marked.actions.where("id = 2").head()["payload_json"])
    assert review.outcome(out, marked, "mutation-3").action_id == 2 and (told["state"], told["commands"]) == ("unknown", 1)


def test_bulk_ignore_behind_a_verified_backup(spark, ws, tmp_path):
    from shoebox.plans import backup

    whole = label(spark, ws)
    before = snapshot(whole)
    done, report = backup.ignore_with_backup(whole, f"{tmp_path}/one", mutation_id="mutation-8", now=now())
    assert {r["status"] for r in done.clusters.collect()} == {"labeled", "ignored"} and report.head()["ignored_clusters"] == 6
    assert snapshot(backup.read_backup(spark, f"{tmp_path}/one")) == before
    # Asked again nothing is copied; a folder holds one backup.
    again, _ = backup.ignore_with_backup(done, f"{tmp_path}/two", mutation_id="mutation-8", now=now())
    assert review.outcome(done, again, "mutation-8").replayed and not (tmp_path / "two").exists()
    with pytest.raises(Exception, match="version"):
        backup.write_backup(whole, f"{tmp_path}/one")


def test_a_backup_that_does_not_hold_is_refused(spark, ws, tmp_path, monkeypatch):
    from dataclasses import replace

    from shoebox.plans import backup

    mixed = replace(ws, faces=ws.faces.withColumn("status", F.when(F.col("id") == face("state_a"), "unknown").otherwise(F.col("status"))))
    with pytest.raises(RuleViolation, match="not ready"):
        backup.ignore_with_backup(mixed, f"{tmp_path}/mixed", mutation_id="mutation-8", now=now())
    assert not (tmp_path / "mixed").exists()
    lost = replace(ws, faces=ws.faces.withColumn("photo_id", F.when(F.col("id") == face("state_a"), "p_gone").otherwise(F.col("photo_id"))))
    assert [tuple(r) for r in backup.broken_references(lost).collect()] == [("face_photo", "p_gone", 1)]
    with pytest.raises(RuleViolation, match="broken references"):
        backup.write_backup(lost, f"{tmp_path}/lost")
    publish = backup.snapshots.publish
    torn = lambda df, root, **more: publish(df.limit(3) if root.endswith("/clusters") else df, root, **more)
    monkeypatch.setattr(backup.snapshots, "publish", torn)
    with pytest.raises(RuleViolation, match="differs from the workspace"):
        backup.write_backup(ws, f"{tmp_path}/torn")
    for name in ("lost", "torn", "never"):
        with pytest.raises(FileNotFoundError):
            backup.read_backup(spark, f"{tmp_path}/{name}")
