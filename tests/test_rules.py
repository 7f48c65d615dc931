"""Rules in one pass per table against plain versions and single checks."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from shoebox.operators.rules import Checked, broken_rules, duplicates, orphans, rule_counts, violations


def found(frame):
    return Counter({(r["rule"], r["key"]): r["violations"] for r in frame.collect()})


def test_against_a_plain_version(spark):
    rng = random.Random(7)
    parents = [(f"p{rng.randint(0, 12)}" if rng.random() > 0.1 else None, rng.randint(0, 9)) for _ in range(20)]
    # A third of all children name one parent; others name none or a missing one.
    name = lambda: rng.choice(["p0", f"p{rng.randint(0, 20)}", rng.choice([None, "gone"])])
    children = [(i // 2, name(), rng.choice([None, "x", "x|y", "y"]), rng.choice(["z", "y|z"]), rng.choice([-1, 1, 2, None])) for i in range(400)]
    p = spark.createDataFrame(parents, "id string, n int")
    c = spark.createDataFrame(children, "id long, parent string, a string, b string, size int").repartition(7)
    got = found(broken_rules(
        Checked(p, F.col("id"), unique={"p_unique": ["id"]}, offers={"has_parent": ["id"]}, claims={"n_children": (["id"], F.col("n"))}),
        Checked(c, F.col("id"), {"size": F.col("size") > 0}, {"pair": ["a", "b"]}, {"has_parent": ["parent"]}, counted={"n_children": ["parent"]}),
    ))
    want = Counter()
    for i, _, _, _, size in children:
        want["size", str(i)] += size is None or size <= 0
    ids = Counter(i for i, _ in parents if i is not None)
    for i, n in ids.items():
        want["p_unique", i] += n > 1
    # Pairs that only look alike once joined are told apart, but share a key.
    for (a, b), n in Counter((a, b) for _, _, a, b, _ in children if a is not None).items():
        want["pair", f"{a}|{b}"] = max(want["pair", f"{a}|{b}"], int(n > 1))
    named = Counter(parent for _, parent, _, _, _ in children if parent is not None)
    for parent, n in named.items():
        want["has_parent", parent] += 0 if parent in ids else n
    for i in ids:
        stated = sum(n for j, n in parents if j == i)
        want["n_children", i] += stated != named[i]
    assert got == +want and got["has_parent", "gone"] > 1


def test_ambiguous_and_null_values(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), (None, "c"), ("", None)], "x string, y string")
    assert found(broken_rules(Checked(rows, F.col("x"), unique={"u": ["x", "y"]}))) == {}
    one = Checked(rows, F.col("x"), {"known": F.col("x") != ""}, references={"r": ["x"]})
    assert found(broken_rules(one)) == {("known", None): 2, ("known", ""): 1, ("r", "a|b"): 1, ("r", "a"): 1, ("r", ""): 1}
    assert broken_rules(Checked(rows.limit(0), F.col("x"), {"never": F.lit(False)})).isEmpty()
    unknown = Checked(rows.where("x = 'a'"), F.col("x"), claims={"n": (["x"], F.lit(None).cast("int"))})
    assert found(broken_rules(unknown)) == {("n", "a"): 1}


def test_equals_the_single_checks(spark, roles):
    faces, people = roles.faces, roles.people.where("album_id <> '5-LOW'")
    ok = {"small": F.col("quality") == "clusterable", "status": F.col("status") != "ignored"}
    single = (
        violations(faces, F.col("id"), ok).unionByName(duplicates(faces, ["photo_id", "cluster_id"], "twice"))
        .unionByName(orphans(faces, F.col("id"), people, "person_id", "id", "person"))
    )
    one = broken_rules(
        Checked(faces, F.col("id"), ok, {"twice": ["photo_id", "cluster_id"]}, {"person": ["person_id"]}),
        Checked(people, F.col("id"), offers={"person": ["id"]}),
    )
    assert {tuple(r) for r in rule_counts(one).collect()} == {tuple(r) for r in rule_counts(single).collect()}


def test_each_table_is_scanned_once(spark, tmp_path):
    from shoebox.plans.checks import catalog_violations

    def written(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    albums = written("albums", [("a", "s", "album_position_asc", 1, None, None)], "id string, slug string, default_sort string, photo_count int, captured_at_min timestamp, captured_at_max timestamp")
    sizes = ("source_width", "source_height", "thumb_width", "thumb_height", "thumb_bytes", "width", "height", "display_bytes")
    shape = "id string, album_id string, imported_run_id string, source_fingerprint string, captured_at_source string, media_type string, album_position int, source_bytes int, dominant_color string, blur_data_url string, thumb_key string, display_key string, " + ", ".join(f"{s} int" for s in sizes)
    row = lambda i, album, run, fp: (i, album, run, fp, "exif", "image", 0, 1, None, None, f"t{i}", f"d{i}", *[1] * len(sizes))
    pictures = written("pictures", [row("1", "a", "r", "f"), row("2", "a", None, "f"), row("3", "b", "q", "f"), row("3", "b", "q", "g")], shape)
    runs = written("runs", [("r", "a", "completed", 1, 1, 0, 0), ("s", None, "failed", 1, 1, 0, None)], "id string, album_id string, status string, discovered_count int, imported_count int, skipped_count int, failed_count int")
    report = catalog_violations(pictures, albums, runs)
    assert found(report) == {
        ("album_source_unique", "a|f"): 1, ("photo_id_unique", "3"): 1, ("thumb_key_unique", "t3"): 1, ("display_key_unique", "d3"): 1,
        ("photo_album", "b"): 2, ("photo_run", "q"): 2, ("failed_count", "s"): 1, ("run_album_set", "s"): 1,
    }
    plan = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") == 3 and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
