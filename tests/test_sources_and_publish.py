from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F, types as T

from shoebox import schemas
from shoebox.functions import text
from shoebox.functions.hashing import digest_nodes, set_digest
from shoebox.operators import facets
from shoebox.operators.rules import RuleViolation, compare_fields
from shoebox.operators.tables import set_differences
from shoebox.operators.workspace import same_photo_links
from shoebox.plans import checks, ingest, publish, scan, upload
from shoebox.sources import batches, files, jsonlines, snapshots
from shoebox.streaming.fold import fold_stream

LINE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.StringType())])


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_inventory_and_fingerprints(spark, tmp_path):
    for name in ("a/IMG_10.JPG", "a/IMG_9.jpg", "b.webp", ".hidden.jpg", "notes.txt"):
        write(tmp_path / name, name)
    found = files.inventory(spark, str(tmp_path))
    assert {r["relative_path"]: r["bytes"] for r in found.collect()} == {"a/IMG_10.JPG": 12, "a/IMG_9.jpg": 11, "b.webp": 6}
    assert [r["relative_path"] for r in files.first_files(found, 2).collect()] == ["a/IMG_9.jpg", "a/IMG_10.JPG"]
    prints = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.fingerprints(spark, str(tmp_path)).collect()}
    assert prints["b.webp"] == hashlib.sha256(b"b.webp").hexdigest()


def test_files_of_any_size_and_name_are_hashed_in_pieces(spark, tmp_path):
    want = {}
    for i, name in enumerate(("a b%20c.jpg", "é/ü #1.jpg", "x.jpg")):
        data = bytes(range(256)) * (i * 37 + 1)
        write(tmp_path / name, data)
        want[name.rsplit("/", 1)[-1]] = (len(data), hashlib.sha256(data).hexdigest())
    write(tmp_path / "unlisted.bin", b"never opened")
    (tmp_path / "unlisted.bin").chmod(0)
    big = tmp_path / "huge.jpg"
    size = (1 << 31) + 5  # more than a binary value can hold; sparse on disk
    with big.open("wb") as out:
        out.truncate(size)
    zeros, digest = bytes(1 << 20), hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(zeros)
    digest.update(bytes(5))
    want["huge.jpg"] = (size, digest.hexdigest())
    listed = files.inventory(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in files.hash_files(listed, chunk_bytes=1 << 20).collect()}
    assert got == want
    assert files.hash_files(listed.limit(0)).count() == 0


def test_strict_tolerant_and_ledger_reads(spark, tmp_path):
    good = "".join(json.dumps({"seq": i, "key": f"k{i}"}) + "\n\n" for i in range(5))
    write(tmp_path / "good.json", good)
    assert jsonlines.read_strict(spark, str(tmp_path / "good.json"), LINE).count() == 5
    write(tmp_path / "middle.json", good + "{oops\n" + good)
    with pytest.raises(jsonlines.CorruptInput, match=r"middle\.json:11"):
        jsonlines.read_strict(spark, str(tmp_path / "middle.json"), LINE)
    kept, dropped = jsonlines.read_tolerant(spark, str(tmp_path / "middle.json"), LINE)
    assert (kept.count(), dropped.head()[0]) == (10, 1)
    write(tmp_path / "torn.json", good + '{"seq": 9, "ke')
    assert jsonlines.read_ledger(spark, str(tmp_path / "torn.json"), LINE).count() == 5
    with pytest.raises(jsonlines.CorruptInput):
        jsonlines.read_ledger(spark, str(tmp_path / "middle.json"), LINE)
    write(tmp_path / "album.json", json.dumps({"album": {"id": "a", "photo_count": 3}, "import_run": {"id": "r", "complete_source_set": True}}, indent=2))
    doc = jsonlines.read_run_document(spark, str(tmp_path / "album.json"), schemas.RUN_DOCUMENT).select("album.id", "import_run.complete_source_set").head()
    assert tuple(doc) == ("a", True)


def test_snapshots_are_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.publish(spark.range(3), root) == 1

    def refuse(_df):
        raise RuleViolation("no")

    with pytest.raises(RuleViolation):
        snapshots.publish(spark.range(9), root, guard=refuse)
    assert snapshots.read_current(spark, root).count() == 3
    # A table may be rewritten from itself: the old version is still there.
    assert snapshots.publish(snapshots.read_current(spark, root).where("id > 0"), root) == 2
    assert snapshots.read_current(spark, root).count() == 2
    with pytest.raises(ValueError):
        batches.numbered_batches(spark.range(3), "id", 5001, largest=5000)
    with pytest.raises(ValueError):
        batches.numbered_batches(spark.range(3), "id", 0)


def test_stream_fold_equals_batch_and_resumes(spark, tmp_path):
    log, table, state = (str(tmp_path / x) for x in ("log", "table", "state"))
    shape = T.StructType([*LINE.fields, T.StructField("type", T.StringType())])
    rows = [(i, f"k{i % 4}", "completed" if i % 5 else "failed") for i in range(40)]
    everything = spark.createDataFrame(rows, shape)
    for part in (everything.where("seq >= 20"), everything.where("seq < 20")):
        part.coalesce(1).write.mode("append").json(log)
        fold_stream(spark, log, shape, table, state, key=["key"], sequence="seq", kind="completed").awaitTermination()
    got = {(r["key"], r["seq"]) for r in snapshots.read_current(spark, table).collect()}
    batch = ingest.latest_state(everything.withColumnRenamed("key", "signature"))
    assert got == {(r["signature"], r["seq"]) for r in batch.collect()}


def test_concurrent_writers_never_lose_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/t"
    add = lambda n: snapshots.update(spark, root, lambda old: spark.range(n, n + 1) if old is None else old.union(spark.range(n, n + 1)))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(add, range(12)))
    assert sorted(versions) == list(range(1, 13)) == snapshots._versions(spark, root)
    assert sorted(r[0] for r in snapshots.read_current(spark, root).collect()) == list(range(12))
    with pytest.raises(snapshots.VersionConflict):
        snapshots.publish(spark.range(1), root, expected=3)
    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(lambda i: snapshots.create_once(spark, root, "one", str(i)), range(16))) == [False] * 15 + [True]
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.startswith(".one")]


def test_a_layer_holds_its_own_keys_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MAX_LAYERS", 3)
    root, want = f"{tmp_path}/t", {}
    for step in range(8):
        rows = [(k, 10 * step + i) for i, k in enumerate((f"k{step}", "hot", "hot"))]
        want.update(dict(rows))
        if step == 5:
            rows.append(("k0", -1))  # late and old: does not count
        snapshots.publish_layer(spark.createDataFrame(rows, "key string, seq long"), root, ["key"], "seq")
        entries = snapshots._entries(spark, root)
        assert len(entries) <= 3
        if entries[-1].key:
            assert spark.read.parquet(entries[-1].path).count() == len({k for k, _s in rows})
        assert {r["key"]: r["seq"] for r in snapshots.read_current(spark, root).collect()} == want


def now():
    return F.to_timestamp(F.lit("2030-01-01 00:00:00"))


def catalog(spark):
    p = lambda i, album="a", run="r0", shown=True: (i, album, run, f"old{i}", shown, 1)
    pictures = spark.createDataFrame(
        [p("p1"), p("p2"), p("p9", "b")], "id string, album_id string, imported_run_id string, original_filename string, published boolean, album_position int"
    ).withColumn("captured_at", now()).withColumn("updated_at", F.lit(None).cast("timestamp"))
    albums = spark.createDataFrame([("a", "a", 2), ("b", "b", 1)], "id string, slug string, photo_count long").select(
        "*", *[F.lit(None).cast("timestamp").alias(c) for c in ("captured_at_min", "captured_at_max", "updated_at")]
    )
    return publish.Catalog(albums, spark.createDataFrame([], schemas.IMPORT_RUNS), pictures)


def run_row(spark, **change):
    row = dict(id="r1", album_id="a", status="completed", failed_count=0, complete_source_set=True, manifest_sha256="m" * 64, imported_count=2)
    row.update(change)
    return spark.createDataFrame([tuple(row.get(n) for n in schemas.IMPORT_RUNS.names)], schemas.IMPORT_RUNS)


def test_import_publishes_behind_its_guard(spark):
    base = catalog(spark)
    manifest = spark.createDataFrame([("p2", "a", "new2", 0), ("p3", "a", "new3", 1)], "id string, album_id string, original_filename string, album_position int").withColumn("captured_at", now())
    album = spark.createDataFrame([("a", "a2")], "id string, slug string")
    additive = publish.import_manifest(base, album, run_row(spark), manifest, now=now(), required=())
    shown = lambda c: {r["id"]: (r["published"], r["original_filename"]) for r in c.pictures.collect()}
    assert shown(additive) == {"p1": (True, "oldp1"), "p2": (True, "new2"), "p3": (True, "new3"), "p9": (True, "oldp9")}
    assert {r["id"]: (r["slug"], r["photo_count"]) for r in additive.albums.collect()} == {"a": ("a2", 3), "b": ("b", 1)}
    run = additive.import_runs.head()
    assert (run["status"], run["imported_count"]) == ("completed", 2)
    full = publish.import_manifest(base, album, run_row(spark), manifest, authoritative=True, now=now(), required=())
    assert shown(full)["p1"][0] is False and shown(full)["p9"][0] is True
    with pytest.raises(RuleViolation):
        publish.import_manifest(base, album, run_row(spark, failed_count=1), manifest, authoritative=True, now=now(), required=())
    for wrong in (manifest.union(manifest.limit(1)), manifest.limit(1), manifest.withColumn("album_id", F.lit("b")), manifest.withColumn("album_position", F.lit(1))):
        with pytest.raises(RuleViolation):
            publish.import_manifest(base, album, run_row(spark), wrong, now=now(), required=())
    with pytest.raises(RuleViolation):
        publish.import_manifest(base, album, run_row(spark), manifest, now=now())
    with pytest.raises(RuleViolation):
        publish.import_manifest(base, album, run_row(spark), manifest, now=now(), required=(), expected_digest="x", actual_digest="y")
    staged = publish.stage_pictures(base.pictures, manifest, "r1", now())
    assert {r["id"]: r["published"] for r in staged.collect()}["p3"] is False
    with pytest.raises(RuleViolation):
        publish.publish_run(staged, run_row(spark), album_id="a", run_id="r1", expected=3, authoritative=False, now=now())
    with pytest.raises(RuleViolation):
        publish.publish_run(staged, run_row(spark), album_id="a", run_id="r2", expected=2, authoritative=False, now=now())


def test_people_replacement(spark):
    from dataclasses import replace

    avatar = lambda i: (i, "a", f"person-{i}", i.upper(), f"k{i}", "s" * 64, 1, 1)
    shape = "id string, album_id string, slug string, display_name string, avatar_key string, avatar_sha256 string, avatar_width int, avatar_height int"
    people = spark.createDataFrame([avatar("x"), avatar("y"), ("z", "b", "person-z", "Z", None, None, None, None)], shape)
    links = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p9", "z")], "photo_id string, person_id string")
    base = replace(catalog(spark), import_runs=run_row(spark), people=people, photo_people=links)
    go = lambda p, l, sha="m" * 64: publish.replace_people(base, p, l, album_id="a", manifest_sha256=sha)
    pair = "photo_id string, person_id string"
    out = go(spark.createDataFrame([avatar("x"), avatar("w")], shape), spark.createDataFrame([("p1", "x"), ("p1", "w")], pair))
    assert {tuple(r) for r in out.photo_people.collect()} == {("p1", "x"), ("p1", "w"), ("p9", "z")}
    assert {r["id"] for r in out.people.collect()} == {"x", "w", "z"}
    emptied = go(spark.createDataFrame([], shape), spark.createDataFrame([], pair))
    assert {r["id"] for r in emptied.people.collect()} == {"z"}
    with pytest.raises(RuleViolation, match="completed import"):
        go(spark.createDataFrame([avatar("x")], shape), spark.createDataFrame([("p1", "x")], pair), "0" * 64)
    with pytest.raises(RuleViolation, match="outside its album"):
        go(spark.createDataFrame([avatar("x")], shape), spark.createDataFrame([("p9", "x")], pair))
    with pytest.raises(RuleViolation, match="person import"):
        go(spark.createDataFrame([avatar("x")[:4] + (None, None, None, None)], shape), spark.createDataFrame([("p1", "x")], pair))


def test_scan_storage(spark):
    pictures = spark.createDataFrame(
        [("p1", "pending", 0, None, None), ("p2", "complete", 1, None, "t")], "id string, scan_status string, face_count int, scan_error string, processed_at string"
    )
    face = "id string, photo_id string, status string, person_id string"
    faces = spark.createDataFrame([("f1", "p2", "unreviewed", None)], face)
    links = spark.createDataFrame([("f1", "x", "manual_split", "t"), ("x", "y", "manual_split", "t")], schemas.CANNOT_LINKS)
    incoming = spark.createDataFrame([(f"g{i}", "p1", "unreviewed", None) for i in range(3)], face)
    both = spark.createDataFrame([("p1",), ("p2",)], "id string")
    new_pictures, new_faces, new_links = scan.replace_faces(pictures, faces, links, incoming, both, now=F.lit("t1"))
    assert {r["id"]: (r["scan_status"], r["face_count"]) for r in new_pictures.collect()} == {"p1": ("complete", 3), "p2": ("complete", 0)}
    # The three links of the photo follow from its faces; exceptions of faces that are gone go too.
    assert new_faces.count() == 3 and same_photo_links(new_faces).count() == 3
    assert [(r["face_id_a"], r["face_id_b"]) for r in new_links.collect()] == [("x", "y")]
    reviewed = faces.withColumn("status", F.lit("ignored"))
    with pytest.raises(RuleViolation):
        scan.replace_faces(pictures, reviewed, links, incoming, both, now=F.lit("t1"))


def test_upload_force_and_preview(spark):
    plan = spark.createDataFrame([("k1", "s1", "c", "x", 1), ("k2", "s2", "c", "x", 2)], "object_key string, sha256 string, content_type string, cache_control string, bytes long")
    ledger = upload.with_fingerprint(plan).select("object_key", "upload_fingerprint")
    remote = plan.where("object_key = 'k1'")
    assert [r["object_key"] for r in upload.pending(plan, ledger, remote).collect()] == ["k2"]
    assert upload.pending(plan, ledger, remote, force=True).count() == 2
    head, more = upload.preview(plan, 1)
    assert head.count() == 1 and more.head()[0] == 1


def test_manifest_gate_and_settings(spark):
    run = run_row(spark)
    assert checks.run_is_complete(run).isEmpty() and not checks.run_is_complete(run_row(spark, failed_count=2)).isEmpty()
    manifest = spark.createDataFrame([("a", "x", 0), ("b", "x", 1)], "id string, album_id string, album_position int")
    assert checks.manifest_violations(manifest, album_id="x", expected_count=2).isEmpty()
    with pytest.raises(RuleViolation):
        checks.manifest_violations(manifest, album_id="x", expected_count=2, expected_digest="1", actual_digest="2")
    with pytest.raises(RuleViolation, match="thumb_key"):
        checks.manifest_violations(manifest, album_id="x", expected_count=2, required=checks.MANIFEST_REQUIRED)
    one = lambda v: spark.createDataFrame([("1", v)], "version string, config string")
    assert [r[0] for r in checks.changed_settings(one("a"), one(None), ["version", "config"]).collect()] == ["config"]
    assert compare_fields(manifest, manifest, ["id"], ["album_position"]).isEmpty()
    sides = set_differences(manifest, manifest.where("id = 'a'").withColumn("id", F.lit("c")).unionByName(manifest.where("id = 'b'")), ["id"])
    assert {tuple(r) for r in sides.collect()} == {("a", "missing"), ("c", "unexpected")}


def test_digest_ignores_order_but_not_copies(spark):
    rows = spark.range(100).select(F.pmod("id", F.lit(7)).alias("v"))
    a = set_digest(rows, ["v"]).head()[0]
    assert a == set_digest(rows.orderBy(F.rand()), ["v"]).head()[0]
    assert a != set_digest(rows.distinct(), ["v"]).head()[0]
    empty = rows.limit(0)
    assert set_digest(empty, ["v"]).head()[0] == hashlib.sha256(b"").hexdigest() and digest_nodes(empty, ["v"], 4).count() == 0
    # A change shows below one prefix, and nodes without common prefixes add up.
    many = spark.range(500).select(F.col("id").cast("string").alias("v"))
    other = many.withColumn("v", F.when(F.col("v") == "77", "x").otherwise(F.col("v")))
    nodes = lambda df, n: {(r["prefix"], r["digest"]) for r in digest_nodes(df, ["v"], n).collect()}
    for digits in (12, 8, 4):
        assert len(nodes(many, digits) ^ nodes(other, digits)) <= 3
    low, high = many.where("cast(v as int) < 250"), many.where("cast(v as int) >= 250")
    assert nodes(low, 12) | nodes(high, 12) == nodes(many, 12)


def test_text_functions(spark):
    names = spark.createDataFrame([("IMG_10.jpg",), ("img_9.jpg",), ("img_009b.jpg",)], "n string")
    assert [r["n"] for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["img_9.jpg", "img_009b.jpg", "IMG_10.jpg"]
    long = spark.createDataFrame([("IMG_12345678901234567890123.jpg",), ("IMG_5.jpg",), ("IMG_0006.jpg",), ("IMG_99999999999999999999.jpg",)], "n string")
    assert [r["n"] for r in long.orderBy(text.natural_key(F.col("n"))).collect()] == ["IMG_5.jpg", "IMG_0006.jpg", "IMG_99999999999999999999.jpg", "IMG_12345678901234567890123.jpg"]
    people = spark.createDataFrame([("1", "José"), ("2", "robin"), ("3", "ROBIN "), ("4", "Bea")], "id string, display_name string")
    assert [r["id"] for r in facets.search_people(people, "JOSE").collect()] == ["1"]
    assert facets.search_people(people, " ").count() == 4
    listed = facets.featured_first(people, ["robin", "jose"], order=["id"], fold=True)
    assert [r["id"] for r in listed.collect()] == ["3", "1", "4"]
    full = spark.createDataFrame([("ＡＢ  c",), ("x" * 121,), ("  ",)], "n string").select(text.first_name(F.col("n")).alias("n"))
    assert [r["n"] for r in full.collect()] == ["AB", None, None]


def test_numbered_batches_lie_in_few_files(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.range(0, 20_003).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("a\nü")).alias("text"))
    batches.write_batches(rows.repartition(7), path, "id", 2)
    index = batches.batch_index(spark, path)
    assert (index.count(), index.agg(F.sum("rows")).head()[0], index.agg(F.max("batch_no")).head()[0]) == (10_002, 20_003, 10_002)
    assert len(list((tmp_path / "out" / "data").glob("*.lines"))) <= 8
    # What a lost attempt leaves behind is never read.
    (tmp_path / "out" / "data" / "lost.lines").write_text("{}\n")
    back = batches.read_batches(spark, path).select("batch_no", "line_no", F.from_json("value", "id long, text string").alias("r"))
    assert back.where(F.expr("batch_no <> r.id div 2 + 1 OR line_no <> r.id % 2 + 1")).isEmpty()
    assert back.select("r.*").exceptAll(rows).isEmpty() and back.count() == 20_003
    some = batches.read_batches(spark, path, first=5_000, last=5_001)
    assert sorted(json.loads(r["value"])["id"] for r in some.collect()) == [9_998, 9_999, 10_000, 10_001]
    assert batches.read_batches(spark, path, first=20_000).isEmpty()
    with pytest.raises(Exception, match="holds batches already"):
        batches.write_batches(rows, path, "id", 2)
    one = index.where("batch_no = 77").head()
    damaged = tmp_path / "out" / (one["file"] + ".lines")
    text = bytearray(damaged.read_bytes())
    text[one["start"]] ^= 1
    damaged.write_bytes(bytes(text))
    with pytest.raises(Exception, match="batch 77 of"):
        batches.read_batches(spark, path, first=77, last=77).collect()


def test_batches_refuse_what_is_not_whole(spark, tmp_path):
    spark.dataSource.register(batches.NumberedBatches)
    save = lambda df, name: df.write.format("numbered_batches").mode("append").save(f"{tmp_path}/{name}")
    lines = spark.range(0, 40, 1, 4).select(F.col("id").alias("batch_no"), F.lit("x").alias("value"))
    with pytest.raises(Exception, match="written by two tasks"):
        save(lines.withColumn("batch_no", F.col("batch_no") % 10), "twice")
    with pytest.raises(Exception, match="in the order of their batches"):
        save(lines.withColumn("batch_no", -F.col("batch_no")), "back")
    with pytest.raises(Exception, match="needs a batch number"):
        batches.write_batches(spark.createDataFrame([(None, 1)], "i long, x int"), f"{tmp_path}/null", "i")
    for name in ("twice", "back", "null"):
        with pytest.raises(Exception, match=batches.LISTING):
            batches.read_batches(spark, f"{tmp_path}/{name}").collect()
    batches.write_batches(spark.createDataFrame([], "i long, x int"), f"{tmp_path}/none", "i")
    assert batches.read_batches(spark, f"{tmp_path}/none").isEmpty() and batches.batch_index(spark, f"{tmp_path}/none").isEmpty()


def test_a_changed_setting_changes_every_signature(spark):
    given = dict(album_id="a", prefix="g", image_format="webp", thumb_size=640, thumb_quality=74, display_size=2048, display_quality=82)
    base = ingest.derivative_settings(**given)
    prints = {ingest.profile_fingerprint(base)}
    for name, value in (("thumb_quality", 75), ("display_size", 1024), ("image_format", "avif"), ("encoder", {"sharp": "1"}), ("prefix", "h")):
        prints.add(ingest.profile_fingerprint(ingest.derivative_settings(**{**given, name: value})))
    assert len(prints) == 6 and base["encoder"] == {"sharp": "not-loaded", "libvips": "not-loaded"}
    files_ = spark.createDataFrame([("e\u0301.jpg", 3, 5), ("\u00e9.jpg", 3, 5), ("b.jpg", 3, 5)], "relative_path string, bytes long, mtime_ms long")
    one, two, three = (r["signature"] for r in ingest.sign_inventory(files_, base).collect())
    parts = ["\u00e9.jpg", "3", "5", ingest.profile_fingerprint(base)]
    assert one == two == hashlib.sha256("\0".join(parts).encode()).hexdigest() and three != one


def test_run_documents_are_checked_before_use(spark, tmp_path):
    whole = {"schema_version": 1, "album": {"id": "a", "slug": "s"}, "import_run": {"id": "r.1", "complete_source_set": False}}
    broken = [
        ("schema_version", {**whole, "schema_version": 2}), ("album_id", {**whole, "album": {"id": "a/b", "slug": "s"}}),
        ("album_slug", {**whole, "album": {"id": "a"}}), ("run_id", {**whole, "import_run": {"complete_source_set": True}}),
        ("complete_source_set", {**whole, "import_run": {"id": "r.1"}}),
    ]
    write(tmp_path / "whole.json", json.dumps(whole))
    read = lambda name: jsonlines.read_run_document(spark, str(tmp_path / name), schemas.RUN_DOCUMENT)
    albums, runs = publish.open_run_document(read("whole.json"))
    assert (albums.head()["id"], runs.head()["id"]) == ("a", "r.1")
    for rule, document in broken:
        write(tmp_path / f"{rule}.json", json.dumps(document))
        assert [r["rule"] for r in checks.run_document_violations(read(f"{rule}.json")).collect()] == [rule]
        with pytest.raises(RuleViolation):
            publish.open_run_document(read(f"{rule}.json"))
