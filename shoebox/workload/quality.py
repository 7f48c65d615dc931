"""Rule sets over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workspace as reads
from ..operators.rules import compare_fields, rule_counts
from ..plans import checks, export, ingest
from .registry import query, tree_sql
from .roles import ALBUM, PREFIX, with_roles


@query("d1_catalog_rules", """SELECT rule, count(*) AS violations FROM (
  SELECT 'source_bytes' AS rule FROM orders WHERE o_totalprice<150000 UNION ALL
  SELECT 'dominant_color' FROM orders WHERE o_orderstatus='O' UNION ALL
  SELECT 'captured_at_source' FROM orders WHERE o_orderstatus='P' UNION ALL
  SELECT 'thumb_key_unique' FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*)>1) UNION ALL
  SELECT 'photo_album' FROM orders WHERE o_orderpriority='5-LOW' UNION ALL
  SELECT 'photo_run' FROM orders WHERE o_orderkey%4=3 UNION ALL
  SELECT 'run_album' FROM (SELECT 1 FROM orders WHERE o_orderkey%3=1 LIMIT 1) UNION ALL
  SELECT 'status' FROM (SELECT 1 FROM orders WHERE o_orderkey%3=2 LIMIT 1) UNION ALL
  SELECT 'failed_count' FROM (SELECT 1 FROM orders WHERE o_orderkey%3=0 LIMIT 1)) GROUP BY 1""")
def _(r):
    """Some pictures name a run that is not there, and each run has a fault of its own."""
    o = r.table("orders")
    pictures = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("album_id"),
        F.col("o_orderkey").cast("string").alias("source_fingerprint"),
        F.when(F.col("o_orderstatus") == "P", "guess").otherwise("exif").alias("captured_at_source"),
        F.lit("image").alias("media_type"), F.col("o_custkey").cast("int").alias("album_position"),
        (F.col("o_totalprice") - 150000).cast("bigint").alias("price"), "o_totalprice",
        F.when(F.col("o_orderstatus") == "O", "#12345").otherwise("#123abc").alias("dominant_color"),
        F.lit("data:image/webp;base64,AA").alias("blur_data_url"),
        F.concat(F.lit("run_"), F.col("o_orderkey") % 4).alias("imported_run_id"),
        F.concat(F.lit("t"), "o_custkey").alias("thumb_key"), F.concat(F.lit("d"), "o_orderkey").alias("display_key"),
        *[F.lit(1).alias(c) for c in ("source_width", "source_height", "thumb_width", "thumb_height", "thumb_bytes", "width", "height", "display_bytes")],
    ).withColumn("source_bytes", F.when(F.col("o_totalprice") < 150000, -1).otherwise(1))
    albums = o.where(F.col("o_orderpriority") != "5-LOW").groupBy(F.col("o_orderpriority").alias("id")).agg(
        F.count(F.lit(1)).alias("photo_count"), F.min("o_orderdate").alias("captured_at_min"), F.max("o_orderdate").alias("captured_at_max")
    ).select("*", F.lower("id").alias("slug"), F.lit("captured_at_asc").alias("default_sort"))
    n = F.col("n")
    runs = o.groupBy((F.col("o_orderkey") % 3).alias("n")).agg(F.count(F.lit(1)).alias("discovered_count")).select(
        F.concat(F.lit("run_"), n).alias("id"), F.when(n == 1, "5-LOW").otherwise("1-URGENT").alias("album_id"),
        F.when(n == 2, "paused").otherwise("completed").alias("status"), "discovered_count",
        F.col("discovered_count").alias("imported_count"), F.lit(0).alias("skipped_count"), (n - 1).alias("failed_count"),
    )
    return rule_counts(checks.catalog_violations(pictures, albums, runs))


@query("d3_workspace_rules", """SELECT rule, count(*) AS violations FROM (
  SELECT 'embedding_dim' AS rule FROM faces WHERE quality='manual_only' UNION ALL
  SELECT 'photo_ordinal_unique' FROM (SELECT photo_id, ordinal FROM faces GROUP BY 1,2 HAVING count(*)>1) UNION ALL
  SELECT 'face_person' FROM faces f WHERE person_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM people p WHERE p.id=f.person_id AND p.album_id<>'5-LOW')) GROUP BY 1""", ("faces", "people"))
def _(r):
    """Small faces claim a dimension without a vector; one album's people are gone."""
    faces = r.faces.withColumn("embedding", F.when(F.col("quality") == "clusterable", F.array(F.lit(1.0)))).withColumn("embedding_dim", F.lit(1))
    people = r.people.where(F.col("album_id") != "5-LOW")
    return rule_counts(checks.workspace_violations(faces, r.clusters, people, r.exceptions))


@query("d4_manifest_rules", f"""SELECT rule, count(*) AS violations FROM (SELECT 'count' AS rule UNION ALL SELECT 'album' FROM pictures WHERE album_id<>'{ALBUM}' UNION ALL
  SELECT 'duplicate_position' FROM (SELECT album_position FROM pictures GROUP BY 1 HAVING count(*)>1)) GROUP BY 1""", ("pictures",))
def _(r):
    return rule_counts(checks.manifest_violations(r.pictures, album_id=ALBUM, expected_count=-1))


@query("d4_run_documents", """SELECT rule, count(*) AS violations FROM (SELECT 'schema_version' AS rule FROM customer WHERE c_custkey%5=0 UNION ALL
  SELECT 'album_id' FROM customer WHERE c_nationkey=3 UNION ALL SELECT 'run_id' FROM customer WHERE c_custkey%7=0 UNION ALL
  SELECT 'album_slug' FROM customer WHERE c_mktsegment='BUILDING' UNION ALL SELECT 'complete_source_set' FROM customer WHERE c_acctbal<0) GROUP BY 1""")
def _(r):
    """One run document per customer, some of them broken."""
    c, key = F.col, F.col("c_custkey").cast("string")
    documents = r.table("customer").select(
        F.when(c("c_custkey") % 5 == 0, 2).otherwise(1).alias("schema_version"),
        F.struct(
            F.when(c("c_nationkey") == 3, F.lit("a/b")).otherwise("album").alias("id"),
            F.when(c("c_mktsegment") == "BUILDING", "").otherwise("s").alias("slug"),
        ).alias("album"),
        F.struct(
            F.concat(F.when(c("c_custkey") % 7 == 0, "-run").otherwise("run."), key).alias("id"),
            F.when(c("c_acctbal") >= 0, True).alias("complete_source_set"),
        ).alias("import_run"),
    )
    return rule_counts(checks.run_document_violations(documents))


@query("d5_scan_manifest_rules", """SELECT rule, count(*) AS violations FROM (SELECT 'dense_positions' AS rule UNION ALL
  SELECT 'source_size' FROM orders WHERE o_orderstatus='O' UNION ALL SELECT 'display_present' FROM orders WHERE o_orderstatus='P') GROUP BY 1""")
def _(r):
    """Sources of open orders changed size; displays of pending ones are missing."""
    k = r.keyed_pictures
    manifest = k.select(
        F.concat(F.lit("p_"), F.substring("source_fingerprint", 1, 32)).alias("id"), "source_fingerprint", "album_position",
        F.concat("o_orderkey", F.lit(".jpg")).alias("original_filename"), F.col("thumb_bytes").alias("source_bytes"), "display_key", "display_bytes",
    )
    sources = k.select(
        F.concat("o_orderkey", F.lit(".jpg")).alias("file_name"),
        F.when(F.col("o_orderstatus") == "O", F.col("thumb_bytes") + 1).otherwise(F.col("thumb_bytes")).alias("bytes"),
    )
    displays = k.where(F.col("o_orderstatus") != "P").select(F.col("display_key").alias("object_key"), F.col("display_bytes").alias("bytes"))
    return rule_counts(checks.scan_manifest_violations(manifest, sources, displays))


@query("d6_digest_check", """SELECT count_if(source<>'src1') AS verified, sum(CASE WHEN source<>'src1' THEN octet_length(encode(text)) END)::BIGINT AS bytes,
  count_if(source='src1') AS changed FROM documents""")
def _(r):
    """The manifest recorded other hashes for one source."""
    from ..functions.hashing import sha256_hex

    docs = r.table("documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    files = docs.select(path.alias("path"), sha256_hex(F.col("text")).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))
    manifest = docs.select(
        path.alias("path"), F.when(F.col("source") == "src1", sha256_hex(F.col("lang"))).otherwise(sha256_hex(F.col("text"))).alias("expected")
    )
    bad, good = checks.digest_check(manifest, files, "path", "expected")
    return good.crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("changed"))))


@query("d7_upload_rules", """SELECT rule, count(*) AS violations FROM (
  SELECT 'cache_control' AS rule FROM orders, (VALUES (1),(2)) x WHERE o_orderstatus='O' UNION ALL
  SELECT 'content_type_matches' FROM orders, (VALUES (1),(2)) x WHERE o_orderstatus='P' AND o_orderkey%3<>0 UNION ALL
  SELECT 'bytes' FROM orders WHERE o_custkey=0) GROUP BY 1""")
def _(r):
    k = r.keyed_pictures.withColumn("id", F.concat(F.lit("p_"), F.substring("source_fingerprint", 1, 32))).withColumn(
        "thumb_bytes", F.col("thumb_bytes") - 1
    )
    status = k.select(F.col("id").alias("photo_id"), "o_orderstatus")
    plan = ingest.upload_plan(k, "/objects").join(status, "photo_id")
    plan = plan.withColumn(
        "cache_control", F.when(F.col("o_orderstatus") == "O", "no-store").otherwise(F.col("cache_control"))
    ).withColumn("content_type", F.when(F.col("o_orderstatus") == "P", "image/webp").otherwise(F.col("content_type")))
    return rule_counts(checks.upload_violations(plan, prefix=PREFIX, private_root="/private"))


@query("d8_consistency_rules", """SELECT rule, count(*) AS violations FROM (
  SELECT 'face_count' AS rule FROM review_pictures WHERE scan_status='complete' AND o_orderkey%9=0 UNION ALL
  SELECT 'representative' FROM clusters UNION ALL
  SELECT 'one_face_per_photo' FROM (SELECT cluster_id, photo_id FROM faces GROUP BY 1,2 HAVING count(*)>1) UNION ALL
  SELECT 'suggestion_blocked' FROM suggestions s WHERE (cluster_id_a, cluster_id_b) IN (SELECT (least(a.cluster_id,b.cluster_id), greatest(a.cluster_id,b.cluster_id)) FROM cannot_links l
    JOIN faces a ON a.id=l.face_id_a JOIN faces b ON b.id=l.face_id_b) UNION ALL
  SELECT 'labeled_identity' FROM faces f JOIN clusters c ON c.id=f.cluster_id WHERE c.status='labeled' AND f.status NOT IN ('ignored','unknown') AND (f.status<>'labeled' OR f.person_id IS DISTINCT FROM c.person_id) UNION ALL
  SELECT 'embedding_length' FROM faces WHERE status='unknown' UNION ALL
  SELECT 'links_complete' WHERE (SELECT sum(face_count::BIGINT*(face_count-1)//2) FROM review_pictures)<>(SELECT count(*) FROM cannot_links)) GROUP BY 1""",
  ("review_pictures", "clusters", "faces", "suggestions", "cannot_links"))
def _(r):
    """Unknown faces state one dimension more than their vectors have."""
    vector = F.when(F.col("status") != "ignored", F.array(F.lit(0.6), F.lit(0.8)))
    faces = r.stored_faces.withColumns({
        "embedding": vector, "embedding_dim": F.size(vector) + F.when(F.col("status") == "unknown", 1).otherwise(0)
    })
    return rule_counts(checks.consistency_violations(r.review_pictures, faces, r.clusters, r.exceptions, r.suggestions))


@query("j9_orphans_and_empty", """SELECT 'orphan_face' AS kind, count(*) AS n FROM faces f WHERE NOT EXISTS (SELECT 1 FROM clusters c WHERE c.id=f.cluster_id AND c.status='unreviewed') AND f.status='unreviewed'
  UNION ALL SELECT 'empty_cluster', count(*) FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM faces f WHERE f.cluster_id=c.id AND f.status='labeled')""", ("faces", "clusters"))
def _(r):
    outside = checks.outside_targets(r.faces, r.clusters).agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan_face").alias("kind"), "n")
    labeled = r.faces.where(F.col("status") == "labeled").select(F.col("cluster_id").alias("id"))
    empty = r.clusters.join(labeled, "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("empty_cluster").alias("kind"), "n")
    return outside.unionByName(empty)


@query("j15_positional_compare", """SELECT coalesce(a.o_orderkey,b.o_orderkey) AS position, u.field FROM (SELECT * FROM orders WHERE o_orderstatus<>'O') a FULL JOIN (SELECT * FROM orders WHERE o_orderstatus<>'P') b USING (o_orderkey),
  (VALUES ('missing'),('price')) u(field) WHERE (u.field='missing' AND (a.o_custkey IS NULL OR b.o_custkey IS NULL)) OR (u.field='price' AND a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL AND a.o_totalprice<200000)""")
def _(r):
    """One side lacks open orders, the other pending ones; low prices differ."""
    o = r.table("orders").select(F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("price"), "o_custkey", "o_orderstatus")
    left = o.where(F.col("o_orderstatus") != "O").drop("o_orderstatus")
    right = o.where(F.col("o_orderstatus") != "P").withColumn(
        "price", F.when(F.col("price") < 200000, F.lit(None)).otherwise(F.col("price"))
    ).drop("o_orderstatus")
    return compare_fields(left, right, ["position"], ["price", "o_custkey"])


@query("d9_export_rules", """SELECT 'mixed_cluster' AS rule, count(*) AS violations FROM (SELECT cluster_id FROM faces WHERE status='labeled' GROUP BY 1 HAVING count(DISTINCT person_id)<>1)
  UNION ALL SELECT 'link_person', count(*) FROM (SELECT DISTINCT photo_id, person_id FROM faces WHERE status='labeled') l WHERE NOT EXISTS (SELECT 1 FROM faces f JOIN clusters c
  ON c.id=f.cluster_id WHERE f.status='labeled' AND c.status='labeled' AND c.person_id=f.person_id AND f.person_id=l.person_id)""", ("faces", "clusters"))
def _(r):
    people = export.exported_people(r.people, r.faces, r.clusters, prefix=PREFIX, side=320)
    crops = r.faces.select(F.col("crop_relpath").alias("relative_path"), F.lit(100).cast("bigint").alias("bytes"))
    uploads = export.avatar_uploads(people, crops, "/private")
    return rule_counts(export.export_rules(people, reads.associations(r.faces, r.pictures), uploads, r.faces, PREFIX))


@query("d10_bulk_ignore_preflight", """SELECT rule, count(*) AS violations FROM (SELECT 'mixed_statuses' AS rule UNION ALL SELECT 'counts_agree' UNION ALL
  SELECT 'unreviewed_outside' FROM faces f WHERE f.status='unreviewed' AND NOT EXISTS (SELECT 1 FROM clusters c WHERE c.id=f.cluster_id AND c.status='unreviewed')) GROUP BY 1""", ("faces", "clusters"))
def _(r):
    return rule_counts(checks.bulk_ignore_preflight(r.clusters, r.faces).where(F.col("rule") != "empty_clusters"))


def _protected_sql():
    text = lambda **f: "sha256(json_object(" + ",".join(f"'{k}',{v}" for k, v in sorted(f.items())) + ")::VARCHAR) AS h"
    people = text(id="id", display_name="display_name", name_key="name_key", created_at="'t0'", updated_at="'t0'")
    clusters = text(id="id", status="status", person_id="person_id", revision="'0'", reviewed_at="NULL", updated_at="'t0'")
    faces = text(id="id", cluster_id="cluster_id", person_id="person_id", status="status", revision="'0'", updated_at="'t0'")
    kept = "WHERE status IN ('labeled','unknown')"
    parts = [f"SELECT {people} FROM people", f"SELECT {clusters} FROM clusters {kept}", f"SELECT {faces} FROM faces {kept}"]
    p, c, f = (f"({tree_sql(x)})" for x in parts)
    return f"WITH d AS (SELECT sha256({p}||chr(10)||{c}||chr(10)||{f}) AS x) SELECT x AS protected_digest, x AS after FROM d"


@query("a17_protected_digest", with_roles(_protected_sql(), ("people", "clusters", "faces")).replace("\nWITH d AS", ",\nd AS"))
def _(r):
    """Ignoring what is unreviewed leaves the digest of all protected rows alone."""
    from ..plans.review import ignore_unreviewed
    from .roles import NOW

    ws = r.workspace
    after = ignore_unreviewed(ws, mutation_id="ignore-all-1", now=F.lit(NOW), check=False)[0]
    # A target that keeps an unknown face becomes unknown; it was not protected before.
    targets = ws.clusters.where(F.col("status") == "unreviewed").select("id")
    clusters = after.clusters.join(targets, "id", "left_anti")
    before_digest = checks.protected_digest(ws.people, ws.clusters, ws.faces)
    after_digest = checks.protected_digest(after.people, clusters, after.faces).withColumnRenamed("protected_digest", "after")
    return before_digest.crossJoin(F.broadcast(after_digest))


@query("d11_changed_settings", """SELECT field, count(*) AS differences FROM (SELECT 'id' AS field FROM pictures WHERE o_orderstatus='O' UNION ALL SELECT 'scan_key' FROM pictures WHERE o_orderstatus='P') GROUP BY 1""", ("pictures",))
def _(r):
    """Stored against expected inputs, position by position."""
    base = r.pictures.select(
        F.col("o_orderkey").alias("album_position"), "id", "source_fingerprint", "display_sha256", F.lit("k1").alias("scan_key"), "o_orderstatus"
    )
    stored = base.withColumn("id", F.when(F.col("o_orderstatus") == "O", "other").otherwise(F.col("id"))).withColumn(
        "scan_key", F.when(F.col("o_orderstatus") == "P", "k0").otherwise(F.col("scan_key"))
    )
    return checks.changed_pictures(base, stored).groupBy("field").agg(F.count(F.lit(1)).alias("differences"))


@query("d12_avatar_sources", """SELECT rule, count(*) AS violations FROM (SELECT 'sha256' AS rule FROM people WHERE album_id='2-HIGH' UNION ALL SELECT 'square_side' FROM people WHERE album_id='3-MEDIUM' UNION ALL
  SELECT 'path' FROM people WHERE album_id='5-LOW') GROUP BY 1""", ("people",))
def _(r):
    """Per album: changed bytes, a wrong side, a path out of the crop folder."""
    folder = F.when(F.col("album_id") == "5-LOW", "crops/../").otherwise("crops/")
    rel = F.concat(folder, "slug", F.lit(".webp"))
    avatars = r.people.select(F.col("id").alias("person_id"), rel.alias("crop_relpath"), F.sha2(F.col("slug").cast("binary"), 256).alias("crop_sha256"))
    crops = r.people.select(
        rel.alias("relative_path"), F.lit(10).alias("bytes"),
        F.when(F.col("album_id") == "2-HIGH", "0").otherwise(F.sha2(F.col("slug").cast("binary"), 256)).alias("sha256"),
    )
    dims = r.people.select(rel.alias("relative_path"), F.lit(320).alias("width"), F.when(F.col("album_id") == "3-MEDIUM", 300).otherwise(320).alias("height"))
    return rule_counts(checks.avatar_source_violations(avatars, crops, dims, root="/private", side=320))


@query("j13_parameters", f"SELECT id, '{ALBUM}' AS album_id, 'run_9' AS run_id FROM pictures", ("pictures",))
def _(r):
    return r.pictures.select("id", F.lit(ALBUM).alias("album_id"), F.lit("run_9").alias("run_id"))
