"""Sources and sinks: data written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from .. import schemas
from ..functions import hashing
from ..operators.numbering import dense_index
from ..session import scratch_path
from ..sources import batches, files, jsonlines, snapshots
from ..streaming.fold import fold_stream
from .registry import query


@query("s1_file_inventory", "SELECT 'txt' AS extension, (sum(octet_length(encode(text)))+count(*))::BIGINT AS bytes FROM documents")
def _(r):
    path = scratch_path(r.spark, "documents")
    r.table("documents").select("text").write.text(path)
    found = files.inventory(r.spark, path, ["txt"])
    return found.groupBy(F.element_at(F.split("file_name", r"\."), -1).alias("extension")).agg(F.sum("bytes").alias("bytes"))


@query("s2_content_fingerprint", "SELECT (sum(octet_length(encode(text)))+count(*))::BIGINT AS bytes, true AS hashes_agree FROM documents")
def _(r):
    """Files hashed where they are read, checked against a second listing."""
    path = scratch_path(r.spark, "documents")
    r.table("documents").select("text").write.text(path)
    prints = files.fingerprints(r.spark, path, ["txt"])
    listed = files.inventory(r.spark, path, ["txt"]).select("path", F.col("bytes").alias("listed"))
    good = (F.col("bytes") == F.col("listed")) & F.col("sha256").rlike("^[0-9a-f]{64}$")
    return prints.join(listed, "path", "full_outer").agg(
        F.sum("bytes").alias("bytes"), F.every(F.coalesce(good, F.lit(False))).alias("hashes_agree")
    )


@query("s2_file_hashes", "SELECT doc_id//100 AS part, sha256(string_agg(coalesce(text,''), chr(10) ORDER BY doc_id)||chr(10)) AS sha256 FROM documents GROUP BY 1")
def _(r):
    """A file for every hundred documents, in their order; the twin joins the same bytes."""
    path = scratch_path(r.spark, "documents")
    docs = r.table("documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lined = docs.repartition("part").sortWithinPartitions("part", "doc_id")
    lined.select("part", "text").write.partitionBy("part").text(path)
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
    return files.fingerprints(r.spark, path, ["txt"]).select(part.alias("part"), "sha256")


@query("s2_text_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(r):
    return r.table("documents").select("doc_id", hashing.sha256_hex(F.col("text")).alias("sha256"))


DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


@query("s3_strict_lines", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def _(r):
    path = scratch_path(r.spark, "lines")
    r.table("documents").select("doc_id", "lang", "text").write.json(path)
    return jsonlines.read_strict(r.spark, path, DOC).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("s4_tolerant_lines", """SELECT count_if(event_type<>'error') AS good_rows, sum(CASE WHEN event_type<>'error' THEN json_extract(props,'$.k')::BIGINT END)::BIGINT AS sum_k,
  count_if(event_type='error') AS dropped_lines FROM events""")
def _(r):
    """Lines of error events are torn."""
    path = scratch_path(r.spark, "state")
    torn = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    r.table("events").select(torn.alias("value")).write.text(path)
    good, dropped = jsonlines.read_tolerant(r.spark, path, T.StructType([T.StructField("k", T.LongType())]))
    return good.agg(F.count(F.lit(1)).alias("good_rows"), F.sum("k").alias("sum_k")).crossJoin(F.broadcast(dropped))


@query("s5_run_document", "SELECT o_orderpriority AS album_id, count(*) AS photo_count, 'run-'||o_orderpriority AS run_id FROM orders GROUP BY 1")
def _(r):
    path = scratch_path(r.spark, "albums")
    docs = r.pictures.groupBy("album_id").agg(F.count(F.lit(1)).alias("photo_count")).select(
        F.col("album_id").alias("part"),
        F.struct(F.col("album_id").alias("id"), "photo_count").alias("album"),
        F.struct(F.concat(F.lit("run-"), "album_id").alias("id"), "album_id").alias("import_run"),
    )
    docs.write.partitionBy("part").json(path)
    read = jsonlines.read_run_document(r.spark, path, schemas.RUN_DOCUMENT)
    return read.select(F.col("album.id").alias("album_id"), F.col("album.photo_count").alias("photo_count"), F.col("import_run.id").alias("run_id"))


@query("s7_position_ordered_lines", "SELECT id, album_id, album_position FROM pictures", ("pictures",))
def _(r):
    path = scratch_path(r.spark, "manifest")
    snapshots.write_lines(r.pictures.select("id", "album_id", "album_position"), path, ["album_position", "id"])
    schema = T.StructType([schemas.PICTURES[c] for c in ("id", "album_id", "album_position")])
    return jsonlines.read_strict(r.spark, path, schema)


@query("s8_snapshot_publish", "SELECT id, album_id, published FROM pictures", ("pictures",))
def _(r):
    """A second version replaces the first; readers see the last one only."""
    root = scratch_path(r.spark, "catalog")
    rows = r.pictures.select("id", "album_id", "published")
    snapshots.publish(rows.withColumn("published", F.lit(False)), root)
    snapshots.publish(rows, root, partition_by=["album_id"], sort_within=["id"])
    return snapshots.read_current(r.spark, root).select("id", "album_id", "published")


@query("s9_numbered_batches", """SELECT batch_no, count(*) AS rows, min(i) AS first_position, max(i) AS last_position FROM (
  SELECT i, i//250+1 AS batch_no FROM (SELECT row_number() OVER (ORDER BY album_position, id)-1 AS i FROM pictures)) GROUP BY 1""", ("pictures",))
def _(r):
    path = scratch_path(r.spark, "batches")
    numbered = dense_index(r.pictures.select("id", "album_position"), [F.col("album_position"), F.col("id")], "i")
    batches.write_batches(numbered.select("id", "i"), path, "i", 250)
    at = F.get_json_object("value", "$.i").cast("bigint")
    return batches.read_batches(r.spark, path).groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("rows"), F.min(at).alias("first_position"), F.max(at).alias("last_position")
    )


EXPORTED = """SELECT pe.id, pe.slug, s.photo_count, 320 AS avatar_width FROM people pe
  JOIN (SELECT person_id, count(DISTINCT photo_id) AS photo_count FROM faces WHERE status='labeled' GROUP BY 1) s ON s.person_id=pe.id
  WHERE EXISTS (SELECT 1 FROM faces f JOIN clusters c ON c.id=f.cluster_id WHERE f.person_id=pe.id AND f.status='labeled' AND c.status='labeled' AND c.person_id=f.person_id)"""


@query("s10_export_sink", EXPORTED, ("people", "faces", "clusters"))
def _(r):
    from ..operators.workspace import associations
    from ..plans.export import exported_people, review_summary
    from .roles import PREFIX

    path = scratch_path(r.spark, "export")
    people = exported_people(r.people, r.faces, r.clusters, prefix=PREFIX, side=320)
    snapshots.write_export(people, associations(r.faces, r.pictures), review_summary(r.faces, r.clusters), path)
    back = r.spark.read.schema("id string, slug string, photo_count long, avatar_width int").json(f"{path}/people")
    return back


@query("st1_stream_fold", "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type='purchase' GROUP BY 1")
def _(r):
    """The log arrives as files; the fold must equal the batch last-wins."""
    log, table, state = (scratch_path(r.spark, x) for x in ("log", "table", "stream"))
    rows = r.table("events").select("user_id", "event_id", F.col("event_type").alias("type"))
    # Two arrivals, later events first: order must come from the sequence.
    half = rows.agg(F.expr("percentile_approx(event_id, 0.5)")).head()[0]
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("type", T.StringType())])
    for part in (rows.where(F.col("event_id") > half), rows.where(F.col("event_id") <= half)):
        part.write.mode("append").json(log)
        fold_stream(r.spark, log, schema, table, state, key=["user_id"], sequence="event_id", kind="purchase").awaitTermination()
    return snapshots.read_current(r.spark, table).select("user_id", "event_id")
