"""Review workspace: reads, decisions and the export."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.packing import packed, unpacked
from ..operators import workspace as reads
from ..operators.numbering import dense_index, index_in_group
from ..operators.tables import set_differences
from ..plans import backup, export, review
from ..session import scratch_path
from .registry import query
from .roles import NOW, PREFIX, cluster_id, person_id

FCP = ("faces", "clusters", "pictures", "people")
def _now():
    return F.lit(NOW)
RANK = "CASE status WHEN 'unreviewed' THEN 0 WHEN 'labeled' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END"
SUMMARY = """SELECT c.id, c.status, c.person_id, pe.display_name, max(f.detection_score) AS confidence, count(f.id) AS face_count,
  count(DISTINCT f.photo_id) AS photo_count, min(ph.album_position) AS first_position FROM clusters c JOIN faces f ON f.cluster_id=c.id
  JOIN pictures ph ON ph.id=f.photo_id LEFT JOIN people pe ON pe.id=c.person_id GROUP BY 1,2,3,4"""


def _summary(r):
    return reads.cluster_summary(r.clusters, r.faces, r.pictures, r.people)


@query("j3_cluster_face_photo", """SELECT f.id AS face_id, c.id AS cluster_id, c.status, ph.album_position, pe.display_name FROM clusters c JOIN faces f ON f.cluster_id=c.id
  JOIN pictures ph ON ph.id=f.photo_id LEFT JOIN people pe ON pe.id=c.person_id""", FCP)
def _(r):
    return reads.cluster_faces(r.clusters, r.faces, r.pictures, r.people).select(
        "face_id", "cluster_id", "status", "album_position", "display_name"
    )


@query("a5_cluster_summary", SUMMARY, FCP)
def _(r):
    return _summary(r).select(
        "id", "status", "person_id", "display_name", "confidence", "face_count", "photo_count", "first_position"
    )


@query("f7_cluster_filter", f"SELECT id, status FROM ({SUMMARY}) WHERE status='labeled' AND (coalesce(display_name,'') ILIKE '%r#000000005%' OR id ILIKE '%ab%')", FCP)
def _(r):
    """A search by literal name part and one by hex text within ids."""
    by_id = reads.filter_clusters(_summary(r), "labeled", " AB ")
    by_name = reads.filter_clusters(_summary(r), "labeled", "R#000000005")
    return by_id.unionByName(by_name).select("id", "status").distinct()


@query("o10_review_queue", f"""SELECT id, status, row_number() OVER (ORDER BY {RANK}, face_count DESC, first_position, id)-1 AS place FROM ({SUMMARY})""", FCP)
def _(r):
    order = [reads.state_rank(F.col("status")), F.col("face_count").desc(), F.col("first_position"), F.col("id")]
    return dense_index(_summary(r), order, "place").select("id", "status", "place")


@query("a6_scoreboard", """SELECT count(*) AS pictures, count_if(scan_status='complete') AS scanned_pictures, (SELECT count(*) FROM faces) AS total_faces,
  (SELECT count(*) FROM faces WHERE quality='clusterable') AS clusterable_faces, (SELECT count(*) FROM faces WHERE quality='manual_only') AS manual_only_faces,
  (SELECT count(*) FROM faces WHERE status='labeled') AS labeled_faces, (SELECT count(*) FROM faces WHERE status='unknown') AS unknown_faces,
  (SELECT count(*) FROM faces WHERE status='ignored') AS ignored_faces, (SELECT count(*) FROM faces WHERE status='unreviewed') AS remaining_faces,
  (SELECT count(*) FROM clusters WHERE status='unreviewed') AS unreviewed_clusters, (SELECT count(*) FROM clusters WHERE status='labeled') AS labeled_clusters,
  (SELECT count(*) FROM clusters WHERE status='unknown') AS unknown_clusters, (SELECT count(*) FROM clusters WHERE status='ignored') AS ignored_clusters
  FROM scan_pictures""", ("scan_pictures", "faces", "clusters"))
def _(r):
    return reads.scoreboard(r.scan_pictures, r.faces, r.clusters)


@query("a7_person_stats", """SELECT pe.id AS person_id, pe.display_name, count(DISTINCT f.photo_id) AS photo_count, count(f.id) AS face_count
  FROM people pe JOIN faces f ON f.person_id=pe.id AND f.status='labeled' GROUP BY 1,2""", ("people", "faces"))
def _(r):
    return reads.person_stats(r.people, r.faces)


@query("a8_distinct_pairs", "SELECT count(*) AS photo_people FROM (SELECT DISTINCT photo_id, person_id FROM faces WHERE status='labeled' AND person_id IS NOT NULL)", ("faces",))
def _(r):
    return reads.association_count(r.faces)


@query("a9_associations", """SELECT f.photo_id, f.person_id, min(ph.album_position) AS album_position FROM faces f JOIN pictures ph ON ph.id=f.photo_id
  WHERE f.status='labeled' AND f.person_id IS NOT NULL GROUP BY 1,2""", ("faces", "pictures"))
def _(r):
    return reads.associations(r.faces, r.pictures)


DOMAIN = "(VALUES ('unreviewed'),('labeled'),('unknown'),('ignored'),('gone')) d(status)"


@query("a10_status_histogram", f"SELECT d.status, count(f.id) AS n FROM {DOMAIN} LEFT JOIN faces f ON f.status=d.status GROUP BY 1", ("faces",))
def _(r):
    return reads.status_histogram(r.faces, (*reads.STATES, "gone"))


@query("a11_target_state", """SELECT count(DISTINCT c.id) AS unreviewed_clusters, count(f.id) AS target_faces, count_if(f.status='unreviewed') AS unreviewed_faces,
  count_if(f.status='labeled') AS labeled_faces, count_if(f.status='unknown') AS unknown_faces, count_if(f.status='ignored') AS ignored_faces,
  count_if(f.id IS NULL) AS empty_clusters FROM clusters c LEFT JOIN faces f ON f.cluster_id=c.id WHERE c.status='unreviewed'""", ("clusters", "faces"))
def _(r):
    return reads.target_state(r.clusters, r.faces)


@query("a12_link_completeness", """SELECT (SELECT coalesce(sum(face_count::BIGINT*(face_count-1)//2),0)::BIGINT FROM review_pictures) AS expected,
  (SELECT count(*) FROM cannot_links) AS actual""", ("review_pictures", "cannot_links"))
def _(r):
    return reads.link_completeness(r.review_pictures, r.faces)


@query("a13_mixed_clusters", "SELECT cluster_id FROM faces WHERE status='labeled' GROUP BY 1 HAVING count(DISTINCT person_id)<>1", ("faces",))
def _(r):
    return reads.mixed_clusters(r.faces)


@query("a19_links_per_person", "SELECT pe.id AS person_id, count(l.person_id) AS links FROM people pe LEFT JOIN links l ON l.person_id=pe.id GROUP BY 1", ("people", "links"))
def _(r):
    return reads.links_per_person(r.people, r.links)


@query("a20_review_progress", """SELECT count(*) AS total, count_if(status<>'unreviewed') AS reviewed,
  CAST(floor(100*count_if(status<>'unreviewed')/count(*)+0.5) AS BIGINT) AS progress FROM clusters""", ("clusters",))
def _(r):
    return reads.progress(r.clusters)


@query("f10_clusterable", "SELECT id, quality FROM faces", ("faces",))
def _(r):
    from ..functions.geometry import quality_class

    return r.faces.select("id", quality_class(F.array("quality_score"), F.col("width_px"), F.col("height_px")).alias("quality"))


@query("f11_eligible_faces", "SELECT id FROM faces WHERE status NOT IN ('ignored','unknown')", ("faces",))
def _(r):
    return r.faces.where(reads.labelable(F.col("status"))).select("id")


@query("f12_work_queue", """SELECT id, row_number() OVER (ORDER BY album_position, id)-1 AS place FROM scan_pictures
  WHERE scan_status IN ('pending','error','processing')""", ("scan_pictures",))
def _(r):
    from ..plans.scan import work_queue

    return dense_index(work_queue(r.scan_pictures), [F.col("album_position"), F.col("id")], "place").select("id", "place")


@query("f13_lookup_batch", "SELECT f.id, f.cluster_id FROM faces f WHERE f.cluster_id IN (SELECT id FROM clusters WHERE status='ignored')", ("faces", "clusters"))
def _(r):
    wanted = r.clusters.where(F.col("status") == "ignored").select(F.col("id").alias("cluster_id"))
    return r.faces.join(wanted, "cluster_id", "left_semi").select("id", "cluster_id")


@query("j4_neighbours", """SELECT cluster_id, other_id, c.status FROM (SELECT cluster_id_a AS cluster_id, cluster_id_b AS other_id FROM suggestions
  UNION ALL SELECT cluster_id_b, cluster_id_a FROM suggestions) s JOIN clusters c ON c.id=s.other_id""", ("suggestions", "clusters"))
def _(r):
    state = r.clusters.select(F.col("id").alias("other_id"), "status")
    return reads.neighbours(r.suggestions.drop("status")).join(state, "other_id").select("cluster_id", "other_id", "status")


TOP8 = """SELECT cluster_id, other_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity_max DESC, other_id) AS n FROM (
  SELECT cluster_id_a AS cluster_id, cluster_id_b AS other_id, similarity_max FROM suggestions WHERE status='pending'
  UNION ALL SELECT cluster_id_b, cluster_id_a, similarity_max FROM suggestions WHERE status='pending')) WHERE n<={n}"""


@query("o12_top_suggestions", TOP8.replace("{n}", "2"), ("suggestions",))
def _(r):
    return reads.top_suggestions(r.suggestions, 2).select("cluster_id", "other_id")


@query("g9_cluster_detail", """SELECT f.id, f.cluster_id, row_number() OVER (PARTITION BY f.cluster_id ORDER BY ph.album_position, f.ordinal, f.id)-1 AS place
  FROM faces f JOIN pictures ph ON ph.id=f.photo_id""", ("faces", "pictures"))
def _(r):
    shown = r.pictures.select(packed(F.col("id")).alias("_photo"), "album_position")
    faces = r.faces.select(packed(F.col("photo_id")).alias("_photo"), packed(F.col("cluster_id")).alias("_cluster"), packed(F.col("id")).alias("_face"), "ordinal")
    placed = faces.join(shown.hint("merge"), "_photo").select(unpacked(F.col("_face")).alias("id"), "_cluster", "album_position", "ordinal")
    order = [F.col("album_position"), F.col("ordinal"), F.col("id")]
    return index_in_group(placed, ["_cluster"], order, "place").select("id", unpacked(F.col("_cluster")).alias("cluster_id"), "place")


@query("g8_label_proposals",
  "SELECT v.cluster_id, v.person_id, t.target_id FROM (SELECT cluster_id, min(CASE WHEN status='labeled' THEN person_id END) AS person_id FROM (ARR) GROUP BY 1 "
  "HAVING min(CASE WHEN status='labeled' THEN person_id END)=max(CASE WHEN status='labeled' THEN person_id END) AND count_if(status='labeled' AND display_name IS NULL)=0) v "
  "JOIN clusters c ON c.id=v.cluster_id AND c.status IN ('unreviewed','labeled') JOIN (SELECT cluster_id, other_id AS target_id FROM (ARR) WHERE status='unreviewed') t ON t.cluster_id=v.cluster_id"
  .replace("ARR", "SELECT x.cluster_id, x.other_id, c.status, c.person_id, pe.display_name FROM (" + TOP8.replace("{n}", "8") +
           " UNION ALL SELECT id, id FROM clusters) x JOIN clusters c ON c.id=x.other_id LEFT JOIN people pe ON pe.id=c.person_id"),
  ("suggestions", "clusters", "people"))
def _(r):
    return reads.label_proposals(r.clusters, r.people, r.suggestions)


# Composed reads ----------------------------------------------------------------------

@query("o10_bootstrap", f"""SELECT id, status, row_number() OVER (ORDER BY face_count DESC, first_position, id)-1 AS place, (SELECT count(*) FROM faces) AS total_faces,
  (SELECT count(*) FROM review_pictures WHERE scan_status='complete') AS scanned_pictures, (SELECT count(*) FROM clusters WHERE status='labeled') AS labeled_clusters
  FROM ({SUMMARY}) WHERE status='labeled' AND (coalesce(display_name,'') ILIKE '%#00%' OR id ILIKE '%#00%')""", (*FCP, "review_pictures"))
def _(r):
    """The scoreboard and the labeled clusters of some names, in review order."""
    board, queue = reads.bootstrap(r.review_pictures, r.faces, r.clusters, r.people, status="labeled", query=" #00 ")
    order = [F.col("face_count").desc(), F.col("first_position"), F.col("id")]
    placed = dense_index(queue, order, "place").select("id", "status", "place")
    return placed.crossJoin(F.broadcast(board.select("total_faces", "scanned_pictures", "labeled_clusters")))


@query("p9_export_preview", """SELECT f.person_id, p.display_name, count(DISTINCT f.photo_id) AS photo_count, count(*) AS face_count,
  (SELECT count(*) FROM (SELECT DISTINCT photo_id, person_id FROM faces WHERE status='labeled' AND person_id IS NOT NULL)) AS photo_people,
  (SELECT count(*) FROM clusters WHERE status='unreviewed') AS unreviewed_clusters, (SELECT count(*) FROM faces WHERE status='ignored') AS ignored_faces
  FROM faces f JOIN people p ON p.id=f.person_id WHERE f.status='labeled' GROUP BY 1,2""", ("faces", "people", "clusters"))
def _(r):
    people, totals = export.export_preview(r.people, r.faces, r.clusters)
    return people.crossJoin(F.broadcast(totals.select("photo_people", "unreviewed_clusters", "ignored_faces")))


# Representatives and avatars ---------------------------------------------------------

@query("w1_best_avatars", """SELECT person_id, id AS face_id FROM (SELECT f.*, row_number() OVER (PARTITION BY f.person_id ORDER BY f.quality_score DESC, f.detection_score DESC,
  least(f.width_px,f.height_px) DESC, f.id) AS n FROM faces f JOIN clusters c ON c.id=f.cluster_id WHERE f.status='labeled' AND f.person_id IS NOT NULL
  AND c.status='labeled' AND c.person_id=f.person_id) WHERE n=1""", ("faces", "clusters"))
def _(r):
    return reads.best_avatars(r.faces, r.clusters).select("person_id", "face_id")


POOL = "CASE status WHEN 'ignored' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END"


def _rep(order):
    return f"SELECT cluster_id, id AS representative_face_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {order}) AS n FROM faces) WHERE n=1"


@query("w2_cluster_representative", _rep(f"{POOL}, quality_score DESC, id"), ("faces",))
def _(r):
    return reads.representatives(r.faces)


@query("w3_set_representative", _rep(f"{POOL}, quality_score DESC, detection_score DESC, id"), ("faces",))
def _(r):
    return reads.representatives(r.faces, by_detection=True)


@query("w4_initial_representative", _rep("quality_score DESC, id"), ("faces",))
def _(r):
    return reads.representatives(r.faces, by_status=False)


# Decisions -------------------------------------------------------------------------

STATE = """SELECT cluster_id AS id, CASE WHEN n_open=0 THEN CASE WHEN n_unknown>0 THEN 'unknown' ELSE 'ignored' END
  WHEN n_named=n_open AND n_people=1 THEN 'labeled' ELSE 'unreviewed' END AS status,
  CASE WHEN n_open>0 AND n_named=n_open AND n_people=1 THEN person END AS person_id FROM (SELECT cluster_id,
  count_if(status NOT IN ('ignored','unknown')) AS n_open, count_if(status='labeled' AND person_id IS NOT NULL) AS n_named, count_if(status='unknown') AS n_unknown,
  count(DISTINCT CASE WHEN status='labeled' THEN person_id END) AS n_people, min(CASE WHEN status='labeled' THEN person_id END) AS person FROM {faces} GROUP BY 1)"""


@query("m17_recompute_clusters", STATE.replace("{faces}", "faces"), ("faces",))
def _(r):
    touched = r.clusters.select(F.col("id").alias("cluster_id"))
    return review.recompute_clusters(r.clusters, r.faces, touched, _now()).select("id", "status", "person_id")


def _name_commands(r):
    """Every part's cluster is named after the first word of the part."""
    return r.table("part").select(cluster_id(F.col("p_partkey")).alias("cluster_id"), F.col("p_name").alias("name"))


CMD = "cmd AS (SELECT 'c_'||substr(sha256(p_partkey::VARCHAR),1,24) AS cluster_id, 'person_'||substr(sha256(lower(split_part(p_name,' ',1))),1,32) AS new_person FROM part)"
LABELED = """relabeled AS (SELECT f.id, f.cluster_id, f.quality_score, CASE WHEN hit THEN 'labeled' ELSE status END AS status, CASE WHEN hit THEN new_person ELSE person_id END AS person_id,
  CASE WHEN hit THEN 1 ELSE 0 END AS revision FROM (SELECT f.*, cmd.new_person, cmd.cluster_id IS NOT NULL AND f.status<>'ignored' AND (c.status='unknown' OR f.status<>'unknown') AS hit
  FROM faces f JOIN clusters c ON c.id=f.cluster_id LEFT JOIN cmd ON cmd.cluster_id=f.cluster_id) f)"""


def _ctes(sql, *extra, roles=("faces", "clusters")):
    from .roles import CTES

    parts = [f"{n} AS ({CTES[n]})" for n in roles]
    return "WITH " + ",\n".join([*parts, *extra]) + "\n" + sql


@query("m10_label_clusters_faces", _ctes("SELECT id, status, person_id, revision FROM relabeled", CMD, LABELED))
def _(r):
    out = review.label_clusters(r.workspace, _name_commands(r), mutation_id="label-all-1", now=_now(), normalize=False, check=False)
    return out.faces.select("id", "status", "person_id", "revision")


@query("m10_label_clusters_state", _ctes(STATE.replace("{faces}", "relabeled"), CMD, LABELED))
def _(r):
    out = review.label_clusters(r.workspace, _name_commands(r), mutation_id="label-all-1", now=_now(), normalize=False, check=False)
    return out.clusters.join(r.faces.select(F.col("cluster_id").alias("id")).distinct(), "id", "left_semi").select("id", "status", "person_id")


@query("m10_find_or_create_people", """SELECT DISTINCT 'person_'||substr(sha256(lower(split_part(p_name,' ',1))),1,32) AS id, lower(split_part(p_name,' ',1)) AS name_key FROM part
  UNION ALL SELECT id, name_key FROM people""", ("people",))
def _(r):
    named = review.named_commands(_name_commands(r), normalize=False)
    people, _created = review.find_or_create_people(r.workspace.people, named, _now())
    return people.select("id", "name_key")


BATCHED = """batched AS (SELECT f.id, f.cluster_id, f.quality_score, CASE WHEN hit THEN 'labeled' ELSE f.status END AS status,
  CASE WHEN hit THEN 'person_'||substr(sha256('s5'),1,32) ELSE f.person_id END AS person_id FROM (SELECT f.*, c.status='unreviewed' AND f.status NOT IN ('ignored','unknown')
  AND NOT (f.status='labeled' AND f.person_id='person_'||substr(sha256('s5'),1,32)) AS hit FROM faces f JOIN clusters c ON c.id=f.cluster_id) f)"""


@query("m11_batch_label", _ctes("SELECT id, status, person_id FROM batched", BATCHED))
def _(r):
    every = r.clusters.select(F.col("id").alias("cluster_id"), person_id(F.lit(5)).alias("person_id"))
    out = review.batch_label(r.workspace, every, mutation_id="batch-all-1", now=_now(), check=False)
    return out.faces.select("id", "status", "person_id")


@query("m12_ignore_unreviewed_report", """SELECT count(*) AS target_clusters, count_if(n_unknown=0) AS ignored_clusters, count_if(n_unknown>0) AS preserved_unknown_clusters,
  sum(n_unreviewed)::BIGINT AS ignored_faces, sum(n_unknown)::BIGINT AS preserved_unknown_faces, sum(n_ignored)::BIGINT AS preserved_ignored_faces FROM (
  SELECT c.id, count_if(f.status='unknown') AS n_unknown, count_if(f.status='unreviewed') AS n_unreviewed, count_if(f.status='ignored') AS n_ignored
  FROM clusters c LEFT JOIN faces f ON f.cluster_id=c.id WHERE c.status='unreviewed' GROUP BY 1)""", ("clusters", "faces"))
def _(r):
    return review.ignore_unreviewed(r.workspace, mutation_id="ignore-all-1", now=_now(), check=False)[1]


@query("m12_ignore_unreviewed_faces", """SELECT f.id, CASE WHEN c.status='unreviewed' AND f.status='unreviewed' THEN 'ignored' ELSE f.status END AS status
  FROM faces f JOIN clusters c ON c.id=f.cluster_id""", ("clusters", "faces"))
def _(r):
    return review.ignore_unreviewed(r.workspace, mutation_id="ignore-all-1", now=_now(), check=False)[0].faces.select("id", "status")


@query("m13_cluster_disposition", """SELECT f.id, CASE WHEN c.status<>'unknown' OR f.status='unknown' THEN 'unreviewed' ELSE f.status END AS status
  FROM faces f JOIN clusters c ON c.id=f.cluster_id""", ("clusters", "faces"))
def _(r):
    """Reopen every cluster; of unknown clusters only the unknown faces."""
    every = r.clusters.select(F.col("id").alias("cluster_id"))
    out = review.set_clusters(r.workspace, every, "unreviewed", mutation_id="reopen-all-1", now=_now())
    return out.faces.select("id", "status")


@query("m14_face_disposition", STATE.replace("{faces}", "(SELECT cluster_id, CASE WHEN quality='manual_only' THEN 'ignored' ELSE status END AS status, CASE WHEN quality='manual_only' THEN NULL ELSE person_id END AS person_id FROM faces)"), ("faces",))
def _(r):
    """Ignore all faces too small to cluster; their clusters follow."""
    small = r.faces.where(F.col("quality") == "manual_only").select(F.col("id").alias("face_id"))
    everyone = r.workspace.clusters.select(F.col("id").alias("cluster_id"))
    out = review.set_faces(r.workspace, small, "ignored", mutation_id="ignore-small-1", now=_now())
    return review.recompute_clusters(out.clusters, out.faces, everyone, _now()).select("id", "status", "person_id")


def _split(r):
    """Take the best face of every cluster out into one of its own."""
    best = reads.representatives(r.faces, by_status=False)
    return best.select("cluster_id", F.col("representative_face_id").alias("face_id"))


@query("m15_split_clusters", """SELECT id, CASE WHEN n=1 THEN 'c_manual_'||substr(sha256(id),1,32) ELSE cluster_id END AS cluster_id, CASE WHEN n=1 THEN 'unreviewed' ELSE status END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, id) AS n FROM faces)""", ("faces",))
def _(r):
    out = review.split_clusters(r.workspace, _split(r), mutation_id="split-all-1", now=_now(), check=False)
    return out.faces.select("id", "cluster_id", "status")


@query("m15_split_links", """SELECT least(a.id,b.id) AS face_id_a, greatest(a.id,b.id) AS face_id_b FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, id) AS n FROM faces) a
  JOIN faces b ON b.cluster_id=a.cluster_id AND b.id<>a.id WHERE a.n=1""", ("faces",))
def _(r):
    return review.split_links(r.faces, _split(r))


@query("u3_unselected_faces", """SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, id) AS n FROM faces) WHERE n>1""", ("faces",))
def _(r):
    return review.remaining_faces(r.faces, _split(r)).select("id")


def _merge(r):
    """Merge the clusters of all parts of one brand and type."""
    return r.table("part").select(
        cluster_id(F.col("p_partkey")).alias("cluster_id"), F.concat_ws("|", "p_brand", "p_type").alias("merge_group")
    )


MERGED = "merged AS (SELECT f.id, m.target AS cluster_id, f.status, f.person_id FROM faces f JOIN (SELECT 'c_'||substr(sha256(p_partkey::VARCHAR),1,24) AS cluster_id, min('c_'||substr(sha256(p_partkey::VARCHAR),1,24)) OVER (PARTITION BY p_brand, p_type) AS target FROM part) m ON m.cluster_id=f.cluster_id)"


@query("m16_merge_clusters", _ctes(STATE.replace("{faces}", "merged"), MERGED, roles=("faces",)))
def _(r):
    out = review.merge_clusters(r.workspace, _merge(r), mutation_id="merge-all-1", now=_now(), check=False)
    return out.clusters.select("id", "status", "person_id")


def _ignored(r):
    return review.ignore_unreviewed(r.workspace, mutation_id="ignore-all-1", now=_now(), check=False)[0]


@query("m18_action_log", """SELECT id, client_mutation_id, action_type, payload_json, max(id) OVER () AS action_high_watermark, max(id) OVER () AS replayed_action FROM (
  SELECT event_id+1 AS id, 'mutation-'||event_id AS client_mutation_id, event_type AS action_type, props AS payload_json FROM events
  UNION ALL SELECT (SELECT max(event_id)+2 FROM events), 'ignore-all-1', 'ignore_all_unreviewed_clusters', json_object('target_clusters', count(DISTINCT c.id),
  'ignored_clusters', count(DISTINCT c.id), 'preserved_unknown_clusters', 0, 'ignored_faces', count(*), 'preserved_unknown_faces', 0, 'preserved_ignored_faces', 0)::VARCHAR
  FROM faces f JOIN clusters c ON c.id=f.cluster_id WHERE c.status='unreviewed')""", ("faces", "clusters"))
def _(r):
    """One more action, with its payload, on a log taken from the events; asked again, its id comes back."""
    none = F.lit(None).cast("string")
    log = r.table("events").select(
        (F.col("event_id") + 1).alias("id"), F.concat(F.lit("mutation-"), "event_id").alias("client_mutation_id"),
        F.col("event_type").alias("action_type"), F.col("props").alias("payload_json"), none.alias("inverse_json"),
        F.col("ts").cast("string").alias("created_at"), none.alias("undone_at"),
    )
    ws = replace(r.whole_workspace, actions=log)
    out = review.ignore_unreviewed(ws, mutation_id="ignore-all-1", now=_now())[0]
    again = review.ignore_unreviewed(out, mutation_id="ignore-all-1", now=_now())[0]
    told = review.outcome(out, again, "ignore-all-1")
    shown = out.actions.select("id", "client_mutation_id", "action_type", "payload_json")
    return shown.crossJoin(F.broadcast(review.high_watermark(again))).withColumn(
        "replayed_action", F.lit(told.action_id if told.replayed else None).cast("bigint")
    )


SAME = "faces f JOIN clusters c ON c.id=f.cluster_id"


@query("m11_batch_label_checked", f"""SELECT f.id, CASE WHEN c.status='unreviewed' THEN 'labeled' ELSE c.status END AS status,
  CASE WHEN c.status='unreviewed' THEN 'person_'||substr(sha256('s5'),1,32) ELSE c.person_id END AS person_id FROM {SAME}""", ("faces", "clusters"))
def _(r):
    """Every open cluster gets one person, through all guards."""
    ws = r.whole_workspace
    todo = ws.clusters.where(F.col("status") == "unreviewed").select(F.col("id").alias("cluster_id"), person_id(F.lit(5)).alias("person_id"))
    return review.batch_label(ws, todo, mutation_id="batch-all-1", now=_now()).faces.select("id", "status", "person_id")


@query("m19_undo_checked", f"SELECT f.id, c.status, c.person_id, 0 AS revision FROM {SAME}", ("faces", "clusters"))
def _(r):
    """Reopen every cluster through the guards, then undo it from the written layers."""
    ws = r.whole_workspace
    every = ws.clusters.select(F.col("id").alias("cluster_id"))
    out = review.set_clusters(ws, every, "unreviewed", mutation_id="reopen-all-1", now=_now())
    restored, _kind = review.undo_last(out, _now())
    return restored.faces.select("id", "status", "person_id", "revision")


@query("d10_ignore_with_backup", f"""SELECT f.id, CASE WHEN c.status='unreviewed' THEN 'ignored' ELSE c.status END AS status,
  CASE WHEN c.status='unreviewed' THEN 1 ELSE 0 END AS revision FROM {SAME}""", ("faces", "clusters"))
def _(r):
    """Preconditions, a backup read back and compared, the decision and its postconditions."""
    done, _report = backup.ignore_with_backup(r.whole_workspace, scratch_path(r.spark, "backup"), mutation_id="ignore-all-1", now=_now())
    return done.faces.select("id", "status", "revision")


@query("d10_backup_fingerprint", f"""SELECT 'faces.'||c.status AS fact, count(*)::VARCHAR AS value FROM {SAME} GROUP BY 1
  UNION ALL SELECT 'clusters.'||status, count(*)::VARCHAR FROM clusters WHERE id IN (SELECT cluster_id FROM faces) GROUP BY 1
  UNION ALL SELECT * FROM (VALUES ('actions', '0'), ('action_high_watermark', '0'))""", ("faces", "clusters"))
def _(r):
    """What a verified backup says of itself; its protected digest was compared when it was written."""
    root = scratch_path(r.spark, "backup")
    backup.write_backup(r.whole_workspace, root)
    return backup.fingerprint(backup.read_backup(r.spark, root)).where(F.col("fact") != "protected")


@query("m20_before_images", """SELECT 'faces' AS table_name, f.id AS key FROM faces f JOIN clusters c ON c.id=f.cluster_id WHERE c.status='unreviewed'
  UNION ALL SELECT 'clusters', id FROM clusters WHERE status='unreviewed'""", ("faces", "clusters"))
def _(r):
    return _ignored(r).images.select("table_name", "key")


@query("m19_undo", "SELECT id, status, person_id, revision FROM faces", ("faces",))
def _(r):
    """Ignore everything unreviewed, then undo it: the faces are as before."""
    restored, _kind = review.undo_last(_ignored(r), _now(), write=False)
    return restored.faces.select("id", "status", "person_id", "revision")


@query("m19_undo_split", "SELECT id, cluster_id, status, person_id, revision FROM faces", ("faces",))
def _(r):
    """Undo a split of every cluster: faces return, links and clusters leave."""
    split = review.split_clusters(r.workspace, _split(r), mutation_id="split-all-1", now=_now(), check=False)
    restored, _kind = review.undo_last(split, _now(), write=False)
    return restored.faces.select("id", "cluster_id", "status", "person_id", "revision")


@query("u5_distinct_members", "SELECT cluster_id, photo_id FROM faces GROUP BY 1,2 HAVING count(*)>1", ("faces",))
def _(r):
    from ..operators.rules import duplicates

    parts = F.split("key", r"\|")
    return duplicates(r.faces, ["cluster_id", "photo_id"], "dup").select(parts[0].alias("cluster_id"), parts[1].alias("photo_id"))


@query("u6_selection_present", "SELECT id FROM clusters WHERE status='labeled'", ("clusters",))
def _(r):
    selected = r.faces.select(F.col("cluster_id").alias("id")).distinct().unionByName(r.clusters.select("id")).distinct()
    return selected.join(r.clusters.where(F.col("status") == "labeled"), "id", "left_semi").select("id")


@query("u1_set_differences", """SELECT coalesce(a.crop,b.crop) AS path, CASE WHEN b.crop IS NULL THEN 'missing' ELSE 'unexpected' END AS side
  FROM (SELECT DISTINCT id AS crop FROM faces WHERE status<>'ignored') a FULL JOIN (SELECT DISTINCT id AS crop FROM faces WHERE status<>'unknown') b ON a.crop=b.crop
  WHERE a.crop IS NULL OR b.crop IS NULL""", ("faces",))
def _(r):
    expected = r.faces.where(F.col("status") != "ignored").select(F.col("id").alias("path"))
    actual = r.faces.where(F.col("status") != "unknown").select(F.col("id").alias("path"))
    return set_differences(expected, actual, ["path"])


# Export ----------------------------------------------------------------------------

@query("p8_avatar_uploads", f"""SELECT person_id, '{PREFIX}/people/'||person_id||'/avatar-'||substr(sha256(id),1,20)||'.webp' AS object_key, sha256(id) AS sha256, 100::BIGINT AS bytes
  FROM (SELECT f.*, row_number() OVER (PARTITION BY f.person_id ORDER BY f.quality_score DESC, f.detection_score DESC, least(f.width_px,f.height_px) DESC, f.id) AS n
  FROM faces f JOIN clusters c ON c.id=f.cluster_id WHERE f.status='labeled' AND c.status='labeled' AND c.person_id=f.person_id) WHERE n=1""", ("faces", "clusters"))
def _(r):
    people = export.exported_people(r.people, r.faces, r.clusters, prefix=PREFIX, side=320)
    crops = r.faces.select(F.col("crop_relpath").alias("relative_path"), F.lit(100).cast("bigint").alias("bytes"))
    return export.avatar_uploads(people, crops, "/private").select("person_id", "object_key", "sha256", "bytes")


@query("p9_review_summary", """SELECT (SELECT count(*) FROM clusters WHERE status='unreviewed') AS unreviewed_clusters, count_if(status='unknown') AS unknown_faces,
  count_if(status='ignored') AS ignored_faces, count_if(status='labeled') AS labeled_faces, count(*) AS total_faces FROM faces""", ("faces", "clusters"))
def _(r):
    return export.review_summary(r.faces, r.clusters)


@query("m21_failure_capture", """SELECT id, CASE WHEN f THEN 'error' ELSE scan_status END AS scan_status, CASE WHEN f THEN 1000 END AS message_length, CASE WHEN f THEN 1 ELSE 0 END AS attempt_count
  FROM (SELECT *, scan_status='pending' AS f FROM scan_pictures)""", ("scan_pictures",))
def _(r):
    from ..plans.scan import record_failures

    stored = r.scan_pictures.withColumn("scan_error", F.lit(None).cast("string")).withColumn("attempt_count", F.lit(0))
    failures = r.scan_pictures.where(F.col("scan_status") == "pending").select("id", F.repeat(F.lit("x"), F.lit(1500)).alias("message"))
    return record_failures(stored, failures).select("id", "scan_status", F.length("scan_error").alias("message_length"), "attempt_count")


@query("m8_conditional_reset", """SELECT id, CASE WHEN o_orderstatus='F' THEN scan_status ELSE 'pending' END AS scan_status,
  CASE WHEN o_orderstatus='F' THEN 7 ELSE 0 END AS face_count FROM (SELECT s.*, p.o_orderstatus FROM scan_pictures s JOIN pictures p ON p.id=s.id)""", ("scan_pictures", "pictures"))
def _(r):
    """Only finished orders keep their scan key."""
    from ..plans.scan import register_pictures

    joined = r.scan_pictures.join(r.pictures.select("id", "o_orderstatus"), "id")
    stored = joined.select(
        "id", "album_position", F.lit("k1").alias("scan_key"), "scan_status", F.lit(7).alias("face_count"),
        F.lit(None).cast("string").alias("scan_error"), F.lit(None).cast("string").alias("processed_at"), F.lit(1).alias("attempt_count"),
    )
    incoming = joined.select("id", "album_position", F.when(F.col("o_orderstatus") == "F", "k1").otherwise("k2").alias("scan_key"))
    return register_pictures(stored, incoming).select("id", "scan_status", "face_count")


@query("m9_replace_faces", """SELECT p.id, CASE WHEN p.published THEN n ELSE 0 END AS face_count FROM pictures p JOIN (SELECT photo_id, count(*)::INTEGER AS n FROM faces GROUP BY 1) f ON f.photo_id=p.id""", ("pictures", "faces"))
def _(r):
    """Rescan all pictures: published ones keep their faces, others lose them."""
    from ..plans.scan import replace_faces

    fresh = r.faces.withColumn("status", F.lit("unreviewed")).withColumn("person_id", F.lit(None).cast("string"))
    shown = r.pictures.where(F.col("published")).select(F.col("id").alias("photo_id"))
    incoming = fresh.join(shown, "photo_id", "left_semi")
    pictures = r.pictures.join(r.faces.select(F.col("photo_id").alias("id")).distinct(), "id", "left_semi").select(
        "id", F.lit("pending").alias("scan_status"), F.lit(-1).alias("face_count"),
        F.lit(None).cast("string").alias("scan_error"), F.lit(None).cast("string").alias("processed_at"),
    )
    new_pictures, _faces, _links = replace_faces(pictures, fresh, r.exceptions, incoming, pictures.select("id"), now=_now())
    return new_pictures.select("id", "face_count")
