"""How the test tables stand in for the catalog and the review workspace.

Each role exists twice: as a DataFrame and as the SQL text of a CTE.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.catalog import read_table

ALBUM = "1-URGENT"
PREFIX = "gallery"
SEED = "0123456789abcdef"
NOW = "2030-01-01T00:00:00.000Z"


def hex_id(prefix: str, text: Column, n: int = 32) -> Column:
    digest = F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("string").cast("binary"), 256), 1, n))
    # Keys have no nulls; saying so spares a null filter that would hash again.
    return F.coalesce(digest, F.lit(""))


def photo_id(key: Column) -> Column:
    return hex_id("p_", key)


def person_id(key: Column) -> Column:
    return hex_id("person_", F.concat(F.lit("s"), key.cast("string")))


def cluster_id(key: Column) -> Column:
    return hex_id("c_", key, 24)


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def pictures(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        sha = lambda letter: F.sha2(F.concat(F.lit(letter), k.cast("string")).cast("binary"), 256)
        return o.select(
            photo_id(k).alias("id"),
            F.col("o_orderpriority").alias("album_id"),
            F.col("o_custkey").cast("int").alias("album_position"),
            F.when(k % 17 != 0, F.col("o_orderdate").cast("timestamp")).alias("captured_at"),
            (F.col("o_orderstatus") != "P").alias("published"),
            F.concat(F.lit("IMG_"), F.col("o_custkey").cast("string"), F.lit(".jpg")).alias("original_filename"),
            (1000 + k % 3000).cast("int").alias("width"),
            (1000 + F.col("o_custkey") % 2000).cast("int").alias("height"),
            sha("s").alias("source_fingerprint"),
            sha("t").alias("thumb_sha256"),
            sha("d").alias("display_sha256"),
            (F.col("o_custkey") + 1).alias("thumb_bytes"),
            (k + 1).alias("display_bytes"),
            F.lit(None).cast("string").alias("blur_data_url"),
            F.concat(F.lit("run_"), (k % 3).cast("string")).alias("imported_run_id"),
            k.alias("o_orderkey"),
            "o_orderstatus",
        )

    @cached_property
    def keyed_pictures(self) -> DataFrame:
        from ..functions.hashing import object_key

        ext = F.element_at(F.array(F.lit("webp"), F.lit("avif"), F.lit("jpeg")), (F.col("o_orderkey") % 3 + 1).cast("int"))
        key = lambda kind: object_key(PREFIX, F.col("source_fingerprint"), kind, F.col(f"{kind}_sha256"), ext)
        return self.pictures.withColumn("thumb_key", key("thumb")).withColumn("display_key", key("display"))

    @cached_property
    def people(self) -> DataFrame:
        s = self.table("supplier")
        albums = F.array(*[F.lit(a) for a in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
        pid = person_id(F.col("s_suppkey"))
        return s.select(
            pid.alias("id"),
            F.element_at(albums, F.col("s_nationkey") % 5 + 1).alias("album_id"),
            F.concat(F.lit("person-"), F.substring(pid, 8, 12)).alias("slug"),
            F.col("s_name").alias("display_name"),
            F.lower("s_name").alias("name_key"),
            F.lit("t0").alias("created_at"),
            F.lit("t0").alias("updated_at"),
            "s_suppkey", "s_acctbal",
        )

    @cached_property
    def links(self) -> DataFrame:
        return self.table("lineitem").select(
            "l_orderkey", "l_suppkey"
        ).distinct().select(
            photo_id(F.col("l_orderkey")).alias("photo_id"), person_id(F.col("l_suppkey")).alias("person_id")
        )

    @cached_property
    def faces(self) -> DataFrame:
        return self._faces(self.table("lineitem"))

    def _faces(self, li: DataFrame, *more: str) -> DataFrame:
        p, flag = F.col("l_partkey"), F.col("l_returnflag")
        key = F.concat_ws(
            "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        )
        status = (
            F.when(p % 5 == 0, F.when(flag == "R", "ignored").otherwise("labeled"))
            .when(p % 5 == 1, F.when(F.col("l_linestatus") == "O", "unknown").otherwise("ignored"))
            .when(p % 5 == 2, F.when(flag == "R", "unknown").otherwise("unreviewed"))
            .when(p % 5 == 3, F.when(flag == "A", "labeled").otherwise("unreviewed"))
            .otherwise("unreviewed")
        )
        width, height = (20 + p % 200).cast("int"), (20 + F.col("l_suppkey") % 100).cast("int")
        fid = hex_id("f_", key)
        return li.select(
            *more, fid.alias("id"),
            photo_id(F.col("l_orderkey")).alias("photo_id"),
            cluster_id(p).alias("cluster_id"),
            F.when(status == "labeled", person_id(F.when(p % 5 == 0, p % 10).otherwise(F.col("l_suppkey")))).alias("person_id"),
            (F.col("l_linenumber") - 1).alias("ordinal"),
            F.col("l_discount").alias("bbox_x"), F.col("l_tax").alias("bbox_y"),
            (F.col("l_quantity") / 50).alias("bbox_width"), (F.col("l_quantity") / 100).alias("bbox_height"),
            F.round(F.col("l_extendedprice") / 105000, 6).alias("detection_score"),
            width.alias("width_px"), height.alias("height_px"),
            F.when(F.least(width, height) >= 40, "clusterable").otherwise("manual_only").alias("quality"),
            (F.col("l_quantity") / 50).alias("quality_score"),
            status.alias("status"),
            F.lit(0).alias("revision"),
            F.concat(F.lit("crops/"), F.substring(fid, 1, 4), F.lit("/"), fid, F.lit(".webp")).alias("crop_relpath"),
            F.sha2(fid.cast("binary"), 256).alias("crop_sha256"),
            F.lit("t0").alias("updated_at"),
        )

    @cached_property
    def clusters(self) -> DataFrame:
        return self._clusters(self.table("part"))

    def _clusters(self, parts: DataFrame, *more: str) -> DataFrame:
        p = F.col("p_partkey")
        status = (
            F.when(p % 5 == 0, "labeled").when(p % 5 == 1, "unknown").when(p % 25 == 4, "ignored").otherwise("unreviewed")
        )
        none = F.lit(None).cast("string")
        return parts.select(
            *more, cluster_id(p).alias("id"), F.lit("automatic").alias("origin"), status.alias("status"),
            F.when(status == "labeled", person_id(p % 10)).alias("person_id"),
            none.alias("representative_face_id"), F.lit(0).alias("revision"), none.alias("reviewed_at"),
            F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"),
        )

    @cached_property
    def suggestions(self) -> DataFrame:
        p, step = F.col("p_partkey"), F.col("step")
        score = F.col("p_size") / 50
        return (
            self.table("part").select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(3))).alias("step"))
            .select(
                F.least(cluster_id(p), cluster_id(p + step)).alias("cluster_id_a"),
                F.greatest(cluster_id(p), cluster_id(p + step)).alias("cluster_id_b"),
                score.alias("similarity_max"), (score * 0.9).alias("similarity_median"), (score * 0.8).alias("similarity_min"),
                F.when(F.col("p_size") % 4 == 0, "rejected").otherwise("pending").alias("status"),
                F.lit("t0").alias("created_at"),
            )
        )

    @cached_property
    def review_pictures(self) -> DataFrame:
        """Pictures with a stored face count that is wrong where the key is a multiple of 9."""
        n = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
        status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderkey") % 7 == 0, "processing").when(
            F.col("o_orderstatus") == "F", "complete"
        ).otherwise("error")
        return self.pictures.join(n, "o_orderkey", "left").select(
            "id", "album_position", status.alias("scan_status"),
            (F.coalesce("n", F.lit(0)) + F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)).cast("int").alias("face_count"),
            "o_orderkey",
        )

    @cached_property
    def scan_pictures(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderkey") % 7 == 0, "processing").when(
            F.col("o_orderstatus") == "F", "complete"
        ).otherwise("error")
        return self.pictures.select("id", "album_position", status.alias("scan_status"), "o_orderkey", "width", "height")

    @cached_property
    def cannot_links(self) -> DataFrame:
        from ..operators.workspace import same_photo_links

        return same_photo_links(self.faces).select(
            "face_id_a", "face_id_b", F.lit("same_photo").alias("reason"), F.lit("t0").alias("created_at")
        )

    @cached_property
    def stored_faces(self) -> DataFrame:
        """Faces as a written table, for jobs that read them many times."""
        from ..session import cut_lineage

        return cut_lineage(self.faces.select("id", "photo_id", "cluster_id", "person_id", "status"), "faces", "zstd")

    @cached_property
    def exceptions(self) -> DataFrame:
        """What the faces of a photo do not say about links: nothing here."""
        from .. import schemas

        return self.spark.createDataFrame([], schemas.CANNOT_LINKS)

    @cached_property
    def vectors(self) -> DataFrame:
        """Two consecutive vectors share a photo."""
        v = F.col("vec_id")
        return self.table("embeddings").select(
            hex_id("f_", F.concat(F.lit("v"), v.cast("string"))).alias("id"),
            photo_id(F.floor(v / 2).cast("bigint")).alias("photo_id"),
            "embedding",
            (F.col("label") / 10).alias("quality_score"),
            F.lit("unreviewed").alias("status"),
            F.lit(None).cast("string").alias("person_id"),
            "vec_id",
        )

    @cached_property
    def workspace(self):
        from .. import schemas
        from ..plans.review import IMAGES, Workspace

        empty = lambda schema: self.spark.createDataFrame([], schema)
        return Workspace(
            pictures=self.pictures.select("id", "album_position"),
            people=self.people.select("id", "display_name", "name_key", "created_at", "updated_at"),
            clusters=self.clusters, faces=self.faces, cannot_links=self.exceptions,
            suggestions=self.suggestions, actions=empty(schemas.ACTIONS), images=empty(IMAGES),
        )

    @cached_property
    def whole_workspace(self):
        """The workspace as the guards want it: faces agree with their clusters, and every id leads somewhere."""
        from dataclasses import replace

        from ..session import cut_lineage

        ws, lines = self.workspace, self.table("lineitem")
        # Joined by the keys that ids are made of, so that no ids are shuffled, and nothing else made of a line's columns.
        parts = self.table("part").join(lines.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
        keyed = cut_lineage(self._clusters(parts, "p_partkey"), "clusters")
        clusters = keyed.drop("p_partkey")
        owner = keyed.select(F.col("p_partkey").alias("l_partkey"), F.col("status").alias("_s"), F.col("person_id").alias("_p"))
        faces = self._faces(lines.join(owner, "l_partkey"), "_s", "_p").withColumns({"status": F.col("_s"), "person_id": F.col("_p")})
        named = clusters.where(F.col("person_id").isNotNull()).select(F.col("person_id").alias("id")).distinct()
        extra = named.join(ws.people, "id", "left_anti").select(
            "id", F.col("id").alias("display_name"), F.col("id").alias("name_key"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at")
        )
        suggestions = ws.suggestions
        for side in ("cluster_id_a", "cluster_id_b"):
            suggestions = suggestions.join(clusters.select(F.col("id").alias(side)), side, "left_semi")
        # Faces stay a plan: who reads two columns of them shuffles two, and the wide rows are written by backups only.
        return replace(
            ws, clusters=clusters, faces=faces.select(*ws.faces.columns), people=ws.people.unionByName(extra),
            suggestions=cut_lineage(suggestions.select(*ws.suggestions.columns), "suggestions"),
        )


# SQL twins -------------------------------------------------------------------

def _pid(x: str) -> str:
    return f"'p_'||substr(sha256(({x})::VARCHAR),1,32)"


def _person(x: str) -> str:
    return f"'person_'||substr(sha256('s'||({x})::VARCHAR),1,32)"


def _cid(x: str) -> str:
    return f"'c_'||substr(sha256(({x})::VARCHAR),1,24)"


_FACE_STATUS = """CASE l_partkey%5
  WHEN 0 THEN CASE WHEN l_returnflag='R' THEN 'ignored' ELSE 'labeled' END
  WHEN 1 THEN CASE WHEN l_linestatus='O' THEN 'unknown' ELSE 'ignored' END
  WHEN 2 THEN CASE WHEN l_returnflag='R' THEN 'unknown' ELSE 'unreviewed' END
  WHEN 3 THEN CASE WHEN l_returnflag='A' THEN 'labeled' ELSE 'unreviewed' END
  ELSE 'unreviewed' END"""

_SCAN_STATUS = """CASE WHEN o_orderstatus='P' THEN 'pending' WHEN o_orderkey%7=0 THEN 'processing'
  WHEN o_orderstatus='F' THEN 'complete' ELSE 'error' END"""

CTES = {
    "pictures": f"""SELECT {_pid('o_orderkey')} AS id, o_orderpriority AS album_id, o_custkey::INTEGER AS album_position,
  CASE WHEN o_orderkey%17<>0 THEN o_orderdate END AS captured_at, o_orderstatus<>'P' AS published,
  'IMG_'||o_custkey||'.jpg' AS original_filename, (1000+o_orderkey%3000)::INTEGER AS width,
  (1000+o_custkey%2000)::INTEGER AS height, sha256('s'||o_orderkey) AS source_fingerprint,
  sha256('t'||o_orderkey) AS thumb_sha256, sha256('d'||o_orderkey) AS display_sha256,
  o_custkey+1 AS thumb_bytes, o_orderkey+1 AS display_bytes, CAST(NULL AS VARCHAR) AS blur_data_url,
  'run_'||(o_orderkey%3) AS imported_run_id, o_orderkey, o_orderstatus FROM orders""",
    "keyed_pictures": f"""SELECT *, '{PREFIX}/'||substr(source_fingerprint,1,2)||'/p_'||substr(source_fingerprint,1,32)
  ||'/thumb-'||substr(thumb_sha256,1,20)||'.'||ext AS thumb_key,
  '{PREFIX}/'||substr(source_fingerprint,1,2)||'/p_'||substr(source_fingerprint,1,32)
  ||'/display-'||substr(display_sha256,1,20)||'.'||ext AS display_key
  FROM (SELECT *, CASE o_orderkey%3 WHEN 0 THEN 'webp' WHEN 1 THEN 'avif' ELSE 'jpeg' END AS ext FROM pictures)""",
    "people": f"""SELECT {_person('s_suppkey')} AS id, CASE s_nationkey%5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH'
  WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS album_id,
  'person-'||substr(sha256('s'||s_suppkey),1,12) AS slug, s_name AS display_name, lower(s_name) AS name_key, s_suppkey, s_acctbal FROM supplier""",
    "links": f"""SELECT DISTINCT {_pid('l_orderkey')} AS photo_id, {_person('l_suppkey')} AS person_id FROM lineitem""",
    "faces": f"""SELECT 'f_'||substr(sha256(k),1,32) AS id, {_pid('l_orderkey')} AS photo_id, {_cid('l_partkey')} AS cluster_id,
  CASE WHEN status='labeled' THEN {_person('CASE WHEN l_partkey%5=0 THEN l_partkey%10 ELSE l_suppkey END')} END AS person_id,
  l_linenumber-1 AS ordinal, l_discount AS bbox_x, l_tax AS bbox_y, l_quantity/50 AS bbox_width, l_quantity/100 AS bbox_height,
  round(l_extendedprice/105000,6) AS detection_score, (20+l_partkey%200)::INTEGER AS width_px, (20+l_suppkey%100)::INTEGER AS height_px,
  CASE WHEN least(20+l_partkey%200,20+l_suppkey%100)>=40 THEN 'clusterable' ELSE 'manual_only' END AS quality,
  l_quantity/50 AS quality_score, status, 0 AS revision FROM (SELECT *, {_FACE_STATUS} AS status,
  concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey,round(l_extendedprice*100)::BIGINT) AS k FROM lineitem)""",
    "clusters": f"""SELECT {_cid('p_partkey')} AS id, status, CASE WHEN status='labeled' THEN {_person('p_partkey%10')} END AS person_id, p_partkey
  FROM (SELECT *, CASE WHEN p_partkey%5=0 THEN 'labeled' WHEN p_partkey%5=1 THEN 'unknown' WHEN p_partkey%25=4 THEN 'ignored'
  ELSE 'unreviewed' END AS status FROM part)""",
    "suggestions": f"""SELECT least({_cid('p_partkey')},{_cid('p_partkey+step')}) AS cluster_id_a,
  greatest({_cid('p_partkey')},{_cid('p_partkey+step')}) AS cluster_id_b, p_size/50 AS similarity_max,
  CASE WHEN p_size%4=0 THEN 'rejected' ELSE 'pending' END AS status FROM part CROSS JOIN (VALUES (1),(3)) s(step)""",
    "review_pictures": f"""SELECT p.id, p.album_position, {_SCAN_STATUS} AS scan_status,
  (coalesce(n,0)+CASE WHEN o_orderkey%9=0 THEN 1 ELSE 0 END)::INTEGER AS face_count, o_orderkey FROM pictures p
  LEFT JOIN (SELECT photo_id, count(*) AS n FROM faces GROUP BY 1) c ON c.photo_id=p.id""",
    "scan_pictures": f"SELECT id, album_position, {_SCAN_STATUS} AS scan_status, o_orderkey, width, height FROM pictures",
    "cannot_links": """SELECT a.id AS face_id_a, b.id AS face_id_b, 'same_photo' AS reason FROM faces a JOIN faces b
  ON a.photo_id=b.photo_id AND a.id<b.id""",
    "vectors": f"""SELECT 'f_'||substr(sha256('v'||vec_id),1,32) AS id, {_pid('vec_id//2')} AS photo_id, embedding::DOUBLE[] AS embedding,
  label/10 AS quality_score, vec_id FROM embeddings""",
}
NEEDS = {
    "keyed_pictures": ("pictures",), "review_pictures": ("pictures", "faces"), "cannot_links": ("faces",),
    "scan_pictures": ("pictures",),
}


def with_roles(sql: str, roles: tuple[str, ...]) -> str:
    """Prefix the CTEs a query needs, dependencies first."""
    if not roles:
        return sql
    wanted: list[str] = []
    for role in roles:
        for name in (*NEEDS.get(role, ()), role):
            if name not in wanted:
                wanted.append(name)
    ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in wanted)
    return f"WITH {ctes}\n{sql}"
