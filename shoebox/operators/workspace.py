"""Reads over the review workspace: clusters, faces, pictures, people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.packing import packed, unpacked
from ..functions.text import like_contains
from ..session import cut_lineage
from .numbering import top_rank

STATES = ("unreviewed", "labeled", "unknown", "ignored")


def labelable(status: Column) -> Column:
    return ~status.isin("ignored", "unknown")


def state_rank(status: Column) -> Column:
    return (
        F.when(status == "unreviewed", 0).when(status == "labeled", 1).when(status == "unknown", 2).otherwise(3)
    )


def cluster_faces(clusters: DataFrame, faces: DataFrame, pictures: DataFrame, people: DataFrame) -> DataFrame:
    """clusters x faces x pictures, with the person's name where there is one."""
    named = people.select(F.col("id").alias("person_id"), "display_name")
    rest = [c for c in faces.columns if c not in ("id", "photo_id", "cluster_id", "person_id", "status", "revision")]
    mine = faces.select(
        packed(F.col("id")).alias("_face"), packed(F.col("photo_id")).alias("_photo"), packed(F.col("cluster_id")).alias("_cluster"), *rest
    )
    shown = pictures.select(packed(F.col("id")).alias("_photo"), "album_position")
    owner = clusters.select(packed(F.col("id")).alias("_cluster"), F.col("id").alias("cluster_id"), "status", "person_id")
    # Ids go through the shuffles as bytes; merges, since columns made from short keys look small to the planner.
    joined = mine.join(shown.hint("merge"), "_photo").join(owner.hint("merge"), "_cluster").join(named, "person_id", "left")
    return joined.select(
        "person_id", "cluster_id", unpacked(F.col("_photo")).alias("photo_id"), unpacked(F.col("_face")).alias("face_id"), *rest,
        "album_position", "status", "display_name",
    )


def cluster_summary(
    clusters: DataFrame, faces: DataFrame, pictures: DataFrame, people: DataFrame
) -> DataFrame:
    """Per cluster: best detection, faces, distinct pictures, first position.

    Faces are aggregated before the cluster and people columns are joined.
    """
    stats = (
        faces.where(F.col("cluster_id").isNotNull())
        .select(packed(F.col("cluster_id")).alias("_cluster"), packed(F.col("photo_id")).alias("photo_id"), "detection_score")
        .join(pictures.select(packed(F.col("id")).alias("photo_id"), "album_position").hint("merge"), "photo_id")
        .groupBy("_cluster")
        .agg(
            F.max("detection_score").alias("confidence"),
            F.count(F.lit(1)).alias("face_count"),
            F.countDistinct("photo_id").alias("photo_count"),
            F.min("album_position").alias("first_position"),
        )
    )
    named = people.select(F.col("id").alias("person_id"), "display_name")
    return (
        clusters.select("id", "status", "person_id", "representative_face_id", "revision", "reviewed_at")
        .join(stats, packed(F.col("id")) == F.col("_cluster"))
        .drop("_cluster")
        .join(named, "person_id", "left")
    )


def filter_clusters(summary: DataFrame, status: str = "all", query: str = "") -> DataFrame:
    """Optional status, optional literal text within the name or the id."""
    if status != "all":
        if status not in STATES:
            raise ValueError("Invalid cluster state")
        summary = summary.where(F.col("status") == status)
    text = query.strip()
    if len(text) > 120:
        raise ValueError("a search text has at most 120 characters")
    if text:
        summary = summary.where(
            like_contains(F.coalesce("display_name", F.lit("")), text)
            | like_contains(F.col("id"), text)
        )
    return summary


def review_queue(summary: DataFrame) -> DataFrame:
    return summary.orderBy(
        state_rank(F.col("status")), F.col("face_count").desc(), "first_position", "id"
    )


def scoreboard(pictures: DataFrame, faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Thirteen counts, one pass per table; the three one-row results join last."""
    is_ = lambda column, value: F.count_if(F.col(column) == value)
    p = pictures.agg(
        F.count(F.lit(1)).alias("pictures"), is_("scan_status", "complete").alias("scanned_pictures")
    )
    f = faces.agg(
        F.count(F.lit(1)).alias("total_faces"),
        is_("quality", "clusterable").alias("clusterable_faces"),
        is_("quality", "manual_only").alias("manual_only_faces"),
        is_("status", "labeled").alias("labeled_faces"),
        is_("status", "unknown").alias("unknown_faces"),
        is_("status", "ignored").alias("ignored_faces"),
        is_("status", "unreviewed").alias("remaining_faces"),
    )
    c = clusters.agg(*[is_("status", s).alias(f"{s}_clusters") for s in STATES])
    return p.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(c))


def bootstrap(
    pictures: DataFrame, faces: DataFrame, clusters: DataFrame, people: DataFrame, *, status: str = "unreviewed", query: str = ""
) -> tuple[DataFrame, DataFrame]:
    """What a review session opens with: (scoreboard, clusters to review in order)."""
    summary = cluster_summary(clusters, faces, pictures, people)
    return scoreboard(pictures, faces, clusters), review_queue(filter_clusters(summary, status, query))


def person_stats(people: DataFrame, faces: DataFrame) -> DataFrame:
    """Distinct pictures and faces per person over labeled faces."""
    labeled = faces.where((F.col("status") == "labeled") & F.col("person_id").isNotNull())
    stats = labeled.groupBy("person_id").agg(
        F.countDistinct("photo_id").alias("photo_count"), F.count(F.lit(1)).alias("face_count")
    )
    return people.select(F.col("id").alias("person_id"), "display_name").join(stats, "person_id")


def associations(faces: DataFrame, pictures: DataFrame) -> DataFrame:
    """One row per (photo, person) with the smallest position."""
    labeled = faces.where((F.col("status") == "labeled") & F.col("person_id").isNotNull())
    return (
        labeled.select("photo_id", "person_id")
        .join(pictures.select(F.col("id").alias("photo_id"), "album_position"), "photo_id")
        .groupBy("photo_id", "person_id")
        .agg(F.min("album_position").alias("album_position"))
    )


def association_count(faces: DataFrame) -> DataFrame:
    labeled = faces.where((F.col("status") == "labeled") & F.col("person_id").isNotNull())
    return labeled.select("photo_id", "person_id").distinct().agg(
        F.count(F.lit(1)).alias("photo_people")
    )


def links_per_person(people: DataFrame, links: DataFrame) -> DataFrame:
    counted = links.groupBy("person_id").agg(F.count(F.lit(1)).alias("links"))
    return people.select(F.col("id").alias("person_id")).join(counted, "person_id", "left").select(
        "person_id", F.coalesce("links", F.lit(0)).alias("links")
    )


def status_histogram(df: DataFrame, domain: Sequence[str] = STATES, column: str = "status") -> DataFrame:
    """Count per status of a fixed domain, zeros included, in one pass."""
    counts = df.agg(*[F.count_if(F.col(column) == s).alias(s) for s in domain])
    pairs = ", ".join(f"'{s}', `{s}`" for s in domain)
    return counts.selectExpr(f"stack({len(domain)}, {pairs}) as (status, n)")


def target_state(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """Face statuses inside unreviewed clusters, and clusters with no face."""
    per_cluster = faces.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATES],
    )
    targets = clusters.where(F.col("status") == "unreviewed").select(F.col("id").alias("cluster_id"))
    joined = targets.join(per_cluster, "cluster_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return joined.agg(
        F.count(F.lit(1)).alias("unreviewed_clusters"),
        total("n").alias("target_faces"),
        *[total(f"n_{s}").alias(f"{s}_faces") for s in STATES],
        F.count_if(F.col("n").isNull()).alias("empty_clusters"),
    )


def progress(clusters: DataFrame) -> DataFrame:
    """round(100 * reviewed / total), 0 for an empty workspace."""
    counts = clusters.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") != "unreviewed").alias("reviewed"),
    )
    percent = F.when(
        F.col("total") > 0, F.floor(F.col("reviewed") * 100 / F.col("total") + 0.5)
    ).otherwise(0)
    return counts.select("total", "reviewed", percent.cast("bigint").alias("progress"))


def members_in_order(faces: DataFrame, pictures: DataFrame) -> DataFrame:
    """Faces with their place in the cluster, for a detail listing."""
    placed = faces.join(pictures.select(F.col("id").alias("photo_id"), "album_position"), "photo_id")
    return placed.orderBy("cluster_id", "album_position", "ordinal", "id")


def neighbours(suggestions: DataFrame, a: str = "cluster_id_a", b: str = "cluster_id_b") -> DataFrame:
    """Each unordered edge once per endpoint, so lookups become equi-joins."""
    rest = [c for c in suggestions.columns if c not in (a, b)]
    ends = F.array(
        F.struct(F.col(a).alias("cluster_id"), F.col(b).alias("other_id")),
        F.struct(F.col(b).alias("cluster_id"), F.col(a).alias("other_id")),
    )
    return suggestions.select(F.explode(ends).alias("_e"), *rest).select("_e.*", *rest)


def top_suggestions(suggestions: DataFrame, n: int = 8) -> DataFrame:
    """Best pending suggestions per cluster by maximum similarity, then id."""
    pending = neighbours(suggestions.where(F.col("status") == "pending"))
    return top_rank(
        pending, ["cluster_id"], [F.col("similarity_max").desc(), F.col("other_id").asc()], n
    )


def label_proposals(clusters: DataFrame, people: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(cluster_id, person_id, target_id): who to propose for which clusters.

    A cluster proposes a person when its labeled listed neighbours and itself,
    if labeled, name exactly one person. A labeled match without person or
    name vetoes. Targets are the unreviewed ones among itself and its listed
    suggestions.

    Clusters are joined by sorted merges: the planner's size of a column made
    from a short one is too small, and broadcasts as large as the table follow.
    One aggregate per cluster has all it needs, at most nine neighbours. The
    name is looked up once for the one person that is left.
    """
    listed = top_suggestions(suggestions).select("cluster_id", "other_id")
    itself = clusters.select(F.col("id").alias("cluster_id"), F.col("id").alias("other_id"))
    state = clusters.select(F.col("id").alias("other_id"), "status", "person_id")
    around = listed.unionByName(itself).join(state.hint("merge"), "other_id")
    is_labeled, own = F.col("status") == "labeled", F.col("cluster_id") == F.col("other_id")
    verdict = (
        around.groupBy("cluster_id")
        .agg(
            F.min(F.when(is_labeled, F.col("person_id"))).alias("person_id"),
            F.max(F.when(is_labeled, F.col("person_id"))).alias("hi"),
            F.count_if(is_labeled & F.col("person_id").isNull()).alias("vetoes"),
            F.count_if(own & F.col("status").isin("unreviewed", "labeled")).alias("open"),
            F.collect_list(F.when(F.col("status") == "unreviewed", F.col("other_id"))).alias("targets"),
        )
        .where((F.col("person_id") == F.col("hi")) & (F.col("vetoes") == 0) & (F.col("open") > 0) & (F.size("targets") > 0))
    )
    named = people.where(F.coalesce("display_name", F.lit("")) != "").select(F.col("id").alias("person_id"))
    return verdict.join(named.hint("merge"), "person_id", "left_semi").select(
        "cluster_id", "person_id", F.explode("targets").alias("target_id")
    )


def representatives(
    faces: DataFrame, group: str = "cluster_id", *, by_status: bool = True, by_detection: bool = False
) -> DataFrame:
    """(group, face id): best status pool, quality desc, [detection desc,] id.

    One aggregate with a struct minimum, so it combines on the map side.
    """
    keys: list[Column] = []
    if by_status:
        keys.append(
            F.when(F.col("status") == "ignored", 2).when(F.col("status") == "unknown", 1).otherwise(0)
        )
    keys.append(-F.col("quality_score"))
    if by_detection:
        keys.append(-F.col("detection_score"))
    keys.append(F.col("id"))
    return faces.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.min_by("id", F.struct(*keys)).alias("representative_face_id")
    )


def best_avatars(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Best face per person, only where the face and its cluster agree."""
    agreed = faces.where((F.col("status") == "labeled") & F.col("person_id").isNotNull()).join(
        clusters.where(F.col("status") == "labeled").select(
            F.col("id").alias("cluster_id"), "person_id"
        ),
        ["cluster_id", "person_id"],
        "left_semi",
    )
    order = F.struct(
        -F.col("quality_score"), -F.col("detection_score"),
        -F.least("width_px", "height_px"), F.col("id"),
    )
    kept = [c for c in ("crop_relpath", "crop_sha256") if c in faces.columns]
    return agreed.groupBy("person_id").agg(
        F.min_by(F.struct(F.col("id").alias("face_id"), *kept), order).alias("_a")
    ).select("person_id", "_a.*")


def mixed_clusters(faces: DataFrame) -> DataFrame:
    """Clusters whose labeled faces do not name exactly one person."""
    return (
        faces.where(F.col("status") == "labeled")
        .groupBy("cluster_id")
        .agg(F.min("person_id").alias("lo"), F.max("person_id").alias("hi"))
        .where(~F.col("lo").eqNullSafe(F.col("hi")) | F.col("lo").isNull())
        .select("cluster_id")
    )


def crossing_links(cannot_links: DataFrame, faces: DataFrame) -> DataFrame:
    """Cannot-links whose two faces sit in different clusters (a < b order)."""
    side = lambda x: faces.select(packed(F.col("id")).alias(f"_{x}"), packed(F.col("cluster_id")).alias(f"c{x}")).hint("merge")
    pairs = cannot_links.select(*[packed(F.col(f"face_id_{x}")).alias(f"_{x}") for x in "ab"])
    # Ids go through both shuffles as bytes and are written out where clusters differ.
    joined = pairs.join(side("a"), "_a").join(side("b"), "_b").where(F.col("ca") != F.col("cb"))
    named = joined.select(*[unpacked(F.col(c)).alias(n) for c, n in (("_a", "face_id_a"), ("_b", "face_id_b"), ("ca", "ca"), ("cb", "cb"))])
    return named.select(
        "face_id_a", "face_id_b",
        F.least("ca", "cb").alias("cluster_id_a"), F.greatest("ca", "cb").alias("cluster_id_b"),
    )


# Cannot-links are a relation, not a table: all faces of one photo are linked to
# each other, which ``faces.photo_id`` says, and a short table of exceptions says
# the rest: ``manual_split`` adds a pair, ``absent`` takes one of a photo back,
# ``same_photo`` repeats one. Whatever needs links counts faces per photo.

def _pairs_of(exceptions: DataFrame, faces: DataFrame, *columns: str) -> DataFrame:
    """Exceptions with columns of both faces (x_a, x_b); those that have them stay as they are."""
    if all(f"{c}_{side}" in exceptions.columns for c in columns for side in "ab"):
        return exceptions
    for side in ("a", "b"):
        mine = faces.select(F.col("id").alias(f"face_id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        exceptions = exceptions.join(mine, f"face_id_{side}")
    return exceptions


def placed_exceptions(exceptions: DataFrame, faces: DataFrame) -> DataFrame | None:
    """Exceptions with the clusters and photos of both faces, written once for all who ask; None if there are none.

    An exception is a row, and faces are many: without any, no face is sent.
    """
    if exceptions.isEmpty():
        return None
    return cut_lineage(_pairs_of(exceptions.select("face_id_a", "face_id_b", "reason"), faces, "cluster_id", "photo_id"), "exceptions")


def count_per_photo(faces: DataFrame, *group: str) -> DataFrame:
    return faces.where("cluster_id IS NOT NULL").groupBy(*group, "photo_id").agg(F.count(F.lit(1)).alias("n"))


def linked_cluster_pairs(candidates: DataFrame, faces: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(cluster_id_a, cluster_id_b, links) for the candidate pairs that hold linked faces.

    Each candidate is followed to the photos of its first cluster and asked
    for in its second; the links of a photo are a product of two counts. No
    pair of faces is formed but for the exceptions.
    """
    key = ["cluster_id_a", "cluster_id_b"]
    short = {x: packed(F.col(x)) for x in ("cluster_id", "photo_id")}
    owned = count_per_photo(faces.select(*[c.alias(x) for x, c in short.items()]), "cluster_id")
    side = lambda x: owned.select(F.col("cluster_id").alias(f"cluster_id_{x}"), "photo_id", F.col("n").alias(f"n_{x}"))
    asked = candidates.select(*key).distinct()
    shared = asked.select(*[packed(F.col(x)).alias(x) for x in key]).join(side("a"), "cluster_id_a").join(side("b"), ["cluster_id_b", "photo_id"])
    counts = shared.groupBy(*key).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("links")).select(*[unpacked(F.col(x)).alias(x) for x in key], "links")
    if exceptions is not None:
        placed = _pairs_of(exceptions, faces, "cluster_id", "photo_id").where("cluster_id_a <> cluster_id_b")
        sign = F.when(F.col("reason") == "absent", -1).when(F.col("photo_id_a") != F.col("photo_id_b"), 1).otherwise(0)
        ends = placed.select(F.least(*key).alias(key[0]), F.greatest(*key).alias(key[1]), sign.cast("bigint").alias("links"))
        ordered = asked.select(*key, F.least(*key).alias("_a"), F.greatest(*key).alias("_b"))
        ends = ends.select(F.col(key[0]).alias("_a"), F.col(key[1]).alias("_b"), "links")
        counts = counts.union(ordered.join(ends, ["_a", "_b"]).select(*key, "links"))
    return counts.groupBy(*key).agg(F.sum("links").alias("links")).where("links > 0")


def linked_groups(groups: DataFrame, faces: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(group, links): groups of clusters, (group, cluster_id), with linked faces in different clusters.

    Of n faces of one photo, n_i in each cluster, (n^2 - sum n_i^2) / 2 links cross.
    """
    placed = faces.select("id", "cluster_id", "photo_id").join(groups.select("group", "cluster_id"), "cluster_id")
    counts = (
        count_per_photo(placed, "group", "cluster_id").groupBy("group", "photo_id")
        .agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("bigint").alias("links"))
        .where("links > 0").select("group", "links")
    )
    if exceptions is not None:
        ends = _pairs_of(exceptions, placed, "group", "cluster_id", "photo_id").where("group_a = group_b AND cluster_id_a <> cluster_id_b")
        sign = F.when(F.col("reason") == "absent", -1).when(F.col("photo_id_a") != F.col("photo_id_b"), 1).otherwise(0)
        counts = counts.union(ends.select("group_a", sign.cast("bigint")))
    return counts.groupBy("group").agg(F.sum("links").alias("links")).where("links > 0")


def same_photo_links(faces: DataFrame) -> DataFrame:
    """Unordered pairs of faces in one photo, smaller id first.

    The relation written out, for whoever wants the pairs themselves.
    """
    a = faces.select("photo_id", F.col("id").alias("face_id_a"))
    b = faces.select("photo_id", F.col("id").alias("face_id_b"))
    return a.join(b, "photo_id").where(F.col("face_id_a") < F.col("face_id_b")).select(
        "face_id_a", "face_id_b", "photo_id"
    )


def link_completeness(pictures: DataFrame, faces: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Links expected from the stored face counts, sum of n(n-1)/2, against those the faces have."""
    expected = pictures.agg(
        F.coalesce(
            F.sum(
                F.expr("cast(face_count as bigint) * (cast(face_count as bigint) - 1) div 2")
            ),
            F.lit(0),
        ).alias("expected")
    )
    there = faces.groupBy(packed(F.col("photo_id"))).agg(F.count(F.lit(1)).alias("n")).select(F.expr("n * (n - 1) div 2").alias("links"))
    if exceptions is not None:
        pairs = _pairs_of(exceptions, faces, "photo_id")
        within = F.col("photo_id_a") == F.col("photo_id_b")
        # A pair repeated within its photo is there already; one across photos is one too many.
        sign = F.when((F.col("reason") == "absent") & within, -1).when((F.col("reason") == "same_photo") & ~within, 1).otherwise(0)
        there = there.union(pairs.select(sign.cast("bigint")))
    actual = there.agg(F.coalesce(F.sum("links"), F.lit(0)).cast("bigint").alias("actual"))
    return expected.crossJoin(F.broadcast(actual))
