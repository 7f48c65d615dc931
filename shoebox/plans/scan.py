"""From detections to faces: scale plan, suppression, ordinals, queue, storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry
from ..functions.hashing import canonical_json, sha256_hex
from ..functions.packing import packed, unpacked
from ..operators.numbering import index_in_group
from ..operators.rules import RuleViolation
from ..operators.tables import delete_keys, upsert
from ..session import cut_lineage

SCAN_STATES = ("pending", "processing", "complete", "error")


def scan_key(photo_id: Column, source_fingerprint: Column, pipeline_key: str) -> Column:
    return sha256_hex(
        canonical_json(
            photo_id=photo_id, source_fingerprint=source_fingerprint, pipeline_key=F.lit(pipeline_key)
        )
    )


def scale_plan(pictures: DataFrame, edges: Sequence[int]) -> DataFrame:
    """Distinct scaled sizes per photo; images are never enlarged.

    The first edge giving a size keeps it. Sizes round half to even.
    """
    longest = F.greatest("width", "height").cast("double")
    steps = pictures.select(
        "id", "width", "height",
        F.posexplode(F.array(*[F.lit(int(e)) for e in edges])).alias("step", "edge"),
    ).withColumn("scale", F.least(F.lit(1.0), F.col("edge") / longest))
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * F.col("scale")).cast("int"))
    sized = steps.select("id", "step", "scale", side("width").alias("scaled_width"), side("height").alias("scaled_height"))
    return sized.groupBy("id", "scaled_width", "scaled_height").agg(
        F.min("step").alias("step"), F.min_by("scale", "step").alias("scale")
    )


# Suppression -----------------------------------------------------------------

def _rank_struct() -> Column:
    return F.struct(
        (-F.bround("score", 6)).alias("k1"), (-F.bround(F.col("w") * F.col("h"), 4)).alias("k2"),
        F.bround("y", 4).alias("k3"), F.bround("x", 4).alias("k4"), F.col("det_id").alias("k5"),
    )


def _keep_in_order(boxes: Column, threshold: float) -> Column:
    """Fold a ranked array of boxes into those no kept box overlaps."""
    def step(kept: Column, box: Column) -> Column:
        overlaps = F.exists(
            kept,
            lambda k: geometry.iou(*[k[c] for c in "xywh"], *[box[c] for c in "xywh"]) >= threshold,
        )
        return F.when(overlaps, kept).otherwise(F.array_append(kept, box))

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)


def _overlaps(boxes: DataFrame, threshold: float) -> DataFrame:
    """(photo_id, winner, loser) for overlapping boxes of one photo.

    Two boxes overlapping by IoU t > 0 have widths within a factor t of each
    other, and heights too, so boxes are put in classes of a factor a little
    over 1/t of either side, and into grid cells as wide and as high as their
    classes; a partner can only be in the same or the next class and in an
    adjoining cell. (With 1/t itself, rounding would put partners at the very
    edge two classes apart.) A column or a row of boxes is spread over cells
    like any other crowd.
    """
    base = F.lit((1.0 + 1e-6) / threshold)
    level = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1e-9))) / F.log(base)).cast("int")
    placed = boxes.withColumn("lw", level("w")).withColumn("lh", level("h"))
    cell = lambda c, at: F.floor(F.col(c) / F.pow(base, F.col(at) + 1)).cast("bigint")
    next_to = F.expr("sequence(-1L, 1L)")
    # Wide: a box is listed under its own class, and looked up from its own and
    # the class below. High: both are listed under their own class and the next.
    tall = placed.withColumn("ah", F.explode(F.array("lh", F.col("lh") + 1)))
    home = tall.withColumn("aw", F.col("lw")).withColumn("gx", cell("x", "aw")).withColumn("gy", cell("y", "ah"))
    looks = (
        tall.withColumn("aw", F.explode(F.array("lw", F.col("lw") + 1)))
        .withColumn("sx", F.explode(next_to)).withColumn("sy", F.explode(next_to))
        .withColumn("gx", F.col("sx") + cell("x", "aw")).withColumn("gy", F.col("sy") + cell("y", "ah"))
    )
    key, mine = ["photo_id", "aw", "ah", "gx", "gy"], ("det_id", "rank", "x", "y", "w", "h", "lh")
    a = home.select(*key, *[F.col(c).alias(f"a_{c}") for c in mine])
    b = looks.select(*key, "lw", *[F.col(c).alias(f"b_{c}") for c in mine])
    joined = a.join(b, key).where((F.col("a_det_id") != F.col("b_det_id")) & (F.col("ah") == F.greatest("a_lh", "b_lh")))
    # The same class of widths meets twice, once from each side: keep one.
    once = (F.col("lw") != F.col("aw")) | (F.col("a_det_id") < F.col("b_det_id"))
    hit = geometry.iou(*[F.col(f"a_{c}") for c in "xywh"], *[F.col(f"b_{c}") for c in "xywh"]) >= threshold
    first = F.col("a_rank") < F.col("b_rank")
    return joined.where(once & hit).select(
        "photo_id",
        F.when(first, F.col("a_det_id")).otherwise(F.col("b_det_id")).alias("winner"),
        F.when(first, F.col("b_det_id")).otherwise(F.col("a_det_id")).alias("loser"),
    )


def _suppress_rounds(boxes: DataFrame, threshold: float) -> DataFrame:
    """Greedy suppression by rounds: a box with no open better overlap stays."""
    edges = cut_lineage(_overlaps(boxes, threshold), "overlaps")
    open_ = boxes.select("photo_id", "det_id")
    kept: DataFrame | None = None
    while True:
        open_ = cut_lineage(open_, "open")
        if open_.isEmpty():
            break
        losers = edges.select("photo_id", F.col("loser").alias("det_id")).distinct()
        stay = cut_lineage(open_.join(losers, ["photo_id", "det_id"], "left_anti"), "stay")
        kept = stay if kept is None else kept.unionByName(stay)
        beaten = cut_lineage(
            edges.join(stay.withColumnRenamed("det_id", "winner"), ["photo_id", "winner"], "left_semi")
            .select("photo_id", F.col("loser").alias("det_id")).distinct(),
            "beaten",
        )
        decided = stay.unionByName(beaten)
        open_ = open_.join(decided, ["photo_id", "det_id"], "left_anti")
        gone = decided.distinct()
        edges = cut_lineage(
            edges.join(gone.withColumnRenamed("det_id", "winner"), ["photo_id", "winner"], "left_anti")
            .join(gone.withColumnRenamed("det_id", "loser"), ["photo_id", "loser"], "left_anti"),
            "overlaps",
        )
    return boxes.select("photo_id", "det_id").limit(0) if kept is None else kept


def suppress_overlaps(
    detections: DataFrame, *, threshold: float = 0.35, minimum_px: float = 24.0, group_rows: int = 4096
) -> DataFrame:
    """Greedy non-maximum suppression per photo, then the minimum face size.

    ``detections``: (photo_id, det_id, x, y, w, h, score). Order: score, area
    (both descending), y, x, det_id. Pictures with up to ``group_rows``
    detections are folded as one sorted array each, inside the JVM; larger
    ones are settled by rounds of joins.
    """
    columns = detections.columns
    number = {c: F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")}
    sized = detections.select(*[number.get(c, F.col(c)) for c in columns], _rank_struct().alias("rank"))
    crowded = (
        detections.groupBy(packed(F.col("photo_id")).alias("_photo")).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > group_rows).select(unpacked(F.col("_photo")).alias("photo_id"))
    )
    usual, big = sized, None
    if not crowded.isEmpty():
        usual = sized.join(crowded, "photo_id", "left_anti")
        big = cut_lineage(sized.join(crowded, "photo_id", "left_semi"), "crowded")
    # The fold carries whole rows, so survivors need no join back; the shuffle
    # has each number once and ids as bytes, the rank is made behind it.
    rest = [c for c in columns if c not in ("photo_id", "det_id")]
    sent = usual.select(packed(F.col("photo_id")).alias("_photo"), packed(F.col("det_id")).alias("_det"), *rest)
    sent = sent.repartition("_photo").select("_photo", unpacked(F.col("_det")).alias("det_id"), *rest).withColumn("rank", _rank_struct())
    box = F.struct("rank", *[c for c in columns if c != "photo_id"])
    kept = (
        sent.groupBy("_photo")
        .agg(F.sort_array(F.collect_list(box)).alias("_boxes"))
        .select("_photo", F.explode(_keep_in_order(F.col("_boxes"), threshold)).alias("_b"))
        .select(*[unpacked(F.col("_photo")).alias(c) if c == "photo_id" else F.col(f"_b.{c}") for c in columns])
    )
    if big is not None:
        settled = _suppress_rounds(big, threshold)
        kept = kept.unionByName(big.join(settled, ["photo_id", "det_id"], "left_semi").select(*columns))
    return kept.where(F.least("w", "h") >= minimum_px)


def face_ordinals(detections: DataFrame) -> DataFrame:
    """Ordinal per photo by rounded top, left, bottom, right, then -score."""
    order = [
        F.bround("y", 4), F.bround("x", 4), F.bround(F.col("y") + F.col("h"), 4),
        F.bround(F.col("x") + F.col("w"), 4), -F.bround("score", 6), F.col("det_id"),
    ]
    return index_in_group(detections, ["photo_id"], order, "ordinal")


def face_id(scan: Column, ordinal: Column, box: Sequence[Column], landmarks: Column) -> Column:
    """f_ + 32 hex over canonical JSON of key, ordinal and 7-digit geometry.

    Numbers are written as fixed seven-digit text, so the identity does not
    depend on how an engine prints floats.
    """
    text = lambda v: F.format_string("%.7f", v)
    body = F.to_json(
        F.struct(
            F.array(*[text(b) for b in box]).alias("bbox"),
            F.transform(landmarks, text).alias("landmarks"),
            ordinal.cast("int").alias("ordinal"),
            scan.alias("scan_key"),
        )
    )
    return F.concat(F.lit("f_"), F.substring(sha256_hex(body), 1, 32))


# Queue and storage -----------------------------------------------------------

def reset_interrupted(pictures: DataFrame) -> DataFrame:
    return pictures.withColumn(
        "scan_status",
        F.when(F.col("scan_status") == "processing", "pending").otherwise(F.col("scan_status")),
    )


def work_queue(pictures: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending and failed pictures by position; interrupted ones count as pending."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    queue = reset_interrupted(pictures).where(F.col("scan_status").isin("pending", "error")).orderBy(
        "album_position", "id"
    )
    return queue if limit is None else queue.limit(limit)


def register_pictures(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert scan inputs; results survive only under an unchanged scan key."""
    same = F.col("_old.scan_key") == F.col("_new.scan_key")
    carry = lambda name, default: F.when(same, F.col(f"_old.{name}")).otherwise(default)
    return upsert(
        stored, incoming, ["id"], keep=["attempt_count"],
        computed={
            "scan_status": carry("scan_status", F.lit("pending")),
            "face_count": carry("face_count", F.lit(0)),
            "scan_error": carry("scan_error", F.lit(None)),
            "processed_at": carry("processed_at", F.lit(None)),
            "attempt_count": F.coalesce("_old.attempt_count", F.lit(0)),
        },
    )


def record_failures(pictures: DataFrame, failures: DataFrame) -> DataFrame:
    """(id, message) outcomes: status error, message cut to 1000, attempt + 1."""
    f = failures.groupBy("id").agg(F.max("message").alias("_message"))
    joined = pictures.join(f, "id", "left")
    hit = F.col("_message").isNotNull()
    return joined.select(
        *[
            F.when(hit, "error").otherwise(F.col(c)).alias(c) if c == "scan_status"
            else F.when(hit, F.left("_message", F.lit(1000))).otherwise(F.col(c)).alias(c) if c == "scan_error"
            else F.when(hit, F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == "attempt_count"
            else F.col(c)
            for c in pictures.columns
        ]
    )


def replace_faces(
    pictures: DataFrame, faces: DataFrame, cannot_links: DataFrame, incoming: DataFrame, scanned: DataFrame,
    *, now: Column,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace all faces of the scanned pictures.

    The links of a photo's faces follow from the faces; of the exceptions in
    ``cannot_links``, those of faces that are gone go too.
    ``scanned`` lists photo ids, since a photo may now have no face. Refuses
    when any of them already carries a review decision.
    """
    ids = scanned.select(F.col("id").alias("photo_id")).distinct()
    old = faces.join(ids, "photo_id", "left_semi")
    reviewed = old.where((F.col("status") != "unreviewed") | F.col("person_id").isNotNull()).head(1)
    if reviewed:
        raise RuleViolation(f"photo {reviewed[0]['photo_id']} was already reviewed")
    gone = old.select("id")
    new_faces = faces.join(ids, "photo_id", "left_anti").select(*faces.columns).unionByName(
        incoming.select(*[c for c in faces.columns if c in incoming.columns]), allowMissingColumns=True
    )
    links = delete_keys(cannot_links, gone.withColumnRenamed("id", "face_id_a"), ["face_id_a"])
    links = delete_keys(links, gone.withColumnRenamed("id", "face_id_b"), ["face_id_b"])
    counts = ids.join(incoming.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n")), "photo_id", "left")
    c = counts.select(F.col("photo_id").alias("id"), F.coalesce("n", F.lit(0)).alias("_n"))
    joined = pictures.join(c, "id", "left")
    hit = F.col("_n").isNotNull()
    done = {
        "scan_status": F.lit("complete"), "face_count": F.col("_n").cast("int"),
        "scan_error": F.lit(None).cast("string"), "processed_at": now.cast("string"),
    }
    new_pictures = joined.select(
        *[F.when(hit, done[x]).otherwise(F.col(x)).alias(x) if x in done else F.col(x) for x in pictures.columns]
    )
    return new_pictures, new_faces, links
