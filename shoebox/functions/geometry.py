"""Boxes and face quality."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(value: Column, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(as_col(high), F.greatest(as_col(low), value))


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two (x, y, width, height) boxes."""
    zero = F.lit(0.0)
    inter_w = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    inter_h = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = inter_w * inter_h
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def unit_box(x, y, w, h, image_w, image_h) -> Column:
    """Box scaled to [0, 1]; a side is at least one pixel."""
    return F.struct(
        clamp(x / image_w).alias("bbox_x"),
        clamp(y / image_h).alias("bbox_y"),
        clamp(w / image_w, F.lit(1.0) / image_w).alias("bbox_width"),
        clamp(h / image_h, F.lit(1.0) / image_h).alias("bbox_height"),
    )


def quality_score(score: Column, width_px: Column, height_px: Column, full_px: float = 160.0) -> Column:
    return clamp(score * F.least(F.lit(1.0), F.least(width_px, height_px) / full_px))


def quality_class(
    embedding: Column, width_px: Column, height_px: Column, minimum_px: int = 40
) -> Column:
    usable = embedding.isNotNull() & (F.least(width_px, height_px) >= minimum_px)
    return F.when(usable, "clusterable").otherwise("manual_only")
