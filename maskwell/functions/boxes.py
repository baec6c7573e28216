"""Axis-parallel boxes: struct<x0, y0, x1, y1> in display space, origin top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_fraction(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies in ``b``; 0 for an empty ``a``."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    whole = area(a) + area(b) - inter
    return F.when(whole > 0, inter / whole).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return make(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def to_display(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> Column:
    """User space (origin bottom left, unrotated width x height) to display space."""
    dx = F.when(rotation == 0, x).when(rotation == 90, y).when(rotation == 180, width - x).when(rotation == 270, height - y)
    dy = F.when(rotation == 0, height - y).when(rotation == 90, x).when(rotation == 180, y).when(rotation == 270, width - x)
    return F.struct(dx.alias("x"), dy.alias("y"))


def to_points(px: Column, dpi: float) -> Column:
    return px * F.lit(72.0) / F.lit(float(dpi))
