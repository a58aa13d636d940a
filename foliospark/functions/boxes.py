"""Box algebra as Column expressions. A box is a struct with x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column | str = "x", y: Column | str = "y", w: Column | str = "w", h: Column | str = "h") -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in (x, y, w, h)]
    return F.struct(*[c.alias(n) for c, n in zip(cols, "xywh")])


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def _share(part: Column, whole: Column) -> Column:
    return F.when((part > 0) & (whole > 0), part / whole).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area, 0 for disjoint or degenerate boxes."""
    return _share(intersection(a, b), area(a) + area(b) - intersection(a, b))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Shared area over the smaller box's area, 0 for disjoint or degenerate boxes."""
    return _share(intersection(a, b), F.least(area(a), area(b)))


def overlap_y(a: Column, b: Column) -> Column:
    """Shared height over the lesser height, 0 if that is 0."""
    shared = F.greatest(F.lit(0.0), F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]))
    lesser = F.least(a["h"], b["h"])
    return F.when(lesser > 0, shared / lesser).otherwise(F.lit(0.0))


def gap(a: Column, b: Column) -> Column:
    """Distance between the edges over the mean height; infinite if the heights are 0."""
    dx = F.greatest(F.lit(0.0), F.greatest(a["x"], b["x"]) - F.least(right(a), right(b)))
    dy = F.greatest(F.lit(0.0), F.greatest(a["y"], b["y"]) - F.least(bottom(a), bottom(b)))
    mean = (a["h"] + b["h"]) / 2
    return F.when(mean > 0, F.sqrt(dx * dx + dy * dy) / mean).otherwise(F.lit(float("inf")))


def union_of(prefix: str = "") -> list[Column]:
    """Aggregates of the box around a group's boxes."""
    x, y = F.min("x"), F.min("y")
    return [x.alias(f"{prefix}x"), y.alias(f"{prefix}y"), (F.max(F.col("x") + F.col("w")) - x).alias(f"{prefix}w"), (F.max(F.col("y") + F.col("h")) - y).alias(f"{prefix}h")]


def clamped(b: Column, width: float, height: float) -> Column:
    """The box cut to the page; null if less than one pixel of it is left in either direction."""
    x0, y0 = (F.least(F.greatest(F.lit(0.0), v), F.lit(float(n))) for v, n in ((b["x"], width), (b["y"], height)))
    x1, y1 = (F.least(F.greatest(F.lit(0.0), v), F.lit(float(n))) for v, n in ((right(b), width), (bottom(b), height)))
    cut = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return F.when((x1 - x0 >= 1) & (y1 - y0 >= 1), cut)


def pixel_box(b: Column, width: int, height: int, pad: int) -> Column:
    """Whole-pixel edges (x0, y0, x1, y1) around the box, padded and cut to the image; null if nothing is left."""
    x0, y0 = F.greatest(F.lit(0), F.floor(b["x"]) - pad), F.greatest(F.lit(0), F.floor(b["y"]) - pad)
    x1, y1 = F.least(F.lit(width), F.ceil(right(b)) + pad), F.least(F.lit(height), F.ceil(bottom(b)) + pad)
    edges = F.struct(*[v.cast("long").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])
    return F.when((x1 > x0) & (y1 > y0), edges)


def decoded(row: Column, scale: float, pad_x: float, pad_y: float) -> Column:
    """A model's (x1, y1, x2, y2) in letterboxed space as a box of the source image."""
    x, y = (F.least(row["x1"], row["x2"]) - pad_x) / scale, (F.least(row["y1"], row["y2"]) - pad_y) / scale
    w, h = F.abs(row["x2"] - row["x1"]) / scale, F.abs(row["y2"] - row["y1"]) / scale
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
