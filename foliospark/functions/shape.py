"""Scanlines through polygons given as arrays of struct(x, y)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's argument is, an expression used several times is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanline_span(polygon: Column, y: Column) -> Column:
    """struct(l, r) of the outermost crossings of the line at y; null with fewer than two, or three points.

    An edge counts where its lower end is at or above the line and its upper end is beyond it.
    """

    def crossings(points: Column) -> Column:
        def crossing(a: Column, i: Column) -> Column:
            b = F.get(points, F.pmod(i + 1, F.size(points)))
            hit = (F.least(a["y"], b["y"]) <= y) & (y < F.greatest(a["y"], b["y"]))
            return F.when(hit, a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]))

        return F.when(F.size(points) >= 3, F.filter(F.transform(points, crossing), lambda x: x.isNotNull()))

    outermost = lambda xs: F.when(F.size(xs) >= 2, F.struct(F.array_min(xs).alias("l"), F.array_max(xs).alias("r")))
    return let(let(polygon, crossings), outermost)


def band_inner(polygon: Column, top: Column, bottom: Column, samples: int = 5) -> Column:
    """struct(l, r) inside the polygon on all of `samples` lines from top to bottom; null if there is none."""

    def inner(points: Column) -> Column:
        return F.transform(F.array(*[top + (bottom - top) * i / (samples - 1) for i in range(samples)]), lambda y: scanline_span(points, y))

    def common(spans: Column) -> Column:
        left, right = F.array_max(F.transform(spans, lambda s: s["l"])), F.array_min(F.transform(spans, lambda s: s["r"]))
        return F.when((bottom >= top) & ~F.exists(spans, lambda s: s.isNull()) & (right > left), F.struct(left.alias("l"), right.alias("r")))

    return let(let(polygon, inner), common)
