"""From raw boxes to regions: shape rules, suppression, merging."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B

#: Fixed value: class order of a detection model.
CLASS_LABELS = ("bubble", "narration", "sfx", "caption")


def shape_type(w: Column, h: Column) -> Column:
    """Type guess from the aspect ratio."""
    return F.when(w / h >= 2.5, "narration").when(w / h <= 0.4, "side_text").otherwise("bubble")


def blob_confidence(fill: Column, area_frac: Column) -> Column:
    """Unrounded score of a blob from how full and how large it is."""
    plausible = F.when((area_frac >= 0.003) & (area_frac <= 0.25), 1.0).otherwise(0.6)
    return F.least(F.lit(1.0), (F.lit(0.4) + F.lit(0.5) * fill) * plausible)


def class_type(index: Column, labels: tuple[str, ...] = CLASS_LABELS) -> Column:
    """Type of a model's class number, unknown if out of range."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), index), F.lit("unknown"))


def sfx_type(kind: Column, w: Column, h: Column, page_w: float, page_h: float, min_area: float = 0.02, aspect: float = 2.2) -> Column:
    """Unknown regions that are large and stretched become sfx; other types stay."""
    sound = (w > 0) & (h > 0) & (w * h / (page_w * page_h) >= min_area) & ((w / h >= aspect) | (w / h <= 1.0 / aspect))
    return F.when((kind == "unknown") & sound & F.lit(page_w * page_h > 0), "sfx").otherwise(kind)


def _per_page(regions: DataFrame, order: list[Column], fields: list[str]) -> DataFrame:
    """Each page's regions as one array, in a total order. A page is bounded: regions of one image."""
    item = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(f) for f in fields])
    return regions.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def nms(regions: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Regions kept by greedy suppression within their page: most confident first, then input order.

    A region stays if it overlaps none already kept beyond the threshold (IoU). regions(page_id, rn, region_id,
    x, y, w, h, confidence); a null confidence comes last.
    """
    fields = ["region_id", "rn", "x", "y", "w", "h"]
    pages = _per_page(regions, [-F.coalesce(F.col("confidence"), F.lit(-1.0)), F.col("rn")], fields)
    kind = pages.schema["items"].dataType.simpleString()
    kept = F.aggregate("items", F.array().cast(kind), lambda got, r: F.when(F.exists(got, lambda k: B.iou(k, r) > threshold), got).otherwise(F.concat(got, F.array(r))))
    return pages.select("page_id", F.explode(kept).alias("r")).select("page_id", "r.region_id", "r.rn")


def merge_overlaps(regions: DataFrame, share: float = 0.2) -> DataFrame:
    """Clusters of overlapping regions of a page, each as one region.

    Two regions join if they share at least `share` of the smaller one; the relation is transitive. A cluster of
    several has the box around all, the least confidence, the type of its largest member (first in input order on
    a tie) and state auto. Ignored regions pass through alone. Result: page_id, first (least rn), members, x, y, w, h,
    type, confidence, status.
    """
    fields = ["rn", "x", "y", "w", "h"]
    pages = _per_page(regions.filter("status <> 'ignore'"), [F.col("rn")], fields)
    kind = pages.schema["items"].dataType.simpleString()

    def step(groups: Column, r: Column) -> Column:
        def touches(g: Column) -> Column:
            return F.exists(g, lambda m: (B.overlap_of_smaller(m, r) > 0) & (B.overlap_of_smaller(m, r) >= share))

        return F.concat(F.filter(groups, lambda g: ~touches(g)), F.array(F.concat(F.flatten(F.filter(groups, touches)), F.array(r))))

    groups = F.aggregate("items", F.array().cast(f"array<{kind}>"), step)
    clusters = pages.select("page_id", F.explode(groups).alias("g")).select("page_id", F.array_min(F.transform("g", lambda m: m["rn"])).alias("first"), F.explode("g").alias("m"))
    member = clusters.select("page_id", "first", F.col("m.rn").alias("rn"))
    full = regions.join(member, ["page_id", "rn"])
    many = full.groupBy("page_id", "first").agg(
        F.count("*").alias("members"), *B.union_of(), F.max_by("type", F.struct(F.col("w") * F.col("h"), -F.col("rn"))).alias("type"),
        F.min("confidence").alias("confidence"), F.when(F.count("*") > 1, "auto").otherwise(F.min("status")).alias("status"),
    )
    alone = regions.filter("status = 'ignore'").select("page_id", F.col("rn").alias("first"), F.lit(1).cast("long").alias("members"), "x", "y", "w", "h", "type", "confidence", "status")
    return many.unionByName(alone)


def content_segments(ticks: DataFrame, key: str, place: str, min_gap: int) -> DataFrame:
    """Runs of inked places, cut where at least min_gap places between two are empty: (key, start, end), end exclusive."""
    w = Window.partitionBy(key).orderBy(place)
    cut = F.coalesce(F.col(place) - F.lag(place).over(w) - 1 >= min_gap, F.lit(False))
    runs = ticks.select(key, place).distinct().withColumn("cut", cut.cast("int")).withColumn("run", F.sum("cut").over(w))
    return runs.groupBy(key, "run").agg(F.min(place).alias("start"), (F.max(place) + 1).alias("end")).drop("run")


def model_regions(rows: DataFrame, width: float, height: float, scale: float = 1.0, pad_x: float = 0.0, pad_y: float = 0.0, least: float = 0.3, threshold: float = 0.45, labels: tuple[str, ...] = CLASS_LABELS) -> DataFrame:
    """Regions (page_id, place, x, y, w, h, type, confidence) of a model's raw rows(page_id, rn, x1, y1, x2, y2, score, cls).

    Back to the page's pixels, scores cut to 0..1, those under least gone, suppression, cut to the page, from the top left.
    """
    raw = F.struct("x1", "y1", "x2", "y2")
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))), 3)
    found = rows.select("page_id", "rn", B.decoded(raw, scale, pad_x, pad_y).alias("b"), class_type(F.bround("cls").cast("int"), labels).alias("type"), score.alias("confidence")).filter(F.col("confidence") >= least)
    flat = found.select("page_id", "rn", F.col("rn").cast("string").alias("region_id"), "b.*", "type", "confidence")
    kept = flat.join(nms(flat, threshold).select("page_id", "rn"), ["page_id", "rn"], "left_semi")
    cut = kept.withColumn("c", B.clamped(B.box(), width, height)).filter("c is not null")
    out = cut.select("page_id", "rn", "c.*", "type", "confidence")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "rn")) - 1)


def quad_regions(rows: DataFrame, confidence: float = 0.9) -> DataFrame:
    """rows(page_id, polys, texts, scores): a region (page_id, place, x, y, w, h, confidence, text, text_confidence) for each outline.

    polys: outlines as arrays of arrays of numbers; a point without two of them is no point, an outline of fewer than three
    none. texts and scores run beside them and may be shorter or null; without texts at all outlines count alone, else one
    without a text goes. Boxes under a pixel go. From the top left.
    """
    points = lambda poly: F.filter(poly, lambda q: F.size(q) >= 2)
    each = rows.select("page_id", "texts", "scores", F.posexplode("polys").alias("i", "poly")).withColumn("p", points(F.col("poly"))).filter(F.size("p") >= 3)
    xs, ys = F.transform("p", lambda q: F.get(q, F.lit(0))), F.transform("p", lambda q: F.get(q, F.lit(1)))
    boxed = each.select("page_id", "i", F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"), F.get("texts", F.col("i")).alias("text"), F.get("scores", F.col("i")).alias("text_confidence"), F.col("texts").isNull().alias("_bare"))
    kept = boxed.filter((F.col("w") >= 1) & (F.col("h") >= 1) & (F.col("_bare") | F.col("text").isNotNull()))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "i")) - 1
    return kept.select("page_id", place.alias("place"), "x", "y", "w", "h", F.coalesce("text_confidence", F.lit(confidence)).alias("confidence"), "text", "text_confidence")


def joined_lines(texts: Column, scores: Column) -> Column:
    """struct(text, confidence) of a recogniser's lines: texts one a line, the mean of the scores that are there, to three digits.

    Scores beside missing texts do not count; scores may be fewer than texts.
    """
    some = F.filter(F.transform(texts, lambda t, i: F.struct(t.alias("t"), F.get(scores, i).alias("s"))), lambda p: p["t"].isNotNull())
    known = F.filter(F.transform(some, lambda p: p["s"]), lambda s: s.isNotNull())
    mean = F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda a, s: a + s) / F.size(known), 3))
    return F.struct(F.array_join(F.transform(some, lambda p: p["t"]), "\n").alias("text"), mean.alias("confidence"))


class Unavailable(RuntimeError):
    """An engine's model or library is not there."""


def with_fallback(primary: Callable[[DataFrame], DataFrame], fallback: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The first engine, or the second from the first time on that the first raises Unavailable while its plan is built."""
    chosen: list[Callable[[DataFrame], DataFrame]] = []

    def run(pages: DataFrame) -> DataFrame:
        if not chosen:
            try:
                out = primary(pages)
            except Unavailable as error:
                warnings.warn(f"engine unavailable, falling back: {error}", stacklevel=2)
                chosen.append(fallback)
                return fallback(pages)
            chosen.append(primary)
            return out
        return chosen[0](pages)

    return run


def merging(engine: Callable[[DataFrame], DataFrame], share: float = 0.2) -> Callable[[DataFrame], DataFrame]:
    """The engine with overlapping regions of a page merged; texts of merged ones are dropped."""

    def run(pages: DataFrame) -> DataFrame:
        w = Window.partitionBy("page_id").orderBy("y", "x", "w", "h")
        found = engine(pages).withColumn("rn", F.row_number().over(w))
        texts = [c for c in ("text", "text_confidence") if c in found.columns]
        merged = merge_overlaps(found, share)
        alone = found.select("page_id", F.col("rn").alias("first"), *texts)
        out = merged.join(alone, ["page_id", "first"], "left")
        single = F.col("members") == 1
        return out.withColumns({c: F.when(single, F.col(c)) for c in texts}).drop("members", "first")

    return run
