"""Confidence of regions, review queue, summaries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import met

THRESHOLD = 0.5
ORDER_LAST = 1 << 30


def region_confidence(regions: DataFrame, spans: DataFrame) -> DataFrame:
    """regions with agg_confidence: the least known of the region's and all its spans' confidences, else null."""
    least = spans.groupBy("region_id").agg(F.min("confidence").alias("_spans"))
    return regions.join(least, "region_id", "left").withColumn("agg_confidence", F.least("confidence", "_spans")).drop("_spans")


def is_low(confidence: Column, threshold: float = THRESHOLD) -> Column:
    """Unknown counts as low."""
    return confidence.isNull() | (confidence < threshold)


def report(regions: DataFrame, spans: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    found = region_confidence(regions, spans)
    return found.agg(
        F.count("*").alias("total"), F.count("agg_confidence").alias("scored"),
        F.count_if(is_low(F.col("agg_confidence"), threshold)).alias("low"), F.count_if(F.col("status") == "needs_review").alias("flagged"),
    )


def flag_low(regions: DataFrame, spans: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Automatic regions of low confidence get state needs_review; no state a person set changes."""
    found = region_confidence(regions, spans)
    status = F.when((F.col("status") == "auto") & is_low(F.col("agg_confidence"), threshold), "needs_review").otherwise(F.col("status"))
    return found.withColumn("status", status)


def ai_flags(unit_regions: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, paged: bool = False) -> DataFrame:
    """(region_id, ai_confidence, ai_flagged) of regions whose unit has an AI candidate; the last unit wins.

    paged: with page_id, and units are looked up within their page.
    """
    if paged:
        ai = candidates.filter("kind = 'ai'").select("page_id", "unit_id", F.struct("ord", F.struct("confidence").alias("c")).alias("_a"))
        units = met(["page_id", "unit_id"], [unit_regions.select("page_id", "unit_id", "region_id"), ai], F.collect_list("region_id").alias("ids"), F.min_by("_a.c", "_a.ord").alias("c"))
        rows = units.filter("c is not null").select("page_id", "unit_id", "c", F.explode("ids").alias("region_id"))
        last = rows.groupBy("page_id", "region_id").agg(F.max_by("c", "unit_id").alias("c"))
        return last.select("page_id", "region_id", F.col("c.confidence").alias("ai_confidence"), is_low(F.col("c.confidence"), threshold).alias("ai_flagged"))
    first = candidates.filter("kind = 'ai'").groupBy("unit_id").agg(F.min_by(F.struct("confidence"), "ord").alias("c"))
    joined = unit_regions.join(first, "unit_id")
    last = joined.groupBy("region_id").agg(F.max_by("c", "unit_id").alias("c"))
    return last.select("region_id", F.col("c.confidence").alias("ai_confidence"), is_low(F.col("c.confidence"), threshold).alias("ai_flagged"))


def review_queue(regions: DataFrame, spans: DataFrame, flags: DataFrame, order: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Regions that are not ignored, those that need attention first, then by page, reading order and id.

    place is the rank over all pages: a range sort, as the queue is one list.
    """
    found = region_confidence(regions.filter("status <> 'ignore'"), spans).join(flags, "region_id", "left").join(order, ["page_id", "region_id"], "left")
    low = is_low(F.col("agg_confidence"), threshold)
    rows = found.select(
        "page_id", "region_id", "reading_order", F.col("agg_confidence").alias("confidence"), low.alias("low_confidence"), "status",
        F.coalesce("ai_flagged", F.lit(False)).alias("ai_flagged"), "ai_confidence",
    )
    first = ~(F.col("low_confidence") | F.col("ai_flagged"))
    keys = [F.when(first, 1).otherwise(0).alias("later"), F.col("page_id"), F.coalesce("reading_order", F.lit(ORDER_LAST)), F.col("region_id")]
    # ranks without one task for all rows: rank within (group, page), plus the rows of the groups and pages before
    inner = Window.partitionBy("later", "page_id").orderBy("_o", "region_id")
    ranked = rows.withColumn("later", keys[0]).withColumn("_o", keys[2]).withColumn("_in", F.row_number().over(inner))
    sizes = ranked.groupBy("later", "page_id").agg(F.count("*").alias("n")).withColumn("_part", F.floor(F.col("page_id") / 4096))
    parts = sizes.groupBy("later", "_part").agg(F.sum("n").alias("m"))
    parts = parts.withColumn("_base", F.coalesce(F.sum("m").over(Window.orderBy("later", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.coalesce(F.sum("n").over(Window.partitionBy("later", "_part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.withColumn("_local", local).join(parts.drop("m"), ["later", "_part"]).select("later", "page_id", (F.col("_base") + F.col("_local")).alias("_before"))
    return ranked.join(before, ["later", "page_id"]).withColumn("place", F.col("_before") + F.col("_in") - 1).drop("later", "_o", "_in", "_before")


def dashboard(pages: DataFrame, regions: DataFrame, spans: DataFrame, units: DataFrame, artifacts: DataFrame, cached: DataFrame) -> DataFrame:
    """(stage, n): how far each of the nine stages has come. cached(page_id): pages with a preprocessed image."""
    per = [
        ("import", pages, F.count("*")), ("preprocess", pages.join(cached.select("page_id").distinct(), "page_id", "left_semi"), F.count("*")),
        ("detect", regions, F.count("*")), ("order", regions, F.count("reading_order")), ("group", units, F.count("*")), ("ocr", spans, F.count("*")),
        ("translate", units, F.count("selected")), ("render", artifacts, F.count_if(F.col("kind") == "mask")), ("compose", artifacts, F.count_if(F.col("kind") == "render")),
    ]
    rows = [df.agg(n.alias("n")).select(F.lit(stage).alias("stage"), "n") for stage, df, n in per]
    return functools.reduce(DataFrame.unionByName, rows)


def project_summary(pages: DataFrame, regions: DataFrame, spans: DataFrame, unit_regions: DataFrame, flags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: regions, units, those of low confidence and those the AI was unsure of, ignored regions included, and rev if pages have it."""
    found = region_confidence(regions, spans).join(flags, "region_id", "left")
    per_page = found.groupBy("page_id").agg(
        F.count("*").alias("n_regions"), F.count_if(is_low(F.col("agg_confidence"), threshold)).alias("n_low"), F.count_if(F.coalesce("ai_flagged", F.lit(False))).alias("n_ai_flagged"),
    )
    n_units = unit_regions.groupBy("page_id").agg(F.countDistinct("unit_id").alias("n_units"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_regions", "n_units", "n_low", "n_ai_flagged")]
    rev = [F.coalesce("rev", F.lit(0)).alias("rev")] if "rev" in pages.columns else []
    return pages.select("page_id", *rev).join(per_page, "page_id", "left").join(n_units, "page_id", "left").select("page_id", *zero, *(["rev"] if rev else []))


def status_counts(regions: DataFrame, spans: DataFrame, unit_regions: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counters of the stages, one row each: (stage, done, total)."""
    conf = region_confidence(regions, spans)
    active = regions.filter("status <> 'ignore'")
    with_text = active.join(spans.select("region_id").distinct(), "region_id", "left_semi")
    with_raw = candidates.filter("kind = 'raw'").select("unit_id").distinct()

    def counter(stage: str, done: DataFrame, total: DataFrame) -> DataFrame:
        return done.agg(F.count("*").alias("done")).crossJoin(total.agg(F.count("*").alias("total"))).select(F.lit(stage).alias("stage"), "done", "total")

    units = unit_regions.select("unit_id").distinct()
    parts = [
        counter("detect", regions.select("page_id").distinct(), regions.select("page_id").distinct()), counter("ocr", with_text, active),
        counter("translate", units.join(with_raw, "unit_id", "left_semi"), units), counter("low", conf.filter(is_low(F.col("agg_confidence"), threshold)), conf),
        counter("flagged", regions.filter("status = 'needs_review'"), regions),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
