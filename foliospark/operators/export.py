"""Placements of translated text, best layers, transcripts, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from . import candidates as C
from .pages import met

#: Text style by region type; others have the default one.
TYPE_PRESETS = {"sfx": "shout", "narration": "caption", "caption": "caption", "side_text": "whisper"}


def unit_ranks(unit_regions: DataFrame, order: DataFrame) -> DataFrame:
    """(page_id, unit_id, rank): place of a unit's first placed region, null if it has none."""
    joined = unit_regions.join(order.select("region_id", "reading_order"), "region_id", "left")
    return joined.groupBy("page_id", "unit_id").agg(F.min_by("reading_order", F.when(F.col("reading_order").isNotNull(), F.col("pos"))).alias("rank"))


def placements(unit_regions: DataFrame, regions: DataFrame, units: DataFrame, order: DataFrame, skip_types: tuple[str, ...] = ()) -> DataFrame:
    """One row a unit to typeset, in reading order (place): its selected text over the box around its regions.

    Units without text or regions, of ignored regions alone, or whose first region has a type to skip are left out. Where
    regions have an outline, a unit of a single region has that; of several it has none.
    """
    shaped = ["outline"] if "outline" in regions.columns else []
    rows = unit_regions.join(regions.select("region_id", "x", "y", "w", "h", "type", "status", *shaped), "region_id")
    outline = [F.when(F.count("*") == 1, F.first("outline")).alias(c) for c in shaped]
    boxes = rows.groupBy("page_id", "unit_id").agg(*B.union_of(), F.min_by("type", "pos").alias("type"), F.bool_and(F.col("status") == "ignore").alias("ignored"), *outline)
    preset = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_PRESETS.items() for x in kv]), F.col("type")), F.lit("default"))
    texts = units.select("unit_id", C.selected_text(F.col("candidates"), F.col("selected")).alias("text")).filter("text <> ''")
    kept = boxes.filter(~F.col("ignored") & ~F.col("type").isin(*skip_types) if skip_types else ~F.col("ignored"))
    ranked = kept.join(texts, "unit_id").join(unit_ranks(unit_regions, order), ["page_id", "unit_id"])
    w = Window.partitionBy("page_id").orderBy(F.col("rank").asc_nulls_last(), "unit_id")
    return ranked.withColumn("place", F.row_number().over(w) - 1).select("page_id", "unit_id", "place", "text", "x", "y", "w", "h", preset.alias("preset"), *shaped)


def page_layers(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(page_id, layer, path, overflow): the last render, else the last mask, else the page's own image."""
    last = artifacts.groupBy("page_id").pivot("kind", ["render", "mask"]).agg(F.max_by(F.struct("path", "overflow"), "seq"))
    joined = pages.join(last, "page_id", "left")
    has_r, has_m = F.col("render").isNotNull(), F.col("mask").isNotNull()
    return joined.select(
        "page_id", F.when(has_r, "render").when(has_m, "masked").otherwise("original").alias("layer"),
        F.coalesce("render.path", "mask.path", "image_path").alias("path"), F.coalesce("render.overflow", F.lit(0)).alias("overflow"),
    )


def transcript(unit_regions: DataFrame, spans: DataFrame, units: DataFrame, order: DataFrame) -> DataFrame:
    """(page_id, n, line): numbered lines "[n] source -> translation" of all spans of a unit, in reading order."""
    joined = unit_regions.join(spans.select("region_id", "seq", "text"), "region_id", "left")
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "seq", "text"))))
    source = joined.groupBy("page_id", "unit_id").agg(F.array_join(F.transform(texts, lambda s: s["text"]), " ").alias("source"))
    ranked = source.join(unit_ranks(unit_regions, order), ["page_id", "unit_id"]).join(units.select("unit_id", C.selected_text(F.col("candidates"), F.col("selected")).alias("target")), "unit_id")
    w = Window.partitionBy("page_id").orderBy(F.col("rank").asc_nulls_last(), "unit_id")
    numbered = ranked.withColumn("n", F.row_number().over(w))
    return numbered.select("page_id", "n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("source"), F.lit("  ->  "), F.col("target")).alias("line"))


def lineage(unit_regions: DataFrame, regions: DataFrame, spans: DataFrame, units: DataFrame, order: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(page_id, mapping): units of a page in order with their regions, spans, candidates and edits, as JSON.

    Regions that are not there are left out. log(unit_id, seq, action, before, after, editor) may be missing; with page_id its
    edits are looked up within the page.
    """
    # what belongs to a region, then what belongs to a unit, meets in one aggregation of the page: joins by id would shuffle it all again
    mine = regions.select("page_id", "region_id", F.struct("type", "status", "x", "y", "w", "h").alias("_r"))
    seen = spans.select("page_id", "region_id", F.struct("seq", "text", "confidence").alias("_s"))
    placed = order.select("page_id", "region_id", F.col("reading_order").alias("_o"))
    used = unit_regions.select("page_id", "region_id", F.struct("unit_id", "pos").alias("_u"))
    texts = F.transform(F.array_sort(F.collect_list("_s")), lambda s: F.struct(s["text"].alias("text"), s["confidence"].alias("confidence")))
    found = met(["page_id", "region_id"], [used, mine, seen, placed], F.collect_list("_u").alias("_u"), F.first("_r", ignorenulls=True).alias("_r"), texts.alias("spans"), F.min("_o").alias("_o"))
    rows = found.select("page_id", "region_id", "_r", "spans", "_o", F.explode("_u").alias("_u")).select("*", "_u.*")
    region = F.when(F.col("_r").isNotNull(), F.struct("pos", "region_id", "_r.type", "_r.status", "_r.x", "_r.y", "_r.w", "_r.h", "spans"))
    parts = [rows.select("page_id", "unit_id", region.alias("_r"), F.when(F.col("_o").isNotNull(), F.struct("pos", "_o")).alias("_o")), units.select("page_id", "unit_id", F.struct("candidates", "selected").alias("_c"))]
    edits, paged = [], log is not None and "page_id" in log.columns
    if paged:
        parts.append(log.select("page_id", "unit_id", F.struct("seq", "action", "before", "after", "editor").alias("_e")))
        edits = [F.when(F.count("_e") > 0, F.array_sort(F.collect_list("_e"))).alias("edits")]
    listed = F.array_sort(F.collect_list("_r")).alias("regions")
    full = met(["page_id", "unit_id"], parts, listed, F.min("_o")["_o"].alias("rank"), F.first("_c", ignorenulls=True).alias("_c"), *edits).filter(F.size("regions") > 0).select("*", "_c.*")
    if log is not None and not paged:
        edits = F.array_sort(F.collect_list(F.struct("seq", "action", "before", "after", "editor")))
        full = full.join(log.groupBy("unit_id").agg(edits.alias("edits")), "unit_id", "left")
    item = F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "unit_id", "regions", "candidates", "selected", *(["edits"] if log is not None else []))
    return full.groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("mapping"))
