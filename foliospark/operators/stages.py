"""Stages over whole tables: each skips pages whose signature has not changed and replaces the rows of the others.

A stage returns its new tables and the provenance(page_id, signature, ...) of the pages it computed. Engines come in as
functions from DataFrame to DataFrame, so that a model runs as a vectorised UDF of the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import keys as K
from . import candidates as C
from . import context, detect, export, glossary, incremental, ordering
from .pages import met

Engine = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Done:
    """The table after the stage, and what was computed for which page."""

    table: DataFrame
    provenance: DataFrame


def _num(c: str) -> Column:
    """A number as text that does not depend on how an engine prints doubles."""
    return F.coalesce(F.format_string("%.6f", F.col(c).cast("double")), F.lit(""))


def boxes_fingerprint(regions: DataFrame) -> DataFrame:
    """(page_id, fingerprint) of ids and boxes."""
    return K.fingerprint(regions, "page_id", F.concat_ws(":", "region_id", F.concat_ws(",", *[_num(c) for c in "xywh"])), "region_id")


def _to_do(fingerprints: DataFrame, tag: str, provenance: DataFrame | None, force: bool) -> DataFrame:
    """(page_id, signature) of the pages whose signature is not the stored one; all of them with force."""
    signed = fingerprints.select("page_id", K.content_key(F.lit(tag), F.col("fingerprint")).alias("signature"))
    if provenance is None or force:
        return signed
    return incremental.changed(signed.withColumnRenamed("signature", "_s"), provenance.select("page_id", F.col("signature").alias("stored")), F.col("_s")).select("page_id", "signature")


def reading_order_stage(regions: DataFrame, direction: str = "rtl", panels: DataFrame | None = None, provenance: DataFrame | None = None, force: bool = False) -> Done:
    """regions with reading_order and panel_index of the pages whose boxes, direction or panel mode changed.

    A page with an unchanged signature keeps what it has, an order set by hand included. Without panels panel_index is
    null; with them it is the panel's number, not its rank.
    """
    mode = "flat" if panels is None else "panels"
    todo = _to_do(boxes_fingerprint(regions), f"reading-order|{direction}|{mode}", provenance, force)
    work = regions.join(todo.select("page_id"), "page_id", "left_semi")
    if panels is None:
        found = ordering.reading_order(work, direction).select("page_id", "region_id", F.col("reading_order").alias("_o"), F.lit(None).cast("int").alias("_p"))
    else:
        found = ordering.order_by_panels(work, panels, direction).select("page_id", "region_id", F.col("reading_order").alias("_o"), F.col("panel").cast("int").alias("_p"))
    columns = [*regions.columns, *(c for c in ("reading_order", "panel_index") if c not in regions.columns)]
    old = [F.col(c) if c in regions.columns else F.lit(None).cast("int").alias(c) for c in columns]
    joined = regions.select(*old).join(found.withColumn("_hit", F.lit(True)), ["page_id", "region_id"], "left")
    new = joined.withColumns({"reading_order": F.when(F.col("_hit"), F.col("_o")).otherwise(F.col("reading_order")), "panel_index": F.when(F.col("_hit"), F.col("_p")).otherwise(F.col("panel_index"))})
    count = work.groupBy("page_id").agg(F.count("*").alias("count"))
    return Done(new.select(columns), todo.join(count, "page_id").withColumn("direction", F.lit(direction)).withColumn("mode", F.lit(mode)))


def sfx_stage(regions: DataFrame, page_w: float, page_h: float, min_area: float = 0.02, aspect: float = 2.2) -> DataFrame:
    """regions with type sfx for those that look like it; only automatic ones of unknown type change."""
    found = detect.sfx_type(F.col("type"), F.col("w"), F.col("h"), page_w, page_h, min_area, aspect)
    return regions.withColumn("type", F.when(F.col("status") == "auto", found).otherwise(F.col("type")))


def detect_stage(pages: DataFrame, regions: DataFrame, spans: DataFrame, engine: Engine, name: str, provenance: DataFrame | None = None, force: bool = False) -> tuple[Done, DataFrame]:
    """Regions found by an engine on pages(page_id, source_hash) that changed or have none, and the spans after it.

    engine turns pages into rows (page_id, x, y, w, h, type, confidence, status, text, text_confidence). Earlier regions
    and spans of these pages go. Text found with a box that is not ignored becomes a span whose source is the engine's name.
    """
    has = regions.select("page_id").distinct().withColumn("_has", F.lit(True))
    keyed = pages.join(has, "page_id", "left").withColumn("_s", K.content_key(F.col("source_hash"), F.lit(name)))
    stored = (provenance if provenance is not None else pages.select("page_id", F.lit(None).cast("string").alias("signature")).limit(0)).select("page_id", F.col("signature").alias("stored"))
    todo = incremental.changed(keyed, stored, F.col("_s"), F.col("_has")) if not force else keyed.withColumn("signature", F.col("_s"))
    w = Window.partitionBy("page_id").orderBy("y", "x", "w", "h")
    found = engine(todo.select(pages.columns)).withColumn("_n", F.row_number().over(w))
    found = found.withColumn("region_id", K.stable_id("rgn", F.col("page_id"), F.lit(name), F.col("_n")))
    work = todo.select("page_id", "signature")
    table = incremental.overwrite_pages(regions, found.select("page_id", "region_id", "x", "y", "w", "h", "type", "confidence", "status"), work).select(regions.columns)
    read = found.filter((F.col("status") != "ignore") & F.col("text").isNotNull()).select("page_id", "region_id", F.lit(0).alias("seq"), "text", F.col("text_confidence").alias("confidence"), F.lit(name).alias("source"))
    return Done(table, work), incremental.overwrite_pages(spans, read, work)


def ocr_stage(regions: DataFrame, spans: DataFrame, engine: Engine, name: str, detector: str | None = None) -> DataFrame:
    """spans after recognition: regions not ignored keep the detector's own first span or are read by the engine.

    engine adds text and confidence to rows (page_id, region_id, x, y, w, h). All other spans go, those of ignored
    regions included.
    """
    box = ["page_id", "region_id", "x", "y", "w", "h"]
    eligible = regions.filter("status <> 'ignore'").select(box)
    columns = ["page_id", "region_id", "seq", "text", "confidence", "source"]
    kept, rest = None, eligible
    if detector is not None:
        kept, rest = incremental.adopt_spans(regions, spans, detector)
        rest = eligible.join(rest.select("region_id"), "region_id", "left_semi").select(box)
        kept = kept.withColumns({"seq": F.lit(0), "source": F.lit(detector)}).select(columns)
    read = engine(rest).withColumns({"seq": F.lit(0), "source": F.lit(name)}).select(columns)
    return read if kept is None else kept.unionByName(read)


def ocr_correct_stage(spans: DataFrame, correct: Engine, name: str, threshold: float = 0.5, provenance: DataFrame | None = None, force: bool = False) -> Done:
    """spans with proposals for unsure texts appended to their alternatives; no text changes.

    correct adds proposed (array of texts, best first) to rows (page_id, region_id, seq, text). Provenance has per page the
    unsure spans and how many of them got something new.
    """
    low = incremental.low_spans(spans, threshold)
    line = F.concat_ws(":", "region_id", F.col("seq").cast("string"), _num("confidence"), "text")
    prints = K.fingerprint(low.withColumn("_k", F.concat_ws(":", "region_id", F.format_string("%09d", F.col("seq").cast("int")))), "page_id", line, "_k")
    todo = _to_do(prints, f"ocr-correct|{name}|{threshold}", provenance, force)
    work = low.join(todo.select("page_id"), "page_id", "left_semi")
    proposed = correct(work.select("page_id", "region_id", "seq", "text")).select("region_id", "seq", "proposed")
    joined = spans.join(proposed, ["region_id", "seq"], "left")
    merged = C.merged_alternatives(F.col("text"), F.col("alternatives"), F.coalesce("proposed", F.array().cast("array<string>")))
    out = joined.withColumn("_more", merged)
    gained = out.filter(F.size("_more") > F.size("alternatives")).groupBy("page_id").agg(F.count("*").alias("suggested"))
    counts = work.groupBy("page_id").agg(F.count("*").alias("low_spans"))
    provenance_ = todo.join(counts, "page_id").join(gained, "page_id", "left").withColumn("suggested", F.coalesce("suggested", F.lit(0)))
    return Done(out.withColumn("alternatives", F.col("_more")).select(spans.columns), provenance_)


def unit_contexts(pages: DataFrame, regions: DataFrame, spans: DataFrame, units: DataFrame, entries: DataFrame, window: int = 2) -> DataFrame:
    """(page_id, unit_id, source, preceding, following, page_index, page_count, terms) of units(page_id, unit_id, ordered_region_ids).

    A unit has the place and panel of its first region; unplaced ones come last, then by id. Where any unit of a page
    has a panel, neighbours come from the unit's own run of one panel. terms are the glossary entries its source has.
    """
    made = _contexts(pages, regions, spans, units, entries, window)
    return made.select("page_id", "unit_id", "source", "preceding", "following", "page_index", "page_count", "terms")


def _contexts(pages: DataFrame, regions: DataFrame, spans: DataFrame, units: DataFrame, entries: DataFrame, window: int) -> DataFrame:
    """unit_contexts() with ordered_region_ids. Tables meet on their pages; just the terms that texts have are shuffled after the search."""
    panel = F.col("panel_index") if "panel_index" in regions.columns else F.lit(None).cast("int")
    used = units.select("page_id", F.posexplode("ordered_region_ids").alias("pos", "region_id"), "unit_id").select("page_id", "region_id", F.struct("unit_id", "pos").alias("_u"))
    seen = spans.select("page_id", "region_id", F.struct("seq", "text").alias("_s"))
    mine = regions.select("page_id", "region_id", F.struct("reading_order", panel.alias("panel")).alias("_r"))
    found = met(["page_id", "region_id"], [used, seen, mine], F.collect_list("_u").alias("_u"), F.min_by("_s.text", "_s.seq").alias("text"), F.first("_r", ignorenulls=True).alias("_r"))
    rows = found.select("page_id", "text", "_r", F.explode("_u").alias("_u")).select("page_id", "text", "_r", "_u.*")
    some = F.when(F.coalesce("text", F.lit("")) != "", F.struct("pos", "text"))
    parts = [units.select("page_id", "unit_id", F.struct("ordered_region_ids").alias("_i")), rows.select("page_id", "unit_id", some.alias("_t"), F.when(F.col("pos") == 0, F.col("_r")).alias("_r"))]
    source = F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda s: s["text"]), "\n")
    placed = met(["page_id", "unit_id"], parts, F.first("_i", ignorenulls=True).alias("_i"), source.alias("text"), F.first("_r", ignorenulls=True).alias("_r"))
    placed = placed.select("page_id", "unit_id", "_i.ordered_region_ids", "text", "_r.reading_order", "_r.panel")
    w = Window.partitionBy("page_id")
    ranked = placed.withColumn("rk", F.row_number().over(w.orderBy(F.col("reading_order").asc_nulls_last(), "unit_id")) - 1).withColumn("_scoped", F.max(F.col("panel").isNotNull()).over(w))
    both = context.with_panel(context.with_flat(ranked, window), window, "_p", "_f")
    both = both.withColumns({"preceding": F.when(F.col("_scoped"), F.col("_p")).otherwise(F.col("preceding")), "following": F.when(F.col("_scoped"), F.col("_f")).otherwise(F.col("following"))})
    terms = glossary.with_applicable(placed.select("page_id", "unit_id", "text"), entries).filter(F.size("terms") > 0).select("page_id", "unit_id", "terms").repartition("page_id")
    whole = both.select("page_id", "unit_id", F.struct("ordered_region_ids", F.col("text").alias("source"), "preceding", "following").alias("_b"))
    with_terms = met(["page_id", "unit_id"], [whole, terms], F.first("_b", ignorenulls=True).alias("_b"), F.coalesce(F.first("terms", ignorenulls=True), F.array().cast(terms.schema["terms"].dataType)).alias("terms"))
    count = pages.agg(F.count("*").alias("page_count"))  # one row
    full = with_terms.join(pages.select("page_id", F.col("idx").alias("page_index")), "page_id").crossJoin(F.broadcast(count))
    return full.select("page_id", "unit_id", "_b.*", "page_index", "page_count", "terms")


def translate_stage(
    pages: DataFrame, regions: DataFrame, spans: DataFrame, units: DataFrame, entries: DataFrame, translate: Engine, name: str, target_lang: str,
    style: str = "balanced", window: int = 2, provenance: DataFrame | None = None, force: bool = False, only: DataFrame | None = None,
) -> Done:
    """units with source, context and a fresh raw candidate where something a page's translations depend on changed.

    translate adds translation and translation_confidence to rows of unit_contexts(); a blank source has an empty
    translation, whatever it says. Glossary aliases in it are replaced. Other candidates and a choice among them stay.
    only(unit_id): just these units, whatever their signature.
    """
    contexts = _contexts(pages, regions, spans, units, entries, window)
    made = F.to_json(F.struct("preceding", "following", "page_index", "page_count", F.col("terms").alias("glossary")))
    item = F.struct("unit_id", "ordered_region_ids", "source", "preceding", "following", "page_index", "page_count", "terms", made.alias("context"))
    # a page's units in one row: its signature and, if that is new, its units come from one pass
    per_page = contexts.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    line = F.transform("rows", lambda r: F.concat_ws(":", r["unit_id"], F.array_join(r["ordered_region_ids"], ","), r["source"], r["context"]))
    tag = f"translate|{name}|{target_lang}|{style}|{window}"
    signed = per_page.withColumn("signature", K.content_key(F.lit(tag), F.sha2(F.array_join(line, "\n"), 256)))
    if provenance is not None and not force and only is None:
        stored = provenance.select("page_id", F.col("signature").alias("_stored"))
        signed = signed.join(stored, "page_id", "left").filter(~F.coalesce(F.col("_stored") == F.col("signature"), F.lit(False))).drop("_stored")
    work = signed.select("page_id", F.explode("rows").alias("r")).select("page_id", "r.*")
    if only is not None:
        work = work.join(only.select("unit_id"), "unit_id", "left_semi")
    said = translate(work).withColumn("text", F.when(F.trim("source") == "", "").otherwise(F.coalesce("translation", F.lit("")))).withColumn("source_text", F.col("source"))
    fixed = glossary.enforce(said, entries, ["page_id", "unit_id", "source", "context", "translation_confidence"])
    mark = F.concat("unit_id", F.lit("_"), F.substring(F.sha2(F.concat_ws("|", F.lit(tag), "context", "fixed"), 256), 1, 12))
    done = fixed.select("page_id", "unit_id", mark.alias("id"), "fixed", F.col("source").alias("_source"), F.col("context").alias("_context"), F.col("translation_confidence").alias("sure"))
    made_ = ["id", "fixed", "_source", "_context", "sure"]  # each by itself, so that what nobody reads is not shuffled
    old_ = units.select("page_id", "unit_id", F.struct(*[c for c in units.columns if c not in ("page_id", "unit_id")]).alias("_x"))
    found = met(["page_id", "unit_id"], [old_, done.repartition("page_id")], F.collect_list("_x").alias("_x"), *[F.first(c, ignorenulls=True).alias(c) for c in made_])
    joined = found.select("page_id", "unit_id", F.when(F.col("id").isNotNull(), F.struct(*made_)).alias("_n"), F.explode("_x").alias("_x")).select("page_id", "unit_id", "_n", "_x.*").withColumns({"_c": F.col("candidates"), "_s": F.col("selected")})
    hit = F.col("_n").isNotNull()
    after = C.attach_raw(joined, C.candidate(F.col("_n.id"), "raw", F.col("_n.fixed"), F.col("_n.sure")))
    old = {c: F.col(c) if c in units.columns else F.lit(None).cast("string") for c in ("source", "context", "style")}
    new = {"candidates": F.col("candidates"), "selected": F.col("selected"), "source": F.col("_n._source"), "context": F.col("_n._context"), "style": F.lit(style)}
    out = after.withColumns({c: F.when(hit, v).otherwise({"candidates": F.col("_c"), "selected": F.col("_s"), **old}[c]) for c, v in new.items()})
    columns = [*units.columns, *(c for c in ("source", "context", "style") if c not in units.columns)]
    provenance_ = signed.select("page_id", "signature", F.size("rows").cast("long").alias("count"))
    return Done(out.select(columns), provenance_ if only is None else provenance_.limit(0))


def mask_boxes(regions: DataFrame, skip_types: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, boxes): what a page's mask covers, in the order of ids. Only types to skip are left out: ignored regions are not."""
    kept = regions.filter(~F.col("type").isin(*skip_types)) if skip_types else regions
    item = F.struct("region_id", B.box().alias("b"))
    return kept.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["b"]).alias("boxes"))


def mask_stage(pages: DataFrame, regions: DataFrame, artifacts: DataFrame, mask: Engine, name: str, skip_types: tuple[str, ...] = (), force: bool = False) -> Done:
    """artifacts with a fresh mask of each of pages(page_id, source_hash, ...) whose image, regions or skipped types changed.

    mask turns rows (pages' columns, boxes) into (page_id, path, overflow). Pages without a region get one too.
    artifacts(page_id, kind, seq, path, overflow, signature).
    """
    tag = f"{name}|skip={','.join(sorted(skip_types))}"
    prints = boxes_fingerprint(regions)
    keyed = pages.join(prints, "page_id", "left").withColumn("signature", K.content_key(F.col("source_hash"), F.concat_ws("|", F.lit(tag), F.coalesce("fingerprint", F.lit("")))))
    return _rendered(keyed.join(mask_boxes(regions, skip_types), "page_id", "left").drop("fingerprint"), artifacts, mask, "mask", force)


def composite_stage(pages: DataFrame, placements: DataFrame, artifacts: DataFrame, composite: Engine, name: str, force: bool = False) -> Done:
    """artifacts with a fresh render of each page whose base layer or placements changed.

    The base is the page's mask if there is one, else its image (pages(page_id, image_path, source_hash)). composite turns
    rows (page_id, base_path, placements) into (page_id, path, overflow). placements as export.placements gives them.
    """
    line = F.concat_ws("|", "preset", F.concat_ws(",", *[_num(c) for c in "xywh"]), "text")
    prints = K.fingerprint(placements.withColumn("_k", F.format_string("%09d", F.col("place").cast("int"))), "page_id", line, "_k")
    item = F.struct("place", "text", "x", "y", "w", "h", "preset")
    listed = placements.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("placements"))
    last = artifacts.filter("kind = 'mask'").groupBy("page_id").agg(F.max_by(F.struct("path", "signature"), "seq").alias("_m"))
    joined = pages.join(last, "page_id", "left").join(prints, "page_id", "left").join(listed, "page_id", "left")
    keyed = joined.withColumn("base_path", F.coalesce("_m.path", "image_path")).withColumn("signature", K.content_key(F.coalesce("_m.signature", "source_hash"), F.concat_ws("|", F.lit(name), F.coalesce("fingerprint", F.lit("")))))
    return _rendered(keyed.select("page_id", "base_path", "placements", "signature"), artifacts, composite, "render", force)


def _rendered(keyed: DataFrame, artifacts: DataFrame, engine: Engine, kind: str, force: bool) -> Done:
    """artifacts where pages of another signature have a new artifact of the kind instead of their old ones."""
    mine = artifacts.filter(F.col("kind") == kind)
    todo = keyed if force else keyed.join(mine.select("page_id", "signature"), ["page_id", "signature"], "left_anti")
    made = engine(todo).select("page_id", "path", "overflow")
    new = made.join(todo.select("page_id", "signature"), "page_id").withColumns({"kind": F.lit(kind), "seq": F.lit(1)})
    old = artifacts.join(todo.select("page_id", F.lit(kind).alias("kind")), ["page_id", "kind"], "left_anti")
    return Done(old.select(artifacts.columns).unionByName(new.select(artifacts.columns)), todo.select("page_id", "signature"))


def preprocess_stage(pages: DataFrame, config: str, cached: DataFrame, force: bool = False) -> DataFrame:
    """(page_id, cache_key) of pages(page_id, source_hash) whose derivative under this configuration is not in cached(cache_key)."""
    keyed = pages.withColumn("cache_key", K.content_key(F.col("source_hash"), F.lit(config)))
    return (keyed if force else keyed.join(cached, "cache_key", "left_anti")).select("page_id", "cache_key")


@dataclass(frozen=True)
class Bundle:
    """What an export consists of; write() puts it into a folder."""

    pages: DataFrame
    mapping: DataFrame
    transcript: DataFrame

    def overflow(self) -> DataFrame:
        return self.pages.agg(F.coalesce(F.sum("overflow"), F.lit(0)).alias("overflow"))

    def write(self, folder: str) -> None:
        """pages (manifest) and mapping as JSON lines, transcript as text, each in parts in the order of pages."""
        self.pages.repartitionByRange("idx").sortWithinPartitions("idx").write.json(f"{folder}/manifest")
        self.mapping.repartitionByRange("page_id").sortWithinPartitions("page_id").write.json(f"{folder}/mapping")
        self.transcript.repartitionByRange("idx", "n").sortWithinPartitions("idx", "n").select("line").write.text(f"{folder}/transcript")


def export_bundle(pages: DataFrame, artifacts: DataFrame, unit_regions: DataFrame, regions: DataFrame, spans: DataFrame, units: DataFrame, order: DataFrame) -> Bundle:
    """pages(page_id, idx, image_path) with the best layer and its file's name, the mapping, and the transcript under a heading a page."""
    layers = export.page_layers(pages.select("page_id", "image_path"), artifacts).join(pages.select("page_id", "idx"), "page_id")
    named = layers.select("idx", "page_id", F.col("layer").alias("source"), F.col("path"), F.format_string("pages/%04d.png", F.col("idx").cast("int")).alias("file"), "overflow")
    lines = export.transcript(unit_regions, spans, units, order).join(pages.select("page_id", "idx"), "page_id").select("idx", "page_id", "n", "line")
    heads = pages.select("idx", "page_id", F.lit(0).alias("n"), F.concat(F.lit("## Page "), (F.col("idx") + 1).cast("string")).alias("line"))
    return Bundle(named, export.lineage(unit_regions, regions, spans, units, order), heads.unionByName(lines))


def rerender(pages: DataFrame, regions: DataFrame, unit_regions: DataFrame, units: DataFrame, order: DataFrame, artifacts: DataFrame, mask: Engine, composite: Engine, name: str) -> Done:
    """artifacts after masking and composing again what an edit changed: no type is skipped, outlines are not followed."""
    masked = mask_stage(pages.select("page_id", "source_hash"), regions, artifacts, mask, name).table
    placed = export.placements(unit_regions, regions.drop("outline"), units, order)
    return composite_stage(pages, placed, masked, composite, name)
