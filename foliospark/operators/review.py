"""Reviewers' edits as tables of commands: many at once, each kind in one pass over the tables it changes.

Tables: regions(page_id, region_id, x, y, w, h, type, status, confidence, reading_order), spans(page_id, region_id, seq,
text, ...), units(page_id, unit_id, ordered_region_ids, candidates, selected). A command that makes no sense changes
nothing and is listed in rejected(id, reason). Of several commands for one entity the one of the highest seq counts.
Pages whose regions come or go get their places closed up; all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import candidates as C
from . import confidence as Q
from .pages import met

ORDER_LAST = 1 << 30
STATUSES = ("auto", "correct", "needs_review", "ignore", "manual")


@dataclass(frozen=True)
class Edited:
    """The tables after the commands; those a command does not touch are the ones given, or None."""

    rejected: DataFrame
    regions: DataFrame | None = None
    spans: DataFrame | None = None
    units: DataFrame | None = None
    log: DataFrame | None = None


def _last(commands: DataFrame, key: str) -> DataFrame:
    """One row a key: the command of the highest seq."""
    rest = [c for c in commands.columns if c != key]
    return commands.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("_c")).select(key, *[F.col(f"_c.{c}").alias(f"_{c}") for c in rest])


def _rejected(commands: DataFrame, key: str, known: DataFrame, reason: Column) -> DataFrame:
    """(id, reason) of commands on ids that are not known, or with a reason."""
    marked = commands.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    why = F.when(F.col("_known").isNull(), "unknown id").otherwise(reason)
    return marked.select(F.col(key).cast("string").alias("id"), why.alias("reason")).filter("reason is not null")


def _none() -> Column:
    return F.lit(None).cast("string")


# translations


def edit_translations(units: DataFrame, edits: DataFrame, editor: str = "user") -> Edited:
    """edits(unit_id, seq, text): the text becomes the unit's manual choice.

    A manual candidate that is selected is rewritten; else one is added and selected. log has an entry for each edit.
    """
    joined = units.join(_last(edits, "unit_id"), "unit_id", "left")
    picked = C.by_id(F.col("candidates"), F.col("selected"))
    new = C.candidate(F.concat("unit_id", F.lit("_edit_"), F.col("_seq").cast("string")), "manual", F.col("_text"))
    manual = F.coalesce(picked["kind"] == "manual", F.lit(False))
    rewritten = F.transform("candidates", lambda c: F.when(c["id"] == F.col("selected"), c.withField("text", F.col("_text"))).otherwise(c))
    hit = F.col("_seq").isNotNull()
    marked = joined.withColumn("_manual", manual).withColumn("_before", C.selected_text(F.col("candidates"), F.col("selected")))
    out = marked.withColumns({
        "candidates": F.when(hit & F.col("_manual"), rewritten).when(hit, F.concat("candidates", F.array(new))).otherwise(F.col("candidates")),
        "selected": F.when(hit & ~F.col("_manual"), new["id"]).otherwise(F.col("selected")),
    })
    log = marked.filter(hit).select("unit_id", F.col("_seq").alias("seq"), F.lit("edit_translation").alias("action"), F.col("_before").alias("before"), F.col("_text").alias("after"), F.lit(editor).alias("editor"))
    return Edited(_rejected(edits, "unit_id", units, _none()), units=out.select(units.columns), log=log)


def select_candidates(units: DataFrame, choices: DataFrame, editor: str = "user") -> Edited:
    """choices(unit_id, seq, candidate_id): an existing candidate becomes the unit's choice."""
    joined = units.join(_last(choices, "unit_id"), "unit_id", "left")
    picked = C.by_id(F.col("candidates"), F.col("_candidate_id"))
    hit = picked.isNotNull()
    before = C.selected_text(F.col("candidates"), F.col("selected"))
    log = joined.filter(hit).select("unit_id", F.col("_seq").alias("seq"), F.lit("select_candidate").alias("action"), before.alias("before"), picked["text"].alias("after"), F.lit(editor).alias("editor"))
    missing = joined.filter(F.col("_seq").isNotNull() & ~hit).select(F.col("unit_id").alias("id"), F.lit("no such candidate").alias("reason"))
    out = joined.withColumn("selected", F.when(hit, F.col("_candidate_id")).otherwise(F.col("selected")))
    return Edited(_rejected(choices, "unit_id", units, _none()).unionByName(missing), units=out.select(units.columns), log=log)


def listed_edits(log: DataFrame, unit_id: str | None = None) -> DataFrame:
    """Entries of a log, of one unit or of all, oldest first: (unit_id, n, ...) with n counted within the unit."""
    rows = log if unit_id is None else log.filter(F.col("unit_id") == unit_id)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("unit_id").orderBy("seq", "action", "after")))


# regions


def set_status(regions: DataFrame, changes: DataFrame) -> Edited:
    """changes(region_id, seq, status)."""
    good = F.col("status").isin(*STATUSES)
    joined = regions.join(_last(changes.filter(good), "region_id").select("region_id", "_status"), "region_id", "left")
    out = joined.withColumn("status", F.coalesce("_status", "status"))
    why = F.when(~F.coalesce(good, F.lit(False)), "unknown status")
    return Edited(_rejected(changes, "region_id", regions, why), regions=out.select(regions.columns))


def move_regions(regions: DataFrame, moves: DataFrame) -> Edited:
    """moves(region_id, seq, x, y, w, h): the region's new box."""
    good = (F.col("w") >= 0) & (F.col("h") >= 0)
    joined = regions.join(_last(moves.filter(good), "region_id"), "region_id", "left")
    hit = F.col("_seq").isNotNull()
    out = joined.withColumns({c: F.when(hit, F.col("_" + c)).otherwise(F.col(c)) for c in "xywh"})
    why = F.when(~F.coalesce(good, F.lit(False)), "negative size")
    return Edited(_rejected(moves, "region_id", regions, why), regions=out.select(regions.columns))


def reorder_pages(regions: DataFrame, orders: DataFrame) -> Edited:
    """orders(page_id, seq, ids): the page's regions in this order; ids has to name each of them once."""
    wanted = _last(orders, "page_id")
    here = regions.groupBy("page_id").agg(F.sort_array(F.collect_list("region_id")).alias("_have"))
    checked = wanted.join(here, "page_id").withColumn("_good", F.coalesce(F.sort_array("_ids") == F.col("_have"), F.lit(False)))
    joined = regions.join(checked.filter("_good").select("page_id", "_ids"), "page_id", "left")
    place = F.array_position("_ids", F.col("region_id")).cast("int") - 1
    out = joined.withColumn("reading_order", F.coalesce(F.when(F.col("_ids").isNotNull(), place), F.col("reading_order")))
    bad = checked.filter("not _good").select(F.col("page_id").cast("string").alias("id"), F.lit("not a permutation of the page's regions").alias("reason"))
    return Edited(_rejected(orders, "page_id", regions, _none()).unionByName(bad), regions=out.select(regions.columns))


def _closed_up(regions: DataFrame, pages: DataFrame, *then: str) -> DataFrame:
    """Places 0.. on the given pages, by present place (none last), id and further columns."""
    w = Window.partitionBy("page_id").orderBy(F.coalesce("reading_order", F.lit(ORDER_LAST)), "region_id", *then)
    marked = regions.join(pages.select("page_id").distinct().withColumn("_touched", F.lit(True)), "page_id", "left")
    ranked = marked.withColumn("_place", F.row_number().over(w) - 1)
    return ranked.withColumn("reading_order", F.when(F.col("_touched"), F.col("_place")).otherwise(F.col("reading_order"))).drop("_touched", "_place")


def _mapped_units(units: DataFrame, pairs: DataFrame, change: Callable[[Column, Column], Column]) -> DataFrame:
    """units with change(ordered_region_ids, map of the page) where the page has pairs(page_id, key, value)."""
    maps = pairs.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_map"))
    joined = units.join(maps, "page_id", "left")
    ids = F.when(F.col("_map").isNull(), F.col("ordered_region_ids")).otherwise(change(F.col("ordered_region_ids"), F.col("_map")))
    return joined.withColumn("ordered_region_ids", ids).select(units.columns)


def split_regions(regions: DataFrame, units: DataFrame, cuts: DataFrame) -> Edited:
    """cuts(region_id, seq, ratio, vertical): the region in two at a share of its height, or of its width.

    The first part keeps the id and the recognised text. The second is a region of the same type and state, without a
    confidence, that follows it in reading order and in every unit that has it. It is named after it with _b; if there
    is such a region, as after an earlier cut, also with a hash of the cut and the box, so a region can be cut any number of times.
    """
    good = (F.col("ratio") > 0) & (F.col("ratio") < 1)
    taken = regions.select(F.col("region_id").alias("_plain"), F.lit(True).alias("_taken"))
    wanted = _last(cuts.filter(good), "region_id").withColumn("_plain", F.concat("region_id", F.lit("_b"))).join(taken, "_plain", "left")
    joined = regions.join(wanted, "region_id", "left")
    mark = F.substring(F.md5(F.concat_ws(":", "region_id", "_seq", "x", "y", "w", "h")), 1, 12)
    joined = joined.withColumn("_second", F.when(F.col("_taken"), F.concat("_plain", mark)).otherwise(F.col("_plain"))).drop("_plain", "_taken")
    hit, vertical = F.col("_seq").isNotNull(), F.coalesce("_vertical", F.lit(False))
    halves = joined.withColumn("_half", F.explode(F.when(hit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    second = F.col("_half") == 1
    box = {}
    for place, size, along in (("x", "w", vertical), ("y", "h", ~vertical)):
        cut = F.col(size) * F.col("_ratio")
        box[place] = F.when(along & second, F.col(place) + cut).otherwise(F.col(place))
        box[size] = F.when(hit & along, F.when(second, F.col(size) - cut).otherwise(cut)).otherwise(F.col(size))
    pages = joined.filter(hit).select("page_id")
    closed = _closed_up(halves.withColumns(box), pages, "_half")
    out = closed.withColumn("confidence", F.when(F.col("_half") == 0, F.col("confidence"))).withColumn("region_id", F.when(F.col("_half") == 1, F.col("_second")).otherwise(F.col("region_id")))
    pairs = joined.filter(hit).select("page_id", F.col("region_id").alias("key"), F.col("_second").alias("value"))
    grown = _mapped_units(units, pairs, lambda ids, m: F.flatten(F.transform(ids, lambda i: F.filter(F.array(i, F.try_element_at(m, i)), lambda x: x.isNotNull()))))
    why = F.when(~F.coalesce(good, F.lit(False)), "ratio must be between 0 and 1")
    return Edited(_rejected(cuts, "region_id", regions, why), regions=out.select(regions.columns), units=grown)


def merge_regions(regions: DataFrame, spans: DataFrame, units: DataFrame, groups: DataFrame) -> Edited:
    """groups(region_id, seq, group_id): the regions of a group, two or more of one page, as one.

    The first in reading order survives with its type and state and the box around all. The others' spans follow its own
    in reading order; units that have one of the others have the survivor, once.
    """
    wanted = regions.join(_last(groups, "region_id"), "region_id")
    order = F.struct(F.coalesce("reading_order", F.lit(ORDER_LAST)), F.col("region_id"))
    x, y = F.min("x"), F.min("y")
    found = wanted.groupBy("_group_id").agg(
        F.min_by("region_id", order).alias("_survivor"), F.count("*").alias("_n"), F.countDistinct("page_id").alias("_pages"), x.alias("_x"), y.alias("_y"),
        (F.max(F.col("x") + F.col("w")) - x).alias("_w"), (F.max(F.col("y") + F.col("h")) - y).alias("_h"),
    )
    sound = (F.col("_n") > 1) & (F.col("_pages") == 1)
    member = wanted.join(found.filter(sound), "_group_id").select("region_id", "_survivor", "_x", "_y", "_w", "_h")
    joined = regions.join(member, "region_id", "left")
    hit = F.col("_survivor").isNotNull()
    pages = joined.filter(hit).select("page_id")
    kept = joined.filter(~hit | (F.col("region_id") == F.col("_survivor"))).withColumns({c: F.coalesce("_" + c, c) for c in "xywh"})
    out = _closed_up(kept, pages).select(regions.columns)
    target = joined.filter(hit).select("region_id", F.col("_survivor"), order.alias("_o"))
    moved = spans.join(target, "region_id", "left")
    renumbered = F.row_number().over(Window.partitionBy("_survivor").orderBy("_o", "seq")) - 1
    some = moved.filter("_survivor is not null").withColumn("seq", renumbered.cast(spans.schema["seq"].dataType)).withColumn("region_id", F.col("_survivor"))
    carried = moved.filter("_survivor is null").select(spans.columns).unionByName(some.select(spans.columns))
    pairs = joined.filter(hit).select("page_id", F.col("region_id").alias("key"), F.col("_survivor").alias("value"))
    mapped = _mapped_units(units, pairs, lambda ids, m: F.array_distinct(F.transform(ids, lambda i: F.coalesce(F.try_element_at(m, i), i))))
    bad = found.filter(~sound).select(F.col("_group_id").cast("string").alias("id"), F.when(F.col("_n") < 2, "needs two regions").otherwise("regions of several pages").alias("reason"))
    return Edited(_rejected(groups, "region_id", regions, _none()).unionByName(bad), regions=out, spans=carried, units=mapped)


def delete_regions(regions: DataFrame, spans: DataFrame, units: DataFrame, gone: DataFrame) -> Edited:
    """gone(region_id, seq): the regions go with their spans and leave their units; a unit without any goes too."""
    ids = _last(gone, "region_id").select("region_id")
    hit = regions.join(ids, "region_id", "left_semi").select("page_id", F.col("region_id").alias("key"), F.lit(True).alias("value"))
    out = _closed_up(regions.join(ids, "region_id", "left_anti"), hit).select(regions.columns)
    kept = spans.join(hit.select(F.col("key").alias("region_id")), "region_id", "left_anti").select(spans.columns)
    rest = _mapped_units(units.withColumn("_had", F.size("ordered_region_ids")), hit, lambda ids_, m: F.filter(ids_, lambda i: F.try_element_at(m, i).isNull()))
    rest = rest.filter((F.size("ordered_region_ids") > 0) | (F.col("_had") == 0)).select(units.columns)
    return Edited(_rejected(gone, "region_id", regions, _none()), regions=out, spans=kept, units=rest)


def accept_alternatives(spans: DataFrame, choices: DataFrame) -> Edited:
    """choices(region_id, span_seq, seq, text): one of a span's alternatives becomes its text, the old text the first alternative."""
    keyed = choices.withColumn("_key", F.struct("region_id", "span_seq"))
    last = _last(keyed.select("_key", "seq", "text"), "_key").select(F.col("_key.region_id").alias("region_id"), F.col("_key.span_seq").alias("_at"), "_text")
    joined = spans.alias("s").join(last.alias("l"), (F.col("s.region_id") == F.col("l.region_id")) & (F.col("s.seq") == F.col("l._at")), "left").select("s.*", "_text")
    hit = F.coalesce(F.array_contains("alternatives", F.col("_text")), F.lit(False))
    text, alternatives = C.accepted_alternative(F.col("text"), F.col("alternatives"), F.col("_text"))
    bad = joined.filter(F.col("_text").isNotNull() & ~hit).select(F.col("region_id").cast("string").alias("id"), F.lit("not an alternative").alias("reason"))
    out = joined.withColumn("_hit", hit).withColumns({"text": F.when(hit, text).otherwise(F.col("text")), "alternatives": F.when(hit, alternatives).otherwise(F.col("alternatives"))})
    return Edited(_rejected(choices, "region_id", spans, _none()).unionByName(bad), spans=out.select(spans.columns))


def create_regions(regions: DataFrame, spans: DataFrame, units: DataFrame, drawn: DataFrame, recognize: Callable[[DataFrame], DataFrame], translate: Callable[[DataFrame], DataFrame]) -> Edited:
    """drawn(page_id, region_id, seq, x, y, w, h, type): manual regions, read and translated at once, last in order.

    recognize adds text and confidence to rows with boxes; translate adds translation and translation_confidence to
    rows with source. Each region gets a unit of its own with the translation selected.
    """
    good = (F.col("w") > 0) & (F.col("h") > 0)
    taken = regions.select("region_id")
    new = _last(drawn.filter(good).join(taken, "region_id", "left_anti"), "region_id")
    rows = new.select("region_id", *[F.col(f"_{c}").alias(c) for c in ("page_id", "x", "y", "w", "h", "type")])
    read = recognize(rows)
    done = translate(read.withColumn("source", F.col("text")))
    added = rows.withColumns({"status": F.lit("manual"), "confidence": F.lit(None).cast("double"), "reading_order": F.lit(None).cast("int")})
    all_ = _closed_up(regions.unionByName(added, allowMissingColumns=True), rows)
    seen = read.select("page_id", "region_id", F.lit(0).cast(spans.schema["seq"].dataType).alias("seq"), "text", "confidence")
    unit = F.concat(F.lit("tu_"), "region_id")
    raw = C.candidate(F.concat(unit, F.lit("_raw")), "raw", F.col("translation"), F.col("translation_confidence"))
    made = done.select("page_id", unit.alias("unit_id"), F.array("region_id").alias("ordered_region_ids"), F.array(raw).alias("candidates"), raw["id"].alias("selected"))
    bad = drawn.filter(~F.coalesce(good, F.lit(False))).select(F.col("region_id").alias("id"), F.lit("size must be positive").alias("reason"))
    used = drawn.filter(good).join(taken, "region_id", "left_semi").select(F.col("region_id").alias("id"), F.lit("id is taken").alias("reason"))
    return Edited(bad.unionByName(used), regions=all_.select(regions.columns), spans=spans.unionByName(seen, allowMissingColumns=True), units=units.unionByName(made, allowMissingColumns=True))


def reread_regions(regions: DataFrame, spans: DataFrame, wanted: DataFrame, recognize: Callable[[DataFrame], DataFrame]) -> Edited:
    """wanted(region_id, seq): these regions are read again; the new span replaces all they had."""
    rows = regions.join(_last(wanted, "region_id").select("region_id"), "region_id", "left_semi")
    read = recognize(rows.select("page_id", "region_id", "x", "y", "w", "h"))
    seen = read.select("page_id", "region_id", F.lit(0).cast(spans.schema["seq"].dataType).alias("seq"), "text", "confidence")
    out = spans.join(rows.select("region_id"), "region_id", "left_anti").select(spans.columns).unionByName(seen, allowMissingColumns=True)
    return Edited(_rejected(wanted, "region_id", regions, _none()), spans=out)


# views


def unit_views(units: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(page_id, unit_id, view): a unit with its translation, candidates and edits, oldest first, as a struct."""
    rows = units
    if log is not None:
        item = F.struct("seq", "action", "before", "after", "editor")
        rows = rows.join(log.groupBy("unit_id").agg(F.array_sort(F.collect_list(item)).alias("edits")), "unit_id", "left")
    else:
        rows = rows.withColumn("edits", F.array().cast("array<struct<seq:int,action:string,before:string,after:string,editor:string>>"))
    text = C.selected_text(F.col("candidates"), F.col("selected")).alias("translation")
    return rows.select("page_id", "unit_id", F.struct("unit_id", "ordered_region_ids", text, F.col("selected").alias("selected_candidate_id"), "candidates", "edits").alias("view"))


def page_views(pages: DataFrame, regions: DataFrame, spans: DataFrame, units: DataFrame, flags: DataFrame, log: DataFrame | None = None, threshold: float = Q.THRESHOLD) -> DataFrame:
    """(page_id, rev, regions, units) of pages(page_id, rev): regions in reading order with spans, confidence and flags.

    A page bounds its arrays. to_json of a row is what an editor loads. Flags that have page_id are looked up within the page.
    """
    seen = spans.select("page_id", "region_id", F.struct("seq", "text", "confidence").alias("_s"))
    marked = [flags.select("page_id", "region_id", F.struct("ai_confidence", "ai_flagged").alias("_f"))] if "page_id" in flags.columns else []
    mine = regions.select("page_id", "region_id", F.struct("type", "reading_order", "status", "confidence", "x", "y", "w", "h").alias("_r"))
    texts = F.array_sort(F.collect_list("_s"))
    found = met(["page_id", "region_id"], [mine, seen, *marked], F.collect_list("_r").alias("_r"), F.when(F.count("_s") > 0, texts).alias("ocr"), F.min("_s.confidence").alias("_least"), *([F.first("_f", ignorenulls=True).alias("_f")] if marked else []))
    found = found.select("page_id", "region_id", "ocr", "_least", *(["_f.*"] if marked else []), F.explode("_r").alias("_r")).select("*", "_r.*").withColumn("agg_confidence", F.least("confidence", "_least"))
    if not marked:
        found = found.join(flags, "region_id", "left")
    low = Q.is_low(F.col("agg_confidence"), threshold)
    item = F.struct(
        F.coalesce("reading_order", F.lit(ORDER_LAST)).alias("_o"), F.col("region_id").alias("_id"),
        F.struct("region_id", "type", "reading_order", "status", F.col("agg_confidence").alias("confidence"), low.alias("low_confidence"), "x", "y", "w", "h", "ocr", F.coalesce("ai_flagged", F.lit(False)).alias("ai_flagged"), "ai_confidence").alias("r"),
    )
    per_page = found.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["r"]).alias("regions"))
    per_unit = unit_views(units, log).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "view"))), lambda s: s["view"]).alias("units"))
    return pages.select("page_id", "rev").join(per_page, "page_id", "left").join(per_unit, "page_id", "left")


# snapshots


def snapshots(regions: DataFrame, spans: DataFrame, units: DataFrame) -> DataFrame:
    """(page_id, snapshot): each page's regions, spans and units as JSON text, in the order of their ids."""
    parts = []
    for name, table, order in (("regions", regions, ["region_id"]), ("spans", spans, ["region_id", "seq"]), ("units", units, ["unit_id"])):
        item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*[c for c in table.columns if c != "page_id"]).alias("r"))
        parts.append(table.select("page_id", item.alias(name)))
    # a page's rows of all tables meet in one aggregation: a full join of the texts would shuffle them once more
    listed = lambda n: F.to_json(F.transform(F.array_sort(F.collect_list(n)), lambda s: s["r"]))
    pages = met(["page_id"], parts, *[listed(n).alias(n) for n in ("regions", "spans", "units")])
    fields = [F.concat(F.lit(f'"{n}":'), n) for n in ("regions", "spans", "units")]
    return pages.select("page_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("snapshot"))


def restored(regions: DataFrame, spans: DataFrame, units: DataFrame, saved: DataFrame) -> Edited:
    """The tables with the pages of saved(page_id, snapshot) as they were; other pages stay."""
    from .incremental import overwrite_pages

    tables = {"regions": regions, "spans": spans, "units": units}
    inner = {n: ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in t.schema if f.name != "page_id") for n, t in tables.items()}
    kind = "struct<" + ",".join(f"{n}:array<struct<{s}>>" for n, s in inner.items()) + ">"
    parsed = saved.select("page_id", F.from_json("snapshot", kind).alias("s"))
    done = {n: overwrite_pages(t, parsed.select("page_id", F.explode(f"s.{n}").alias("r")).select("page_id", "r.*").select(t.columns), saved) for n, t in tables.items()}
    return Edited(saved.select(F.lit(None).cast("string").alias("id"), _none().alias("reason")).limit(0), **done)


def step_back(entries: DataFrame, page_id=None) -> DataFrame:
    """entries(page_id, seq, undone) with the last one not undone marked so, of one page or of all."""
    rows = entries if page_id is None else entries.filter(F.col("page_id") == page_id)
    hit = rows.filter(~F.col("undone")).agg(F.max("seq").alias("_hit"))  # one row
    return entries.crossJoin(hit).withColumn("undone", F.col("undone") | F.coalesce(F.col("seq") == F.col("_hit"), F.lit(False))).drop("_hit")


def step_forward(entries: DataFrame, page_id=None) -> DataFrame:
    """entries(page_id, seq, undone) with the first undone one in force again, of one page or of all."""
    rows = entries if page_id is None else entries.filter(F.col("page_id") == page_id)
    hit = rows.filter("undone").agg(F.min("seq").alias("_hit"))
    return entries.crossJoin(hit).withColumn("undone", F.col("undone") & ~F.coalesce(F.col("seq") == F.col("_hit"), F.lit(False))).drop("_hit")
