"""Queries of reviewers' edits, stages, detection chains and typesetting, with their SQL; queries.py loads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import prompts, shape, typeset
from .operators import candidates as C
from .operators import confidence as Q
from .operators import calls, detect, export, glossary, incremental, labelling, presets, review, stages, vision
from .operators import history as H
from .queries import AGG, EDITS, FLAGS, INTER, PAGE_H, PAGE_W, PICK, PROJECT_SQL, SERIES_SQL, _flags, _layers, _order, _order_sql, candidate_rows, picked, query, regions, spans, unit_regions, units

G = X.REGIONS
#: Reading order of regions: the input order.
ORDERED = f"select g.*, cast(rn - 1 as int) reading_order from ({G}) g"
#: What spans, units and candidates take of a region.
PLACES = ("rn", "region_id")
UNITS = f"select page_id, unit_id, list(region_id order by pos) ids from ({X.UNIT_REGIONS}) u group by page_id, unit_id"
LISTED = f"select u.page_id, u.unit_id, u.ids, p.c, p.sel from ({UNITS}) u join ({PICK}) p on p.unit_id = u.unit_id"


def ordered(spark, d) -> DataFrame:
    return X.frame(spark, d, ORDERED)


def full_units(spark, d, frame=X.frame, **columns) -> DataFrame:
    """Units with their regions as an array: regions and candidates are gathered together, not joined."""
    placed = frame(spark, d, X.UNIT_REGIONS, **columns).select("page_id", "unit_id", F.struct("pos", "region_id").alias("_r"))
    ids = F.transform(F.array_sort(F.collect_list("_r")), lambda s: s["region_id"])
    return picked(frame(spark, d, X.CANDIDATES, **columns), ids.alias("ordered_region_ids"), beside=placed).select("page_id", "unit_id", "ordered_region_ids", "candidates", "selected")


def _pick(sql: str) -> str:
    return f"select region_id, cast(1 as int) seq from ({G}) g where {sql}"


def _flat_units(df: DataFrame) -> DataFrame:
    return df.select("page_id", "unit_id", F.array_join("ordered_region_ids", ",").alias("ids"))


def _cands(df: DataFrame, *more) -> DataFrame:
    return df.select("unit_id", "selected", F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", c["kind"], c["text"])), ";").alias("candidates"), *more)


CANDS = "array_to_string(list_transform({}, lambda x: x.kind || '=' || x.text), ';')"


# translations


@query(f"""with e as (select unit_id, max(seq) seq, arg_max("after", seq) t from ({EDITS}) e group by unit_id),
u as (select p.unit_id, p.c, p.sel, e.seq, e.t, coalesce(list_filter(c, lambda x: x.id = sel)[1].kind = 'manual', false) man from ({PICK}) p left join e on e.unit_id = p.unit_id)
select unit_id, case when t is null or man then sel else unit_id || '_edit_' || seq::varchar end selected,
  case when t is null then {CANDS.format("c")} when man then array_to_string(list_transform(c, lambda x: x.kind || '=' || case when x.id = sel then t else x.text end), ';')
  else {CANDS.format("c")} || ';manual=' || t end candidates from u""")
def edit_translations(spark, d):
    edits = X.frame(spark, d, EDITS).withColumnRenamed("after", "text")
    return _cands(review.edit_translations(full_units(spark, d), edits).units)


@query(f"""with e as (select unit_id, max(seq) seq, arg_max("after", seq) t from ({EDITS}) e group by unit_id)
select p.unit_id, 1::bigint n, 'edit_translation' "action", coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') "before", t "after" from ({PICK}) p join e on e.unit_id = p.unit_id""")
def edits_log(spark, d):
    edits = X.frame(spark, d, EDITS).withColumnRenamed("after", "text")
    log = review.edit_translations(full_units(spark, d), edits).log
    return review.listed_edits(log).select("unit_id", F.col("n").cast("long").alias("n"), "action", "before", "after")


CHOICES = f"select unit_id, 1 seq, case when page_id % 3 = 0 then concat(unit_id, '_manual') else concat(unit_id, '_raw') end candidate_id from (select page_id, unit_id from ({X.UNIT_REGIONS}) r group by page_id, unit_id) u where page_id % 2 = 0"


@query(f"""select p.unit_id, case when len(list_filter(c, lambda x: x.id = h.candidate_id)) > 0 then h.candidate_id else sel end selected,
  h.candidate_id is not null and len(list_filter(c, lambda x: x.id = h.candidate_id)) = 0 refused from ({PICK}) p left join ({CHOICES}) h on h.unit_id = p.unit_id""")
def select_candidates(spark, d):
    done = review.select_candidates(full_units(spark, d), X.frame(spark, d, CHOICES))
    bad = done.rejected.select(F.col("id").alias("unit_id"), F.lit(True).alias("refused"))
    return done.units.select("unit_id", "selected").join(bad, "unit_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


# regions


@query(f"select region_id, case when rn % 3 = 0 then 'manual' else status end status from ({G}) g")
def set_status(spark, d):
    r = regions(spark, d)
    changes = r.filter("rn % 3 = 0").select("region_id", F.lit(2).alias("seq"), F.lit("manual").alias("status"))
    bad = r.filter("rn % 4 = 0").select("region_id", F.lit(3).alias("seq"), F.lit("no such state").alias("status"))
    older = r.filter("rn % 3 = 0").select("region_id", F.lit(1).alias("seq"), F.lit("correct").alias("status"))
    return review.set_status(r, changes.union(bad).union(older)).regions.select("region_id", "status")


@query(f"select region_id, case when rn % 2 = 0 and rn % 4 > 0 then x + 5 else x end x, y, case when rn % 2 = 0 and rn % 4 > 0 then w * 2 else w end w, h from ({G}) g")
def move_regions(spark, d):
    r = regions(spark, d)
    moves = r.filter("rn % 2 = 0").select("region_id", F.lit(1).alias("seq"), (F.col("x") + 5).alias("x"), "y", F.when(F.col("rn") % 4 == 0, -1.0).otherwise(F.col("w") * 2).alias("w"), "h")
    return review.move_regions(r, moves).regions.select("region_id", "x", "y", "w", "h")


@query(f"select region_id, (case when page_id % 3 = 0 then row_number() over (partition by page_id order by region_id desc) - 1 else rn - 1 end)::int reading_order from ({G}) g")
def reorder_pages(spark, d):
    r = ordered(spark, d)
    wanted = r.groupBy("page_id").agg(F.sort_array(F.collect_list("region_id"), asc=False).alias("ids"))
    good = wanted.filter("page_id % 3 = 0")
    bad = wanted.filter("page_id % 3 = 1").withColumn("ids", F.concat("ids", F.array(F.lit("no such region"))))
    orders = good.union(bad).select("page_id", F.lit(1).alias("seq"), "ids")
    return review.reorder_pages(r, orders).regions.select("region_id", F.col("reading_order").cast("int").alias("reading_order"))


CUT = "(rn % 4 = 1)"
HALVES = f"""select g.*, 0 half from ({ORDERED}) g union all select g.*, 1 from ({ORDERED}) g where {CUT}"""


@query(f"""select page_id, region_id || case when half = 1 then '_b' else '' end region_id, type, status,
  case when half = 1 and page_id % 2 = 0 then x + w * 0.25 else x end x, case when half = 1 and page_id % 2 = 1 then y + h * 0.25 else y end y,
  case when not {CUT} or page_id % 2 = 1 then w when half = 1 then w - w * 0.25 else w * 0.25 end w, case when not {CUT} or page_id % 2 = 0 then h when half = 1 then h - h * 0.25 else h * 0.25 end h,
  case when half = 0 then confidence end confidence, (case when bool_or({CUT}) over (partition by page_id) then row_number() over (partition by page_id order by reading_order, region_id, half) - 1 else reading_order end)::int reading_order
  from ({HALVES}) q""")
def split_regions(spark, d):
    cuts = regions(spark, d).filter(CUT).select("region_id", F.lit(1).alias("seq"), F.lit(0.25).alias("ratio"), (F.col("page_id") % 2 == 0).alias("vertical"))
    out = review.split_regions(ordered(spark, d), full_units(spark, d), cuts).regions
    return out.select("page_id", "region_id", "type", "status", "x", "y", "w", "h", "confidence", F.col("reading_order").cast("int").alias("reading_order"))


@query(f"""select u.page_id, u.unit_id, string_agg(case when {CUT.replace("rn", "g.rn")} then u.region_id || ',' || u.region_id || '_b' else u.region_id end, ',' order by u.pos) ids
  from ({X.UNIT_REGIONS}) u join ({G}) g on g.region_id = u.region_id group by u.page_id, u.unit_id""")
def split_units(spark, d):
    cuts = regions(spark, d).filter(CUT).select("region_id", F.lit(1).alias("seq"), F.lit(0.25).alias("ratio"), F.lit(False).alias("vertical"))
    return _flat_units(review.split_regions(ordered(spark, d), full_units(spark, d), cuts).units)


#: Regions 2, 3 and 5 of a page are to be one; with fewer than two of them nothing happens.
GROUPS = f"""select region_id, page_id, 1 seq, cast(page_id as varchar(20)) group_id from ({G}) g where rn in (2, 3, 5)"""
MEMBER = f"""select region_id, page_id, min(rn) over (partition by page_id) first, concat('rgn_', page_id::varchar, '_', min(rn) over (partition by page_id)::varchar) survivor
from (select * from ({G}) g where rn in (2, 3, 5) qualify count(*) over (partition by page_id) > 1) q"""


@query(f"""with m as ({MEMBER}), b as (select g.page_id, m.survivor, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from ({G}) g join m on m.region_id = g.region_id group by g.page_id, m.survivor)
select g.page_id, g.region_id, g.type, coalesce(b.x, g.x) x, coalesce(b.y, g.y) y, coalesce(b.w, g.w) w, coalesce(b.h, g.h) h,
  (case when g.page_id in (select page_id from m) then row_number() over (partition by g.page_id order by g.rn) - 1 else g.rn - 1 end)::int reading_order
from ({G}) g left join b on b.survivor = g.region_id where g.region_id not in (select region_id from m where region_id <> survivor)""")
def merge_regions(spark, d):
    done = review.merge_regions(ordered(spark, d), spans(spark, d), full_units(spark, d), X.frame(spark, d, GROUPS).drop("page_id"))
    return done.regions.select("page_id", "region_id", "type", "x", "y", "w", "h", F.col("reading_order").cast("int").alias("reading_order"))


@query(f"""with m as ({MEMBER}), s as (select s.page_id, coalesce(m.survivor, s.region_id) region_id, s.text, s.confidence, s.seq old, m.survivor is not null mine, g.rn from ({X.SPANS}) s
  join ({G}) g on g.region_id = s.region_id left join m on m.region_id = s.region_id)
select page_id, region_id, (case when mine then row_number() over (partition by region_id order by rn, old) - 1 else old end)::int seq, "text" from s""")
def merge_spans(spark, d):
    done = review.merge_regions(ordered(spark, d), spans(spark, d), full_units(spark, d), X.frame(spark, d, GROUPS).drop("page_id"))
    return done.spans.select("page_id", "region_id", F.col("seq").cast("int").alias("seq"), "text")


@query(f"""with m as ({MEMBER}), p as (select u.page_id, u.unit_id, coalesce(m.survivor, u.region_id) region_id, min(u.pos) pos from ({X.UNIT_REGIONS}) u left join m on m.region_id = u.region_id group by 1, 2, 3)
select page_id, unit_id, string_agg(region_id, ',' order by pos) ids from p group by page_id, unit_id""")
def merge_units(spark, d):
    done = review.merge_regions(ordered(spark, d), spans(spark, d), full_units(spark, d), X.frame(spark, d, GROUPS).drop("page_id"))
    return _flat_units(done.units)


GONE = "(rn % 3 = 1 or page_id % 4 = 0)"


@query(f"""select page_id, region_id, (row_number() over (partition by page_id order by rn) - 1)::int reading_order, n::int spans from (
  select g.page_id, g.region_id, g.rn, coalesce(s.n, 0) n from ({G}) g left join (select region_id, count(*) n from ({X.SPANS}) s group by region_id) s on s.region_id = g.region_id where not {GONE.replace("rn", "g.rn").replace("page_id", "g.page_id")}) q""")
def delete_regions(spark, d):
    gone = regions(spark, d).filter(GONE).select("region_id", F.lit(1).alias("seq"))
    done = review.delete_regions(ordered(spark, d), spans(spark, d), full_units(spark, d), gone)
    n = done.spans.groupBy("region_id").agg(F.count("*").alias("n"))
    return done.regions.join(n, "region_id", "left").select("page_id", "region_id", F.col("reading_order").cast("int").alias("reading_order"), F.coalesce("n", F.lit(0)).cast("int").alias("spans"))


@query(f"""select u.page_id, u.unit_id, string_agg(u.region_id, ',' order by u.pos) ids from ({X.UNIT_REGIONS}) u join ({G}) g on g.region_id = u.region_id where not {GONE.replace("rn", "g.rn").replace("page_id", "g.page_id")} group by u.page_id, u.unit_id""")
def delete_units(spark, d):
    gone = regions(spark, d).filter(GONE).select("region_id", F.lit(1).alias("seq"))
    return _flat_units(review.delete_regions(ordered(spark, d), spans(spark, d), full_units(spark, d), gone).units)


#: Spans with two alternatives, one of which is the text itself for some.
WITH_ALTERNATIVES = f"select s.*, array('alt a', concat('alt ', text)) alternatives from ({X.SPANS}) s"


@query(f"""select region_id, seq, case when seq = 0 then 'alt a' else "text" end "text", case when seq > 0 then 'alt a|alt ' || "text" when "text" = '' then 'alt ' else "text" || '|alt ' || "text" end alternatives from ({X.SPANS}) s""")
def accept_alternatives(spark, d):
    s = X.frame(spark, d, WITH_ALTERNATIVES)
    choices = s.filter("seq = 0").select("region_id", F.col("seq").alias("span_seq"), F.lit(1).alias("seq"), F.lit("alt a").alias("text"))
    wrong = s.filter("seq = 1").select("region_id", F.col("seq").alias("span_seq"), F.lit(1).alias("seq"), F.lit("none of them").alias("text"))
    return review.accept_alternatives(s, choices.union(wrong)).spans.select("region_id", "seq", "text", F.array_join("alternatives", "|").alias("alternatives"))


@query(f"""select g.page_id, g.region_id, g.status, (rn - 1)::int reading_order, null::varchar source, null::varchar target from ({G}) g
union all select page_id, 'drawn_' || page_id::varchar, 'manual', n::int, 'read ' || page_id::varchar, 'EN[read ' || page_id::varchar || ']' from (select page_id, count(*) n from ({G}) g where page_id % 3 = 0 group by page_id) q""")
def create_regions(spark, d):
    r, s, u = ordered(spark, d), spans(spark, d), full_units(spark, d)
    drawn = r.filter("page_id % 3 = 0").select("page_id").distinct().select(
        "page_id", F.concat(F.lit("drawn_"), F.col("page_id").cast("string")).alias("region_id"), F.lit(1).alias("seq"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(30.0).alias("w"), F.lit(10.0).alias("h"), F.lit("bubble").alias("type"))
    flat = drawn.withColumns({"w": F.lit(0.0), "region_id": F.concat("region_id", F.lit("_flat"))})
    read = lambda rows: rows.withColumns({"text": F.concat(F.lit("read "), F.col("page_id").cast("string")), "confidence": F.lit(0.5)})
    said = lambda rows: rows.withColumns({"translation": F.concat(F.lit("EN["), "source", F.lit("]")), "translation_confidence": F.lit(0.9)})
    done = review.create_regions(r, s, u, drawn.union(flat), read, said)
    new_spans = done.spans.filter("region_id like 'drawn%'").select("region_id", F.col("text").alias("source"))
    new_units = done.units.filter("unit_id like 'tu_drawn%'").select(F.get("ordered_region_ids", F.lit(0)).alias("region_id"), C.selected_text(F.col("candidates"), F.col("selected")).alias("target"))
    out = done.regions.join(new_spans, "region_id", "left").join(new_units, "region_id", "left")
    return out.select("page_id", "region_id", "status", F.col("reading_order").cast("int").alias("reading_order"), "source", "target")


@query(f"""select page_id, region_id, seq, "text" from ({X.SPANS}) s where region_id not in (select region_id from ({_pick("rn % 4 = 2")}) w)
union all select page_id, region_id, 0, 'again ' || region_id from ({G}) g where rn % 4 = 2""")
def reread_regions(spark, d):
    read = lambda rows: rows.withColumns({"text": F.concat(F.lit("again "), "region_id"), "confidence": F.lit(0.5)})
    return review.reread_regions(regions(spark, d), spans(spark, d), X.frame(spark, d, _pick("rn % 4 = 2")), read).spans.select("page_id", "region_id", "seq", "text")


# views and snapshots


@query(f"""select o.o_orderkey page_id, o.o_orderkey % 7 rev, coalesce(r.n, 0)::int n_regions, r.regions, coalesce(u.n, 0)::int n_units, u.units from orders o
left join (select page_id, count(*) n, string_agg(region_id || ':' || type || ':' || coalesce(agg::varchar, '') || ':' || low::varchar || ':' || flag::varchar || ':' || coalesce(texts, ''), ';' order by rn) regions from (
  select a.page_id, a.region_id, a.rn, a.type, round(a.agg * 10)::int agg, (a.agg is null or a.agg < 0.5) low, coalesce(f.c < 0.5, false) flag, s.texts from ({AGG}) a left join ({FLAGS}) f on f.region_id = a.region_id
  left join (select region_id, string_agg("text", '|' order by seq) texts from ({X.SPANS}) s group by region_id) s on s.region_id = a.region_id) q group by page_id) r on r.page_id = o.o_orderkey
left join (select page_id, count(*) n, string_agg(unit_id || ':' || coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') || ':' || len(c)::varchar || ':' || len(ids)::varchar, ';' order by unit_id) units from ({LISTED}) l group by page_id) u on u.page_id = o.o_orderkey""")
def page_views(spark, d):
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % 7).alias("rev"))
    r, s = X.shared(spark, d, ORDERED), X.shared(spark, d, X.SPANS)
    flags = Q.ai_flags(X.shared(spark, d, X.UNIT_REGIONS), X.shared(spark, d, X.CANDIDATES), paged=True)
    view = review.page_views(pages, r, s, full_units(spark, d, X.shared), flags)
    text = lambda b: b.cast("string")
    region = lambda r: F.concat_ws(":", r["region_id"], r["type"], F.coalesce(F.round(r["confidence"] * 10).cast("int").cast("string"), F.lit("")), text(r["low_confidence"]), text(r["ai_flagged"]), F.coalesce(F.array_join(F.transform(r["ocr"], lambda o: o["text"]), "|"), F.lit("")))
    unit = lambda u: F.concat_ws(":", u["unit_id"], u["translation"], F.size(u["candidates"]).cast("string"), F.size(u["ordered_region_ids"]).cast("string"))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"n_{c}")
    return view.select("page_id", "rev", n("regions"), F.array_join(F.transform("regions", region), ";").alias("regions"), n("units"), F.array_join(F.transform("units", unit), ";").alias("units"))


@query(f"""with e as (select unit_id, max(seq) seq, arg_max("after", seq) t from ({EDITS}) e group by unit_id)
select p.unit_id, coalesce(e.t, list_filter(c, lambda x: x.id = sel)[1].text, '') translation, coalesce(e.seq::varchar || ':' || coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') || '>' || e.t, '') edits
from ({PICK}) p left join e on e.unit_id = p.unit_id""")
def unit_views(spark, d):
    done = review.edit_translations(full_units(spark, d), X.frame(spark, d, EDITS).withColumnRenamed("after", "text"))
    rows = review.unit_views(done.units, done.log).select("unit_id", "view.translation", "view.edits")
    listed = F.array_join(F.transform("edits", lambda e: F.concat(e["seq"].cast("string"), F.lit(":"), e["before"], F.lit(">"), e["after"])), "|")
    return rows.select("unit_id", "translation", F.coalesce(listed, F.lit("")).alias("edits"))


@query(f"select page_id, region_id, x, y, w, h, status, rn from ({G}) g")
def snapshot_restore(spark, d):
    """Pages are saved, spoilt and restored."""
    r, s, u = X.shared(spark, d, X.REGIONS), X.shared(spark, d, X.SPANS), full_units(spark, d, X.shared)
    saved = review.snapshots(r, s, u)
    spoilt = r.filter("rn > 1").withColumn("status", F.lit("ignore"))
    return review.restored(spoilt, s, u, saved).regions.select("page_id", "region_id", "x", "y", "w", "h", "status", "rn")


@query(f'select page_id, unit_id, {CANDS.format("c")} candidates, sel selected, array_to_string(ids, \',\') ids from ({LISTED}) l')
def snapshot_units(spark, d):
    r, s, u = X.shared(spark, d, X.REGIONS), X.shared(spark, d, X.SPANS), full_units(spark, d, X.shared)
    saved = review.snapshots(r, s, u)
    back = review.restored(r, s, u.filter("page_id % 2 = 0"), saved).units
    return _cands(back, "page_id", F.array_join("ordered_region_ids", ",").alias("ids")).select("page_id", "unit_id", "candidates", "selected", "ids")


ENTRIES_OF = f"select page_id, cmd_seq seq, cmd = 'undo' undone from ({X.COMMANDS}) c where cmd in ('edit', 'undo')"


@query(f"""with e as ({ENTRIES_OF}), b as (select page_id, seq, undone or seq = (select max(seq) from e where not undone) undone from e)
select page_id, seq, undone, undone and seq <> (select min(seq) from b where undone) again from b""")
def undo_everywhere(spark, d):
    back = review.step_back(X.frame(spark, d, ENTRIES_OF))
    again = review.step_forward(back).select("seq", F.col("undone").alias("again"))
    return back.join(again, "seq").select("page_id", "seq", "undone", "again")


@query(f"""with recursive c as (select page_id, cmd_seq, cmd, row_number() over (partition by page_id order by cmd_seq) n from ({X.COMMANDS}) c),
s as (select distinct page_id, 0::bigint n, []::int[] done, []::int[] undone from c
 union all select s.page_id, c.n, case when cmd = 'edit' then list_append(done, cmd_seq) when cmd = 'undo' then done[1:len(done) - 1] when cmd = 'redo' and len(undone) > 0 then list_append(done, undone[1]) else done end,
  case when cmd = 'edit' then [] when cmd = 'undo' and len(done) > 0 then list_prepend(done[len(done)], undone) when cmd = 'redo' then undone[2:] else undone end
 from s join c on c.page_id = s.page_id and c.n = s.n + 1),
l as (select page_id, arg_max(done, n) done, arg_max(undone, n) undone from s group by page_id)
select page_id, unnest(done) seq, false undone from l union all select page_id, unnest(undone), true from l""")
def history_listing(spark, d):
    return H.listing(X.frame(spark, d, X.COMMANDS))


# stages


@query(f"""with o as ({_order_sql("-")}) select o.page_id, o.region_id, case when o.page_id % 3 = 0 then g.rn - 1 else o.reading_order end::int reading_order from o join ({G}) g on g.region_id = o.region_id""")
def reading_order_stage(spark, d):
    """Pages divisible by three have the signature of the run before: their order, set by hand, stays."""
    first = stages.reading_order_stage(ordered(spark, d))
    done = stages.reading_order_stage(ordered(spark, d), provenance=first.provenance.filter("page_id % 3 = 0"))
    return done.table.select("page_id", "region_id", F.col("reading_order").cast("int").alias("reading_order"))


PROPOSED = "case when seq = 0 then '' else \"text\" end"


@query(f"""select region_id, seq, "text", case when not low or seq > 0 then 'alt a' else 'alt a|fix of ' || "text" end alternatives from (
  select s.*, trim("text") <> '' and (confidence is null or confidence < 0.5) low from ({X.SPANS}) s) q""")
def ocr_correct_stage(spark, d):
    s = spans(spark, d).withColumn("alternatives", F.array(F.lit("alt a")))
    some = F.when(F.col("seq") == 0, F.array(F.concat(F.lit("fix of "), "text"), F.lit("alt a"), F.col("text"), F.lit(""), F.concat(F.lit("fix of "), "text"))).otherwise(F.array(F.lit("alt a")))
    done = stages.ocr_correct_stage(s, lambda rows: rows.withColumn("proposed", some), "fixer")
    return done.table.select("region_id", "seq", "text", F.array_join("alternatives", "|").alias("alternatives"))


SOURCES = f"""select u.page_id, u.unit_id, min(u.rn) rk, coalesce(string_agg(s.text, chr(10) order by u.pos) filter (s.text <> ''), '') source from ({X.UNIT_REGIONS}) u
left join (select region_id, arg_min("text", seq) "text" from ({X.SPANS}) s group by region_id) s on s.region_id = u.region_id group by u.page_id, u.unit_id"""
#: A small glossary over the fixture's texts: order, source, target, aliases.
TERMS = [(0, "t1.0", "first", ["EN[t1", "EN["]), (1, "t3", "third", ["t3.0", "t2"])]
SAID = "'EN[' || replace(source, chr(10), ' ') || ']'"
ENFORCED = f"case when contains(source, 't1.0') then replace(replace({SAID}, 'EN[t1', 'first'), 'EN[', 'first') else {SAID} end"


def _terms(spark):
    return spark.createDataFrame(TERMS, "ord int, source string, target string, aliases array<string>")


@query(f"""with s as ({SOURCES}), n as (select *, list_filter(list(source) over (partition by page_id order by rk rows between 2 preceding and 1 preceding), lambda t: t <> '') p,
    list_filter(list(source) over (partition by page_id order by rk rows between 1 following and 2 following), lambda t: t <> '') f, row_number() over (order by page_id) - 1 z from s)
select page_id, unit_id, source, coalesce(array_to_string(p, '|'), '') preceding, coalesce(array_to_string(f, '|'), '') "following", (page_id // 2)::bigint page_index, (select count(*) from orders) page_count,
  concat_ws(',', case when contains(source, 't1.0') then 't1.0=first' end, case when contains(source, 't3') then 't3=third' end) terms from n""")
def unit_contexts(spark, d):
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), F.floor(F.col("o_orderkey") / 2).alias("idx"))
    got = stages.unit_contexts(pages, ordered(spark, d), spans(spark, d), full_units(spark, d), _terms(spark))
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws("=", t["source"], t["target"])), ",")
    return got.select("page_id", "unit_id", "source", F.array_join("preceding", "|").alias("preceding"), F.array_join("following", "|").alias("following"), "page_index", "page_count", terms.alias("terms"))


def _loud(body: str, attempt: int) -> tuple[int, str]:
    """A service that shouts the line back; by the first digit of the line's MD5 it refuses, fails twice, prattles or never answers."""
    import hashlib
    import json

    line = json.loads(body)["messages"][-1]["content"].rpartition("Line:\n")[2]
    digit = hashlib.md5(line.encode()).hexdigest()[0]
    if digit == "0":
        return 404, "no such model"
    if digit == "1" and attempt < 2:
        return 503, "busy"
    if digit == "2":
        return 200, "no JSON"
    if digit == "3":
        raise TimeoutError("no answer")
    return 200, json.dumps({"choices": [{"message": {"content": f" {line}! "}}]})


@query("""with c as (select conv_id, turn, trim(text) line, substr(md5(trim(text)), 1, 1) k from conversations)
select conv_id, turn, case when line = '' or k in ('0', '2', '3') then null else md5(line || '!') end said, case when line = '' then null when k = '0' then 'rejected' when k = '2' then 'malformed' when k = '3' then 'timeout' end error,
  case when line = '' then null when k in ('1', '3') then 3 else 1 end attempts, case when line = '' then null when k = '0' then '404: no such model' when k = '2' then 'no JSON' when k = '3' then 'no answer' end message from c""")
def translate_calls(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.trim("text").alias("source"))
    none = F.array().cast("array<string>")
    rows = turns.withColumns({"preceding": none, "following": none, "terms": F.array().cast("array<struct<source:string,target:string>>")})
    done = calls.chat_translator(_loud, "m", "fr", "en", strict=False, retries=2, pause=0.0)(rows)
    return done.select("conv_id", "turn", F.md5("translation").alias("said"), "error", "attempts", "message")


@query(f"""with t as (select page_id, unit_id, case when trim(source) = '' then '' else {ENFORCED} end said from ({SOURCES}) s),
f as (select page_id, unit_id, case when contains(source, 't3') then replace(replace(said, 't3.0', 'third'), 't2', 'third') else said end fixed from t join (select unit_id, source from ({SOURCES}) s) using (unit_id)),
u as (select p.page_id, p.unit_id, p.c, p.sel, f.fixed, list_filter(c, lambda x: x.kind <> 'raw') rest from ({PICK}) p join f on f.unit_id = p.unit_id)
select unit_id, case when page_id % 4 = 0 then {CANDS.format("c")} when len(rest) = 0 then 'raw=' || fixed else {CANDS.format("rest")} || ';raw=' || fixed end candidates,
  case when page_id % 4 = 0 then coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') when len(list_filter(rest, lambda x: x.id = sel)) > 0 then list_filter(rest, lambda x: x.id = sel)[1].text else fixed end chosen,
  case when page_id % 4 = 0 then null else 'natural' end style from u""")
def translate_stage(spark, d):
    """Pages divisible by four have the signature of the run before and stay as they are."""
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("idx"))
    said = lambda rows: rows.withColumns({"translation": F.concat(F.lit("EN["), F.replace("source", F.lit("\n"), F.lit(" ")), F.lit("]")), "translation_confidence": F.lit(0.9)})
    table = lambda sql: X.shared(spark, d, sql, PLACES)
    args = (pages, table(ORDERED), table(X.SPANS), full_units(spark, d, X.shared, columns=PLACES), _terms(spark), said, "echo", "en")
    first = stages.translate_stage(*args, style="natural").provenance.filter("page_id % 4 = 0")
    out = stages.translate_stage(*args, style="natural", provenance=first).table
    return _cands(out, C.selected_text(F.col("candidates"), F.col("selected")).alias("chosen"), "style").drop("selected")


@query(f"""select region_id, seq, "text", source from (
  select g.region_id, g.rn, g.status, s.seq, s.text, s.source from ({G}) g left join (select region_id, 0 seq, 'seen ' || region_id "text", 'detector' source from ({G}) g where rn % 2 = 0) s on s.region_id = g.region_id) q
where status <> 'ignore' and rn % 2 = 0 union all select region_id, 0, 'read ' || region_id, 'reader' from ({G}) g where status <> 'ignore' and rn % 2 = 1""")
def ocr_stage(spark, d):
    r = regions(spark, d)
    old = r.select("page_id", "region_id", F.lit(0).alias("seq"), F.concat(F.lit("seen "), "region_id").alias("text"), F.lit(0.7).alias("confidence"), F.when(F.col("rn") % 2 == 0, "detector").otherwise("someone").alias("source"))
    read = lambda rows: rows.withColumns({"text": F.concat(F.lit("read "), "region_id"), "confidence": F.lit(0.6)})
    return stages.ocr_stage(r, old, read, "reader", "detector").select("region_id", "seq", "text", "source")


@query(f"""select page_id, count(*) n, min(x) x, min("text") "text" from (
  select page_id, x, null "text" from ({G}) g where page_id % 5 = 0 and page_id % 2 = 1
  union all select page_id, 7.0, 'found' from (select distinct page_id from ({G}) g where not (page_id % 5 = 0 and page_id % 2 = 1)) q) r group by page_id""")
def detect_stage(spark, d):
    """Pages divisible by ten had no region; those by five alone are unchanged."""
    r = regions(spark, d).select("page_id", "region_id", "x", "y", "w", "h", "type", "confidence", "status")
    pages = r.select("page_id").distinct().withColumn("source_hash", F.sha2(F.col("page_id").cast("string"), 256))
    engine = lambda p: p.select("page_id", F.lit(7.0).alias("x"), F.lit(8.0).alias("y"), F.lit(9.0).alias("w"), F.lit(9.0).alias("h"), F.lit("unknown").alias("type"), F.lit(0.9).alias("confidence"), F.lit("auto").alias("status"), F.lit("found").alias("text"), F.lit(0.8).alias("text_confidence"))
    none = spark.createDataFrame([], "page_id long, region_id string, seq int, text string, confidence double, source string")
    all_, _ = stages.detect_stage(pages, r, none, engine, "finder")
    old = r.filter("page_id % 5 = 0 and page_id % 2 = 1")
    done, read = stages.detect_stage(pages, old, none, engine, "finder", all_.provenance.filter("page_id % 5 = 0"))
    return done.table.join(read.select("region_id", "text"), "region_id", "left").groupBy("page_id").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("text").alias("text"))


@query(f"""select region_id, case when status = 'auto' and type = 'unknown' and w * h / 960000.0 >= 0.002 and (w / h >= 2.2 or w / h <= 1 / 2.2::double) then 'sfx' else type end type from ({G}) g""")
def sfx_stage(spark, d):
    return stages.sfx_stage(regions(spark, d), PAGE_W, PAGE_H, 0.002).select("region_id", "type")


ARTIFACTS = "select o_orderkey page_id, case when o_custkey % 2 = 0 then 'mask' else 'render' end kind, 1 seq, concat('old', cast(o_orderkey as varchar(20))) path, cast(o_orderkey % 5 as bigint) overflow, 'old' signature from {orders} where o_custkey % 3 > 0"


def _artifacts(spark, d) -> DataFrame:
    return spark.sql(ARTIFACTS, orders=spark.read.parquet(f"{d}/orders.parquet"))


@query(f"""select page_id, kind, path from ({ARTIFACTS.replace("{orders}", "orders")}) a where kind = 'render'
union all select o_orderkey, 'mask', case when o_orderkey % 3 = 0 then 'again' else 'first' end || coalesce(n, 0)::varchar from orders left join (select page_id, count(*) n from ({G}) g where type <> 'sfx' group by page_id) g on g.page_id = o_orderkey""")
def mask_stage(spark, d):
    """Run twice, the second time with the regions of pages divisible by three moved: only these are masked again."""
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_hash"))
    engine = lambda word: lambda p: p.select("page_id", F.concat(F.lit(word), F.greatest(F.coalesce(F.size("boxes"), F.lit(0)), F.lit(0)).cast("string")).alias("path"), F.lit(0).cast("long").alias("overflow"))
    first = stages.mask_stage(pages, regions(spark, d), _artifacts(spark, d), engine("first"), "mask", ("sfx",))
    moved = regions(spark, d).withColumn("x", F.when(F.col("page_id") % 3 == 0, F.col("x") + 1).otherwise(F.col("x")))
    some = pages.withColumn("source_hash", F.when(F.col("page_id") % 3 == 0, F.lit("other")).otherwise(F.col("source_hash")))
    return stages.mask_stage(some, moved, first.table, engine("again"), "mask", ("sfx",)).table.select("page_id", "kind", "path")


@query(f"""with a as ({ARTIFACTS.replace("{orders}", "orders")}) select o_orderkey page_id, case when a.kind = 'mask' then 'old' || o_orderkey::varchar else 'img' end || ':' || coalesce(p.n, 0)::varchar path
from orders left join a on a.page_id = o_orderkey left join (select u.page_id, count(*) n from (select u.page_id, u.unit_id, bool_and(status = 'ignore') ign from ({X.UNIT_REGIONS}) u join ({G}) g on g.region_id = u.region_id group by 1, 2) u
  join ({PICK}) p on p.unit_id = u.unit_id where not ign and coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') <> '' group by u.page_id) p on p.page_id = o_orderkey""")
def composite_stage(spark, d):
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), F.lit("img").alias("image_path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_hash"))
    placed = export.placements(unit_regions(spark, d), regions(spark, d), units(spark, d), _order(spark, d))
    engine = lambda p: p.select("page_id", F.concat("base_path", F.lit(":"), F.greatest(F.coalesce(F.size("placements"), F.lit(0)), F.lit(0)).cast("string")).alias("path"), F.lit(0).cast("long").alias("overflow"))
    return stages.composite_stage(pages, placed, _artifacts(spark, d), engine, "paint").table.filter("kind = 'render'").select("page_id", "path")


@query("select o_orderkey page_id from orders where o_orderkey % 3 > 0")
def preprocess_stage(spark, d):
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_hash"))
    done = stages.preprocess_stage(pages.filter("page_id % 3 = 0"), "v1", spark.createDataFrame([], "cache_key string")).select("cache_key")
    return stages.preprocess_stage(pages, "v1", done).select("page_id")


@query(f"""with a as ({ARTIFACTS.replace("{orders}", "orders")}) select o_orderkey page_id, o_orderkey idx, case when kind = 'render' then 'render' when kind = 'mask' then 'masked' else 'original' end source,
  'pages/' || lpad(o_orderkey::varchar, greatest(4, length(o_orderkey::varchar))::int, '0') || '.png' file, case when kind = 'render' then overflow else 0 end overflow from orders left join a on a.page_id = o_orderkey""")
def export_manifest(spark, d):
    return _bundle(spark, d).pages.select("page_id", "idx", "source", "file", "overflow")


def _bundle(spark, d) -> stages.Bundle:
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("idx"), F.lit("img").alias("image_path"))
    return stages.export_bundle(pages, _artifacts(spark, d), unit_regions(spark, d), regions(spark, d), spans(spark, d), units(spark, d), _order(spark, d))


@query(f"""select o_orderkey page_id, 0 n, '## Page ' || (o_orderkey + 1)::varchar line from orders
union all select page_id, n, '[' || n::varchar || '] ' || source || '  ->  ' || target from (
select u.page_id, row_number() over (partition by u.page_id order by rank, u.unit_id)::int n, source, coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') target
from (select u.page_id, u.unit_id, min(u.rn) rank, coalesce(string_agg(s.text, ' ' order by u.pos, s.seq), '') source from ({X.UNIT_REGIONS}) u left join ({X.SPANS}) s on s.region_id = u.region_id group by u.page_id, u.unit_id) u
join ({PICK}) p on p.unit_id = u.unit_id) q""")
def export_transcript(spark, d):
    return _bundle(spark, d).transcript.select("page_id", F.col("n").cast("int").alias("n"), "line")


@query(f"""with a as ({ARTIFACTS.replace("{orders}", "orders")}) select 'import' stage, (select count(*) from orders) n union all select 'preprocess', (select count(*) from orders where o_orderkey % 2 = 0)
union all select 'detect', (select count(*) from ({G}) g) union all select 'order', (select count(*) from ({G}) g where rn % 2 = 0) union all select 'group', (select count(*) from ({UNITS}) u)
union all select 'ocr', (select count(*) from ({X.SPANS}) s) union all select 'translate', (select count(*) from ({PICK}) p where sel is not null)
union all select 'render', (select count(*) from a where kind = 'mask') union all select 'compose', (select count(*) from a where kind = 'render')""")
def dashboard(spark, d):
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"))
    r = regions(spark, d).withColumn("reading_order", F.when(F.col("rn") % 2 == 0, F.col("rn")))
    return Q.dashboard(pages, r, spans(spark, d), units(spark, d), _artifacts(spark, d), pages.filter("page_id % 2 = 0"))


# glossaries and presets


#: Every third word that is said by users, and words that nobody says.
ASKED_SQL = f"select source from ({PROJECT_SQL}) p where ord % 3 = 0 union all select 'nobody ' || n_name from nation"


def _asked(spark, d):
    some = _layers(spark, d)[0].filter("ord % 3 = 0").select("source")
    return some.union(spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("nobody "), "n_name")))


@query(f"""with s as ({SERIES_SQL}), n as (select * from ({PROJECT_SQL}) p where source in ({ASKED_SQL}))
select (row_number() over (order by s.ord nulls last, n.ord) - 1)::int ord, source, coalesce(n.target, s.target) target from s full join n using (source)""")
def glossary_promote(spark, d):
    project, series = _layers(spark, d)
    return glossary.promote(series, project, _asked(spark, d))[0]


@query("select 'nobody ' || n_name source from nation")
def glossary_promote_unknown(spark, d):
    project, series = _layers(spark, d)
    return glossary.promote(series, project, _asked(spark, d))[1]


@query(f"""with s as (select * from ({SERIES_SQL}) s where source not in ({ASKED_SQL})), n as ({PROJECT_SQL}), b as (select 0 l, * from s where source not in (select source from n) union all select 1, * from n)
select (row_number() over (order by l, ord) - 1)::int ord, source, target from b""")
def glossary_put_last(spark, d):
    project, series = _layers(spark, d)
    return glossary.put_last(glossary.remove(series, _asked(spark, d)), project)


#: A preset of each nation, and one that each customer asks for: names repeat, and a style is not known.
OLD_PRESETS = "select n_nationkey ord, concat('preset ', cast(n_nationkey as varchar(20))) name, case n_nationkey % 4 when 0 then 'literal' when 1 then 'balanced' when 2 then 'natural' else 'localized' end style, case when n_nationkey % 3 = 0 then 'g.json' end glossary_path, n_nationkey % 5 pad, n_nationkey % 7 border from {nation}"
NEW_PRESETS = "select cast(c_custkey as int) ord, concat('preset ', cast((c_custkey * 7) % 43 as varchar(20))) name, case cast(c_custkey % 5 as int) when 0 then 'literal' when 1 then 'unheard of' when 2 then 'natural' when 3 then 'balanced' else 'localized' end style, case when c_custkey % 2 = 0 then concat('g', cast(c_nationkey as varchar(20)), '.json') end glossary_path, cast(c_custkey % 11 as int) pad, c_nationkey border from {customer}"


@query(f"""with o as ({OLD_PRESETS}), n as (select name, arg_max(struct_pack(style := style, glossary_path := glossary_path, pad := pad, border := border), ord) v, min(ord) first from ({NEW_PRESETS}) c where style <> 'unheard of' group by name)
select (row_number() over (order by o.ord nulls last, n.first) - 1)::int ord, name, case when n.v is null then o.style else n.v.style end style, case when n.v is null then o.glossary_path else n.v.glossary_path end glossary_path,
  case when n.v is null then o.pad else n.v.pad end pad, case when n.v is null then o.border else n.v.border end border from o full join n using (name)""")
def preset_upsert(spark, d):
    return presets.upsert(X.frame(spark, d, OLD_PRESETS), X.frame(spark, d, NEW_PRESETS))


# candidates


@query(f"""select region_id, seq, 'alt a|alt ' || "text" || case when seq = 0 then '|new' else '' end alternatives from ({X.SPANS}) s""")
def merge_alternatives(spark, d):
    s = X.frame(spark, d, WITH_ALTERNATIVES)
    proposed = F.when(F.col("seq") == 0, F.array(F.lit("new"), F.lit(""), F.col("text"), F.lit("alt a"), F.lit("new"))).otherwise(F.array(F.col("text")))
    return s.select("region_id", "seq", F.array_join(C.merged_alternatives(F.col("text"), F.col("alternatives"), proposed), "|").alias("alternatives"))


@query("""select c_custkey id, case c_custkey % 4 when 0 then 'text ' || c_custkey::varchar when 1 then 'r' || c_custkey::varchar end candidate, case when c_custkey % 4 = 0 then least(1, c_custkey % 3)::double end confidence,
  case c_custkey % 4 when 0 then 'w' when 1 then '' end warnings from customer""")
def parse_replies(spark, d):
    k = F.col("c_custkey")
    fenced = F.concat(F.lit('```json\n{"candidate": " text '), k.cast("string"), F.lit(' ", "confidence": '), (k % 3).cast("string"), F.lit(', "warnings": ["w", " "]}\n```'))
    reply = F.when(k % 4 == 0, fenced).when(k % 4 == 1, F.concat(F.lit('{"readability": "r'), k.cast("string"), F.lit('"}'))).when(k % 4 == 2, "no json").otherwise('{"candidate": " "}')
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), C.parsed_reply(reply).alias("p"))
    return rows.select("id", F.col("p.candidate").alias("candidate"), F.col("p.confidence").alias("confidence"), F.array_join("p.warnings", "|").alias("warnings"))


@query(f"""with s as ({SOURCES}), n as (select *, list_filter(list(source) over (partition by page_id order by rk rows between 2 preceding and 1 preceding), lambda t: t <> '') p,
    list_filter(list(source) over (partition by page_id order by rk rows between 1 following and 2 following), lambda t: t <> '') f from s)
select unit_id, concat_ws(chr(10) || chr(10), case when contains(source, 't1.0') or contains(source, 't3') then 'Always translate these terms so: ' || concat_ws('; ', case when contains(source, 't1.0') then 't1.0 = first' end, case when contains(source, 't3') then 't3 = third' end) || '.' end,
  case when len(p) > 0 then 'Said before: ' || array_to_string(p, ' / ') end, case when len(f) > 0 then 'Said after: ' || array_to_string(f, ' / ') end, 'Line:' || chr(10) || source) said from n""")
def translation_prompts(spark, d):
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("idx"))
    got = stages.unit_contexts(pages, ordered(spark, d), spans(spark, d), full_units(spark, d), _terms(spark))
    messages = prompts.translation_messages(F.col("source"), F.col("preceding"), F.col("following"), F.col("terms"), "ja", "en")
    return got.select("unit_id", F.get(messages, F.lit(1))["content"].alias("said"))


@query("""select c_custkey id, case c_custkey % 3 when 0 then 'a' || c_custkey::varchar || '|b' when 1 then '' end alternatives, case when c_custkey % 3 = 0 then 1.0::double end confidence from customer""")
def parse_corrections(spark, d):
    k = F.col("c_custkey")
    good = F.concat(F.lit('```json\n{"alternatives": [" a'), k.cast("string"), F.lit('", " ", "b", "b ", "c", "d"], "confidence": 1.5, "rationale": " "}\n```'))
    reply = F.when(k % 3 == 0, good).when(k % 3 == 1, '{"alternatives": []}').otherwise("[1, 2]")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), prompts.corrected(reply, 2).alias("p"))
    return rows.select("id", F.array_join("p.alternatives", "|").alias("alternatives"), F.col("p.confidence").alias("confidence"))


# detection


#: Boxes as a model gives them: corners in a space twice as large, moved by 3 and 5; scores beyond 0..1, classes beyond the labels.
RAW = f"select page_id, rn, x * 2 + 3 x1, y * 2 + 5 y1, (x + w) * 2 + 3 x2, (y + h) * 2 + 5 y2, coalesce(confidence * 1.25, 0.1) score, cast(rn as double) cls from ({G}) g"


@query(f"""with recursive g as (select * from (select page_id, rn, x, y, w, h, coalesce(['bubble', 'narration', 'sfx', 'caption'][rn + 1], 'unknown') type, round(least(1.0, coalesce(confidence * 1.25, 0.1)), 3) confidence from ({G}) g) q where confidence >= 0.3),
b as (select *, row_number() over (partition by page_id order by confidence desc, rn) n from g),
t as (select page_id, n, [{{'x': x, 'y': y, 'w': w, 'h': h, 'rn': rn}}] kept from b where n = 1
  union all select b.page_id, b.n, case when len(list_filter(t.kept, lambda a: {INTER} > 0 and ({INTER}) / (a.w * a.h + b.w * b.h - {INTER}) > 0.05)) > 0 then t.kept
    else list_append(t.kept, {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 'rn': b.rn}}) end from t join b on b.page_id = t.page_id and b.n = t.n + 1),
flat as (select page_id, unnest(kept).rn rn from (select page_id, arg_max(kept, n) kept from t group by page_id) l),
c as (select g.page_id, g.rn, g.type, g.confidence, least(greatest(0.0::double, x), 700.0) x0, least(greatest(0.0::double, y), 1100.0) y0, least(greatest(0.0::double, x + w), 700.0) x1, least(greatest(0.0::double, y + h), 1100.0) y1 from flat join g on g.page_id = flat.page_id and g.rn = flat.rn)
select page_id, rn, x0 x, y0 y, x1 - x0 w, y1 - y0 h, type, confidence, (row_number() over (partition by page_id order by y0, x0, rn) - 1)::int place from c where x1 - x0 >= 1 and y1 - y0 >= 1""")
def model_regions(spark, d):
    return detect.model_regions(X.frame(spark, d, RAW), 700, 1100, 2.0, 3.0, 5.0, 0.3, 0.05)


QUADS = f"""select page_id, collect_list(named_struct('rn', rn, 'p', case when rn % 5 = 0 then array(array(x, y), array(x + w)) else array(array(x, y), array(x + w, y), array(x + w, y + h), array(x), array(x, y + h)) end, 't', case when rn % 3 = 0 then null else concat('t', cast(rn as varchar(9))) end)) l
from ({G}) g group by page_id"""


@query(f"""select page_id, (row_number() over (partition by page_id order by y, x, rn) - 1)::int place, x, y, w, h, case when rn = 1 then 0.5::double else 0.9::double end confidence, 't' || rn::varchar "text" from ({G}) g where rn % 5 > 0 and rn % 3 > 0""")
def quad_regions(spark, d):
    rows = X.frame(spark, d, QUADS).withColumn("l", F.array_sort("l")).select("page_id", F.transform("l", lambda q: q["p"]).alias("polys"), F.transform("l", lambda q: q["t"]).alias("texts"), F.array(F.lit(0.5)).alias("scores"))
    return detect.quad_regions(rows).select("page_id", "place", "x", "y", "w", "h", "confidence", "text")


@query(f"""select region_id, coalesce(string_agg("text", chr(10) order by seq), '') "text", round(avg(case when seq = 0 then 0.25::double end), 3) confidence from ({X.SPANS}) s group by region_id""")
def line_flatten(spark, d):
    lists = spans(spark, d).groupBy("region_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]).alias("texts"))
    got = lists.select("region_id", detect.joined_lines(F.col("texts"), F.array(F.lit(0.25))).alias("l"))
    return got.select("region_id", "l.text", "l.confidence")


# typesetting


@query(f"""with b as (select region_id, x, y, w, h, unnest(range(0, 5)) i from ({G}) g),
s as (select *, y + h * 0.25 + (h * 0.25) * i / 4 v from b), c as (select *, case when v - y <= h / 2 then (v - y) / (h / 2) else (y + h - v) / (h / 2) end f from s)
select region_id, round(max(x + w / 2 - (w / 2) * f), 6) l, round(min(x + w / 2 + (w / 2) * f), 6) r from c group by region_id""")
def band_inner(spark, d):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    diamond = F.array(pt(x + w / 2, y), pt(x + w, y + h / 2), pt(x + w / 2, y + h), pt(x, y + h / 2))
    got = shape.band_inner(diamond, y + h * 0.25, y + h * 0.5)
    return regions(spark, d).select("region_id", F.round(got["l"], 6).alias("l"), F.round(got["r"], 6).alias("r"))


STYLE = "(values ('default', 10, 48, 1.05::double, 4, 2), ('shout', 14, 72, 1.0::double, 3 + 1, 3), ('whisper', 8, 28, 1.1::double, 4, 0), ('caption', 9, 32, 1.15::double, 6, 0)) k(preset, lo, hi, spacing, pad, stroke)"
BOXES = f"""select unit_id, min(w) w, min(h) * 2 h, concat('word ', cast(min(rn) as varchar(9)), ' unbreakable') text, min(case cast(page_id % 4 as int) when 0 then 'default' when 1 then 'shout' when 2 then 'whisper' else 'caption' end) preset
from (select u.unit_id, u.page_id, u.rn, g.w, g.h from ({X.UNIT_REGIONS}) u join ({G}) g on g.region_id = u.region_id) q group by unit_id"""


@query(f"""with recursive b as (select b.*, k.lo, k.hi, k.spacing, k.pad, k.stroke, unnest(range(k.lo, k.hi + 1)) z from ({BOXES}) b join {STYLE} on k.preset = b.preset),
p as (select *, greatest(1, floor((greatest(1.0, w - 2 * pad) - 2 * stroke) / (z / 2.0)))::int m, string_split("text", ' ') ws from b),
s as (select unit_id, z, m, ws, 0 i, []::varchar[] lines, '' cur from p
  union all select unit_id, z, m, ws, i + 1, case when length(joined) <= m then lines when length(word) <= m then flushed else flushed || list_transform(range(0, ((length(word) + m - 1) // m) - 1), lambda k: substr(word, (k * m + 1)::bigint, m)) end,
    case when length(joined) <= m then joined when length(word) <= m then word else substr(word, (((length(word) + m - 1) // m - 1) * m + 1)::bigint, m) end
  from (select *, ws[i + 1] word, case when cur = '' then ws[i + 1] else cur || ' ' || ws[i + 1] end joined, case when cur = '' then lines else list_append(lines, cur) end flushed from s where i < len(ws)) q),
l as (select unit_id, z, list_append(lines, cur) lines from s where i = len(ws)),
f as (select p.*, l.lines, z + 2 * stroke lh, round_even((z + 2 * stroke) * spacing, 0)::int down, round_even(list_max(list_transform(l.lines, lambda x: length(x))) * z / 2.0 + 2 * stroke, 0)::int wide from p join l using (unit_id, z)),
g as (select *, down * (len(lines) - 1) + lh tall, wide <= w - 2 * pad and down * (len(lines) - 1) + lh <= h - 2 * pad fits from f),
t as (select unit_id, coalesce(max(z) filter (fits), min(z)) z, not bool_or(fits) overflow from g group by unit_id)
select g.unit_id, g.z::int font_size, g.down line_step, g.wide text_width, g.tall::int text_height, t.overflow, array_to_string(g.lines, '|') lines from g join t on t.unit_id = g.unit_id and t.z = g.z""")
def text_layout(spark, d):
    made = typeset.fitted(X.frame(spark, d, BOXES))
    return made.select("unit_id", "font_size", "line_step", "text_width", "text_height", "overflow", F.array_join(F.transform("lines", lambda x: x["line"]), "|").alias("lines"))


# pixels


#: Frames of pages of 400 by 600: a grid for each customer, its columns and rows by nation and balance.
FRAMES = """select page_id, cast(10 + i * cw as double) x, cast(10 + j * ch as double) y, cast(cw - 14 as double) w, cast(ch - 14 as double) h from (
  select c_custkey page_id, i, j, c, r, cast(floor(380.0 / c) as int) cw, cast(floor(580.0 / r) as int) ch from (
    select c_custkey, 1 + c_nationkey % 3 c, 1 + cast(floor(abs(c_acctbal)) as int) % 5 r from {customer}) k
  cross join (select 0 i union all select 1 union all select 2) a cross join (select 0 j union all select 1 union all select 2 union all select 3 union all select 4) b) g where i < c and j < r"""


@query(FRAMES)
def panels(spark, d):
    import numpy as np
    import pandas as pd

    from .sources.images import encode_png

    def paint(batches):
        for b in batches:
            for i in range(0, len(b), vision.TOGETHER):
                some, made = b.iloc[i : i + vision.TOGETHER], []
                for frames in some["frames"]:
                    page = np.full((600, 400), 255, np.uint8)
                    for f in frames:
                        x, y, w, h = int(f["x"]), int(f["y"]), int(f["w"]), int(f["h"])
                        page[y : y + h, x : x + w] = 0
                        page[y + 3 : y + h - 3, x + 3 : x + w - 3] = 255
                    made.append(encode_png(page, 1))
                yield pd.DataFrame({"page_id": some["page_id"], "png": made})

    listed = X.frame(spark, d, FRAMES).groupBy("page_id").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("frames"))
    pages = listed.mapInPandas(paint, "page_id long, png binary")
    return vision.over_images(pages, vision.panels, "x double, y double, w double, h double")


#: Pixels of small pages by a rule: page, column, row.
PIXELS = "select n_nationkey::bigint page_id, x, y, (x * 7 + y * 13 + n_nationkey * 29 + (x * y) % 11) % 251 v from nation, range(0, 40) a(x), range(0, 30) b(y)"


def _ruled_pages(spark, d) -> DataFrame:
    import numpy as np
    import pandas as pd

    from .sources.images import encode_png

    def run(batches):
        y, x = np.mgrid[0:30, 0:40]
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "png": [encode_png(((x * 7 + y * 13 + int(n) * 29 + (x * y) % 11) % 251).astype(np.uint8)) for n in b["page_id"]]})

    pages = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("page_id"))
    return pages.mapInPandas(run, "page_id long, png binary")


@query(f"""select page_id, round_even(median(v), 0)::bigint v from ({PIXELS}) p where x >= 6 and x < 24 and y >= 4 and y < 22 and not (x >= 10 and x < 20 and y >= 8 and y < 18) group by page_id""")
def pixel_ring_median(spark, d):
    import pandas as pd

    return vision.over_images(_ruled_pages(spark, d), lambda a: pd.DataFrame({"v": [vision.ring_median(a, 10, 8, 20, 18)[0]]}), "v long")


@query(f"""with c as (select page_id, v, count(*) n from ({PIXELS}) p group by page_id, v),
k as (select p.page_id, t.t, coalesce(sum(c.n) filter (c.v <= t.t), 0)::double w, coalesce(sum(c.n * c.v) filter (c.v <= t.t), 0)::double m, sum(c.n)::double nn, sum(c.n * c.v)::double mm from (select distinct page_id from c) p, range(0, 256) t(t) join c on true where c.page_id = p.page_id group by 1, 2),
b as (select page_id, t, case when w > 0 and w < nn then power(mm * w / nn - m, 2) / (w * (nn - w)) else -1 end s from k)
select page_id, min(t)::bigint threshold from b where s = (select max(s) from b q where q.page_id = b.page_id) group by page_id""")
def otsu(spark, d):
    import pandas as pd

    return vision.over_images(_ruled_pages(spark, d), lambda a: pd.DataFrame({"threshold": [vision.otsu(a)]}), "threshold long")


# the store


@query("select c_custkey id, c_nationkey v from customer where c_nationkey % 5 > 0 or c_nationkey is null")
def entity_delete(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("v"))
    for v in (0, 5, 10, 15, 20):
        rows = incremental.delete_where(rows, "v", v)
    return rows


#: Documents as pages of 80 columns, a letter a pixel; ink is where some letters stand.
INK_SQL = "select doc_id page_id, (k - 1) % 80 x, (k - 1) // 80 y from (select doc_id, text, unnest(range(1, length(text) + 1)) k from documents) t where contains('ou', substr(text, k, 1)) and substr(text, k, 1) <> ''"


def _ink(spark, d) -> DataFrame:
    letters = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "")).alias("k", "c"))
    return letters.filter(F.col("c").isin("o", "u")).select("page_id", (F.col("k") % 80).alias("x"), F.floor(F.col("k") / 80).cast("int").alias("y"))


@query(f"""with recursive p as materialized ({INK_SQL}),
e as materialized (select p.page_id, p.x, p.y, q.x nx, q.y ny from p cross join (select a - 1 dx, b - 1 dy from range(3) a(a), range(3) b(b)) o join p q on q.page_id = p.page_id and q.x = p.x + o.dx and q.y = p.y + o.dy),
r as (select page_id, x, y, y * 16777216 + x label from p union select e.page_id, e.nx, e.ny, r.label from r join e on e.page_id = r.page_id and e.x = r.x and e.y = r.y),
l as (select page_id, x, y, min(label) first from r group by page_id, x, y),
u as (select *, case when x = lag(x) over (partition by page_id, y order by x) + 1 then 0 else 1 end opens from l),
c as (select page_id, first, count(*) area, min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, count(*) filter (opens = 1) runs, sum(x) sx, sum(y) sy from u group by page_id, first)
select page_id, count(*) n, sum(area)::bigint ink, max(area) largest, sum(w * h)::bigint boxes, sum(runs)::bigint runs, max(round(1.0 * sx / area, 6)) mean_x, max(round(1.0 * sy / area, 6)) mean_y from c group by page_id""")
def ink_components(spark, d):
    each = labelling.blobs_of(_ink(spark, d))
    return each.groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum("area").alias("ink"), F.max("area").alias("largest"), F.sum(F.col("w") * F.col("h")).cast("long").alias("boxes"), F.sum("runs").alias("runs"),
        F.max(F.round("mean_x", 6)).alias("mean_x"), F.max(F.round("mean_y", 6)).alias("mean_y"),
    )
