"""The library's queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import boxes as B
from .functions import keys as K
from .functions import shape, text
from .operators import candidates as C
from .operators import confidence as Q
from .operators import context, detect, export, glossary, grouping, history, incremental, ordering
from .plans import dag, graph
from .sources import archives
from .sources.shared import settled
from .streaming import review_stream

PAGE_W, PAGE_H = 800.0, 1200.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = X.duck(sql)
        return f

    return add


def regions(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, X.REGIONS)


def spans(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, X.SPANS)


def unit_regions(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, X.UNIT_REGIONS)


def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, X.CANDIDATES)


def picked(rows: DataFrame, *more, beside: DataFrame | None = None) -> DataFrame:
    """Units with their candidates as an array, and the one picked; more are further aggregates of their rows and those beside."""
    selected = F.when(F.col("picked") != "none", F.concat("unit_id", F.lit("_"), "picked"))
    return C.gathered(rows, F.first("picked", ignorenulls=True).alias("picked"), *more, beside=beside).withColumn("selected", selected).drop("picked")


def units(spark: SparkSession, d: str) -> DataFrame:
    return picked(candidate_rows(spark, d))


G = X.REGIONS
INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


# boxes and shapes


@query(f"select page_id, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from ({G}) g group by page_id")
def box_union(spark, d):
    return regions(spark, d).groupBy("page_id").agg(*B.union_of())


@query(f"""select region_id, x0 x, y0 y, x1 - x0 w, y1 - y0 h from (select region_id, least(greatest(0.0::double, x), 300.0) x0, least(greatest(0.0::double, y), 1100.0) y0,
  least(greatest(0.0::double, x + w), 300.0) x1, least(greatest(0.0::double, y + h), 1100.0) y1 from ({G}) g) q where x1 - x0 >= 1 and y1 - y0 >= 1""")
def box_clamp(spark, d):
    return regions(spark, d).select("region_id", B.clamped(B.box(), 300, 1100).alias("b")).filter("b is not null").select("region_id", "b.*")


@query(f"""select region_id, greatest(0, floor(x)::bigint - 3) x0, greatest(0, floor(y)::bigint - 3) y0, least(500, ceil(x + w)::bigint + 3) x1, least(900, ceil(y + h)::bigint + 3) y1
  from ({G}) g where least(500, ceil(x + w) + 3) > greatest(0, floor(x) - 3) and least(900, ceil(y + h) + 3) > greatest(0, floor(y) - 3)""")
def mask_clamp(spark, d):
    return regions(spark, d).select("region_id", B.pixel_box(B.box(), 500, 900, 3).alias("b")).filter("b is not null").select("region_id", "b.*")


@query(f"""select region_id, case when w / h >= 2.5 then 'narration' when w / h <= 0.4 then 'side_text' else 'bubble' end shape_type,
  case when type = 'unknown' and w * h / 960000.0 >= 0.002 and (w / h >= 2.2 or w / h <= 1 / 2.2::double) then 'sfx' else type end sfx_type from ({G}) g""")
def shape_types(spark, d):
    return regions(spark, d).select("region_id", detect.shape_type(F.col("w"), F.col("h")).alias("shape_type"), detect.sfx_type(F.col("type"), F.col("w"), F.col("h"), PAGE_W, PAGE_H, 0.002).alias("sfx_type"))


@query(f"""select region_id, least(1.0::double, (0.4::double + 0.5::double * (h / 128)) * case when w * h / 1048576 >= 0.003 and w * h / 1048576 <= 0.25 then 1.0::double else 0.6::double end) score from ({G}) g""")
def blob_confidence(spark, d):
    return regions(spark, d).select("region_id", detect.blob_confidence(F.col("h") / 128, F.col("w") * F.col("h") / 1048576).alias("score"))


@query("""select l_orderkey k, l_linenumber n, coalesce((['bubble', 'narration', 'sfx', 'caption'])[l_linenumber], 'unknown') type,
  (least(l_quantity, l_linenumber * 8) - 4) / 2 x, abs(l_linenumber * 8 - l_quantity) / 2 w from lineitem""")
def decode_detections(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    raw = F.struct(F.col("l_quantity").alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_linenumber") * 8).cast("double").alias("x2"), F.lit(10.0).alias("y2"))
    box = B.decoded(raw, 2.0, 4.0, 0.0)
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), detect.class_type(F.col("l_linenumber") - 1).alias("type"), box["x"].alias("x"), box["w"].alias("w"))


@query(f"""with recursive g as ({G}), b as (select *, row_number() over (partition by page_id order by coalesce(confidence, -1) desc, rn) n from g),
t as (select page_id, n, [{{'x': x, 'y': y, 'w': w, 'h': h, 'rn': rn}}] kept from b where n = 1
  union all select b.page_id, b.n, case when len(list_filter(t.kept, lambda a:
    {INTER} > 0 and ({INTER}) / (a.w * a.h + b.w * b.h - {INTER}) > 0.05)) > 0 then t.kept
    else list_append(t.kept, {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 'rn': b.rn}}) end
  from t join b on b.page_id = t.page_id and b.n = t.n + 1),
last as (select page_id, arg_max(kept, n) kept from t group by page_id),
flat as (select page_id, unnest(kept).rn rn from last)
select g.page_id, g.region_id, g.rn from flat join g on g.page_id = flat.page_id and g.rn = flat.rn""")
def nms(spark, d):
    return detect.nms(regions(spark, d), 0.05)


@query(f"""with recursive g as ({G}), c as (select * from g where status <> 'ignore'),
e as (select a.page_id, a.rn u, b.rn v from c a join c b on a.page_id = b.page_id and a.rn <> b.rn where {INTER} > 0 and ({INTER}) / least(a.w * a.h, b.w * b.h) >= 0.2),
r as (select page_id, rn, rn root from c union select r.page_id, e.v, r.root from r join e on e.page_id = r.page_id and e.u = r.rn),
l as (select page_id, rn, min(root) first from r group by page_id, rn)
select c.page_id, first, count(*) members, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h, arg_max(type, (w * h, -c.rn)) type, min(confidence) confidence,
  case when count(*) > 1 then 'auto' else min(status) end status from c join l on l.page_id = c.page_id and l.rn = c.rn group by c.page_id, first
union all select page_id, rn, 1, x, y, w, h, type, confidence, status from g where status = 'ignore'""")
def merge_overlaps(spark, d):
    return detect.merge_overlaps(regions(spark, d))


@query("""with e as (select distinct user_id k, cast(floor(epoch(ts)) as bigint) // 3600 t from events),
c as (select *, case when t - lag(t) over (partition by k order by t) - 1 >= 5 then 1 else 0 end cut from e),
r as (select *, sum(cut) over (partition by k order by t) run from c)
select k, min(t) "start", max(t) + 1 "end" from r group by k, run""")
def content_segments(spark, d):
    ticks = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), F.floor(F.unix_timestamp("ts") / 3600).alias("t"))
    return detect.content_segments(ticks, "k", "t", 5)


# order and grouping


def _tiers_sql(source: str, keys: str, id_: str, prefix: str) -> str:
    on = " and ".join(f"b.{k} is not distinct from t.{k}" for k in keys.split(", "))
    return f"""{prefix}b as (select *, row_number() over (partition by {keys} order by y, x, {id_}) n from {source}),
{prefix}t as (select {keys}, {id_}, x, y, w, h, n, [{{'y': y, 'h': h}}] anchors, 0 tier from {prefix}b where n = 1
  union all select {", ".join("b." + k for k in keys.split(", "))}, b.{id_}, b.x, b.y, b.w, b.h, b.n,
    case when p > 0 then anchors else list_append(anchors, {{'y': b.y, 'h': b.h}}) end, case when p > 0 then p - 1 else len(anchors) end
  from (select b, t.anchors, coalesce(list_position(list_transform(t.anchors, lambda a:
      greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.h, b.h) >= 0.5), true), 0) p
    from {prefix}t t join {prefix}b b on {on} and b.n = t.n + 1) j)"""


def _order_sql(sign: str) -> str:
    return f"""with recursive g as ({G}), {_tiers_sql("g", "page_id", "region_id", "")}
select page_id, region_id, tier::int tier, (row_number() over (partition by page_id order by tier, {sign}(x + w / 2), y, x, region_id) - 1)::int reading_order from t"""


@query(_order_sql("-"))
def reading_order_rtl(spark, d):
    return ordering.reading_order(regions(spark, d), "rtl")


@query(_order_sql(""))
def reading_order_ltr(spark, d):
    return ordering.reading_order(regions(spark, d), "ltr")


ASSIGN = f"""select page_id, region_id, arg_max(panel, (s, -panel)) panel from (select a.page_id, a.region_id, case when {INTER} > 0 then b.panel end panel, case when {INTER} > 0 then {INTER} end s
  from ({G}) a left join ({X.PANELS}) b on a.page_id = b.page_id) q group by page_id, region_id"""


@query(ASSIGN)
def panel_assign(spark, d):
    return ordering.panel_assign(regions(spark, d), X.frame(spark, d, X.PANELS))


@query(f"""with recursive g as ({G}), a as ({ASSIGN}), ga as (select g.*, a.panel from g join a on a.page_id = g.page_id and a.region_id = g.region_id),
pn as ({X.PANELS}), {_tiers_sql("ga", "page_id, panel", "region_id", "r")}, {_tiers_sql("pn", "page_id", "panel", "p")},
pr as (select page_id, panel, row_number() over (partition by page_id order by tier, -(x + w / 2), y, x, panel) pr from pt)
select rt.page_id, rt.region_id, rt.panel, (row_number() over (partition by rt.page_id order by pr nulls last, tier, -(x + w / 2), y, x, region_id) - 1)::int reading_order
from rt left join pr on pr.page_id = rt.page_id and pr.panel = rt.panel""")
def reading_order_panels(spark, d):
    return ordering.order_by_panels(regions(spark, d), X.frame(spark, d, X.PANELS))


CHAINS = f"""select *, row_number() over (partition by page_id, chain order by rn) - 1 pos from (select page_id, region_id, rn, (sum(new) over (partition by page_id order by rn) - 1)::bigint chain from (
  select *, case when pt = type and type <> 'sfx' and sqrt(power(greatest(0, greatest(px, x) - least(px + pw, x + w)), 2) + power(greatest(0, greatest(py, y) - least(py + ph, y + h)), 2)) / ((ph + h) / 2) <= 6 then 0 else 1 end new
  from (select *, lag(type) over q pt, lag(x) over q px, lag(y) over q py, lag(w) over q pw, lag(h) over q ph from ({G}) g window q as (partition by page_id order by rn)) l) m) n"""


def _chained(spark, d):
    return grouping.chains(regions(spark, d).withColumn("reading_order", F.col("rn")), 6.0)


@query(f"select page_id, region_id, chain, pos::int pos from ({CHAINS}) c")
def group_chains(spark, d):
    return _chained(spark, d)


@query(f"select page_id, chain, string_agg(region_id, ',' order by pos) ids from ({CHAINS}) c group by page_id, chain")
def units_of_chains(spark, d):
    return grouping.units(_chained(spark, d)).select("page_id", "chain", F.array_join("ordered_region_ids", ",").alias("ids"))


@query(f"select page_id, region_id, (row_number() over (partition by page_id order by coalesce(nullif(rn % 4, 0), 1073741824), region_id) - 1)::int reading_order from ({G}) g")
def reindex(spark, d):
    return history.reindexed(regions(spark, d).withColumn("reading_order", F.nullif(F.col("rn") % 4, F.lit(0))))


NATURAL = "list_zip(string_split_regex(lower(name), '[0-9]+'), list_transform(regexp_extract_all(name, '[0-9]+'), lambda c: c::bigint))"


@query(f"select name, (row_number() over (order by {NATURAL}, name) - 1)::int place from (select distinct concat(p_type, p_size::varchar, '_', (p_partkey % 40)::varchar) \"name\" from part) q")
def natural_order(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_type", F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 40).cast("string")).alias("name"))
    return ordering.natural_order(names, "name")


FILES = "select distinct concat('Page', p_size::varchar, '.png') \"name\" from part"
LISTED = "select concat('Page', (60 - i)::varchar, '.png') \"name\", i pos from range(1, 41, 3) t(i)"


@query(f"""with j as (select coalesce(f.name, m.name) "name", f.name is not null found, m.pos from ({FILES}) f full join ({LISTED}) m on f.name = m.name)
select name, found, case when found then (row_number() over (partition by found order by pos nulls last, {NATURAL}, name) - 1)::int end place from j""")
def manifest_order(spark, d):
    files = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("Page"), F.col("p_size").cast("string"), F.lit(".png")).alias("name"))
    manifest = spark.range(1, 41, 3).select(F.concat(F.lit("Page"), (60 - F.col("id")).cast("string"), F.lit(".png")).alias("name"), F.col("id").alias("pos"))
    return ordering.manifest_order(files, manifest).select("name", "found", "place")


@query("""with p as (select min(p_partkey) s, p_brand || p_size::varchar "name" from part group by 2), old as (select name, (row_number() over (order by s) - 1) idx from (select * from p where s % 3 = 0) q)
select name, ((select max(idx) from old) + row_number() over (order by s))::bigint idx from p where name not in (select name from old)""")
def import_dedupe(spark, d):
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("seq"))
    first = rows.groupBy("name").agg(F.min("seq").alias("seq"))
    old = first.filter("seq % 3 = 0").select("name", (F.row_number().over(Window.orderBy("seq")) - 1).alias("idx"))
    return ordering.import_pages(old, rows).select("name", F.col("idx").cast("long").alias("idx"))


# confidence and review

AGG = f"select g.*, least(g.confidence, s.c) agg from ({G}) g left join (select region_id, min(confidence) c from ({X.SPANS}) s group by region_id) s on s.region_id = g.region_id"
FLAGS = f"""select region_id, arg_max(coalesce(confidence, -1), r.unit_id) c, true has from ({X.UNIT_REGIONS}) r join (select unit_id, confidence from ({X.CANDIDATES}) c where kind = 'ai') a on a.unit_id = r.unit_id group by region_id"""


def _flags(spark, d):
    return Q.ai_flags(unit_regions(spark, d), candidate_rows(spark, d))


@query(f"select region_id, agg agg_confidence, (agg is null or agg < 0.5) low from ({AGG}) a")
def confidence(spark, d):
    return Q.region_confidence(regions(spark, d), spans(spark, d)).select("region_id", "agg_confidence", Q.is_low(F.col("agg_confidence")).alias("low"))


@query(f"select count(*) total, count(agg) scored, count(*) filter (agg is null or agg < 0.5) low, count(*) filter (status = 'needs_review') flagged from ({AGG}) a")
def conf_report(spark, d):
    return Q.report(regions(spark, d), spans(spark, d))


@query(f"select region_id, case when status = 'auto' and (agg is null or agg < 0.5) then 'needs_review' else status end status from ({AGG}) a")
def flag_low(spark, d):
    return Q.flag_low(regions(spark, d), spans(spark, d)).select("region_id", "status")


@query(f"select region_id, nullif(c, -1) ai_confidence, c < 0.5 ai_flagged from ({FLAGS}) f")
def ai_flags(spark, d):
    return _flags(spark, d)


@query(f"""with q as (select a.page_id, a.region_id, rn reading_order, agg confidence, (agg is null or agg < 0.5) low_confidence, status, coalesce(f.c < 0.5, false) ai_flagged, nullif(f.c, -1) ai_confidence
  from ({AGG}) a left join ({FLAGS}) f on f.region_id = a.region_id where status <> 'ignore')
select *, (row_number() over (order by not (low_confidence or ai_flagged), page_id, reading_order, region_id) - 1)::bigint place from q""")
def review_queue(spark, d):
    """Regions are worked out once, as a table; spans, units and candidates follow from it."""
    r = settled(regions(spark, d), "regions")

    def over(sql: str) -> DataFrame:
        return spark.sql(sql.replace(G, "select * from {g}"), g=r)

    flags = Q.ai_flags(over(X.UNIT_REGIONS), over(X.CANDIDATES))
    return Q.review_queue(r, over(X.SPANS), flags, r.select("page_id", "region_id", F.col("rn").alias("reading_order")))


@query(f"""select p.page_id, coalesce(n_regions, 0) n_regions, coalesce(n_units, 0) n_units, coalesce(n_low, 0) n_low, coalesce(n_ai_flagged, 0) n_ai_flagged
from (select distinct o_orderkey page_id from orders) p
left join (select a.page_id, count(*) n_regions, count(*) filter (agg is null or agg < 0.5) n_low, count(*) filter (f.c < 0.5) n_ai_flagged from ({AGG}) a left join ({FLAGS}) f on f.region_id = a.region_id group by a.page_id) r on r.page_id = p.page_id
left join (select page_id, count(distinct unit_id) n_units from ({X.UNIT_REGIONS}) u group by page_id) u on u.page_id = p.page_id""")
def project_summary(spark, d):
    pages = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"))
    return Q.project_summary(pages, regions(spark, d), spans(spark, d), unit_regions(spark, d), _flags(spark, d))


@query(f"""with a as ({AGG}), s as (select distinct region_id from ({X.SPANS}) s), u as (select distinct unit_id from ({X.UNIT_REGIONS}) u), c as (select distinct unit_id from ({X.CANDIDATES}) c where kind = 'raw')
select 'detect' stage, count(distinct page_id) done, count(distinct page_id) total from a
union all select 'ocr', (select count(*) from a where status <> 'ignore' and region_id in (select region_id from s)), (select count(*) from a where status <> 'ignore')
union all select 'translate', (select count(*) from u where unit_id in (select unit_id from c)), (select count(*) from u)
union all select 'low', (select count(*) from a where agg is null or agg < 0.5), (select count(*) from a)
union all select 'flagged', (select count(*) from a where status = 'needs_review'), (select count(*) from a)""")
def status_counts(spark, d):
    return Q.status_counts(regions(spark, d), spans(spark, d), unit_regions(spark, d), candidate_rows(spark, d))


# context, glossary, candidates


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("page_id", "rk", *[F.array_join(c, "|").alias(c) for c in columns])


@query(f"""select page_id, rk, coalesce(array_to_string(list_filter(list(text) over (partition by page_id order by rk rows between 2 preceding and 1 preceding), lambda t: t <> ''), '|'), '') preceding,
  coalesce(array_to_string(list_filter(list(text) over (partition by page_id order by rk rows between 1 following and 2 following), lambda t: t <> ''), '|'), '') "following" from ({X.TURNS}) t""")
def context_flat(spark, d):
    return _joined(context.context_flat(X.frame(spark, d, X.TURNS)), "preceding", "following")


@query(f"""with t as ({X.TURNS}), c as (select *, case when panel is not distinct from lag(panel) over (partition by page_id order by rk) and rk > (min(rk) over (partition by page_id)) then 0 else 1 end cut from t),
r as (select *, sum(cut) over (partition by page_id order by rk) run from c),
n as (select a.page_id, a.rk, b.rk brk, b.text from r a join r b on a.page_id = b.page_id and a.rk <> b.rk and b.text <> '' and (a.panel is null or a.run = b.run)),
k as (select *, row_number() over (partition by page_id, rk, brk < rk order by abs(brk - rk)) n from n)
select r.page_id, r.rk, coalesce(string_agg(k.text, '|' order by k.brk) filter (k.brk < k.rk), '') preceding, coalesce(string_agg(k.text, '|' order by k.brk) filter (k.brk > k.rk), '') "following"
from r left join k on k.page_id = r.page_id and k.rk = r.rk and k.n <= 2 group by r.page_id, r.rk""")
def context_panel(spark, d):
    return _joined(context.context_panel(X.frame(spark, d, X.TURNS)), "preceding", "following")


@query(f"""select u.page_id, u.unit_id, coalesce(string_agg(s.text, chr(10) order by u.pos) filter (s.text <> ''), '') source from ({X.UNIT_REGIONS}) u
left join (select region_id, arg_min(text, seq) text from ({X.SPANS}) s group by region_id) s on s.region_id = u.region_id group by u.page_id, u.unit_id""")
def source_bundle(spark, d):
    return context.source_bundles(unit_regions(spark, d), spans(spark, d))


#: Words of conversations, each where it stands: the glossaries of the queries are made of them. DuckDB's text of spoken().
SPOKEN = """select conv_id, turn, role, source, conv_id * 100000000 + turn * 1000000 + k as ord from (
  select conv_id, turn, role, unnest(w) source, generate_subscripts(w, 1) - 1 k from (select *, regexp_extract_all("text", '[A-Za-zÀ-ÿ]+') w from conversations) q) q where length(source) >= 5"""
#: A glossary entry of each word that a role says: its place is the first, its target a mark, its aliases the word and its rest.
ENTRIES_SQL = f"""select min(ord)::bigint ord, source, '<' || substr(md5(source), 1, 4) || '>' target, [substr(source, 2), '', source] aliases from ({SPOKEN}) s where role = '{{role}}' group by source"""


def spoken(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("at", "source"))
    return rows.filter(F.length("source") >= 5).select("conv_id", "turn", "role", "source", (F.col("conv_id") * 100000000 + F.col("turn") * 1000000 + F.col("at")).alias("ord"))


def said_by(spark: SparkSession, d: str, role: str) -> DataFrame:
    """The glossary of the words that a role says."""
    first = spoken(spark, d).filter(F.col("role") == role).groupBy("source").agg(F.min("ord").alias("ord"))
    mark = F.concat(F.lit("<"), F.substring(F.md5("source"), 1, 4), F.lit(">"))
    return first.select("ord", "source", mark.alias("target"), F.array(F.expr("substr(source, 2)"), F.lit(""), F.col("source")).alias("aliases"))


@query(f"select doc_id id, e.ord, e.source, e.target from documents d join ({ENTRIES_SQL.format(role='assistant')}) e on contains(d.text, e.source)")
def glossary_applicable(spark, d):
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return glossary.applicable(texts, said_by(spark, d, "assistant"))


@query(f"""with e as ({ENTRIES_SQL.format(role='assistant')}), a as (select ord, target, unnest(aliases) a from e),
s as (select d.doc_id, list(struct_pack(a := a.a, t := a.target) order by e.ord, length(a.a) desc) steps from documents d join e on contains(d.text, e.source) join a on a.ord = e.ord and a.a <> '' group by d.doc_id)
select d.doc_id, md5(coalesce(list_reduce(list_prepend(struct_pack(a := d.text, t := ''), s.steps), lambda x, y: struct_pack(a := replace(x.a, y.a, y.t), t := '')).a, d.text)) fixed from documents d left join s on s.doc_id = d.doc_id""")
def glossary_apply(spark, d):
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.col("text").alias("source_text"))
    return glossary.enforce(texts, said_by(spark, d, "assistant"), ["doc_id"]).select("doc_id", F.md5("fixed").alias("fixed"))


#: Two layers that share some words: what users say first, and what assistants say.
PROJECT_SQL, SERIES_SQL = (f"select ord, source, '{mark}' || ord::varchar target from ({ENTRIES_SQL.format(role=role)}) {role[0]}" for role, mark in (("user", "p"), ("assistant", "s")))


def _layer(spark, d, role: str, mark: str) -> DataFrame:
    return said_by(spark, d, role).select("ord", "source", F.concat(F.lit(mark), F.col("ord").cast("string")).alias("target"))


def _layers(spark, d) -> tuple[DataFrame, DataFrame]:
    return _layer(spark, d, "user", "p"), _layer(spark, d, "assistant", "s")


@query(f"""with p as ({PROJECT_SQL}), s as ({SERIES_SQL}), b as (select 0 l, * from p union all select 1, * from s where source not in (select source from p))
select (row_number() over (order by l, ord) - 1)::int ord, source, target from b""")
def glossary_merge(spark, d):
    return glossary.merge(*_layers(spark, d))


#: Words as they come, many of them more than once: the last use of a word is the one that counts.
USES_SQL = f"select ord, source, 'u' || ord::varchar target from ({SPOKEN}) s where role <> 'assistant'"


def _uses(spark, d) -> DataFrame:
    return spoken(spark, d).filter("role <> 'assistant'").select("ord", "source", F.concat(F.lit("u"), F.col("ord").cast("string")).alias("target"))


@query(f"""with s as ({SERIES_SQL}), n as (select source, arg_max(target, ord) target, min(ord) first from ({USES_SQL}) u group by source)
select (row_number() over (order by s.ord nulls last, n.first) - 1)::int ord, source, coalesce(n.target, s.target) target from s full join n using (source)""")
def glossary_upsert(spark, d):
    return glossary.upsert(_layers(spark, d)[1], _uses(spark, d))


PICK = f"select unit_id, page_id, list(struct_pack(id := candidate_id, kind := kind, \"text\" := text) order by ord) c, case when any_value(picked) <> 'none' then unit_id || '_' || any_value(picked) end sel from ({X.CANDIDATES}) c group by unit_id, page_id"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("unit_id", "selected", F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", c["kind"], c["text"])), ";").alias("candidates"))


def _list_sql(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: x.kind || '=' || x.text), ';')"


@query(f"select unit_id, coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') selected_text from ({PICK}) p")
def select_text(spark, d):
    return units(spark, d).select("unit_id", C.selected_text(F.col("candidates"), F.col("selected")).alias("selected_text"))


@query(f"""select unit_id, case when len(list_filter(rest, lambda x: x.id = sel)) > 0 then sel else unit_id || '_new' end selected, {_list_sql("list_append(rest, struct_pack(id := unit_id || '_new', kind := 'raw', \"text\" := 'fresh'))")} candidates
from (select *, list_filter(c, lambda x: x.kind <> 'raw') rest from ({PICK}) p) q""")
def attach_raw(spark, d):
    return _flat(C.attach_raw(units(spark, d), C.candidate(F.concat("unit_id", F.lit("_new")), "raw", F.lit("fresh"))))


@query(f"""select unit_id, case when sel is not null and sel = unit_id || '_manual' then sel else unit_id || '_sfx' end selected, {_list_sql("list_append(c, struct_pack(id := unit_id || '_sfx', kind := 'sfx', \"text\" := 'DON'))")} candidates from ({PICK}) p""")
def sfx_candidate(spark, d):
    return _flat(C.attach_sfx(units(spark, d), C.candidate(F.concat("unit_id", F.lit("_sfx")), "sfx", F.lit("DON")), "transliterate"))


@query(f"""select unit_id, case when sel = unit_id || '_manual' then sel else unit_id || '_ai' end selected,
{_list_sql("list_append(list_filter(c, lambda x: x.kind <> 'ai'), struct_pack(id := unit_id || '_ai', kind := 'ai', \"text\" := 'better'))")} candidates from ({PICK}) p""")
def assist_apply(spark, d):
    return _flat(C.attach_ai(units(spark, d), F.lit("better"), F.lit(0.9), "auto"))


# text and shapes

KANA_ROWS = [
    (0, "ドーン", "DOON"), (1, "どっかん", "DOKKAN"), (2, "キャー", "KYAA"), (3, "ぎゅっ", "GYU"), (4, "abc きゃ!", "ABC KYA!"), (5, "", ""),
    (6, "ッ", ""), (7, "ー", ""), (8, "シュッパ", "SHUPPA"), (9, "ゴゴゴ", "GOGOGO"), (10, "ピョンっと", "PYONTTO"),
]


def _picked(column: int) -> str:
    """A text of KANA_ROWS for each customer, another, and the customer's name; as SQL of both engines."""
    texts = [f"when {i} then '{r[column]}'" for i, r in enumerate(KANA_ROWS)]
    first, second = (f"case cast({key} as int) {' '.join(texts)} end" for key in (f"c_custkey % {len(KANA_ROWS)}", f"floor(c_custkey / {len(KANA_ROWS)}.0) % {len(KANA_ROWS)}"))
    return f"select c_custkey id, concat({first}, ' ', {second}, ' ', c_name) text from {{customer}}"


@query(f"select id, upper(text) romaji from ({_picked(2)}) t")
def romaji(spark, d):
    return X.frame(spark, d, _picked(1)).select("id", text.romaji(F.col("text")).alias("romaji"))


ALL_LINES = "select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 rk from documents"


@query(f"""with recursive l as ({ALL_LINES}), w as (select doc_id, rk, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') ws from l),
s as (select doc_id, rk, ws, 0 i, []::varchar[] lines, '' cur from w
  union all select doc_id, rk, ws, i + 1,
    case when length(joined) <= 14 then lines when length(word) <= 14 then flushed
      else flushed || list_transform(range(0, ((length(word) + 13) // 14) - 1), lambda k: substr(word, (k * 14 + 1)::bigint, 14)) end,
    case when length(joined) <= 14 then joined when length(word) <= 14 then word else substr(word, (((length(word) + 13) // 14 - 1) * 14 + 1)::bigint, 14) end
  from (select *, ws[i + 1] word, case when cur = '' then ws[i + 1] else cur || ' ' || ws[i + 1] end joined, case when cur = '' then lines else list_append(lines, cur) end flushed from s where i < len(ws)) q)
select doc_id, rk::int rk, array_to_string(case when len(ws) = 0 then [''] when cur = '' then lines else list_append(lines, cur) end, '|') lines from s where i = len(ws)""")
def wrap_lines(spark, d):
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("rk", "line"))
    return lines.select("doc_id", "rk", F.array_join(text.wrapped(F.col("line"), F.lit(14)), "|").alias("lines"))


@query(f"""with g as ({G}), p as (select region_id, x, y, w, h, y + h * 0.25 t from g)
select region_id, x + (w / 2) * 0.5 l, x + w - (w / 2) * 0.5 r from p""")
def scanline(spark, d):
    # a diamond in each box; a quarter down it is half as wide as the box, exactly in binary
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    diamond = F.array(pt(x + w / 2, y), pt(x + w, y + h / 2), pt(x + w / 2, y + h), pt(x, y + h / 2))
    got = shape.scanline_span(diamond, y + h * 0.25)
    return regions(spark, d).select("region_id", F.round(got["l"], 6).alias("l"), F.round(got["r"], 6).alias("r"))


# export and increments

ORDERED = f"select page_id, region_id, rn reading_order from ({G}) g"
#: Edits of some units, up to two each.
EDITS = f"""select unit_id, cast(k as int) seq, concat('edit ', cast(k as varchar(9)), ' of ', unit_id) after
from (select page_id, unit_id, min(rn) n from ({X.UNIT_REGIONS}) r group by page_id, unit_id) u cross join (select 1 k union all select 2) v where (page_id + n) % 5 = 0 and k <= 1 + page_id % 2"""
RANKS = f"select page_id, unit_id, min(rn) rank from ({X.UNIT_REGIONS}) u group by page_id, unit_id"


def _order(spark, d):
    return regions(spark, d).select("page_id", "region_id", F.col("rn").alias("reading_order"))


@query(f"""select u.page_id, u.unit_id, (row_number() over (partition by u.page_id order by rank, u.unit_id) - 1)::int place, t.text, x, y, w, h,
  case type when 'sfx' then 'shout' when 'narration' then 'caption' when 'caption' then 'caption' when 'side_text' then 'whisper' else 'default' end preset
from (select u.page_id, u.unit_id, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h, arg_min(type, pos) type, bool_and(status = 'ignore') ign, min(u.rn) rank
  from ({X.UNIT_REGIONS}) u join ({G}) g on g.region_id = u.region_id group by u.page_id, u.unit_id) u
join (select unit_id, coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') "text" from ({PICK}) p) t on t.unit_id = u.unit_id where not ign and t.text <> '' and type <> 'sfx'""")
def placements(spark, d):
    return export.placements(unit_regions(spark, d), regions(spark, d), units(spark, d), _order(spark, d), ("sfx",))


@query("""with a as (select o_orderkey page_id, o_custkey % 3 k, o_orderdate from orders where o_custkey % 4 > 0)
select o.o_orderkey page_id, case k when 1 then 'render' when 2 then 'masked' else 'original' end layer,
  case k when 1 then 'r' || a.page_id::varchar when 2 then 'm' || a.page_id::varchar else 'img' || o.o_orderkey::varchar end path, case k when 1 then a.page_id % 5 else 0 end overflow
from orders o left join a on a.page_id = o.o_orderkey""")
def page_layer(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 3).alias("k"), (F.col("o_custkey") % 4).alias("m"))
    kind = F.when(F.col("k") == 1, "render").otherwise("mask")
    art = o.filter("m > 0 and k > 0").select("page_id", kind.alias("kind"), F.lit(1).alias("seq"), F.concat(F.substring(kind, 1, 1), F.col("page_id").cast("string")).alias("path"), (F.col("page_id") % 5).alias("overflow"))
    return export.page_layers(o.select("page_id", F.concat(F.lit("img"), F.col("page_id").cast("string")).alias("image_path")), art)


@query(f"""select page_id, n, '[' || n::varchar || '] ' || source || '  ->  ' || target line from (
select u.page_id, row_number() over (partition by u.page_id order by rank, u.unit_id)::int n, source, coalesce(list_filter(c, lambda x: x.id = sel)[1].text, '') target
from (select u.page_id, u.unit_id, min(u.rn) rank, coalesce(string_agg(s.text, ' ' order by u.pos, s.seq), '') source from ({X.UNIT_REGIONS}) u left join ({X.SPANS}) s on s.region_id = u.region_id group by u.page_id, u.unit_id) u
join ({PICK}) p on p.unit_id = u.unit_id) q""")
def transcript(spark, d):
    return export.transcript(unit_regions(spark, d), spans(spark, d), units(spark, d), _order(spark, d))


@query(f"""select u.page_id, rank::int rank, u.unit_id, u.pos::int pos, u.region_id, g.type, g.status, g.x::int x, g.y::int y, g.w::int w, g.h::int h, coalesce(s.texts, '') texts,
  m.texts candidates, m.sel selected, coalesce(e.edits, '') edits from ({X.UNIT_REGIONS}) u join ({G}) g on g.region_id = u.region_id
join ({RANKS}) r on r.unit_id = u.unit_id left join (select region_id, string_agg("text", '|' order by seq) texts from ({X.SPANS}) s group by region_id) s on s.region_id = u.region_id
join (select unit_id, array_to_string(list_transform(c, lambda x: x.id || '=' || x.text), '|') texts, sel from ({PICK}) p) m on m.unit_id = u.unit_id
left join (select unit_id, string_agg(seq::varchar || ':' || "after", '|' order by seq) edits from ({EDITS}) e group by unit_id) e on e.unit_id = u.unit_id""")
def lineage(spark, d):
    # the nested mapping, flattened again: JSON text of doubles differs between engines
    table = lambda sql: X.shared(spark, d, sql)
    log = table(EDITS.replace("select unit_id,", "select page_id, unit_id,", 1)).withColumns({"action": F.lit("edit_translation"), "before": F.lit(""), "editor": F.lit("user")})
    made = export.lineage(table(X.UNIT_REGIONS), table(X.REGIONS), table(X.SPANS), picked(table(X.CANDIDATES)), table(ORDERED), log)
    span, cand, edit = "struct<text:string>", "struct<id:string,text:string>", "struct<seq:int,after:string>"
    region = f"struct<pos:int,region_id:string,type:string,status:string,x:double,y:double,w:double,h:double,spans:array<{span}>>"
    kind = f"array<struct<rank:int,unit_id:string,regions:array<{region}>,candidates:array<{cand}>,selected:string,edits:array<{edit}>>>"
    u = made.select("page_id", F.explode(F.from_json("mapping", kind)).alias("u")).select("page_id", "u.*")
    r = u.select("page_id", "rank", "unit_id", "candidates", "selected", "edits", F.explode("regions").alias("r"))
    listed = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "|"), F.lit(""))
    return r.select(
        "page_id", "rank", "unit_id", *[F.col(f"r.{c}").alias(c) for c in ("pos", "region_id", "type", "status")], *[F.col(f"r.{c}").cast("int").alias(c) for c in "xywh"],
        listed("r.spans", lambda x: x["text"]).alias("texts"), listed("candidates", lambda x: F.concat_ws("=", x["id"], x["text"])).alias("candidates"), "selected",
        listed("edits", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["after"])).alias("edits"),
    )


@query("""select doc_id, sha256(concat(chr(0), chr(0), chr(0), chr(0), chr(0), chr(0), chr(0), chr(length(lang)::int), lang, chr(0), chr(0), chr(0), chr(0), chr(0), chr(0), chr(0), chr(length(source)::int), source)) key from documents""")
def content_key(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", K.content_key(F.col("lang"), F.col("source")).alias("key"))


@query(f"select page_id, sha256(string_agg(region_id || '|' || type || '|' || w::int::varchar, chr(10) order by region_id)) fingerprint from ({G}) g group by page_id")
def fingerprint(spark, d):
    line = F.concat_ws("|", "region_id", "type", F.col("w").cast("int").cast("string"))
    return K.fingerprint(regions(spark, d), "page_id", line, "region_id")


@query("""select o_orderkey page_id, sha256(o_orderstatus || ':' || o_orderpriority) signature from orders where not (o_orderkey % 3 > 0 and o_orderkey % 5 > 0 and o_orderkey % 7 > 0)""")
def skip_unchanged(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderkey", "page_id")
    sig = F.sha2(F.concat_ws(":", "o_orderstatus", "o_orderpriority"), 256)
    stored = o.filter("page_id % 3 > 0").select("page_id", F.when(F.col("page_id") % 5 > 0, sig).otherwise("old").alias("stored"))
    return incremental.changed(o, stored, sig, F.col("page_id") % 7 > 0).select("page_id", "signature")


@query("select c_custkey id, case when c_custkey % 2 = 0 then c_nationkey + 100 else c_nationkey end v from customer")
def entity_upsert(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("v"), F.lit(1).alias("ver"))
    return incremental.upsert(c, c.filter("id % 2 = 0").select("id", (F.col("v") + 100).alias("v"), F.lit(2).alias("ver")), "id", "ver").select("id", "v")


@query(f"""with s as (select * from ({X.SPANS}) s) select region_id, seq, text from s where trim(text) <> '' and (confidence is null or confidence < 0.5)""")
def low_spans(spark, d):
    return incremental.low_spans(spans(spark, d)).select("region_id", "seq", "text")


# history


def _fold_sql(commands: str, kind: str) -> str:
    return f"""with recursive c as (select page_id, cmd_seq, cmd, row_number() over (partition by page_id order by cmd_seq) n from ({commands}) c),
s as (select distinct page_id, 0::bigint n, []::{kind}[] done, []::{kind}[] undone, 0 rev from c
 union all select s.page_id, c.n, case when cmd = 'edit' then list_append(done, cmd_seq) when cmd = 'undo' then done[1:len(done) - 1] when cmd = 'redo' and len(undone) > 0 then list_append(done, undone[1]) else done end,
  case when cmd = 'edit' then [] when cmd = 'undo' and len(done) > 0 then list_prepend(done[len(done)], undone) when cmd = 'redo' then undone[2:] else undone end,
  rev + case when cmd = 'edit' or (cmd = 'undo' and len(done) > 0) or (cmd = 'redo' and len(undone) > 0) then 1 else 0 end
 from s join c on c.page_id = s.page_id and c.n = s.n + 1)
select page_id, array_to_string(arg_max(done, n), ',') done, array_to_string(arg_max(undone, n), ',') undone, max(rev) rev from s group by page_id"""


def _listed(state: DataFrame) -> DataFrame:
    return state.select("page_id", F.array_join(F.col("done").cast("array<string>"), ",").alias("done"), F.array_join(F.col("undone").cast("array<string>"), ",").alias("undone"), "rev")


@query(_fold_sql(X.COMMANDS, "int"))
def history_fold(spark, d):
    return _listed(history.folded(X.frame(spark, d, X.COMMANDS)))


def _replayed(spark, d) -> DataFrame:
    """The events as a stream of commands by the time they were given, run as far as there are any."""
    # a pattern, as the source takes a folder or a pattern, and the table may be one file
    events = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")
    cmd = F.when(F.col("event_type") == "view", "undo").when(F.col("event_type") == "error", "redo").when(F.col("event_type") == "signup", "claim").otherwise("edit")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")  # whatever the session's time zone
    return review_stream.replayed(events.select(F.col("user_id").alias("page_id"), micros.alias("seq"), F.timestamp_micros(micros).alias("ts"), cmd.alias("cmd"), F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string")).alias("editor")))


#: The same commands in a table.
TIMED = """select user_id page_id, epoch_us(ts) cmd_seq, ts, 'e' || (event_id % 3)::varchar editor,
  case event_type when 'view' then 'undo' when 'error' then 'redo' when 'signup' then 'claim' else 'edit' end cmd from events"""


@query(_fold_sql(TIMED, "bigint"))
def history_stream_fold(spark, d):
    return _listed(review_stream.latest(_replayed(spark, d)))


@query(f"""with recursive c as (select page_id, cmd_seq, editor, epoch_us(ts) // 1000 ms, row_number() over (partition by page_id order by cmd_seq) n from ({TIMED}) c where cmd = 'claim'),
s as (select distinct page_id, 0::bigint n, '' held, 0::bigint until, '' kind, '' editor, 0::bigint seq from c
 union all select s.page_id, c.n, case when s.until > c.ms and s.held <> c.editor then s.held else c.editor end, case when s.until > c.ms and s.held <> c.editor then s.until else c.ms + 900000 end,
  case when s.until > c.ms and s.held <> c.editor then 'refused' else 'claimed' end, c.editor, c.cmd_seq from s join c on c.page_id = s.page_id and c.n = s.n + 1)
select page_id, seq, editor, kind, until until_ms from s where n > 0""")
def claim_stream(spark, d):
    rows = _replayed(spark, d).filter("kind in ('claimed', 'refused')")
    return rows.select("page_id", "seq", "editor", "kind", F.unix_millis("until").alias("until_ms"))


@query(f"select page_id, max(cmd_seq) cmd_seq from ({X.COMMANDS}) c where cmd in ('claim', 'redo') group by page_id having arg_max(cmd, cmd_seq) = 'claim'")
def claims(spark, d):
    return history.claims(X.frame(spark, d, X.COMMANDS))


@query(f"""with recursive w as (select page_id, cmd_seq, case when cmd = 'undo' then null when cmd = 'redo' then 1 else row_number() over (partition by page_id order by cmd_seq) // 3 end e, row_number() over (partition by page_id order by cmd_seq) n from ({X.COMMANDS}) c),
s as (select page_id, n, cmd_seq, (e is null or e = 0) accepted, case when e is null or e = 0 then 1 else 0 end rev from w where n = 1
 union all select w.page_id, w.n, w.cmd_seq, (e is null or e = rev), rev + case when e is null or e = rev then 1 else 0 end from s join w on w.page_id = s.page_id and w.n = s.n + 1)
select page_id, cmd_seq, accepted, rev from s""")
def stale_writes(spark, d):
    from pyspark.sql import Window

    c = X.frame(spark, d, X.COMMANDS)
    n = F.floor(F.row_number().over(Window.partitionBy("page_id").orderBy("cmd_seq")) / 3)
    expected = F.when(F.col("cmd") == "redo", 1).when(F.col("cmd") != "undo", n)
    return history.stale_writes(c.select("page_id", "cmd_seq", expected.cast("int").alias("expected_rev")))


#: What depends on what: customers on their nation, nations on their region.
PLACES = "select concat('n', cast(n_nationkey as varchar(20))) src, concat('c', cast(c_custkey as varchar(20))) dst from {customer} join {nation} on n_nationkey = c_nationkey union all select concat('r', cast(n_regionkey as varchar(20))), concat('n', cast(n_nationkey as varchar(20))) from {nation}"


@query(f"with recursive e as ({PLACES}), c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src) select src, dst from c")
def dag_closure(spark, d):
    return dag.closure(X.frame(spark, d, PLACES))


#: A graph of stages: an order depends on its parts, and every second one on its customer's order before; customers on their orders, nations on customers.
STAGE_EDGES = """select distinct concat('part ', cast(l_partkey as varchar(20))) src, concat('order ', cast(l_orderkey as varchar(20))) dst from {lineitem}
union all select concat('order ', cast(before as varchar(20))), concat('order ', cast(o_orderkey as varchar(20))) from (
  select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) before from {orders}) o where before is not null and o_orderkey % 2 = 0
union all select concat('order ', cast(o_orderkey as varchar(20))), concat('customer ', cast(o_custkey as varchar(20))) from {orders}
union all select concat('customer ', cast(c_custkey as varchar(20))), concat('nation ', cast(c_nationkey as varchar(20))) from {customer}"""
STAGES = """select concat('part ', cast(p_partkey as varchar(20))) node, p_name own from {part} union all select concat('order ', cast(o_orderkey as varchar(20))), o_orderpriority from {orders}
union all select concat('customer ', cast(c_custkey as varchar(20))), c_mktsegment from {customer} union all select concat('nation ', cast(n_nationkey as varchar(20))), n_name from {nation}"""
#: Stages whose own part was another one when the keys were stored; every hundredth part had no key yet.
BEFORE = f"select node, case when node like 'part %7' and length(node) % 2 = 0 then 'another' when node = 'customer 5' then '' else own end own from ({STAGES}) n"


@query(f"with recursive e as ({STAGE_EDGES}), n as ({STAGES}), l as (select node, 0 level from n union select e.dst, l.level + 1 from l join e on e.src = l.node) select node, max(level)::int level from l group by node")
def graph_levels(spark, d):
    return graph.peeled(X.frame(spark, d, STAGES), X.frame(spark, d, STAGE_EDGES))[0].select("node", "level")


@query(f"""with recursive e as ({STAGE_EDGES}), n as ({STAGES}), b as ({BEFORE}),
s as (select n.node from n join b on n.node = b.node where n.own <> b.own union select node from n where node like 'part %00' union select e.dst from s join e on e.src = s.node) select distinct node from s""")
def graph_stale(spark, d):
    nodes, edges = X.frame(spark, d, STAGES), X.frame(spark, d, STAGE_EDGES)
    # parts without a key are unknown then, so what depends on them was never run either
    before, _ = graph.peeled(X.frame(spark, d, BEFORE).filter("node not like 'part %00'"), edges)
    now, _ = graph.peeled(nodes, edges)
    return graph.stale(now, before).select("node")


@query(f"with recursive e as ({STAGE_EDGES}), r as (select 'part 3' node union select 'order 10' union select e.dst from r join e on e.src = r.node), b as (select 'nation 1' node union select 'nation 2' union select e.src from b join e on e.dst = b.node) select node from r where node in (select node from b)")
def graph_selected(spark, d):
    nodes, edges = X.frame(spark, d, STAGES), X.frame(spark, d, STAGE_EDGES)
    return graph.selected(nodes, edges, nodes.filter("node in ('part 3', 'order 10')"), nodes.filter("node in ('nation 1', 'nation 2')"))


#: A graph with cycles: each part leads to one of its ten; parts from 8 on of a ten lead on to the next ten.
LOOPS = """select cast(p_partkey as varchar(20)) src, cast(p_partkey - p_partkey % 10 + (p_partkey * p_partkey + p_partkey + 1) % 10 as varchar(20)) dst from {part}
union all select cast(p_partkey as varchar(20)), cast(p_partkey + 2 as varchar(20)) from {part} where p_partkey % 10 >= 8"""


@query(f"""with recursive e as ({LOOPS}), n as (select p_partkey::varchar node from part),
c as (select src a, dst b from e union select c.a, e.dst from c join e on e.src = c.b where e.src::bigint // 10 = c.a::bigint // 10), on_cycle as (select distinct a from c where a = b),
f as (select a node from on_cycle union select e.dst from f join e on e.src = f.node), g as (select a node from on_cycle union select e.src from g join e on e.dst = g.node)
select n.node, n.node in (select node from f) stuck, n.node in (select node from f) and n.node in (select node from g) cyclic from n""")
def graph_cycles(spark, d):
    nodes, edges = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("node"), F.lit("").alias("own")), X.frame(spark, d, LOOPS)
    edges = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    _, stuck = graph.peeled(nodes, edges)
    on = graph.cyclic(stuck, edges).select("node", F.lit(True).alias("cyclic"))
    marked = nodes.select("node").join(stuck.select("node", F.lit(True).alias("stuck")), "node", "left").join(on, "node", "left")
    return marked.select("node", F.coalesce("stuck", F.lit(False)).alias("stuck"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


#: Documents as members of archives, one file a text; those whose name begins so are read.
@query("""select 'doc-' || doc_id::varchar || '.' || lang || '.txt' "name", octet_length(encode(text)) size, md5(text) md5 from documents where starts_with('doc-' || doc_id::varchar, 'doc-1') and lang <> 'fr'""")
def archive_members(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), F.lit(".txt"))
    path = archives.archived(docs.select(name.alias("name"), F.encode("text", "UTF-8").alias("content")))
    return archives.members(spark, path, names="doc-1*.en.txt|doc-1*.de.txt|doc-1*.es.txt").select("name", "size", F.md5("content").alias("md5"))


@query("""select lang, count(*) n, sum(octet_length(encode(text)))::bigint size from documents where octet_length(encode(text)) > 2000 group by lang""")
def archive_sizes(spark, d):
    """No member is opened: the directories of the archives tell."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    path = archives.archived(docs.select(name.alias("name"), F.encode("text", "UTF-8").alias("content")))
    found = archives.members(spark, path, ["name", "size"], suffixes="en,fr,de,es", least="2001")
    return found.groupBy(F.element_at(F.split("name", r"\."), -1).alias("lang")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


from . import edit_queries  # noqa: E402, F401  adds its own to the tables above
