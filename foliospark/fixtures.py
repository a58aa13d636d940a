"""Page-shaped inputs derived from the driver's tables, as SQL that Spark and DuckDB both run.

Each text names its source table in braces; Spark binds a DataFrame to it, DuckDB gets the bare name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regions of pages: boxes, types, states, confidences. rn is the input order within a page.
REGIONS = """
select page_id, rn, concat('rgn_', cast(page_id as varchar(20)), '_', cast(rn as varchar(20))) region_id,
  cast((pk * 37) % 760 as double) x, cast((sk * 53 + ln * 71) % 1120 as double) y, 20 + qty * 3 w, cast(20 + (pk * 13) % 90 as double) h,
  case cast(pk % 6 as int) when 0 then 'bubble' when 1 then 'narration' when 2 then 'sfx' when 3 then 'caption' when 4 then 'side_text' else 'unknown' end type,
  case cast(sk % 10 as int) when 0 then 'needs_review' when 1 then 'correct' when 2 then 'ignore' when 3 then 'manual' else 'auto' end status,
  case when ln = 7 then null else disc * 10 end confidence
from (select l_orderkey page_id,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) rn,
    l_partkey pk, l_suppkey sk, l_linenumber ln, l_quantity qty, l_discount disc from {lineitem}) q
"""

#: Recognised spans of regions: none, one or two each, some blank, some without a confidence.
SPANS = f"""
select page_id, region_id, seq, case when (rn + seq) % 5 = 0 then '' else concat('t', cast(rn as varchar(20)), '.', cast(seq as varchar(20))) end text,
  case when (rn + seq) % 4 = 0 then null else cast((rn * 7 + seq * 3) % 10 as double) / 10 end confidence
from ({REGIONS}) g cross join (select 0 seq union all select 1 seq) s
where seq < case when rn % 7 = 0 then 0 when rn % 3 = 0 then 2 else 1 end
"""

#: Units of up to three regions in input order, one row a region.
UNIT_REGIONS = f"""
select page_id, concat('tu_', cast(page_id as varchar(20)), '_', cast((rn - 1 - (rn - 1) % 3) / 3 as int)) unit_id, (rn - 1) % 3 pos, region_id, rn
from ({REGIONS}) g
"""

#: Candidates of units: the draft always, an edited one for some, an AI one for some.
CANDIDATES = f"""
select u.page_id, u.unit_id, c.ord, concat(u.unit_id, '_', c.kind) candidate_id, c.kind,
  case when c.kind = 'raw' and u.n % 5 = 0 then '' else concat(c.kind, ' ', cast(u.n as varchar(20))) end text,
  case when c.kind = 'ai' and u.n % 4 <> 0 then cast(u.n % 10 as double) / 10 else null end confidence,
  case when u.n % 3 = 0 then 'manual' when u.n % 3 = 1 then 'raw' else 'none' end picked
from (select page_id, unit_id, min(rn) + page_id % 7 n from ({UNIT_REGIONS}) r group by page_id, unit_id) u
cross join (select 0 ord, 'raw' kind union all select 1, 'manual' union all select 2, 'ai') c
where c.kind = 'raw' or (c.kind = 'manual' and u.n % 3 = 0) or (c.kind = 'ai' and u.n % 2 = 0)
"""

#: Dialogue turns in order, with empty texts and null panels.
TURNS = """
select conv_id page_id, turn rk, case when turn % 4 = 3 then '' else text end text,
  case when role = 'system' then null else cast(floor(turn / 3.0) as int) end panel from {conversations}
"""

#: Ordered commands on pages.
COMMANDS = """
select user_id page_id, cast(row_number() over (order by ts, event_id) as int) cmd_seq, ts,
  case event_type when 'view' then 'undo' when 'error' then 'redo' when 'signup' then 'claim' else 'edit' end cmd, value from {events}
"""

#: Panels: a grid of two by three on every page, in raster order.
PANELS = """
select p.page_id, q.panel, cast(q.panel % 2 * 400 as double) x, cast((q.panel - q.panel % 2) / 2 * 400 as double) y, cast(380 as double) w, cast(370 as double) h
from (select distinct l_orderkey page_id from {lineitem}) p
cross join (select 0 panel union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) q
"""

TABLES = ("lineitem", "conversations", "events", "documents", "part", "orders", "customer", "nation")


def duck(sql: str) -> str:
    """The text for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The text as a DataFrame over the tables of sf_dir."""
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


#: What REGIONS calls the columns of lineitem.
NAMES = {"l_orderkey": "page_id", "l_partkey": "pk", "l_suppkey": "sk", "l_linenumber": "ln", "l_quantity": "qty", "l_discount": "disc"}


def shared(spark: SparkSession, sf_dir: str, sql: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """As frame() for a text over REGIONS; all tables of a query that come from here share one shuffle of lineitem.

    Columns are renamed before the window, which would shuffle a column under both of its names and leave it unknown that pages are
    dealt by page_id. Regions are gathered by page and dealt out again: nothing is pruned from what is gathered, so the
    shuffles are alike and Spark runs one of them, and all that keeps page_id stays where its page is.
    columns: just these of the regions.
    """
    text = REGIONS
    for old, new in NAMES.items():
        text = text.replace(f"{old} {new}", new).replace(old, new)
    g = spark.sql(text, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnsRenamed(NAMES))
    pages = g.groupBy("page_id").agg(F.collect_list(F.struct(*(columns or [c for c in g.columns if c != "page_id"]))).alias("rows"))
    g = pages.select("page_id", F.explode("rows").alias("r")).select("page_id", "r.*")
    return spark.sql(sql.replace(REGIONS, "select * from {g}"), g=g)
