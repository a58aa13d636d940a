"""Reading order of regions, panels, natural order of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B

ROW_OVERLAP = 0.5


def tiers(regions: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """regions with tier: boxes are visited from the top (y, x, id) and each joins the first tier whose first box it
    overlaps by half the lesser height or more, or opens a new one.

    The fold over a page's sorted boxes stays in the JVM; a page bounds its array.
    """
    item = F.struct(F.col("y"), F.col("x"), F.col(id_column).alias("id"), F.col("h"), F.col("w"))
    pages = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    state = "struct<anchors:array<struct<y:double,h:double>>,tiers:array<int>>"

    def step(s: Column, r: Column) -> Column:
        fits = F.transform(s["anchors"], lambda a: B.overlap_y(F.struct(a["y"].alias("y"), a["h"].alias("h")), r) >= ROW_OVERLAP)
        at = F.array_position(fits, True).cast("int")
        new = F.struct(F.concat(s["anchors"], F.array(F.struct(r["y"].alias("y"), r["h"].alias("h")))).alias("anchors"), F.concat(s["tiers"], F.array(F.size(s["anchors"]))).alias("tiers"))
        old = F.struct(s["anchors"].alias("anchors"), F.concat(s["tiers"], F.array(at - 1)).alias("tiers"))
        return F.when(at > 0, old.cast(state)).otherwise(new.cast(state))

    zero = F.struct(F.array().cast("array<struct<y:double,h:double>>").alias("anchors"), F.array().cast("array<int>").alias("tiers")).cast(state)
    found = pages.withColumn("tiers", F.aggregate("items", zero, step, lambda s: s["tiers"]))
    rows = found.select(*keys, F.explode(F.arrays_zip("items", "tiers")).alias("z"))
    return rows.select(*keys, F.col("z.items.id").alias(id_column), *[F.col(f"z.items.{c}").alias(c) for c in "xywh"], F.col("z.tiers").alias("tier"))


def reading_order(regions: DataFrame, direction: str = "rtl", keys: list[str] | None = None, id_column: str = "region_id") -> DataFrame:
    """(keys, id, tier, reading_order): tier by tier, each from the right (rtl) or left (ltr), then from the top, then by id."""
    keys = keys or ["page_id"]
    found = tiers(regions, keys, id_column)
    centre = F.col("x") + F.col("w") / 2
    w = Window.partitionBy(*keys).orderBy("tier", -centre if direction == "rtl" else centre, "y", "x", id_column)
    return found.withColumn("reading_order", F.row_number().over(w) - 1).select(*keys, id_column, "tier", "reading_order")


def panel_assign(regions: DataFrame, panels: DataFrame) -> DataFrame:
    """(page_id, region_id, panel): the panel that shares most area, the first on a tie, null if none shares any."""
    joined = regions.alias("r").join(panels.select("page_id", "panel", B.box().alias("p")).alias("q"), "page_id", "left")
    shared = B.intersection(B.box(F.col("r.x"), F.col("r.y"), F.col("r.w"), F.col("r.h")), F.col("q.p"))
    best = F.max_by(F.when(shared > 0, F.col("q.panel")), F.when(shared > 0, F.struct(shared, -F.col("q.panel"))))
    return joined.groupBy("page_id", "region_id").agg(best.alias("panel"))


def order_by_panels(regions: DataFrame, panels: DataFrame, direction: str = "rtl") -> DataFrame:
    """(page_id, region_id, panel, reading_order): panels in reading order, regions within them, the rest last."""
    owner = panel_assign(regions, panels)
    rank = reading_order(panels.withColumnRenamed("panel", "panel_id"), direction, ["page_id"], "panel_id").select("page_id", F.col("panel_id").alias("panel"), F.col("reading_order").alias("panel_rank"))
    inner = reading_order(regions.join(owner, ["page_id", "region_id"]), direction, ["page_id", "panel"])
    placed = inner.join(rank, ["page_id", "panel"], "left")
    w = Window.partitionBy("page_id").orderBy(F.col("panel_rank").asc_nulls_last(), "reading_order")
    return placed.withColumn("reading_order", F.row_number().over(w) - 1).select("page_id", "region_id", "panel", "reading_order")


def natural_key(name: Column) -> Column:
    """A text that sorts page2 before page10: by turns text chunks in lower case, each closed by the least character, and numbers
    of any length, without leading zeros and behind the number of their digits."""
    chunks = F.transform(F.split(F.lower(name), r"\d+"), lambda t: F.concat(t, F.lit("\0")))
    digits = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), lambda d: F.regexp_replace(d, r"^0+(?=\d)", ""))
    numbers = F.transform(digits, lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d))
    return F.array_join(F.transform(F.arrays_zip(chunks.alias("t"), numbers.alias("n")), lambda z: F.concat(z["t"], F.coalesce(z["n"], F.lit("")))), "")


def placed(rows: DataFrame, key: Column, place: str, then: list[str | Column], first: int = 0, rows_of: int = 200_000, sample: int = 20_000) -> DataFrame:
    """rows with their place, from `first` on, by key and further columns, without one task for all of them.

    A sample of the keys, picked by their hash and of a bounded size, gives bounds of groups; ranks inside a group follow
    the rows of the groups before. There are 256 groups, or more so that one has about rows_of rows, as far as the sample tells them
    apart. Bounds are values in the plan, so every evaluation deals alike. Rows of one key are in one group.
    """
    keyed = rows.withColumn("_key", key)
    total = rows.count()
    groups = min(max(256, total // rows_of), max(256, sample // 8))
    some = keyed.filter(F.pmod(F.xxhash64("_key"), F.lit(max(1, total // sample))) == 0).select("_key").filter("_key is not null").limit(4 * sample)
    found = sorted(r["_key"] for r in some.collect())
    bounds = sorted({found[i * len(found) // groups] for i in range(1, groups)}) if found else []
    group = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    dealt = keyed.withColumn("_group", group)
    sizes = dealt.groupBy("_group").agg(F.count("*").alias("_n"))  # groups rows at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_group").orderBy("_key", *then))
    ranked = dealt.withColumn("_at", inside).join(F.broadcast(sizes.select("_group", before.alias("_base"))), "_group")
    return ranked.withColumn(place, (F.col("_base") + F.col("_at") + (first - 1)).cast("int")).drop("_key", "_group", "_n", "_at", "_base")


def natural_order(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with their place in natural order; the raw name breaks ties."""
    return placed(names.select(column).distinct(), natural_key(F.col(column)), "place", [column])


def manifest_order(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(name) in the order of manifest(name, pos), the unlisted after them in natural order.

    A listed name that is not there is kept with found false and no place.
    """
    listed = manifest.groupBy("name").agg(F.min("pos").alias("pos"))
    there = files.select("name").distinct()
    at = F.lpad((F.col("pos").cast("decimal(38,0)") + F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("string"), 20, "0")  # not negative, of one length
    key = F.concat(F.coalesce(F.concat(F.lit("0"), at), F.lit("1")), natural_key(F.col("name")))
    found = placed(there.join(listed, "name", "left"), key, "place", ["name"])
    lost = listed.join(there, "name", "left_anti").select("name", "pos", F.lit(None).cast("int").alias("place"))
    return found.select("name", "pos", "place", F.lit(True).alias("found")).unionByName(lost.withColumn("found", F.lit(False)))


def import_pages(pages: DataFrame, images: DataFrame) -> DataFrame:
    """New pages (name, idx) of images(name, seq): none twice, none there already, numbered on from the last index."""
    new = images.groupBy("name").agg(F.min("seq").alias("seq")).join(pages.select("name"), "name", "left_anti")
    last = pages.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("last")).first()["last"]
    return placed(new, F.col("seq"), "idx", ["name"], int(last) + 1).select("name", "idx")
