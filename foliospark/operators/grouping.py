"""Chains of neighbouring regions, and units of translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B


def chains(regions: DataFrame, max_gap: float = 0.4) -> DataFrame:
    """(page_id, region_id, chain, pos) of regions(page_id, region_id, reading_order, type, box columns).

    In reading order (none last, then y, x, id) a region continues the chain if it has the type of the one before,
    is no sfx, and the gap between them is at most max_gap of their mean height; max_gap 0 chains nothing.
    """
    w = Window.partitionBy("page_id").orderBy(F.col("reading_order").asc_nulls_last(), "y", "x", "region_id")
    here, before = B.box(), F.lag(F.struct("type", B.box().alias("b"))).over(w)
    steps = regions.withColumn("_at", F.row_number().over(w)).withColumn("_before", before)
    goes_on = (F.col("_before.type") == F.col("type")) & (F.col("type") != "sfx") & (B.gap(F.col("_before.b"), here) <= max_gap) & F.lit(max_gap > 0)
    marked = steps.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    run = Window.partitionBy("page_id").orderBy("_at")
    numbered = marked.withColumn("chain", F.sum("_new").over(run) - 1)
    inside = Window.partitionBy("page_id", "chain").orderBy("_at")
    return numbered.withColumn("pos", F.row_number().over(inside) - 1).select("page_id", "region_id", "chain", "pos")


def units(chained: DataFrame) -> DataFrame:
    """One unit a chain: (page_id, chain, ordered_region_ids)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "region_id"))), lambda s: s["region_id"])
    return chained.groupBy("page_id", "chain").agg(ids.alias("ordered_region_ids"))
