"""Recomputing only what changed, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(pages: DataFrame, provenance: DataFrame, signature: Column, guard: Column | None = None) -> DataFrame:
    """Pages to compute: the stored signature differs or is missing, or the guard fails. provenance(page_id, stored)."""
    joined = pages.withColumn("signature", signature).join(provenance, "page_id", "left")
    fresh = F.coalesce(F.col("stored") == F.col("signature"), F.lit(False)) & (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True))
    return joined.filter(~fresh).drop("stored")


def upsert(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version for each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return table.unionByName(rows, allowMissingColumns=True).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def overwrite_pages(table: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of the recomputed pages replace all earlier ones of those pages."""
    return table.join(pages.select("page_id").distinct(), "page_id", "left_anti").unionByName(rows, allowMissingColumns=True)


def adopt_spans(regions: DataFrame, spans: DataFrame, detector: str) -> tuple[DataFrame, DataFrame]:
    """(adopted spans, regions still to recognise): regions not ignored keep the detector's first own span."""
    eligible = regions.filter("status <> 'ignore'").select("page_id", "region_id")
    first = spans.filter(F.col("source") == detector).groupBy("region_id").agg(F.min_by(F.struct("text", "confidence"), "seq").alias("s"))
    return eligible.join(first, "region_id").select("page_id", "region_id", "s.text", "s.confidence"), eligible.join(first, "region_id", "left_anti")


def low_spans(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans to correct: not blank, and of unknown or low confidence."""
    return spans.filter((F.trim("text") != "") & (F.col("confidence").isNull() | (F.col("confidence") < threshold)))


def select_where(table: DataFrame, column: str | None = None, value=None, order_by: str | None = None) -> DataFrame:
    """The store's query language: at most one equality and one ascending sort, on columns that exist."""
    for c in (column, order_by):
        if c is not None and c not in table.columns:
            raise ValueError(f"no column {c}")
    out = table if column is None else table.filter(F.col(column) == F.lit(value))
    return out if order_by is None else out.orderBy(order_by)


def delete_where(table: DataFrame, column: str, value) -> DataFrame:
    """The table without the rows that have this value."""
    if column not in table.columns:
        raise ValueError(f"no column {column}")
    return table.filter(~F.col(column).eqNullSafe(F.lit(value)))
