"""Rows of several tables that meet on their pages."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def met(keys: list[str], tables: list[DataFrame], *aggregates: Column) -> DataFrame:
    """keys and aggregates over the rows of all tables; columns that a table lacks are null. The first key is page_id, others lie within a page.

    Where all tables are dealt by page nothing is shuffled, as it would be by a join on more than the page. Spark sees that of a
    union only by a column that each table names anew, so the page has another name in it.
    """
    named = [t.select(F.col(keys[0]).alias("_page"), *[c for c in t.columns if c != keys[0]]) for t in tables]
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    found = rows.groupBy("_page", *keys[1:]).agg(*aggregates)
    return found.select(F.col("_page").alias(keys[0]), *[c for c in found.columns if c != "_page"])
