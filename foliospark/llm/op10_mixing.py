"""Mixing sources to target weights, DataFrame operations only.

Every document gets a hash-random key. Within each source, rows are range-bucketed by that key and sorted in
their bucket; sums over buckets and prefix sums inside them give every document the words before it in its
source. A source's budget is taken as whole epochs plus a cut at the exact word of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, prefix_sums, written

#: A key is a hash's leading 52 bits; the leading 31 of these decide the bucket, so that their product with a number
#: of buckets below 2**31 fits a long.
KEY_BITS, RANGE_BITS = 52, 31


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(seed: int, doc_id: Column, text: Column) -> Column:
    """A hash-random key that depends on seed, id and text alone: reruns agree."""
    md5 = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(md5, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """sources(source, n, source_size) with target: shares by weight, none above cap times its size.

    Weights are 1, 2, 3, repeating over the sources by code point, null last. Sources whose cap is lowest for
    their weight reach it first; as soon as the rest's even share is below the next cap, nothing is capped any
    more. One row a source passes the window, not one a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("lim", (F.lit(cap) * F.col("source_size")).cast("double"))
    full = Window.partitionBy()
    order = Window.orderBy(F.col("lim") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(full).cast("double")).withColumn("all_w", F.sum("w").over(full))
    left = F.col("total") - F.coalesce(F.sum("lim").over(order), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum("w").over(order), F.lit(0.0))
    s = s.withColumn("capped", F.col("lim") * left_w <= left * F.col("w"))
    open_ = F.col("total") - F.sum(F.when(F.col("capped"), F.col("lim")).otherwise(0.0)).over(full)
    open_w = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(full)
    target = F.when(F.col("capped"), F.col("lim")).otherwise(open_ * F.col("w") / open_w)
    return s.select("source", "n", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, carried: list[str], seed: int = 42, bucket_rows: int = 4096) -> DataFrame:
    """row (struct of docs' carried columns), size, source_size, target and taken, of every document.

    taken: words of the document that the mix takes, repeats counted; within a source they sum to the target
    rounded. Rows of equal id and text tie; they are equal for the result. A null source is a source; a null
    text or one without words has size 0 and takes 0. An empty table stays empty.
    """
    digest = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("source").alias("source"), size.alias("size"), hash_key(seed, F.col("doc_id"), F.col("text")).alias("key"))
    digest = written(digest, "mix")
    sources = targets(digest.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    sources = written(sources, "targets")
    # the range of keys is cut into as many buckets as the source's rows fill: up to 2**31 of them
    keyed = digest.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    leading = F.shiftright("key", KEY_BITS - RANGE_BITS)
    bucket = F.shiftright(leading * F.ceil(F.col("n") / F.lit(bucket_rows)), RANGE_BITS)
    keyed = keyed.select("d.*", "s.source_size", "s.target", bucket.alias("bucket"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    bases = prefix_sums(sums, ["source"], "bucket", "sum", "base").drop("sum")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = F.col("k.source").eqNullSafe(F.col("b.source")) & (F.col("k.bucket") == F.col("b.bucket"))
    placed = keyed.alias("k").join(bases.alias("b"), on).select("k.*", "b.base")
    budget = F.round("target").cast("long")
    epochs = F.floor(budget / F.col("source_size"))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("base") - F.col("before")))
    taken = F.when(F.col("size") > 0, epochs * F.col("size") + rest).otherwise(F.lit(0)).cast("long")
    return placed.select("row", "size", "source_size", "target", taken.alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), words_in(F.col("text")), ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(concat('42:', coalesce(doc_id::varchar, ''), ':', md5(coalesce(text, '')))), 1, 13))::bigint as k
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w, (3 * source_size)::double as lim from s0),
s2 as (select *, sum(source_size) over ()::double as total, sum(w) over () as all_w,
    coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    coalesce(sum(w) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before_w from s1),
s3 as (select *, lim * (all_w - before_w) <= (total - before) * w as capped from s2),
s4 as (select source, source_size, case when capped then lim else (total - sum(case when capped then lim else 0 end) over ()) * w
    / sum(case when capped then 0 else w end) over () end as target from s3),
p as (select d.doc_id, d.size, s4.source_size, s4.target, round(s4.target)::bigint as budget,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join s4 on d.source is not distinct from s4.source)
select doc_id, size, source_size, target,
  (case when size > 0 then (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) else 0 end)::bigint as taken
from p
"""
