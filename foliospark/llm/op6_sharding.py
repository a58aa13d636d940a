"""Two-pass external shuffle into shards, DataFrame operations only.

Pass 1 scatters records uniformly over memory-sized buckets by a seeded hash of their id and content. Pass 2
gathers each bucket, puts it in a canonical order and runs a Fisher-Yates shuffle over it whose draws are hashes of
seed, bucket and step: the order does not depend on partitions or on which executor does it. Prefix sums of the bucket
sizes give each record its place in the whole order; places are dealt round over the shards, so counts differ by one
at most and slots have no gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_null, discard, documents, free_name, prefix_sums, shared_path, written


#: Places of a block in the fold of a bucket's permutation.
BLOCK = 128


def fisher_yates(n: Column, bucket: Column, seed: int) -> Column:
    """A permutation of 0 .. n - 1 for a bucket: at step i, i takes the place of a drawn one of 0 .. i, which moves to the end.

    The permutation is kept as blocks of BLOCK places, so a step writes two blocks anew and not the whole of it.
    """
    block = F.lit(BLOCK)
    start = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda k: F.sequence(k * block, F.least(n, (k + 1) * block) - 1))

    def put(places: Column, at: Column, value: Column) -> Column:
        return F.concat(F.slice(places, F.lit(1), at), F.array(value), F.slice(places, at + 2, block))

    def step(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        of_i, of_j = F.floor(i / block).cast("int"), F.floor(j / block).cast("int")
        moved = F.get(F.get(done, of_j), j % block)

        def written_anew(places: Column, k: Column) -> Column:
            drawn = F.when(k == of_j, put(places, j % block, i)).otherwise(places)
            return F.when(k == of_i, put(drawn, i % block, moved)).otherwise(drawn)

        return F.when(j == i, done).otherwise(F.transform(done, written_anew))

    return F.aggregate(F.sequence(F.lit(1), n - 1), start, step, F.flatten)


def _permuted(gathered: DataFrame, seed: int, *carried: str) -> DataFrame:
    """(_bucket, carried, _rows) with the rows of each bucket in their drawn order."""
    drawn = F.when(F.size("_rows") > 1, fisher_yates(F.size("_rows"), F.col("_bucket"), seed)).otherwise(F.array(F.lit(0)))
    return gathered.select("_bucket", *carried, F.transform(drawn, lambda k: F.get("_rows", k)).alias("_rows"))


def _buckets(rows: int, size: int, bucket_rows: int, bucket_bytes: int) -> int:
    return max(1, -(-rows // bucket_rows), -(-size // bucket_bytes))


def external_shuffle(records: DataFrame, n_shards: int, hash_columns: list[str], seed: int = 42, bucket_rows: int = 4096, bucket_bytes: int = 32 << 20, size: Column | None = None) -> DataFrame:
    """records with _shard int and _slot long added, in random order over all shards.

    hash_columns decide the bucket, nulls included. Rows equal in all columns are counted first and each copy has a
    bucket of its own, so repeated rows spread like others; columns have to be comparable. A bucket has about
    bucket_rows rows and, where size (bytes of a row) is given, about bucket_bytes. Other columns are carried as they
    are; ones named _shard or _slot are replaced. An empty table stays empty.
    """
    records = records.drop("_shard", "_slot")
    columns = [F.col(f"`{c}`") for c in records.columns]
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)) if size is not None else F.lit(0)).first()
    n = _buckets(rows, total, bucket_rows, bucket_bytes)
    copies = free_name(records, "_copies")
    counted = records.groupBy(*columns).agg(F.count("*").alias(copies))
    each = counted.select(F.struct(*columns).alias("r"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias("copy"))
    key = F.xxhash64(F.lit(seed), *[F.col(f"r.`{c}`") for c in hash_columns], "copy")
    scattered = each.select(F.pmod(key, F.lit(n)).alias("_bucket"), F.struct(key.alias("k"), "copy", "r").alias("_row"))
    gathered = scattered.groupBy("_bucket").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    shuffled = written(_permuted(gathered, seed), "shuffled")
    bases = prefix_sums(shuffled.select("_bucket", F.size("_rows").cast("long").alias("_n")), [], "_bucket", "_n", "_base")
    placed = shuffled.join(bases.drop("_n"), "_bucket").select("_base", F.posexplode("_rows").alias("_at", "_row"))
    place = F.col("_base") + F.col("_at")
    return placed.select(F.expr("_row.r.*"), F.pmod(place, F.lit(n_shards)).cast("int").alias("_shard"), F.floor(place / F.lit(n_shards)).alias("_slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, seed: int = 42, bucket_rows: int = 16384, bucket_bytes: int = 32 << 20, task_bytes: int = 512 << 20) -> None:
    """Writes docs(doc_id, text, ..) shuffled, a folder _shard=s for each shard, with the place of each row in its shard as _slot.

    The law is that of external_shuffle. Sizes and places are worked out from digests of the rows; the rows themselves are
    shuffled once, by ranges of buckets of about task_bytes, and a task writes what its buckets hold of every shard. Files of a
    shard, in the order of their names, hold its rows in the order of their slots. Rows that are equal in all columns are
    gathered to one, counted before the shuffle, and dealt out again by their copies. Columns named _shard or _slot are
    replaced; an empty table writes no row.
    """
    docs = docs.drop("_shard", "_slot")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    keyed = docs.select(digest.alias("d"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64).alias("size"), F.struct(*columns).alias("r"))
    counted = written(keyed.groupBy("d").agg(F.count("*").alias("copies"), F.max("size").alias("size")), "digests")
    rows, total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0))).first()
    n = _buckets(rows, total, bucket_rows, bucket_bytes)

    def at(copy: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "d", copy), F.lit(n))

    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    sizes = counted.select("d", copy.alias("copy")).groupBy(at(F.col("copy")).alias("_bucket")).agg(F.count("*").alias("_n"))
    bases = prefix_sums(sizes, [], "_bucket", "_n", "_base")
    more = written(counted.filter("copies > 1").select("d", "copies"), "copies")  # mostly few: the planner sees its size, and texts are not shuffled for it
    first = F.lit(1).cast("long")
    single = keyed.join(more, "d", "left_anti").select(at(first).alias("_bucket"), F.struct("d", first.alias("copy"), "r").alias("_row"))
    several = keyed.join(more, "d").groupBy("d", "copies").agg(F.first("r").alias("r")).select("d", "r", copy.alias("copy"))
    several = several.select(at(F.col("copy")).alias("_bucket"), F.struct("d", "copy", "r").alias("_row"))
    marks = bases.select("_bucket", F.lit(None).cast(single.schema["_row"].dataType).alias("_row"), "_base")
    scattered = single.unionByName(several).withColumn("_base", F.lit(None).cast("long")).unionByName(marks)
    dealt = scattered.repartitionByRange(max(1, -(-total // task_bytes)), "_bucket")
    gathered = dealt.groupBy("_bucket").agg(F.max("_base").alias("_base"), F.array_sort(F.collect_list("_row"), lambda a, b: F.when(a["d"] < b["d"], -1).when(a["d"] > b["d"], 1).when(a["copy"] < b["copy"], -1).when(a["copy"] > b["copy"], 1).otherwise(0)).alias("_rows"))
    placed = _permuted(gathered, seed, "_base").select("_base", F.posexplode("_rows").alias("_at", "_row"))
    place = F.col("_base") + F.col("_at")
    out = placed.select(F.expr("_row.r.*"), F.pmod(place, F.lit(n_shards)).cast("int").alias("_shard"), F.floor(place / F.lit(n_shards)).alias("_slot"))
    out.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    discard(counted, more)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts and all, written to shards 0 to 15 under the law rows; the columns are read from the shards' files.

    A null text has size 1 and the checksum of no byte.
    """
    docs, path = documents(spark, sf_dir), shared_path(spark, "shards")
    write_shards(docs, path, 16)
    made = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, _slot long, _shard int").parquet(path)
    text = F.coalesce("text", F.lit(""))
    size, crc = F.octet_length(text).cast("long") + 1, F.crc32(F.encode(text, "UTF-8"))
    return made.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), as_null("int").alias("grown_shard"))
