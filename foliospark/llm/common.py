"""Shared pieces of the training-data operators: tables in the shared folder, prefix sums, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of a text: a maximal run of characters other than blank and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one made here.

    Outside local mode the setting has to be there; a machine-local folder would lose rows on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> Iterator[None]:
    """Limits what an Arrow batch holds while an action runs; the session's own settings are back afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Lowers the session's limits of an Arrow batch to these, for plans that run after the operator has returned.

    Other queries of the session then run under them too, with the same results.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not re.fullmatch(r"\d+b?", now) or not 0 < int(now.rstrip("b")) <= size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and about `size` bytes, whatever the session's settings.

    After the last one the worker gives memory that it does not use back to the system.
    """
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def written(df: DataFrame, tag: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, tag)
    with small_batches(df.sparkSession, size=batch_bytes):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._shared_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes what written() made, once nothing that is still to run reads it."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column; a null text is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def prefix_sums(totals: DataFrame, keys: list[str], order: str, value: str, out: str, span: int = 4096) -> DataFrame:
    """Exclusive prefix sums of value by order within keys, in two levels of span buckets each.

    totals has one row per (keys, order), order being a dense bucket number. Rows of span neighbouring
    buckets are summed together and only the sums of such runs pass through the upper window.
    """
    run = F.floor(F.col(order) / F.lit(span))
    inner = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    low = totals.withColumn("_run", run).withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    outer = (Window.partitionBy(*keys) if keys else Window).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = totals.withColumn("_run", run).groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    runs = runs.withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    on = F.col("a._run") == F.col("b._run")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = low.alias("a").join(runs.alias("b"), on)
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in totals.columns], (F.col("a._in") + F.col("b._base")).alias(out))


def _stars(edges: DataFrame, hot: list[int]) -> DataFrame:
    """One round: every node is linked to the least node next to it, first from above, then from below.

    Minima are taken with map-side aggregation, never by gathering the neighbours of a node. Nodes in hot have many
    neighbours: their rows are dealt to SALTS tasks.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    above, on = both.filter("v > u"), ["u"]
    if hot:
        is_hot, on = F.col("u").isin(hot), ["u", "s"]
        above = above.withColumn("s", F.when(is_hot, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
        least = least.withColumn("s", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    above = above.join(least, on).select(F.col("v").alias("u"), F.col("m").alias("v"))
    above = above.filter("u > v").distinct()
    below = above.groupBy("u").agg(F.min("v").alias("m"))
    links = above.join(below, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(below.select("u", F.col("m").alias("v"))).distinct()


#: Tasks that share a node of many neighbours, and how many such nodes there are at most.
SALTS, HOT_NODES = 32, 1000


def _hot(edges: DataFrame, total: int) -> list[int]:
    """The nodes, HOT_NODES at most, that are the lesser end of more than a thousandth of all links, and of 1000 at least."""
    counts = edges.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > max(1000, total // HOT_NODES))
    return [r["v"] for r in counts.orderBy(F.desc("n")).limit(HOT_NODES).collect()]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u long, v long): the least node that links reach.

    Alternating large-star and small-star rounds; each result is a table in the shared folder. It ends
    when a round leaves count and checksum of the links as they were.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        hot = _hot(edges, state[0]) if state[0] > 1000 else []
        last, edges = edges, written(_stars(edges, hot), "links")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def as_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def by_bucket(rows: DataFrame, buckets: int, function: Callable[[list[bytes], list[bytes]], Iterator[list]], schema: str) -> DataFrame:
    """function(blobs of kind 0, blobs of kind 1) of each bucket of rows(bucket, kind, blob), one bucket at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for b in batches:
            for bucket, kind, blob in zip(b["bucket"].to_pylist(), b["kind"].to_pylist(), b["blob"].to_pylist()):
                if bucket != now and now is not None:
                    yield from function(*held)
                    held = ([], [])
                now = bucket
                held[kind].append(blob)
        if now is not None:
            yield from function(*held)
        release()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.record_batch([pa.array(c) for c in columns], names)

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(named, schema)
