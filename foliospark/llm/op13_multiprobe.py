"""Nearest neighbours by largest inner product with multiprobe p-stable hashing.

Vectors are scaled by the longest one and get a component that makes them unit vectors; then the largest inner product with a
query is the smallest distance to it. Each of several tables hashes a vector by m functions floor((a x + b) / w) with normal a.
A query does not only look into its own bucket: in each table it visits perturbed buckets, where any function's value may be
moved, in the order of the squared distance of its projections to the bucket, which orders them by the estimated chance that a
neighbour is there. How far it goes is fitted: a bounded sample of queries is searched exactly, and the distance is taken at
which the wanted share of their true neighbours is in a visited bucket of some table.

A table's buckets that agree in all but the last functions are one region. A row is sent to the region of each table, a
query once to each region it visits, with the buckets it visits there. Regions of many rows or queries are cut into
blocks, so no task gets more than a block of rows and a stream of queries. A block returns each query's best rows as
one row; these are merged over blocks and tables. Scores are summed in one fixed order, from the original vectors.

Equal vectors are one class, of which no query can need more than its k + 1 least ids. Queries that found less than
they should are compared with all rows, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesets import mixed
from .common import discard, release, slices, written

SEED, WIDTH, LAST = 29, 1.0, 3
#: Bits that a function of this width tells of a normal projection: how many functions a table needs follows from it.
BITS = 2.05


@dataclass(frozen=True)
class Index:
    """What tasks need: dim, the longest vector's length, tables of m functions, and how far queries go."""

    dim: int
    longest: float
    tables: int
    m: int
    reach: float = 0.0

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        return rng.standard_normal((self.tables, self.dim + 1, self.m)), rng.random((self.tables, 1, self.m)) * WIDTH

    def projected(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections (tables, n, m) in units of the width."""
        if query:
            y, more = x / norms(x)[:, None], np.zeros((len(x), 1))
        else:
            y = x / self.longest
            more = np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))
        a, b = self.functions()
        return (np.hstack([y, more]) @ a + b) / WIDTH

    def split(self, t: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Region and bucket of values h(n, m) in table t: the functions but the last ones, and the last ones."""
        lead = max(0, self.m - LAST)
        region = np.full(len(h), (t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for i in range(lead):
            region = mixed(region * np.uint64(0xD6E8FEB86659FD93) + h[:, i].astype(np.int64).view(np.uint64))
        bucket = np.zeros(len(h), np.int64)
        for i in range(lead, self.m):
            bucket = bucket << 16 | (h[:, i].astype(np.int64) + (1 << 15)) & 0xFFFF
        return region.view(np.int64), bucket


def visited(p: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that queries with projections p(n, m) visit: (query, values, score), by query and score.

    The score of a bucket is the sum over the functions of the squared distance from the projection to the bucket's cell;
    visited are those of at most reach. The own bucket has score 0.
    """
    n, m = p.shape
    own = np.floor(p)
    query, score, values = np.arange(n), np.zeros(n), np.zeros((n, 0), np.int64)
    furthest = math.ceil(math.sqrt(reach)) + 1
    steps = np.arange(-furthest, furthest + 1)
    for i in range(m):
        inside = p[:, i] - own[:, i]
        away = np.where(steps > 0, steps - inside[:, None], np.where(steps < 0, inside[:, None] - steps - 1, 0.0)) ** 2
        total = score[:, None] + away[query]
        row, step = np.nonzero(total <= reach)
        values = np.hstack([values[row], (own[query[row], i] + steps[step]).astype(np.int64)[:, None]])
        query, score = query[row], total[row, step]
    order = np.lexsort((score, query))
    return query[order], values[order], score[order]


def vectors_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows that are not zero, without overflow or underflow of squares."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in an order that depends on their length alone."""
    return (q * x).sum(1)


def best_pairs(qi: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, in its order: largest score first, ties to the smaller id; an id counts once."""
    order = np.lexsort((-score, ids, qi))
    q, i = qi[order], ids[order]
    once = np.ones(len(order), bool)
    once[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    order = order[once]
    order = order[np.lexsort((ids[order], -score[order], qi[order]))]
    q = qi[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def matched(q: np.ndarray, probes: list[np.ndarray] | None, x: np.ndarray, bucket: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score) of the k best ids of each query among the rows in buckets that it visits; of all without probes.

    Rows are in the order of their buckets. Products of matrices find what may be among the best; scores are taken anew.
    """
    if probes is None:
        near = q @ x.T
    else:
        near = np.full((len(q), len(x)), -np.inf)
        found, first = np.unique(bucket, return_index=True)
        end = np.append(first[1:], len(bucket))
        qi = np.repeat(np.arange(len(q)), [len(p) for p in probes])
        at = np.searchsorted(found, flat := np.concatenate(probes))
        hit = (at < len(found)) & (found[np.minimum(at, len(found) - 1)] == flat)
        qi, at = qi[hit], at[hit]
        order = np.argsort(at, kind="stable")
        qi, at = qi[order], at[order]
        edges = np.searchsorted(at, np.arange(len(found) + 1))
        for c in np.unique(at):
            some = qi[edges[c] : edges[c + 1]]
            near[some, first[c] : end[c]] = q[some] @ x[first[c] : end[c]].T
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(q), -np.inf)
    slack = 1e-9 * norms(q) * norms(x).max()
    qi, xi = np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))
    score = scores(q[qi], x[xi])
    count = np.array([len(i) for i in ids])[xi]
    qi, score = np.repeat(qi, count), np.repeat(score, count)
    each = np.concatenate([ids[i] for i in xi]) if len(xi) else np.zeros(0, np.int64)
    keep = best_pairs(qi, score, each, k)
    return qi[keep], each[keep], score[keep]


def taking_part(rows: DataFrame, dim: int | None) -> DataFrame:
    """(vec_id, v) of the rows that take part; dim None: of any length."""
    finite = F.coalesce(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    base = rows.filter(F.col("vec_id").isNotNull() & finite)
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double") + 0.0).alias("v"))  # no -0.0
    return base.filter(F.exists("v", lambda c: c != 0) & (F.size("v") == dim if dim is not None else F.lit(True)))


def _packed(rows: DataFrame, carried: str) -> DataFrame:
    """v as doubles in a binary named vector, beside the column carried ("name type")."""
    name = carried.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if len(b):
                x = b["v"].flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(b), -1)
                yield pa.record_batch([b[name], pa.array([v.tobytes() for v in x], pa.binary()), pa.array(norms(x))], [name, "vector", "norm"])

    return rows.select(name, "v").mapInArrow(run, f"{carried}, vector binary, norm double")


def classes(base: DataFrame, k: int) -> DataFrame:
    """(cid, ids, vector, norm) of each different vector of base(vec_id, v), with its k + 1 least ids."""
    # ranks up to k + 1 are taken before the shuffle as well: a class may hold a third of all rows
    least = base.withColumn("rank", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("rank") <= k + 1)
    return _packed(least.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "ids array<long>").withColumn("cid", F.monotonically_increasing_id())


def _exact(base: DataFrame, queries: np.ndarray, own: np.ndarray, dim: int, k: int) -> DataFrame:
    """(query, id, score, vector): the k nearest of each of a bounded number of queries, their own ids left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for b in slices(batches):
            if not len(b):
                continue
            x, ids = vectors_of(b["vector"], dim), [i.values.to_numpy() for i in b["ids"]]
            qi, each, score = matched(queries, None, x, None, ids, k + 1)
            at = {int(i): r for r, some in enumerate(ids) for i in some}
            found = (qi, each, score, x[[at[int(i)] for i in each]])
            if kept is not None:
                found = tuple(np.concatenate(p) for p in zip(kept, found))
            keep = best_pairs(*(found[0], found[2], found[1]), k + 1)
            kept = tuple(f[keep] for f in found)
        if kept is not None:
            other = own[kept[0]] != kept[1]
            qi, each, score, x = (f[other] for f in kept)
            yield pa.record_batch([pa.array(qi), pa.array(each), pa.array(score), pa.array([v.tobytes() for v in x], pa.binary())], ["query", "id", "score", "vector"])
        release()

    found = base.mapInArrow(run, "query long, id long, score double, vector binary")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def fitted(base: DataFrame, members: DataFrame, index: Index, k: int, sample: int, recall: float) -> Index:
    """The index with the reach at which the sampled queries meet the share recall of their true neighbours.

    The sample: the `sample` classes of least hash among those that hold a query, each with its least query. They are
    searched exactly, so what comes to the driver is sample * k vectors.
    """
    asked = base.join(members.groupBy("cid").agg(F.min("vec_id").alias("query")), "cid").orderBy(F.xxhash64("vector"), "vector").select("vector", "query").limit(sample).collect()
    if not asked:
        return index
    q = vectors_of(pa.array([r["vector"] for r in asked], pa.binary()), index.dim)
    own = np.array([r["query"] for r in asked])
    true = _exact(base, q, own, index.dim, k).select("query", "vector").collect()
    if not true:
        return index
    x = vectors_of(pa.array([r["vector"] for r in true], pa.binary()), index.dim)
    p, h = index.projected(q, True)[:, [r["query"] for r in true]], np.floor(index.projected(x, False))
    away = np.maximum(0, np.maximum(h - p, p - (h + 1)))
    far = np.sort((away**2).sum(2).min(0))  # the least score of a bucket that holds the neighbour, over the tables
    return Index(index.dim, index.longest, index.tables, index.m, float(far[min(len(far) - 1, math.ceil(recall * len(far)))]) + 1e-9)


def _entered(base: DataFrame, index: Index) -> DataFrame:
    """A row for each table: region, bucket, and what a row is compared by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if len(b):
                h = np.floor(index.projected(vectors_of(b["vector"], index.dim), False))
                for t in range(index.tables):
                    region, bucket = index.split(t, h[t])
                    yield pa.record_batch([pa.array(region), pa.array(bucket), b["cid"], b["ids"], b["vector"]], ["region", "bucket", "cid", "ids", "vector"])

    return base.mapInArrow(run, "region long, bucket long, cid long, ids array<long>, vector binary")


def _probing(base: DataFrame, index: Index) -> DataFrame:
    """A row for each region that a query visits, with the buckets that it visits there, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            if not len(b):
                continue
            p = index.projected(vectors_of(b["vector"], index.dim), True)
            for t in range(index.tables):
                query, values, _ = visited(p[t], index.reach)
                region, bucket = index.split(t, values)
                order = np.lexsort((np.arange(len(query)), region, query))
                query, region, bucket = query[order], region[order], bucket[order]
                first = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (region[1:] != region[:-1])])
                probes = pa.LargeListArray.from_arrays(pa.array(np.append(first, len(query))), pa.array(bucket)).cast(pa.list_(pa.int64()))
                at = pa.array(query[first])
                yield pa.record_batch([pa.array(region[first]), probes, b["cid"].take(at), b["vector"].take(at)], ["region", "probes", "cid", "vector"])

    return base.mapInArrow(run, "region long, probes array<long>, cid long, vector binary")


def _met(rows: DataFrame, queries: DataFrame, index: Index, k: int, limit: int, most: int) -> DataFrame:
    """(cid, ids, scores): the best ids of each query in each block of a region, packed in one row.

    rows(region, bucket, cid, ids, vector), queries(region, probes, cid, vector). A region is cut into blocks of about
    limit rows and most queries, and each block of rows meets each block of queries in a group of its own.
    """
    def blocks(side: DataFrame, per: int, name: str) -> DataFrame:
        return side.groupBy("region").agg(F.ceil(F.count("*") / per).cast("int").alias(name))

    cut = written(blocks(rows, limit, "rb").join(blocks(queries, most, "qb"), "region"), "regions")  # those that queries visit
    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        met = side.join(cut, "region").withColumn(own, F.pmod(F.xxhash64(F.lit(7), "cid"), F.col(own)).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    none = F.lit(None)
    left = dealt(rows, "rb", "qb").select("region", "rb", "qb", F.lit(0).alias("kind"), "bucket", "cid", "ids", "vector")
    right = dealt(queries, "qb", "rb").select("region", "rb", "qb", F.lit(1).alias("kind"), none.cast("long").alias("bucket"), "cid", F.col("probes").alias("ids"), "vector")
    parts = left.union(right).repartition("region", "rb", "qb").sortWithinPartitions("region", "rb", "qb", "kind", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def answered(asked: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, index_rows = pa.Table.from_batches(asked), pa.Table.from_batches(held)
            q, cid = vectors_of(table["vector"], index.dim), table["cid"].to_numpy()
            x, bucket = vectors_of(index_rows["vector"], index.dim), index_rows["bucket"].to_numpy()
            ids = [i.values.to_numpy() for c in index_rows["ids"].chunks for i in c]
            probes = [p.values.to_numpy() if p.is_valid else None for c in table["ids"].chunks for p in c]
            every = [p is None for p in probes]
            for group in ([i for i, e in enumerate(every) if not e], [i for i, e in enumerate(every) if e]):
                if group:
                    some = [probes[i] for i in group] if probes[group[0]] is not None else None
                    qi, each, score = matched(q[group], some, x, bucket, ids, k)
                    if len(qi):
                        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
                        ends = np.append(first, len(qi))
                        cut_at = lambda v: pa.array([v[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])], pa.binary())
                        yield pa.record_batch([pa.array(cid[group][qi[first]]), cut_at(each), cut_at(score)], ["cid", "ids", "scores"])

        for b in slices(batches, 1024):
            key = [b[c].to_numpy() for c in ("region", "rb", "qb", "kind")]
            edge = np.flatnonzero(np.any([k_[1:] != k_[:-1] for k_ in key], axis=0)) + 1 if len(b) else []
            for s, e in zip([0, *edge], [*edge, len(b)]):
                if s == e:
                    continue
                here, part = tuple(int(k_[s]) for k_ in key[:3]), b.slice(s, e - s)
                if here != now:
                    now, held = here, []
                if key[3][s] == 0:
                    held.append(part)
                elif held:
                    yield from answered([part])
        release()

    return parts.mapInArrow(run, "cid long, ids binary, scores binary")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(cid, ids, scores) with the k best of each query over all blocks and tables; one query is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, score, done = None, np.zeros(0, np.int64), np.zeros(0), []

        def settle() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.list_(pa.int64())), pa.array([d[2] for d in done], pa.list_(pa.float64()))], ["cid", "ids", "scores"])
            done.clear()
            return out

        for b in batches:
            for cid, i, s in zip(b["cid"].to_pylist(), b["ids"].to_pylist(), b["scores"].to_pylist()):
                if cid != now:
                    if now is not None:
                        done.append((now, ids, score))
                        if len(done) >= 4096:
                            yield settle()
                    now, ids, score = cid, np.zeros(0, np.int64), np.zeros(0)
                ids, score = np.append(ids, np.frombuffer(i, np.int64)), np.append(score, np.frombuffer(s))
                keep = best_pairs(np.zeros(len(ids), np.int8), score, ids, k)
                ids, score = ids[keep], score[keep]
        if now is not None:
            done.append((now, ids, score))
            yield settle()
        release()

    return found.repartition("cid").sortWithinPartitions("cid").mapInArrow(run, "cid long, ids array<long>, scores array<double>")


def search(rows: DataFrame, every: int = 20, k: int = 20, tables: int = 2, occupancy: int = 64, sample: int = 128, recall: float = 0.96, limit: int = 1024, most: int = 8192, dim: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to each of rows(vec_id, embedding) whose id every divides.

    Nearness is the largest inner product in double precision, ties go to the smaller vec_id. Vectors that are null, empty, zero or
    hold a null or a non-finite component, rows without an id, and vectors of another length than dim (if None: than the most
    frequent length, of ties the least) take no part. Rows equal in id and vector count once; rows that share an id
    with different vectors ask with each of them, and none of them is found by its own id. A query has k rows, or all
    candidates if there are fewer. An empty table gives no row; other columns are not looked at.
    Buckets hold about `occupancy` rows where vectors are spread; recall is what the fit on `sample` queries aims at.
    """
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        usual = taking_part(rows, None).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        if not usual:
            return none
        dim = usual[0]["d"]
    part = taking_part(rows, dim)
    base = written(classes(part, k), "classes")
    n, longest, known = base.agg(F.count("*"), F.max("norm"), F.sum(F.size("ids"))).first()
    if not n:
        return none
    asking = _packed(part.filter(F.col("vec_id") % every == 0).distinct(), "vec_id long")
    members = written(asking.join(base.select("vector", "cid"), "vector").select("vec_id", "cid"), "members")
    m = max(2, round(math.log2(max(1, n / occupancy)) / BITS))
    index = fitted(base, members, Index(dim, longest, tables, m), k, sample, recall)
    asking = base.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "vector")
    entered, probing = written(_entered(base, index), "entered"), written(_probing(asking, index), "probing")
    best = written(_merged(_met(entered, probing, index, k + 1, limit, most), k + 1), "merged")
    discard(entered, probing)
    # a query needs k + 1 ids, as its own may be among them, or all that there are
    short = written(asking.join(best.filter(F.size("ids") >= min(k + 1, known)).select("cid"), "cid", "left_anti"), "short")
    if short.limit(1).count():
        blocks = -(-n // limit)
        dealt = base.select(F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(blocks)).alias("region"), F.lit(0).cast("long").alias("bucket"), "cid", "ids", "vector")
        asked = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("region"), F.lit(None).cast("array<long>").alias("probes"), "cid", "vector")
        whole = written(_merged(_met(dealt, asked, index, k + 1, limit, most), k + 1), "whole")
        best = best.join(short.select("cid"), "cid", "left_anti").unionByName(whole)
    each = F.transform("ids", lambda i, at: F.struct(i.alias("vec_id"), F.get("scores", at).alias("score")))
    found = members.join(best, "cid").select(F.col("vec_id").alias("query_id"), F.slice(F.filter(each, lambda e: e["vec_id"] != F.col("vec_id")), 1, k).alias("found"))
    found = found.select("query_id", F.posexplode("found").alias("at", "e"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def op13_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector of embeddings whose vec_id 20 divides, by inner product, among all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
