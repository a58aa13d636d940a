"""Centroid clustering: Lloyd rounds over two trees.

Vectors are dealt to blocks as they are read, and each block gets a cover tree, built once and kept as a row of a table in
the shared folder. A node's children are centred on points of it that are further apart than the radius that they cover.
Each round builds such a tree over the centroids as well and walks both at once, from the pair of the roots: a pair of nodes
is dropped when even the nearest that its vectors and centroids can be is further than some centroid surely is from
every vector of that node; a node with one centroid left is assigned as a whole; what is left of two leaves is compared
exactly. Components are integers and squared distances exact, so pruning changes no result and ties are true ties.

Rounds send the centroids to the tasks and get sums per centroid back: k times dim numbers, whatever the rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, slices, written

#: Vectors of a block, points of a leaf, and by how much a child's radius is less than its parent's.
BLOCK, LEAF, BASE = 2048, 8, 1.3
#: Bounds are widened by this share, far over the rounding of a square root.
SLACK = 1e-9


@dataclass
class CoverTree:
    """Nodes in breadth-first order, the children of one side by side; points in an order in which each node is a range."""

    points: np.ndarray  # (n, dim) integers
    order: np.ndarray  # where each point was
    centre: np.ndarray  # of a node: a point of it
    radius: np.ndarray  # the furthest of its points from its centre
    start: np.ndarray
    size: np.ndarray
    child: np.ndarray  # its first child
    children: np.ndarray  # none: a leaf

    def packed(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)}, **more)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> tuple[CoverTree, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            found = {k: z[k] for k in z.files}
        own = {f.name: found.pop(f.name) for f in fields(cls)}
        return cls(**own), found


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, one by one."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """The tree over the rows of points(n, dim), n at least 1. Equal points are one leaf, whatever their number."""
    x = points.astype(np.int64)
    # products below 2**53 are exact in double precision too, where numpy multiplies matrices fast
    small = 4 * x.shape[1] * float(np.abs(x).max(initial=0)) ** 2 < 2**53
    f = x.astype(float) if small else x
    norm = np.einsum("ij,ij->i", f, f) if small else None

    def far(at: np.ndarray, q: int) -> np.ndarray:
        if small:
            return np.sqrt(norm[at] + norm[q] - 2 * (f[at] @ f[q]))
        return np.sqrt(squared(x[at], x[q]).astype(float))

    # breadth first: each entry is a node's points and their distances to its centre
    nodes = [(np.arange(len(x)), 0, far(np.arange(len(x)), 0))]
    centre, radius, child, children, held = [], [], [], [], []
    done = 0
    while done < len(nodes):
        at, c, d = nodes[done]
        r = float(d.max())
        centre.append(c), radius.append(r), child.append(len(nodes)), children.append(0), held.append(at)
        if len(at) > leaf and r > 0:
            reach = r / BASE
            near = d <= reach
            nodes.append((at[near], c, d[near]))
            at, d = at[~near], d[~near]
            while len(at):
                q = int(at[np.argmax(d)])
                e = far(at, q)
                near = e <= reach
                nodes.append((at[near], q, e[near]))
                at, d = at[~near], d[~near]
            children[done] = len(nodes) - child[done]
        nodes[done] = (nodes[done][0][:0], c, d[:0])
        done += 1
    size = np.array([len(h) for h in held])
    child, children = np.array(child), np.array(children)
    start = np.zeros(len(size), np.int64)
    order = np.empty(len(x), np.int64)
    for i in range(len(size)):  # a parent comes before its children
        if children[i]:
            kids = slice(child[i], child[i] + children[i])
            start[kids] = start[i] + np.concatenate([[0], np.cumsum(size[kids])[:-1]])
        else:
            order[start[i] : start[i] + size[i]] = held[i]
    return CoverTree(x[order], order, x[np.array(centre)], np.array(radius), start, size, child, children)


def _fan(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand for count numbers from first on: the row of each number, and the numbers."""
    row = np.repeat(np.arange(len(first)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def nearest(tree: CoverTree, centroids: CoverTree) -> tuple[np.ndarray, int]:
    """For each of tree's points the nearest centroid (its number before the tree; ties: the least), and the number of
    distances of a point to a centroid that were taken for it."""
    n, top = len(tree.points), np.iinfo(np.int64).max
    label, least = np.full(n, top), np.full(n, top)
    best = np.full(len(tree.size), np.inf)  # some centroid is at most this far from every vector of the node
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(v):
        d = np.sqrt(squared(tree.centre[v], centroids.centre[c]).astype(float))
        np.minimum.at(best, v, (d + tree.radius[v]) * (1 + SLACK))  # the centre of a node of centroids is a centroid
        keep = d * (1 - SLACK) - (tree.radius[v] + centroids.radius[c]) * (1 + SLACK) <= best[v]
        v, c = v[keep], c[keep]
        alone = (np.bincount(v, minlength=len(best))[v] == 1) & (centroids.size[c] == 1)
        row, at = _fan(tree.start[v[alone]], tree.size[v[alone]])
        label[at] = centroids.order[centroids.start[c[alone]]][row]
        v, c = v[~alone], c[~alone]
        leaf = tree.children[v] == 0
        grow = (centroids.children[c] > 0) & (leaf | (centroids.radius[c] >= tree.radius[v]))
        waits = np.zeros(len(best), bool)  # its centroids are told apart first
        waits[v[grow]] = True
        row, kids = _fan(centroids.child[c[grow]], centroids.children[c[grow]])
        new = [(v[grow][row], kids), (v[waits[v] & ~grow], c[waits[v] & ~grow])]
        rest = ~waits[v]
        leaves.append((v[rest & leaf], c[rest & leaf]))
        pv, pc = v[rest & ~leaf], c[rest & ~leaf]
        row, kids = _fan(tree.child[pv], tree.children[pv])
        best[kids] = best[pv][row]
        new.append((kids, pc[row]))
        v, c = (np.concatenate(x) for x in zip(*new))
    lv, lc = (np.concatenate(x) for x in zip(*leaves)) if leaves else (v, c)
    row, at = _fan(tree.start[lv], tree.size[lv])
    pair, of = _fan(centroids.start[lc[row]], centroids.size[lc[row]])
    at = at[pair]
    for s in range(0, len(at), 1 << 15):
        p, q = at[s : s + (1 << 15)], of[s : s + (1 << 15)]
        d, number = squared(tree.points[p], centroids.points[q]), centroids.order[q]
        before = least[p]
        np.minimum.at(least, p, d)
        label[p[least[p] < before]] = top  # what was found so far is further
        same = d == least[p]
        np.minimum.at(label, p[same], number[same])
    return label, len(at)


def _trees(vectors: DataFrame, block: int) -> DataFrame:
    """vectors(vec_id, x array<long>) as rows of one tree each; vec_ids go along in the tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            x = table["x"].combine_chunks()
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
            tree = cover_tree(x)
            ids = table["vec_id"].combine_chunks()
            none, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            tree.points = tree.points.astype(np.int32)
            return pa.record_batch([pa.array([tree.packed(vec_id=value[tree.order], none=none[tree.order])], pa.binary())], ["tree"])

        for b in slices(batches, block):
            held.append(b)
            while (n := sum(len(h) for h in held)) >= block:
                last, over = held[-1], n - block
                held[-1] = last.slice(0, len(last) - over)
                yield settle()
                held = [last.slice(len(last) - over)] if over else []
        if held:
            yield settle()
        release()

    return vectors.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, "tree binary")


def _each_tree(trees: DataFrame, centroids: list[list[int]], function, schema: str) -> DataFrame:
    """function(tree, ids, labels) of each block under these centroids; its columns are the result."""
    names, points = [c.split()[0] for c in schema.split(", ")], np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = cover_tree(points, 1)
        for b in batches:
            for data in b["tree"]:
                tree, more = CoverTree.unpacked(data.as_py())
                yield pa.record_batch(function(tree, more, nearest(tree, over)[0]), names)
        release()

    return trees.mapInArrow(run, schema)


def _sums(tree: CoverTree, more: dict, label: np.ndarray) -> list[pa.Array]:
    order = np.argsort(label, kind="stable")
    found, at, n = np.unique(label[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(tree.points[order].astype(np.int64), at)
    return [pa.array(found.astype(np.int32)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))]


def bound_of(dim: int) -> int:
    """The largest integer a component may be, so that a squared distance fits a long."""
    return 1 << ((62 - (dim - 1).bit_length()) // 2 - 1)


def integer_vectors(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, x): rows(vec_id, embedding) of exactly dim components, none null or not finite, as integers."""
    e, most = F.col("embedding"), bound_of(dim)
    good = (F.size(e) == dim) & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def whole(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(most))), F.lit(float(most))))

    return rows.filter(F.coalesce(good, F.lit(False))).select("vec_id", F.transform(e, whole).alias("x"))


def dual_tree_lloyd(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each of rows(vec_id, embedding) that is kept.

    Kept are vectors of exactly dim components, none null or not finite. Components become floor(scale * x); those beyond
    bound_of(dim) (2**27 for 64) are held there, so that squared distances are exact longs. The k kept rows whose
    seed:vec_id has the smallest SHA-256 (a null id is the empty text; of equal ids the smaller vector) are the first
    centroids, in that order; if fewer are kept, there are fewer. Each round assigns every vector to its nearest
    centroid (ties: the smaller number) and moves every centroid that has any to the floor of their mean. Repeated rows
    are vectors of their own, other columns are not looked at, an empty table gives no row. An inertia that does
    not fit a long is null.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, dim, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    now = [list(r["x"]) for r in vectors.orderBy(name, "x").limit(k).select("x").collect()]  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not now:
        return spark.createDataFrame([], schema)
    trees = written(_trees(vectors, block), "trees")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(dim)]
    for _ in range(rounds):
        sums = _each_tree(trees, now, _sums, "cluster int, n long, sums array<long>")
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*total).alias("sums")).collect():  # k rows
            now[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    last = np.array(now, np.int64)

    def final(tree: CoverTree, more: dict, label: np.ndarray) -> list[pa.Array]:
        return [pa.array(more["vec_id"], mask=more["none"]), pa.array(label.astype(np.int32)), pa.array(squared(tree.points, last[label]))]

    assigned = written(_each_tree(trees, now, final, "vec_id long, cluster int, distance long"), "assigned")
    discard(trees)
    each = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows

    def fit(v: int) -> int | None:
        return v if v < 1 << 63 else None

    known = [(c, fit(s), fit(sum(each.values())), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for c, s in sorted(each.items())]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_dualtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector of embeddings with its cluster after three rounds over 16 centroids."""
    return dual_tree_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    near = """select vec_id, rid, x, arg_min(c, (d, c)) c, min(d) d from (
    select v.vec_id, v.rid, v.x, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d from v cross join c{i} k) q group by vec_id, rid, x"""
    steps = [f"""v as (select vec_id, row_number() over () rid, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) x from embeddings
  where len(embedding) = 64 and list_count(embedding) = 64 and len(list_filter(embedding, lambda e: not isfinite(e))) = 0),
c0 as materialized (select (row_number() over (order by h, x) - 1)::int c, x from (select sha256('1:' || coalesce(vec_id::varchar, '')) h, x from v order by h, x limit {k}) q)"""]  # fmt: skip
    for i in range(rounds):
        steps.append(f"a{i} as materialized ({near.format(i=i)})")
        steps.append(f"""c{i + 1} as materialized (select k.c, coalesce(m.x, k.x) x from c{i} k left join (
  select c, list(m order by i) x from (select c, i, ((s - ((s % n) + n) % n) // n)::bigint m from (select c, i, sum(e)::bigint s, count(*) n from (select c, unnest(x) e, generate_subscripts(x, 1) i from a{i}) u group by c, i) s) t group by c) m on m.c = k.c)""")
    steps.append(f"z as materialized ({near.format(i=rounds)})")
    return f"""with {", ".join(steps)}
select z.vec_id, z.c::int cluster, z.d distance, (sum(z.d) over (partition by z.c))::bigint cluster_inertia, (sum(z.d) over ())::bigint inertia,
  sha256(array_to_string(k.x, ',')) centroid_sha256 from z join c{rounds} k on k.c = z.c"""


SQL = _sql()
