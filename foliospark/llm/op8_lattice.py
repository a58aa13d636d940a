"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions by several random matrices and each image is decoded to the
nearest point of the lattice E8 (the better of D8 and D8 shifted by one half). A vector is entered under its own
lattice point and under the next nearest ones, in every table. Vectors of one label that share a point are
compared by cosine in double precision. A pair that shares several points counts at the least of them.

Vectors do not travel to every point they are entered under. First only (point, id, code) do, a code being the unit vector in four
bits a component with the length of what that leaves out. Two codes bound the cosine of their vectors from above, so at a
point stay those that have another that may be near, and no near pair is lost at any point that it shares. Only these are joined
to their vectors and compared.

Equal vectors of one label are one class, whatever their number; only classes meet at lattice points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocked, grouped, pairs_meet, roots
from .bytesets import mixed
from .common import components, discard, slices, written

TABLES, PROBES, WIDTH, SEED = 8, 4, 1.2, 17


def projections(dim: int, tables: int = TABLES) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((tables, dim, 8))


def lattice_points(y: np.ndarray, probes: int) -> np.ndarray:
    """The probes nearest lattice points found for each row of y(n, 8), nearest first, in half units: (n, probes, 8).

    For both cosets of D8: the decoded point, and those with two of the three least certain coordinates moved to
    their second choice.
    """
    found = []
    rows = np.arange(len(y))
    for shift in (0.0, 0.5):
        z = y - shift
        f = np.rint(z)
        away = np.where(z >= f, 1.0, -1.0)
        order = np.argsort(-np.abs(z - f), axis=1)
        odd = f.sum(1) % 2 != 0
        f[rows[odd], order[odd, 0]] += away[odd, order[odd, 0]]
        found.append(f + shift)
        # second choices: the coordinate already moved goes back to its first
        back = away.copy()
        back[rows[odd], order[odd, 0]] *= -1
        for a, b in ((0, 1), (0, 2), (1, 2)):
            g = f.copy()
            g[rows, order[:, a]] += back[rows, order[:, a]]
            g[rows, order[:, b]] += back[rows, order[:, b]]
            found.append(g + shift)
    points = np.stack(found, axis=1)
    far = ((points - y[:, None, :]) ** 2).sum(2)
    nearest = np.argsort(far, axis=1, kind="stable")[:, :probes]
    return np.rint(2 * np.take_along_axis(points, nearest[:, :, None], axis=1)).astype(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> np.ndarray:
    """The keys (n, tables * probes) of the lattice points of unit vectors."""
    out = []
    for t, r in enumerate(projections(unit.shape[1], tables)):
        p = lattice_points(unit @ r / width, probes).astype(np.uint64)
        h = np.full(p.shape[:2], (t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for k in range(8):
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + p[:, :, k])
        out.append(h)
    return np.hstack(out).view(np.int64)


def coded(unit: np.ndarray) -> list[bytes]:
    """Unit vectors in four bits a component: the scale, the length of the rest, and two components a byte."""
    scale = np.abs(unit).max(1) / 7
    q = np.rint(unit / scale[:, None])
    rest = np.sqrt(((unit - scale[:, None] * q) ** 2).sum(1))
    nibbles = (q + 8).astype(np.uint8)
    if nibbles.shape[1] % 2:
        nibbles = np.hstack([nibbles, np.full((len(nibbles), 1), 8, np.uint8)])
    packed = nibbles[:, ::2] << 4 | nibbles[:, 1::2]
    head = np.stack([scale, rest], axis=1).astype("<f8").view(np.uint8)
    return [r.tobytes() for r in np.hstack([head, packed])]


def decoded(codes: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """What codes keep of their vectors, padded with zeros to one length, and the lengths of the rest."""
    size = pa.compute.binary_length(codes).to_numpy()
    v, rest = np.zeros((len(codes), 2 * (int(size.max(initial=16)) - 16)), np.float32), np.zeros(len(codes))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        data = np.frombuffer(b"".join(codes.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), n)
        scale, rest[at] = data[:, :16].copy().view("<f8").T
        q = np.stack([data[:, 16:] >> 4, data[:, 16:] & 15], axis=2).reshape(len(at), -1).astype(np.float32) - 8
        v[at, : q.shape[1]] = q * scale[:, None].astype(np.float32)
    return v, rest


def may_be_near(v: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """For each two of decoded() whether the cosine of their vectors can be threshold; false only if it cannot."""
    # x y = x' y' + (x - x') y + x' (y - y'), and the last two are no longer than rest and (1 + rest) times rest
    slack = (v.shape[1] + 4) * 2**-23 * (1 + rest.max(initial=0)) ** 2  # what single precision may be off by
    return v @ v.T + rest[:, None] + (1 + rest[:, None]) * rest[None, :] >= threshold - slack


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of a binary column, in the precision that their table has, scaled to length 1 in double precision."""
    data = column.to_pylist()
    x = np.stack([np.frombuffer(d, "<f8" if d[:1] == b"d" else "<f4", offset=1).astype("<f8") for d in data])
    x /= np.abs(x).max(1, keepdims=True)  # keeps squares of very large or small numbers finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def alive(threshold: float):
    """A function for grouped(): the classes of a lattice point that have another there that may be near."""

    def some(group: dict, bi: int, bj: int, own: np.ndarray) -> dict[str, np.ndarray] | None:
        near = may_be_near(group["v"], group["rest"], threshold)
        np.fill_diagonal(near, False)
        if (meet := pairs_meet(own, bi, bj)) is not None:
            near &= meet
        if not (rows := near.any(1)).any():
            return None
        return {"home": group["at"].to_numpy()[rows], "rep": group["rep"].to_numpy()[rows], "key": group["key"].to_numpy()[rows]}

    return some


def opened(table: pa.Table) -> dict[str, np.ndarray]:
    """For grouped(): the codes of many groups at once."""
    v, rest = decoded(table["code"])
    return {"v": v, "rest": rest}


def entered_as(tables: int, probes: int, width: float):
    """A function for grouped(): unit vectors and lattice points of the rows of many groups at once."""

    def prepare(table: pa.Table) -> dict[str, np.ndarray]:
        data = table["vector"]
        length = pa.compute.binary_length(data).to_numpy()
        units, keys = np.empty(len(data), object), np.zeros((len(data), tables * probes), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            x = unit_rows(data.take(pa.array(at)))
            keys[at] = cells(x, tables, probes, width)
            for i, row in zip(at.tolist(), x):
                units[i] = row
        return {"unit": units, "points": keys}

    return prepare


def link_cells(threshold: float):
    """A function for grouped(): for each class of a lattice point its new links and the least class they reach."""

    def links(group: dict, bi: int, bj: int, own: np.ndarray) -> dict[str, np.ndarray] | None:
        unit = np.stack(group["unit"])
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, False)
        if (meet := pairs_meet(own, bi, bj)) is not None:
            near &= meet
        some = np.flatnonzero(near.any(1))
        if not len(some):
            return None
        near, rep, n, keys = near[np.ix_(some, some)], group["rep"].to_numpy()[some], group["n"].to_numpy()[some], group["points"][some]
        here = group["key"][0].as_py()
        lesser, inverse = np.unique(keys, return_inverse=True)
        met = np.zeros((len(rep), len(lesser)), np.float32)
        met[np.arange(len(rep))[:, None], inverse.reshape(keys.shape)] = 1
        met = met[:, (lesser < here) & (met.sum(0) > 1)]  # a pair counts here unless it meets at a lesser key
        count = (near & ~(met @ met.T > 0)) @ n
        return {"rep": rep, "links": count, "root": roots(near, rep)}

    return links


def embedding_links(rows: DataFrame, threshold: float = 0.93, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, limit: int = 512) -> DataFrame:
    """vec_id, n_links and component_id of every row of rows(vec_id, label, embedding).

    Only rows of equal label, not null, are compared, and of equal length. A vector that is null, empty, zero or
    holds a null or a non-finite component, or has no vec_id, links with nothing and is its own component.
    Repeated rows are vectors of their own. vec_id should be a key; of rows that share one, links add up. A
    lattice point with over limit classes is compared in blocks. An empty table gives no row.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True))
    some = F.exists("v", lambda x: x != 0)
    base = rows.select("vec_id", "label", vector.alias("v")).withColumn("ok", good & F.coalesce(some, F.lit(False)))
    single = dict(rows.dtypes)["embedding"] == "array<float>"
    classes = written(base.filter("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            v = b["v"].to_pylist()
            for dim in sorted({len(x) for x in v}):
                at = [i for i, x in enumerate(v) if len(x) == dim]
                data = [(b"f" + np.array(v[i], "<f4").tobytes()) if single else (b"d" + np.array(v[i], "<f8").tobytes()) for i in at]
                x = unit_rows(pa.array(data, pa.binary()))
                keys = cells(x, tables, probes, width)
                pick = pa.array(at)
                columns = [b["label"].take(pick), pa.array(np.full(len(at), dim, np.int32)), b["rep"].take(pick), b["n"].take(pick)]
                columns += [pa.array(list(keys), pa.list_(pa.int64())), pa.array(coded(x), pa.binary()), pa.array(data, pa.binary())]
                yield pa.record_batch(columns, ["label", "dim", "rep", "n", "keys", "code", "vector"])

    kind = dict(rows.dtypes)["label"]
    entered = written(classes.mapInArrow(enter, f"label {kind}, dim int, rep long, n long, keys array<long>, code binary, vector binary"), "entered")
    points = entered.select(F.explode("keys").alias("key"), "label", "dim", "rep", "code").withColumn("home", F.xxhash64("key", "label", "dim"))
    dealt = blocked(points.select("home", F.col("home").alias("at"), "key", "rep", "code"), "home", "rep", 2 * limit, points.select("home"))
    close = grouped(dealt, "home", ["at", "key", "rep", "code"], "home long, rep long, key long", alive(threshold), opened)
    close = written(close.distinct(), "close")
    at_points = close.groupBy("rep").agg(F.collect_list(F.struct("home", "key")).alias("points"))  # tables * probes at most
    sent = entered.select("rep", "n", "vector").join(at_points, "rep").select(F.explode("points").alias("p"), "rep", "n", "vector").select("p.home", "p.key", "rep", "n", "vector")
    dealt = blocked(sent, "home", "rep", limit, close.select("home"))
    found = written(grouped(dealt, "home", ["key", "rep", "n", "vector"], "rep long, links long, root long", link_cells(threshold), entered_as(tables, probes, width)), "cosine")
    discard(entered, close)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    known = classes.join(counts, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    known = known.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = base.filter("ok").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone)


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return made.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = r"""
with recursive v as (
  select vec_id, label, embedding::double[] e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
n as (select *, sqrt(list_inner_product(e, e)) n from v),
p as (select a.vec_id u, b.vec_id w from n a join n b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r as (select vec_id, vec_id root from v union select p.w, r.root from r join p on p.u = r.vec_id),
c as (select vec_id, min(root) component_id from r group by vec_id),
k as (select u, count(*) n from p group by u)
select e.vec_id, coalesce(k.n, 0)::bigint n_links, coalesce(c.component_id, e.vec_id) component_id, coalesce(e.vec_id = coalesce(c.component_id, e.vec_id), false) kept
from embeddings e left join c on c.vec_id = e.vec_id left join k on k.u = e.vec_id
"""
