"""Connected components of pixels as tables: tiles that are labelled by themselves, what touches across their borders, and rounds
that give each component its least run.

Pixels come as rows (page_id, x, y) of ink. Everything is keyed by page and tile: a task holds some tiles of bounded size, and only what
lies at their borders goes through joins, so neither a large page nor one large component is in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import dropped, settled

#: Bits of x in a run's number, which is y and then x; columns that are searched together for what touches.
X_BITS, STRIP = 24, 64
#: Bits of a tile's side, and bytes of tiles that are labelled at a time.
TILE_BITS, READ = 10, 8_000_000
SIDE = 1 << TILE_BITS

PIECES = "array<struct<y:long,x0:long,x1:long>>"


def _packed(pixels: DataFrame) -> DataFrame:
    """(page_id, ty, tx, cells): pixels by tile, several rows a tile; cells are places in the tile as 32-bit integers."""
    schema = T.StructType([pixels.schema["page_id"], *T.StructType.fromDDL("ty long, tx long, cells binary")])

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        page, x, y = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
        ty, tx, cell = y >> TILE_BITS, x >> TILE_BITS, (y & SIDE - 1) << TILE_BITS | x & SIDE - 1
        order = np.lexsort((cell, tx, ty, page))
        page, ty, tx, cell = page[order], ty[order], tx[order], cell[order]
        tile = np.ones(len(cell), bool)
        tile[1:] = (page[1:] != page[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])
        once = tile.copy()
        once[1:] |= cell[1:] != cell[:-1]
        ends = np.append(np.flatnonzero(tile[once]), once.sum()).astype(np.int32) * 4
        cells = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(cell[once].astype(np.int32))])
        return pa.record_batch([b.column(0).take(pa.array(order[tile])), pa.array(ty[tile]), pa.array(tx[tile]), cells], schema.names)

    there = pixels.select("page_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).dropna()
    return there.mapInArrow(lambda batches: (pack(b) for b in batches if b.num_rows), schema)


def _cells(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The places in all rows of a column of cells, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int32)[ends[0] // 4 : ends[-1] // 4], np.diff(ends) // 4


def _opens(tiles: pa.RecordBatch) -> np.ndarray:
    """Whether a row is the first of its tile."""
    of = [tiles.column(0).dictionary_encode().indices.to_numpy(), tiles.column(1).to_numpy(), tiles.column(2).to_numpy()]
    return np.append(True, np.any([c[1:] != c[:-1] for c in of], axis=0))


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of its component for each of n nodes under edges (a, b): the greater root turns to the less, over and over."""
    to = np.arange(n)
    while True:
        a, b = to[a], to[b]
        a, b = a[a != b], b[a != b]
        if not len(a):
            return to
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(to, far := to[to]):
            to = far


def _tile_parts(tiles: pa.RecordBatch, near: int, whole: bool, names: list[str]) -> pa.RecordBatch:
    """The components within each of some tiles, which are all there."""
    opens = _opens(tiles)
    cell, n = _cells(tiles.column(3))
    at = np.unique(np.repeat(np.cumsum(opens) - 1, n) << 2 * TILE_BITS | cell)  # by tile, row and column
    cut = np.append(True, np.diff(at) != 1) | (at & SIDE - 1 == 0)
    first = np.flatnonzero(cut)
    s, e = at[first], at[np.append(first[1:], len(at)) - 1]
    row = (s >> TILE_BITS) + 1  # the next one
    lo = np.searchsorted(e, np.maximum(s + SIDE - near, row << TILE_BITS))
    hi = np.searchsorted(s, np.minimum(e + SIDE + near, (row << TILE_BITS) + SIDE - 1), "right")
    met = np.where(row & SIDE - 1 == 0, 0, np.maximum(hi - lo, 0))
    a = np.repeat(np.arange(len(s)), met)
    root = _least(len(s), a, np.arange(len(a)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(lo, met))
    order = np.argsort(root, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(root[order]) != 0))
    s, e = s[order], e[order]
    first = np.flatnonzero(opens)[s >> 2 * TILE_BITS]
    ty, tx = tiles.column(1).to_numpy()[first] << TILE_BITS, tiles.column(2).to_numpy()[first] << TILE_BITS
    y, x0, x1 = ty + (s >> TILE_BITS & SIDE - 1), tx + (s & SIDE - 1), tx + (e & SIDE - 1)
    n = x1 - x0 + 1
    edge = np.any([y & SIDE - 1 == 0, y + 1 & SIDE - 1 == 0, x0 & SIDE - 1 == 0, x1 + 1 & SIDE - 1 == 0], axis=0)
    told = np.ones(len(s), bool) if whole else edge
    sums = [np.add.reduceat(v, starts) for v in (n, (x0 + x1) * n // 2, y * n, np.ones_like(n), told)]
    kept = pa.StructArray.from_arrays([pa.array(v[told]) for v in (y, x0, x1)], ["y", "x0", "x1"])
    pieces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sums[4])).astype(np.int32)), kept)
    ends = [y[starts], np.minimum.reduceat(x0, starts), np.maximum.reduceat(x1, starts), np.maximum.reduceat(y, starts)]
    part = (y[starts] << X_BITS) + x0[starts]
    columns = [part, np.logical_or.reduceat(edge, starts), *sums[:4], *ends]
    return pa.record_batch([tiles.column(0).take(pa.array(first[starts])), *map(pa.array, columns), pieces], names)


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come by tile, in batches of some READ bytes that hold all rows of their tiles."""
    held, size = [], 0
    for b in batches:
        step = max(1, b.num_rows * READ // max(1, b.nbytes))
        for piece in (b.slice(i, step) for i in range(0, b.num_rows, step)):
            held.append(piece)
            size += piece.nbytes
            if size < READ:
                continue
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(_opens(both))[-1])
            if last:
                yield both.slice(0, last)
            rest = both.slice(last)
            merged = pa.array([np.unique(_cells(rest.column(3))[0]).tobytes()], pa.binary())
            held = [pa.record_batch([*(rest.column(i).slice(0, 1) for i in range(3)), merged], rest.schema.names)]
            size = 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def parts(pixels: DataFrame, corners: bool = True, whole: bool = False) -> DataFrame:
    """The components within each tile: (page_id, part, edge, area, sx, sy, runs, y, x0, x1, y1, pieces).

    part is the number of its least run, edge tells whether it reaches the tile's border, sx and sy are sums over pixels, runs counts
    pieces of rows; pieces has those at the tile's border, or with whole all. Pixels may repeat.
    """
    stats = "part long, edge boolean, area long, sx long, sy long, runs long, y long, x0 long, x1 long, y1 long, pieces " + PIECES
    schema = T.StructType([pixels.schema["page_id"], *T.StructType.fromDDL(stats)])
    by_tile = _packed(pixels).repartition("page_id", "ty", "tx").sortWithinPartitions("page_id", "ty", "tx")
    return by_tile.mapInArrow(lambda batches: (_tile_parts(t, int(corners), whole, schema.names) for t in _whole_tiles(batches)), schema)


def _across(found: DataFrame, corners: bool) -> tuple[DataFrame, DataFrame]:
    """Of settled parts() at borders: (page_id, part, label), the least run of those that touch others; and (page_id, part, joined),
    how often a piece of the part goes on in the next tile's column."""
    border = settled(found.filter("edge").select("page_id", F.col("part").alias("run"), F.explode("pieces").alias("p")).select("page_id", "run", "p.*"), "border")
    ahead = border.select("page_id", "y", (F.col("x1") + 1).alias("x0"), F.col("run").alias("a")).filter(F.col("x0") % SIDE == 0)
    beside = ahead.join(border.withColumnRenamed("run", "b"), ["page_id", "y", "x0"]).select("page_id", "a", "b")
    edges = settled(beside.union(touching(border, corners)).filter("a <> b").distinct(), "across")
    nodes = edges.select("page_id", F.explode(F.array("a", "b")).alias("run")).distinct()
    joined = settled(beside.groupBy("page_id", F.col("a").alias("part")).agg(F.count("*").alias("joined")), "joined")
    labels = components(nodes, edges).withColumnRenamed("run", "part")
    dropped(border, edges)
    return labels, joined


def touching(found: DataFrame, corners: bool = True) -> DataFrame:
    """(page_id, a, b): runs of neighbouring rows that share a column, or with corners also a corner.

    Runs are entered under every strip of columns that they reach, so a row's runs are not all compared with the next row's.
    """
    near = 1 if corners else 0

    def entered(shift: int) -> DataFrame:
        strips = F.sequence(F.floor((F.col("x0") - shift) / STRIP), F.floor((F.col("x1") + shift) / STRIP))
        return found.select("page_id", "y", "x0", "x1", "run", F.explode(strips).alias("strip"))

    above = entered(0).toDF("page_id", "y", "p0", "p1", "a", "strip").withColumn("y", F.col("y") + 1)
    below = entered(near).withColumnRenamed("run", "b")
    met = above.join(below, ["page_id", "y", "strip"]).filter((F.col("p0") <= F.col("x1") + near) & (F.col("x0") <= F.col("p1") + near))
    return met.select("page_id", "a", "b").distinct()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(page_id, run, label): the least run of each component of nodes(page_id, run) under edges(page_id, a, b).

    A node points to one of its component, at first itself. In each round it, and the one it points to, turn to the least that
    any neighbour's pointer points to; and pointers are followed one step. Their length halves, so rounds are as the
    logarithm of a component's extent. Each round is a table in the shared folder.
    """
    both = settled(edges.union(edges.select("page_id", F.col("b").alias("a"), F.col("a").alias("b"))), "touching")
    now = settled(nodes.select("page_id", "run", F.col("run").alias("to")), "labels")
    for _ in range(rounds):
        ahead = now.join(now.select("page_id", F.col("run").alias("to"), F.col("to").alias("far")), ["page_id", "to"]).select("page_id", "run", "to", "far")
        least = both.join(ahead.select("page_id", F.col("run").alias("b"), "far"), ["page_id", "b"]).groupBy("page_id", F.col("a").alias("run")).agg(F.min("far").alias("least"))
        seen = ahead.join(least, ["page_id", "run"], "left")
        low = F.least("far", F.coalesce("least", "far"))
        turns = F.array(F.struct(F.col("run").alias("run"), low.alias("to")), F.struct(F.col("to").alias("run"), low.alias("to")))
        new = seen.select("page_id", F.explode(turns).alias("t")).groupBy("page_id", F.col("t.run").alias("run")).agg(F.min("t.to").alias("to"))
        last, now = now, settled(new, "labels")
        moved = now.join(last.withColumnRenamed("to", "_was"), ["page_id", "run"]).filter("to <> _was").limit(1).count()
        dropped(last)
        if not moved:
            dropped(both)
            return now.withColumnRenamed("to", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled(pixels: DataFrame, corners: bool = True) -> DataFrame:
    """(page_id, y, x0, x1, run, label): the runs of pixels(page_id, x, y) with the least run of their component."""
    found = settled(parts(pixels, corners, whole=True), "parts")
    labels, _ = _across(found, corners)
    own = found.join(labels, ["page_id", "part"], "left").select("page_id", F.coalesce("label", "part").alias("label"), F.explode("pieces").alias("p")).select("page_id", "label", "p.*")
    ends = (F.col("x0") % SIDE == 0) | (F.col("x1") % SIDE == SIDE - 1)
    w = Window.partitionBy("page_id", "y").orderBy("x0")
    opens = F.when(F.col("x0") == F.lag("x1").over(w) + 1, 0).otherwise(1)  # pieces of a run that tiles cut are put together
    cut = own.filter(ends).withColumn("_o", opens).withColumn("_g", F.sum("_o").over(w))
    cut = cut.groupBy("page_id", "label", "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")
    every = own.filter(~ends).unionByName(cut)
    kind = {"y": pixels.schema["y"].dataType, "x0": pixels.schema["x"].dataType, "x1": pixels.schema["x"].dataType}
    run = (F.shiftleft("y", X_BITS) + F.col("x0")).alias("run")
    return every.select("page_id", *[F.col(c).cast(t).alias(c) for c, t in kind.items()], run, "label")


def blobs_of(pixels: DataFrame, corners: bool = True) -> DataFrame:
    """blobs() of pixels(page_id, x, y), and their number of runs, without a table of runs: only components at borders of tiles are grouped."""
    found = settled(parts(pixels, corners), "parts")
    labels, joined = _across(found, corners)
    at_edge = found.filter("edge").join(labels, ["page_id", "part"], "left").join(joined, ["page_id", "part"], "left").withColumn("label", F.coalesce("label", "part"))
    least, most, total = ("y", "x0"), ("x1", "y1"), ("area", "sx", "sy")
    grouped = at_edge.groupBy("page_id", "label").agg(
        *[F.sum(c).alias(c) for c in total], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most],
        F.sum(F.col("runs") - F.coalesce("joined", F.lit(0))).alias("runs"),
    )
    every = found.filter("not edge").select("page_id", F.col("part").alias("label"), *total, *least, *most, "runs").unionByName(grouped)
    x, y = pixels.schema["x"].dataType, pixels.schema["y"].dataType
    return every.select(
        "page_id", "label", "area", F.col("x0").cast(x).alias("x"), F.col("y").cast(y).alias("y"), (F.col("x1") - F.col("x0") + 1).cast(x).alias("w"), (F.col("y1") - F.col("y") + 1).cast(y).alias("h"),
        (F.col("sx") / F.col("area")).alias("mean_x"), (F.col("sy") / F.col("area")).alias("mean_y"), "runs",
    )


def blobs(found: DataFrame) -> DataFrame:
    """(page_id, label, area, x, y, w, h, mean_x, mean_y) of each component of labelled()."""
    n = F.col("x1") - F.col("x0") + 1
    out = found.groupBy("page_id", "label").agg(
        F.sum(n).cast("long").alias("area"), F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("_x1"), F.max("y").alias("_y1"),
        F.sum((F.col("x0") + F.col("x1")) * n / 2).alias("_sx"), F.sum(F.col("y") * n).alias("_sy"),
    )
    return out.select("page_id", "label", "area", "x", "y", (F.col("_x1") - F.col("x") + 1).alias("w"), (F.col("_y1") - F.col("y") + 1).alias("h"), (F.col("_sx") / F.col("area")).alias("mean_x"), (F.col("_sy") / F.col("area")).alias("mean_y"))
