"""Comparing the rows of a bucket with each other, in blocks of bounded size, without emitting pairs.

blocked() deals rows to groups: a bucket of at most `limit` rows is one group. A larger one is cut into blocks
by a hash, and each two of its blocks meet in a group of their own, so every pair of rows still meets exactly
once. grouped() then hands each group to a function as arrays, group after group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def blocked(rows: DataFrame, key: str, id_column: str, limit: int, keys: DataFrame | None = None, weight: str | None = None, heaviest: int = 0) -> DataFrame:
    """rows with _bi, _bj (the group's blocks) and _b (the row's own block). keys: a cheaper table with the same keys.

    weight: a column whose sum in a group is to be at most about heaviest; one row may weigh more.
    """
    load = F.greatest(F.count("*") / limit, F.sum(weight) / heaviest) if weight else F.count("*") / limit
    counts = (keys if keys is not None else rows).groupBy(key).agg(load.alias("_n")).filter(F.col("_n") > 1)
    counts = written(counts, "hot")  # few rows: the planner sees its size and broadcasts it, or not
    n = F.coalesce(F.ceil(2 * F.col("_n")), F.lit(1)).cast("int")
    dealt = rows.join(counts, key, "left").withColumn("_k", n).withColumn("_b", F.pmod(F.xxhash64(F.lit(5), id_column), F.col("_k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.struct(F.least("_b", j).alias("i"), F.greatest("_b", j).alias("j")))
    return dealt.withColumn("_p", F.explode(pairs)).withColumn("_bi", F.col("_p.i")).withColumn("_bj", F.col("_p.j")).drop("_n", "_k", "_p")


def pairs_meet(own: np.ndarray, bi: int, bj: int) -> np.ndarray | None:
    """Which pairs of a group's rows meet here; None if all do."""
    return None if bi == bj else own[:, None] != own[None, :]


def grouped(rows: DataFrame, key: str, columns: list[str], schema: str, function: Callable[[dict[str, np.ndarray], int, int, np.ndarray], dict[str, np.ndarray] | None], prepare: Callable[[pa.Table], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """function(columns of the group, bi, bj, own blocks) for each group of two rows or more; its columns are the result.

    Groups of a partition stream through in sorted order; one group is held at a time, besides a batch. prepare makes
    further columns from the rows of many groups at once.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    parts = rows.select(key, "_bi", "_bj", "_b", *columns).repartition(key, "_bi", "_bj").sortWithinPartitions(key, "_bi", "_bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            k, bi, bj, own = (table[i].to_numpy() for i in range(4))
            edge = np.flatnonzero((k[1:] != k[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            first = np.concatenate([[0], edge])
            last = np.concatenate([edge, [len(k)]])
            many = np.flatnonzero(last - first > 1)
            out: list[dict[str, np.ndarray]] = []
            more = prepare(table) if prepare and len(many) else {}
            for s, e in zip(first[many].tolist(), last[many].tolist()):
                part = table.slice(s, e - s)
                values = {c: part[c] for c in columns} | {c: v[s:e] for c, v in more.items()}
                if (got := function(values, int(bi[s]), int(bj[s]), own[s:e])) is not None:
                    out.append(got)
            if out:
                yield pa.record_batch([pa.array(np.concatenate([o[c] for o in out])) for c in names], names)

        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not len(table):
                continue
            k, bi, bj = (table[i].to_numpy() for i in range(3))
            inner = np.flatnonzero((k != k[-1]) | (bi != bi[-1]) | (bj != bj[-1]))
            cut = int(inner[-1]) + 1 if len(inner) else 0
            if cut:
                yield from settle(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield from settle(rest)
        release()

    return parts.mapInArrow(run, schema)


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id that links of this group reach."""
    label = ids.copy()
    linked = linked | np.eye(len(ids), dtype=bool)
    top = np.iinfo(ids.dtype).max
    while True:
        new = np.where(linked, label[None, :], top).min(1)
        if (new == label).all():
            return label
        label = new
