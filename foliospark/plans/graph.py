"""Graphs of stages as tables: order, keys, cycles and closures in rounds of joins.

nodes(node, own): a stage and what its own key depends on. edges(src, dst): dst depends on src. Node names are texts. A graph may have
any number of nodes and edges; the number of rounds is the length of its longest chain. Each round takes off the edges of the nodes that
the last one finished and writes the nodes and edges that are left as tables in the shared folder, so later rounds read ever less; sums
are taken before the shuffle, so neither a node with many dependents nor one with many dependencies is gathered anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, settled

#: A dependency's share in its dependent's key: that many numbers of fifteen hexadecimal digits, which are summed.
PIECES, DIGITS = 4, 15


def _share(node: Column, key: Column) -> list[Column]:
    h = F.sha2(F.concat_ws(":", node, key), 256)
    return [F.conv(F.substring(h, 1 + i * DIGITS, DIGITS), 16, 10).cast("decimal(38,0)") for i in range(PIECES)]


def _sums() -> list[str]:
    return [f"s{i}" for i in range(PIECES)]


def _key() -> Column:
    """Of a node, from its name, its own part, and the number and sums of its dependencies' shares: their order is of no account."""
    return F.sha2(F.concat_ws("|", "node", F.coalesce("own", F.lit("")), "deps", *_sums()), 256)


def unknown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): dependencies on stages that there are not."""
    return edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("src")), "src", "left_anti")


def peeled(nodes: DataFrame, edges: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """((node, level, key) of every stage that can run, (node) of those that cannot).

    level: the length of the longest chain of dependencies before it, so an order by level is topological. key: changes with the
    stage's own part and with any key before it. A stage cannot run if it is on a cycle, depends on one that is, or on one
    that is unknown. A stage named twice is an error; repeated edges count once; an empty graph gives empty tables.
    """
    if twice := nodes.groupBy("node").count().filter("count > 1").limit(5).collect():
        raise ValueError(f"two stages share a name: {', '.join(str(r['node']) for r in twice)}")
    edges = settled(edges.select("src", "dst").distinct(), "edges")
    waits = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("deps"))
    zero = [F.lit(0).cast("decimal(38,0)").alias(s) for s in _sums()]
    state = nodes.select("node", "own").join(waits, "node", "left").select("node", "own", F.coalesce("deps", F.lit(0)).alias("deps"), F.coalesce("deps", F.lit(0)).alias("waits"), *zero)
    done, used, last, level = [], [], None, 0
    while True:
        state = settled(state.withColumn("key", F.when(F.col("waits") == 0, _key())), "stages", "waits = 0")
        dropped(*used)
        if last is not None:
            dropped(last)
        used = []
        ready, last = state.filter("part"), state.filter("not part")
        last._shared_path = f"{state._shared_path}/part=false"
        if not ready.limit(1).count():
            break
        if level > most:
            raise RuntimeError(f"chains of over {most} stages")
        done.append(ready.select("node", F.lit(level).alias("level"), "key"))
        shares = ready.select("node", *[s.alias(c) for s, c in zip(_share(F.col("node"), F.col("key")), _sums())])  # once for a node
        sent = edges.join(shares, F.col("node") == F.col("src")).select("dst", *_sums())
        used.append(edges)
        edges = settled(edges.join(ready.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"), "edges")
        sent = sent.groupBy("dst").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"_{c}") for c in _sums()])
        left = last.join(sent, F.col("node") == F.col("dst"), "left")
        more = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast("decimal(38,0)").alias(c) for c in _sums()]
        state = left.select("node", "own", "deps", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), *more)
        level += 1
    dropped(edges)
    order = reduce(DataFrame.unionByName, done) if done else state.select("node", F.lit(0).alias("level"), "key")
    return order, last.select("node")


def cyclic(stuck: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): of the stages that cannot run those that are on a cycle, or between two.

    Stages on which no other of them depends, and those that wait for none of them, are taken off until none is left.
    """
    node = settled(stuck.select("node").distinct(), "stuck")
    while True:
        here, there = node.select(F.col("node").alias("src")), node.select(F.col("node").alias("dst"))
        inner = edges.select("src", "dst").distinct().join(here, "src").join(there, "dst")
        both = inner.select(F.col("src").alias("node")).distinct().join(inner.select(F.col("dst").alias("node")).distinct(), "node")
        last, node = node, settled(both, "stuck")
        same = last.count() == node.count()
        dropped(last)
        if same:
            return node


def reached(edges: DataFrame, starts: DataFrame, back: bool = False) -> DataFrame:
    """(node): starts(node) and all that depend on them, or with back all that they depend on."""
    a, b = ("dst", "src") if back else ("src", "dst")
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    seen = [settled(starts.select("node").distinct(), "reached")]
    while True:
        met = seen[-1].join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = settled(met.join(reduce(DataFrame.union, seen), "node", "left_anti"), "reached")
        if not new.limit(1).count():
            dropped(new)
            return reduce(DataFrame.union, seen)
        seen.append(new)


def selected(nodes: DataFrame, edges: DataFrame, start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """(node): the stages from start on, up to end, or between them; both are tables of nodes."""
    chosen = nodes.select("node")
    if start is not None:
        chosen = chosen.join(reached(edges, start), "node", "left_semi")
    if end is not None:
        chosen = chosen.join(reached(edges, end, back=True), "node", "left_semi")
    return chosen


def stale(order: DataFrame, stored: DataFrame) -> DataFrame:
    """(node, level): the stages of order(node, level, key) whose key is not the one of stored(node, key): these are to run."""
    had = stored.select("node", F.col("key").alias("_had"))
    return order.join(had, "node", "left").filter("_had is null or _had <> key").select("node", "level")
