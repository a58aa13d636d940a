"""Graphs of stages against a walk in plain Python."""

import random

import pytest

from foliospark.plans import dag, graph

NODES, EDGES = "node string, own string", "src string, dst string"


def walk(nodes, edges):
    """Levels of what can run, by taking off what waits for nothing."""
    level, left = {}, set(nodes)
    while ready := {n for n in left if all(s in level for s, d in edges if d == n)}:
        now = {n: 1 + max((level[s] for s, d in edges if d == n), default=-1) for n in ready}
        level |= now
        left -= ready
    return level, left


def on_or_between(left, edges):
    inner = {(s, d) for s, d in edges if s in left and d in left}

    def reach(n, pairs):
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            for s, d in pairs:
                if s == x and d not in seen:
                    seen.add(d)
                    todo.append(d)
        return seen

    loops = {n for n in left if n in reach(n, inner)}
    return {n for n in left if n in loops or (reach(n, inner) & loops and reach(n, {(d, s) for s, d in inner}) & loops)}


@pytest.mark.parametrize("seed", range(3))
def test_peeling_cycles_and_reach(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(25)]
    edges = [(f"s{a}", f"s{b}") for a, b in (rng.sample(range(25), 2) for _ in range(30)) if a < b or rng.random() < 0.15 * seed] + [("nowhere", "s3")] * 2 + ([("s9", "s9")] if seed else [])
    nodes, table = spark.createDataFrame([(n, n if i % 4 else None) for i, n in enumerate(names)], NODES), spark.createDataFrame(edges, EDGES)
    order, stuck = graph.peeled(nodes, table)
    level, left = walk(names, edges)
    assert {r["node"]: r["level"] for r in order.collect()} == level and {r["node"] for r in stuck.collect()} == left
    assert {r["node"] for r in graph.cyclic(stuck, table).collect()} == on_or_between(left, edges)
    assert [tuple(r) for r in graph.unknown(nodes, table).collect()] == [("nowhere", "s3")]
    ahead = {"s0", "s1"}
    while more := {d for s, d in edges if s in ahead} - ahead:
        ahead |= more
    starts = spark.createDataFrame([("s0",), ("s1",), ("s1",)], "node string")
    assert sorted(r["node"] for r in graph.reached(table, starts).collect()) == sorted(ahead)
    behind = {"s20"}
    while more := {s for s, d in edges if d in behind} - behind:
        behind |= more
    end = spark.createDataFrame([("s20",)], "node string")
    assert {r["node"] for r in graph.selected(nodes, table, starts, end).collect()} == ahead & behind


def test_keys_follow_what_comes_before(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("a", "c")]
    own = {"a": "1", "b": "1", "c": "1", "x": "1", "y": None}

    def keys(own, edges):
        order, _ = graph.peeled(spark.createDataFrame(list(own.items()), NODES), spark.createDataFrame(edges, EDGES))
        return {r["node"]: r["key"] for r in order.collect()}, order

    first, order = keys(own, edges)
    assert len(set(first.values())) == 5 and keys(dict(reversed(own.items())), edges[::-1])[0] == first
    second, _ = keys(own | {"b": "2"}, edges)
    assert {n for n in own if first[n] != second[n]} == {"b", "c"}
    third, _ = keys(own, [e for e in edges if e != ("a", "b")])
    assert {n for n in own if first[n] != third[n]} == {"b", "c"}
    stored = spark.createDataFrame([(n, k) for n, k in second.items() if n != "x"], "node string, key string")
    assert {(r["node"], r["level"]) for r in graph.stale(order, stored).collect()} == {("b", 1), ("c", 2), ("x", 0)}


def test_graphs_of_nothing_and_of_twins(spark):
    none, no_edge = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    order, stuck = graph.peeled(none, no_edge)
    assert order.collect() == [] and stuck.collect() == [] and order.columns == ["node", "level", "key"]
    assert graph.cyclic(stuck, no_edge).collect() == [] and graph.reached(no_edge, spark.createDataFrame([], "node string")).collect() == []
    with pytest.raises(ValueError, match="share a name"):
        graph.peeled(spark.createDataFrame([("a", ""), ("a", "x")], NODES), no_edge)
    hub = spark.createDataFrame([("a", str(i)) for i in range(400)], EDGES)
    order, stuck = graph.peeled(spark.createDataFrame([("a", "")] + [(str(i), "") for i in range(400)], NODES), hub)
    assert order.groupBy("level").count().orderBy("level").collect() == [(0, 1), (1, 400)] and stuck.count() == 0


def test_closures_of_cycles_and_long_chains(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 4}") for i in range(4)] + [("r0", "r1"), ("in", "r2"), (None, "in"), ("r3", None)]
    got = [tuple(r) for r in dag.closure(spark.createDataFrame(ring, EDGES)).collect()]
    rs = [f"r{i}" for i in range(4)]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in (*rs, "in", None) for b in (*rs, None)} | {(None, "in")}


def test_a_closure_of_over_a_million_pairs(spark):
    """A hub between many and many: the pairs are more than a recursive query may give."""
    ends = spark.range(1050).selectExpr("concat('a', id) src", "'hub' dst").union(spark.range(1000).selectExpr("'hub' src", "concat('b', id) dst"))
    assert dag.closure(ends).count() == 1050 * 1000 + 1050 + 1000


def test_edges_that_were_used_are_not_read_again(spark, monkeypatch):
    """Rounds write what is left of the edges: together a bounded multiple of them where levels thin out."""
    kept, real = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, tag, part=None: (out := real(df, tag, part), kept.append(out.count()) if tag == "edges" else None)[0])
    edges = [(f"p{i}", f"o{i % 7}") for i in range(200)] + [(f"o{i}", f"o{i + 1}") for i in range(6)]
    names = sorted({n for e in edges for n in e})
    order, stuck = graph.peeled(spark.createDataFrame([(n, "") for n in names], NODES), spark.createDataFrame(edges, EDGES))
    assert {r["node"]: r["level"] for r in order.collect()} == walk(names, edges)[0] and stuck.count() == 0
    assert kept[0] == 206 and kept[1:] == [6, 5, 4, 3, 2, 1, 0, 0][: len(kept) - 1]
