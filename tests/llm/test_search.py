"""Spelling variants, centroid clustering and nearest neighbours against brute force, with odd rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import op11_spelling, op12_dualtree, op13_multiprobe

DOCS = "doc_id long, text string"


# 11


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs, least=7, modulus=31):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    out = {}
    for w in n:
        some = [v for v in n if near(w, v)]
        best = min(some, key=lambda v: (-n[v], v)) if some else None
        out[w] = (best if best and n[best] >= 10 * n[w] else None, len(some))
    found = {}
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        found[w] = (out[w][0], root, n[w], out[w][1], n.get(out[w][0]))
    return found


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_variants_chains_ties_and_letters(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "caaabbb": 2000, "Éaaaaab": 3, "éaaaaab": 3, "×÷ÿßaaaa": 4, "×÷ÿßaaab": 40, "aaaaaaab": 3, "short": 50}
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())] + [(None, None), (None, "Caaabbb1CAAABBB"), (3, "")]
    want = variants(docs)
    assert got(op11_spelling.variants(spark.createDataFrame(docs, DOCS).repartition(3))) == want
    assert sum(form is not None and form != root for form, root, *_ in want.values()) >= 2  # roots beyond the form


def test_variants_of_long_words(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(3000))
    words = [long, long[:1500] + long[1501:], long[:1500] + "Z" + long[1501:], *(long[:n] for n in (64, 65, 66)), long[:30] + long[31:66], long[:30] + "é" + long[31:66], "x" * 9000, "x" * 8999, "x" * 8999 + "y"]
    docs = [(None, w) for w in words for _ in range(2)] + [(5, f"{long[:65]} {long[:64]}")] * 30
    found = got(op11_spelling.variants(spark.createDataFrame(docs, DOCS)))
    assert found == variants(docs) and sum(v[3] > 0 for v in found.values()) >= 8


def test_variants_of_random_words(spark):
    rng = np.random.default_rng(4)
    docs = [(int(i % 50), " ".join("".join(rng.choice(list("abÀ"), rng.integers(5, 9))) for _ in range(30))) for i in range(200)] + [(None, "abababa Abababa")] * 2
    df = spark.createDataFrame(docs, DOCS).withColumn("word", F.lit("extra")).withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    assert got(op11_spelling.variants(df, modulus=5)) == variants(docs, modulus=5)


def test_variants_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {tuple(None if v != v else v for v in r) for r in con.execute(f"select word, form, root, n, n_near, form_n from ({op11_spelling.SQL}) q").fetchall()}
    found = op11_spelling.op11_spelling(spark, sf_dir)
    assert {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert op11_spelling.variants(empty).collect() == [] and op11_spelling.variants(spark.createDataFrame([(1, None), (2, "a b")], DOCS)).count() == 0
    with pytest.raises(ValueError):
        op11_spelling.variants(empty, ratio=1)


# 12


def nearest(x, c):
    return [min(range(len(c)), key=lambda j: (sum((int(a) - int(b)) ** 2 for a, b in zip(r, c[j])), j)) for r in x]


def test_trees_prune_no_nearest():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, dim, k = int(rng.integers(1, 400)), int(rng.integers(1, 8)), int(rng.integers(1, 30))
        most = int(rng.choice([2, 50, 1 << 20, op12_dualtree.bound_of(64)]))
        x = rng.integers(-most, most + 1, (n, dim))
        x[rng.random(n) < 0.3] = x[0]
        c = np.concatenate([x[rng.integers(0, n, k)], rng.integers(-most, most + 1, (k, dim))])
        tree = op12_dualtree.cover_tree(x)
        label, _ = op12_dualtree.nearest(tree, op12_dualtree.cover_tree(c, 1))
        assert label.tolist() == nearest(x[tree.order], c)
        assert sorted(tree.order) == list(range(n))
        for i in np.flatnonzero(tree.children):
            kids = np.arange(tree.child[i], tree.child[i] + tree.children[i])
            reach = tree.radius[i] / op12_dualtree.BASE
            apart = np.sqrt(((tree.centre[kids][:, None].astype(float) - tree.centre[kids][None]) ** 2).sum(2))
            assert (tree.radius[kids] <= reach).all() and (apart[~np.eye(len(kids), dtype=bool)] > reach * (1 - 1e-9)).all()
            assert tree.size[kids].sum() == tree.size[i] and tree.start[kids[0]] == tree.start[i]


def test_trees_save_work():
    rng = np.random.default_rng(1)
    heaps = rng.integers(-5000, 5000, (16, 64))
    x = heaps[rng.integers(0, 16, 2000)] + rng.integers(-9, 10, (2000, 64))
    _, taken = op12_dualtree.nearest(op12_dualtree.cover_tree(x), op12_dualtree.cover_tree(heaps, 1))
    assert taken < 2000


def lloyd(rows, k, rounds, dim, scale, seed=1):
    most = op12_dualtree.bound_of(dim)
    kept = [(i, [int(max(-most, min(most, np.floor(float(c) * scale)))) for c in e]) for i, e in rows if e is not None and len(e) == dim and all(c is not None and np.isfinite(c) for c in e)]
    if not kept:
        return []
    by_hash = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    c, x = [list(v) for _, v in by_hash[:k]], [v for _, v in kept]
    for _ in range(rounds):
        label = nearest(x, c)
        for j in set(label):
            own = [v for v, g in zip(x, label) if g == j]
            c[j] = [sum(p) // len(own) for p in zip(*own)]
    label = nearest(x, c)
    d = [sum((a - b) ** 2 for a, b in zip(v, c[g])) for v, g in zip(x, label)]
    name = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return [(i, g, e, sum(f for f, h in zip(d, label) if h == g), sum(d), name[g]) for (i, _), g, e in zip(kept, label, d)]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(150)]
    rows += [(i, [0.5, -0.25, 0.0, 1.0]) for i in range(200, 260)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 2 + [(None, [1.0, 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(301, None), (302, []), (303, [1.0, 2.0, 3.0]), (304, [1.0, None, 1.0, 1.0]), (305, [float("nan"), 1.0, 1.0, 1.0]), (306, [float("-inf"), 1.0, 1.0, 1.0]), (307, [1e300, -1e300, 0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("extra")).withColumn("x", F.lit(1)).withColumn("tree", F.lit(1)).repartition(3)
    for k, block in ((6, 2048), (6, 16), (40, 50)):
        assert in_order(op12_dualtree.dual_tree_lloyd(df, k=k, dim=4, block=block).collect()) == in_order(lloyd(rows, k, 3, 4, 64))


def test_clusters_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, None)]
    assert in_order(op12_dualtree.dual_tree_lloyd(spark.createDataFrame(few, kind)).collect()) == in_order(lloyd(few, 16, 3, 64, 64))
    empty = op12_dualtree.dual_tree_lloyd(spark.createDataFrame([], kind))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = in_order(op12_dualtree.op12_dualtree(spark, sf_dir).collect())
    assert found == in_order(lloyd(rows, 16, 3, 64, 64))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert found == in_order(con.execute(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({op12_dualtree.SQL}) q").fetchall())


# 13


def exact(rows, every, k, dim):
    part = {(i, tuple(0.0 + c for c in e)) for i, e in rows if i is not None and e is not None and len(e) == dim and all(c is not None and np.isfinite(c) for c in e) and any(e)}
    ids, x = np.array([i for i, _ in sorted(part)]), np.array([v for _, v in sorted(part)])
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        score = (x * x[at]).sum(1)
        best = {}
        for i, s in zip(ids.tolist(), score.tolist()):
            if i != ids[at]:
                best[i] = max(s, best.get(i, -np.inf))
        out.setdefault(int(ids[at]), []).append(sorted(((-s, i) for i, s in best.items()))[:k])
    return out


def answers(df):
    out = collections.defaultdict(dict)
    for r in df.collect():
        assert r["rank"] not in out[r["query_id"]]
        out[r["query_id"]][r["rank"]] = (-r["score"], r["vec_id"])
    for ranks in out.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1)) and [ranks[i] for i in sorted(ranks)] == sorted(ranks.values())
    return {q: [ranks[i] for i in sorted(ranks)] for q, ranks in out.items()}


def recall(found, want):
    assert found.keys() == want.keys()
    hit = total = 0
    for q, (best,) in want.items():
        assert len(found[q]) == len(best)
        hit, total = hit + len({i for _, i in found[q]} & {i for _, i in best}), total + len(best)
    return hit / total


def test_visited_buckets_are_all_within_reach():
    rng = np.random.default_rng(3)
    p = rng.normal(size=(20, 3)) * 2
    query, values, score = op13_multiprobe.visited(p, 3.0)
    cells = np.stack(np.meshgrid(*[np.arange(-9, 10)] * 3, indexing="ij"), -1).reshape(-1, 3)
    for i in range(20):
        away = (np.maximum(0, np.maximum(cells - p[i], p[i] - (cells + 1))) ** 2).sum(1)
        assert {tuple(c) for c in values[query == i]} == {tuple(c) for c in cells[away <= 3.0]}
        assert (np.diff(score[query == i]) >= 0).all() and score[query == i][0] == 0


def test_search_query_recall(spark, sf_dir):
    rows = [(r[0], [float(c) for c in r[1]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found, want = answers(op13_multiprobe.op13_multiprobe(spark, sf_dir)), exact(rows, 20, 20, 64)
    assert recall(found, want) >= 0.9
    score = {(q, i): s for q, (best,) in exact(rows, 20, len(rows), 64).items() for s, i in best}
    assert all(score[q, i] == s for q, best in found.items() for s, i in best)


def test_search_of_heaps_lengths_and_copies(spark):
    rng = np.random.default_rng(5)
    heaps = rng.normal(size=(12, 8))
    x = heaps[rng.integers(0, 12, 3000)] * rng.lognormal(0, 1, (3000, 1)) + rng.normal(size=(3000, 8)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000 + i, x[0].tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = exact(rows, 20, 20, 8)
    found = answers(op13_multiprobe.search(df, limit=100, most=40))
    assert recall(found, want) >= 0.9
    assert found[4000] == want[4000][0]  # among copies: the least ids, its own left out
    full = answers(op13_multiprobe.search(df, recall=1.1, sample=10_000))  # as far as the furthest neighbour
    assert recall(full, want) == 1.0


def test_search_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(40, [1.0, 0.0, 0.0]), (60, [-0.0, 0.0, 1e-200]), (80, [0.0, 0.0, 1e150])]
    rows += [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]), (180, [1.0, float("nan"), 2.0]), (200, [1.0, float("inf"), 2.0]), (220, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(0, rows[0][1])] * 2 + [(20, rows[1][1])]  # a repeated row, and an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("x")).withColumn("cid", F.lit("x")).withColumn("rank", F.lit("x")).withColumn("ids", F.lit("x"))
    want = exact(rows, 20, 20, 3)
    found = collections.defaultdict(list)
    for r in op13_multiprobe.search(df).collect():
        found[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert found.keys() == want.keys() == {0, 20, 40, 60, 80} and len(want[20]) == 2
    for q, lists in want.items():
        assert len(found[q]) == 20 * len(lists)
        if len(lists) == 1:
            assert [p[1:] for p in sorted(found[q])] == lists[0] or len({p[2] for p in found[q]} & {i for _, i in lists[0]}) >= 12


def test_search_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    few = [(i, [float(i), 1.0]) for i in range(0, 60, 10)]
    df = spark.createDataFrame(few, kind)
    assert answers(op13_multiprobe.search(df)) == {q: best for q, (best,) in exact(few, 20, 20, 2).items()}  # fewer than k: all of them, by the exact way
    assert op13_multiprobe.search(spark.createDataFrame([], kind)).collect() == []
    assert op13_multiprobe.search(spark.createDataFrame([(20, [1.0, 2.0])], kind)).collect() == []
    assert op13_multiprobe.search(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], kind)).collect() == []


def test_search_without_reach_goes_to_all_rows(spark, monkeypatch):
    """Queries that find too few in the buckets they visit are compared with every row."""
    monkeypatch.setattr(op13_multiprobe, "fitted", lambda base, members, index, *a: index)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = answers(op13_multiprobe.search(df, limit=64, occupancy=1)), exact(rows, 20, 20, 16)
    assert found == {q: best for q, (best,) in want.items()}
