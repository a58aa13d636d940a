"""Components of pixels against a flood over the image."""

import random

import pytest

from foliospark.operators import labelling


def flood(ink, corners):
    label, out = {}, {}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    for p in sorted(ink, key=lambda p: (p[0], p[2], p[1])):
        if p in label:
            continue
        label[p], todo = p, [p]
        while todo:
            q, x, y = todo.pop()
            for a, b in steps:
                n = (q, x + a, y + b)
                if n in ink and n not in label:
                    label[n] = p
                    todo.append(n)
        mine = [n for n in label if label[n] == p]
        xs, ys = [n[1] for n in mine], [n[2] for n in mine]
        out[p[0], (p[2] << labelling.X_BITS) + p[1]] = (len(mine), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, round(sum(xs) / len(mine), 6), round(sum(ys) / len(mine), 6))
    return out


@pytest.mark.parametrize("corners", [True, False])
def test_components_are_what_a_flood_finds(spark, corners):
    rng = random.Random(1)
    ink = {(p, rng.randrange(150), rng.randrange(20)) for p in (1, 2, 7) for _ in range(1300)}
    ink |= {(3, x, 2 * y) for x in range(200) for y in range(8)} | {(3, 199 if y % 4 == 1 else 0, y) for y in range(1, 14, 2)}  # a snake
    ink |= {(4, i, i) for i in range(90)} | {(5, 0, 0)}
    df = spark.createDataFrame([*ink, *list(ink)[:50]], "page_id long, x int, y int").repartition(4)
    got = {(r["page_id"], r["label"]): (r["area"], r["x"], r["y"], r["w"], r["h"], round(r["mean_x"], 6), round(r["mean_y"], 6)) for r in labelling.blobs(labelling.labelled(df, corners)).collect()}
    assert got == flood(ink, corners)


def test_no_ink(spark):
    assert labelling.blobs(labelling.labelled(spark.createDataFrame([], "page_id long, x int, y int"))).count() == 0


@pytest.mark.parametrize("corners", [True, False])
def test_components_over_several_tiles(spark, corners, monkeypatch):
    """Tiles are labelled by themselves; what touches across their borders is one, and runs that they cut are whole."""
    monkeypatch.setattr(labelling, "READ", 2000)
    rng = random.Random(2)
    s = labelling.SIDE
    ink = {(1, s + rng.randrange(-30, 30), s + rng.randrange(-30, 30)) for _ in range(1500)}
    ink |= {(2, x, 5) for x in range(2 * s + 9)} | {(2, 2 * s + 8, y) for y in range(s + 3)} | {(2, x, 7) for x in range(s - 4, s)} | {(2, x, 8) for x in range(s, s + 3)}
    ink |= {(3, s - 1, s - 1), (3, s, s), (3, 0, 0), (3, s - 1, 1), (3, 0, 2), (3, s - 1, 3), (3, s - 2, 3), (3, 4, s - 1), (3, 4, s)}
    df = spark.createDataFrame([*ink, *list(ink)[:500]], "page_id long, x int, y int").repartition(5)
    want = flood(ink, corners)
    runs = labelling.labelled(df, corners).collect()
    covered = [(r["page_id"], x, r["y"]) for r in runs for x in range(r["x0"], r["x1"] + 1)]
    assert len(covered) == len(ink) and set(covered) == ink
    assert all((r["page_id"], r["x0"] - 1, r["y"]) not in ink and (r["page_id"], r["x1"] + 1, r["y"]) not in ink for r in runs)
    for made in (labelling.blobs(labelling.labelled(df, corners)), labelling.blobs_of(df, corners)):
        assert {(r["page_id"], r["label"]): (r["area"], r["x"], r["y"], r["w"], r["h"], round(r["mean_x"], 6), round(r["mean_y"], 6)) for r in made.collect()} == want
    counted = {}
    for r in runs:
        counted[r["page_id"], r["label"]] = counted.get((r["page_id"], r["label"]), 0) + 1
    assert {(r["page_id"], r["label"]): r["runs"] for r in labelling.blobs_of(df, corners).collect()} == counted
