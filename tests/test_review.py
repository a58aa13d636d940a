"""Edits, stages, typesetting and the store on small cases with known results."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions import typeset
from foliospark.operators import detect, export, history, presets, review, stages, vision
from foliospark.sources import images, store

CANDS = "array<struct<id:string,kind:string,text:string,confidence:double>>"


@pytest.fixture(scope="module")
def tables(spark):
    regions = [(1, f"r{i}", i, float(10 * i), 0.0, 8.0, 20.0, "bubble", "auto", 0.5) for i in range(4)] + [(2, "s0", 0, 0.0, 0.0, 5.0, 5.0, "sfx", "auto", None)]
    r = spark.createDataFrame(regions, "page_id long, region_id string, reading_order int, x double, y double, w double, h double, type string, status string, confidence double")
    s = spark.createDataFrame([(1, f"r{i}", 0, f"text {i}", 0.9) for i in range(4)], "page_id long, region_id string, seq int, text string, confidence double")
    u = spark.createDataFrame([(1, "a", ["r1"], [("a1", "raw", "x", None)], "a1"), (1, "b", ["r1", "r2", "r3"], [("b1", "manual", "mine", None)], "b1"), (2, "c", ["s0"], [], None)], f"page_id long, unit_id string, ordered_region_ids array<string>, candidates {CANDS}, selected string")
    return r, s, u


def ids(units):
    return {x["unit_id"]: x["ordered_region_ids"] for x in units.collect()}


def places(regions):
    return {x["region_id"]: x["reading_order"] for x in regions.collect()}


def refused(done):
    return {(x["id"], x["reason"]) for x in done.rejected.collect()}


def test_split(spark, tables):
    r, _, u = tables
    cuts = spark.createDataFrame([("r1", 1, 0.25, False), ("r2", 1, 1.0, False), ("zz", 1, 0.5, True)], "region_id string, seq int, ratio double, vertical boolean")
    done = review.split_regions(r, u, cuts)
    got = {x["region_id"]: (x["reading_order"], x["y"], x["h"], x["confidence"]) for x in done.regions.collect()}
    assert got["r1"] == (1, 0, 5, 0.5) and got["r1_b"] == (2, 5, 15, None) and got["r3"] == (4, 0, 20, 0.5) and got["s0"][0] == 0
    assert ids(done.units) == {"a": ["r1", "r1_b"], "b": ["r1", "r1_b", "r2", "r3"], "c": ["s0"]}
    assert refused(done) == {("r2", "ratio must be between 0 and 1"), ("zz", "unknown id")}
    first = cuts.limit(1)
    again = review.split_regions(done.regions, done.units, first)  # a second cut, a cut of the half, and a third cut
    new = set(places(again.regions)) - set(places(done.regions))
    assert not refused(again) and len(new) == 1 and (name := new.pop()).startswith("r1_b")
    got = {x["region_id"]: (x["reading_order"], x["y"], x["h"]) for x in again.regions.collect()}
    assert got["r1"] == (1, 0, 1.25) and got[name] == (2, 1.25, 3.75) and got["r1_b"] == (3, 5, 15) and ids(again.units)["a"] == ["r1", name, "r1_b"]
    both = review.split_regions(again.regions, again.units, first.withColumn("region_id", F.explode(F.array(F.lit("r1"), F.lit("r1_b")))))
    assert len(places(both.regions)) == len(places(again.regions)) + 2 and "r1_b_b" in places(both.regions)
    assert sorted(places(both.regions.filter("region_id not like 's%'")).values()) == list(range(len(places(both.regions.filter("region_id not like 's%'")))))


def test_merge(spark, tables):
    r, s, u = tables
    groups = spark.createDataFrame([("r3", 1, "g"), ("r1", 1, "g"), ("r2", 1, "alone"), ("r0", 1, "pages"), ("s0", 1, "pages")], "region_id string, seq int, group_id string")
    done = review.merge_regions(r, s, u, groups)
    assert {x["region_id"]: (x["reading_order"], x["x"], x["w"]) for x in done.regions.collect()} == {"r0": (0, 0, 8), "r1": (1, 10, 28), "r2": (2, 20, 8), "s0": (0, 0, 5)}
    assert sorted((x["region_id"], x["seq"], x["text"]) for x in done.spans.collect()) == [("r0", 0, "text 0"), ("r1", 0, "text 1"), ("r1", 1, "text 3"), ("r2", 0, "text 2")]
    assert ids(done.units) == {"a": ["r1"], "b": ["r1", "r2"], "c": ["s0"]}
    assert refused(done) == {("alone", "needs two regions"), ("pages", "regions of several pages")}


def test_delete_reorder_move(spark, tables):
    r, s, u = tables
    done = review.delete_regions(r, s, u, spark.createDataFrame([("r1", 1), ("s0", 1), ("zz", 1)], "region_id string, seq int"))
    assert places(done.regions) == {"r0": 0, "r2": 1, "r3": 2} and ids(done.units) == {"b": ["r2", "r3"]}
    assert {x["region_id"] for x in done.spans.collect()} == {"r0", "r2", "r3"} and refused(done) == {("zz", "unknown id")}
    orders = spark.createDataFrame([(1, 1, ["r3", "r2", "r1", "r0"]), (2, 1, ["s0", "s0"])], "page_id long, seq int, ids array<string>")
    done = review.reorder_pages(r, orders)
    assert places(done.regions) == {"r3": 0, "r2": 1, "r1": 2, "r0": 3, "s0": 0} and [x[0] for x in refused(done)] == ["2"]
    moves = spark.createDataFrame([("r0", 1, 1.0, 1.0, 1.0, 1.0), ("r0", 2, 2.0, 2.0, 2.0, 2.0), ("r1", 1, 0.0, 0.0, -1.0, 1.0)], "region_id string, seq int, x double, y double, w double, h double")
    done = review.move_regions(r, moves)
    assert {x["region_id"]: x["x"] for x in done.regions.collect()} == {"r0": 2, "r1": 10, "r2": 20, "r3": 30, "s0": 0} and refused(done) == {("r1", "negative size")}


def test_empty_commands_change_nothing(spark, tables):
    r, s, u = tables
    none = lambda kind: spark.createDataFrame([], kind)
    assert places(review.split_regions(r, u, none("region_id string, seq int, ratio double, vertical boolean")).regions) == places(r)
    assert places(review.merge_regions(r, s, u, none("region_id string, seq int, group_id string")).regions) == places(r)
    assert ids(review.delete_regions(r, s, u, none("region_id string, seq int")).units) == ids(u)
    done = review.edit_translations(u, none("unit_id string, seq int, text string"))
    assert done.units.count() == 3 and done.log.count() == 0


def test_edits_and_choices(spark, tables):
    _, _, u = tables
    edits = spark.createDataFrame([("a", 1, "first"), ("a", 2, "second"), ("b", 1, "other"), ("zz", 1, "x")], "unit_id string, seq int, text string")
    done = review.edit_translations(u, edits)
    got = {x["unit_id"]: (x["selected"], [(c["kind"], c["text"]) for c in x["candidates"]]) for x in done.units.collect()}
    assert got == {"a": ("a_edit_2", [("raw", "x"), ("manual", "second")]), "b": ("b1", [("manual", "other")]), "c": (None, [])}
    assert {(x["unit_id"], x["before"], x["after"]) for x in done.log.collect()} == {("a", "x", "second"), ("b", "mine", "other")} and refused(done) == {("zz", "unknown id")}
    back = review.select_candidates(done.units, spark.createDataFrame([("a", 3, "a1"), ("b", 3, "gone")], "unit_id string, seq int, candidate_id string"))
    assert {x["unit_id"]: x["selected"] for x in back.units.collect()} == {"a": "a1", "b": "b1", "c": None} and refused(back) == {("b", "no such candidate")}


def test_snapshots_and_steps(spark, tables):
    r, s, u = tables
    saved = review.snapshots(r, s, u)
    gone = review.delete_regions(r, s, u, spark.createDataFrame([("r1", 1)], "region_id string, seq int"))
    back = review.restored(gone.regions, gone.spans, gone.units, saved.filter("page_id = 1"))
    for now, was in ((back.regions, r), (back.spans, s), (back.units, u)):
        assert sorted(map(str, now.select(sorted(now.columns)).collect())) == sorted(map(str, was.select(sorted(was.columns)).collect()))
    e = spark.createDataFrame([(1, 1, False), (2, 2, False), (1, 3, False)], "page_id long, seq int, undone boolean")
    flags = lambda df: {x["seq"]: x["undone"] for x in df.collect()}
    one = review.step_back(e)
    assert flags(one) == {1: False, 2: False, 3: True} and flags(review.step_back(one)) == {1: False, 2: True, 3: True}
    assert flags(review.step_back(one, 1)) == {1: True, 2: False, 3: True} and flags(review.step_forward(review.step_back(one))) == {1: False, 2: False, 3: True}
    assert flags(review.step_forward(e)) == flags(e)


def test_people_are_not_overruled(spark, tables):
    r, s, u = tables
    pages = spark.createDataFrame([(1, 0), (2, 1)], "page_id long, idx int")
    entries = spark.createDataFrame([], "ord int, source string, target string, aliases array<string>")
    said = lambda rows: rows.withColumns({"translation": F.lit("machine"), "translation_confidence": F.lit(0.9)})
    done = stages.translate_stage(pages, r, s, u, entries, said, "echo", "en")
    chosen = {x["unit_id"]: x["selected"] for x in done.table.collect()}
    assert chosen["b"] == "b1" and chosen["a"] not in (None, "a1") and {x["unit_id"]: x["candidates"][-1]["text"] for x in done.table.collect()} == {"a": "machine", "b": "machine", "c": ""}
    args = (pages, r, s, done.table, entries, said, "echo", "en")
    assert stages.translate_stage(*args, provenance=done.provenance).provenance.count() == 0
    assert stages.translate_stage(*args, provenance=done.provenance, force=True).provenance.count() == 2
    assert {x["page_id"] for x in stages.translate_stage(pages, r, s.withColumn("text", F.lit("new")), done.table, entries, said, "echo", "en", provenance=done.provenance).provenance.collect()} == {1}
    only = stages.translate_stage(*args, only=spark.createDataFrame([("a",)], "unit_id string"))
    assert only.table.count() == 3 and only.provenance.count() == 0
    loud = r.withColumn("type", F.lit("unknown")).withColumn("status", F.when(F.col("region_id") == "r0", "manual").otherwise("auto")).withColumn("w", F.lit(100.0))
    assert {x["region_id"]: x["type"] for x in stages.sfx_stage(loud, 100, 100).collect()} == {"r0": "unknown", "r1": "sfx", "r2": "sfx", "r3": "sfx", "s0": "sfx"}


def test_order_stage_keeps_a_manual_order(spark, tables):
    r, _, _ = tables
    first = stages.reading_order_stage(r, "ltr")
    by_hand = first.table.withColumn("reading_order", F.when(F.col("page_id") == 1, 3 - F.col("reading_order")).otherwise(F.col("reading_order")))
    again = stages.reading_order_stage(by_hand, "ltr", provenance=first.provenance)
    assert places(again.table) == places(by_hand) and again.provenance.count() == 0
    other = stages.reading_order_stage(by_hand, "rtl", provenance=first.provenance)
    assert places(other.table) == {"r0": 3, "r1": 2, "r2": 1, "r3": 0, "s0": 0}


def test_fallback_is_pinned(spark):
    calls = []

    def broken(pages):
        calls.append(1)
        raise detect.Unavailable("no model")

    engine = detect.with_fallback(broken, lambda pages: pages.withColumn("x", F.lit(1)))
    with pytest.warns(UserWarning):
        assert engine(spark.range(2)).count() == 2
    assert engine(spark.range(3)).count() == 3 and calls == [1]
    assert detect.with_fallback(lambda p: p, broken)(spark.range(1)).count() == 1


def test_model_file_is_missing(spark):
    with pytest.warns(UserWarning):
        assert detect.with_fallback(lambda p: vision.onnx_rows(p, "/no/such/model.onnx"), lambda p: p)(vision.sample_pages(spark, 1)).count() == 1


def test_layouts(spark):
    rows = spark.createDataFrame([("hello world", 100.0, 60.0, "default"), ("hello world", 100.0, 60.0, "caption"), ("toolongword", 20.0, 20.0, "shout"), ("", 50.0, 50.0, "nothing")], "text string, w double, h double, preset string")
    got = [r.asDict() for r in typeset.fitted(rows).collect()]
    for r in got:
        style = typeset.PRESETS.get(r["preset"], typeset.PRESETS["default"])
        for size in range(style.max_size, style.min_size - 1, -1):
            lines = greedy(r["text"], lambda i: max(1.0, r["w"] - 2 * style.padding), size / 2, style.stroke)
            tall = round((size + 2 * style.stroke) * style.spacing) * (len(lines) - 1) + size + 2 * style.stroke
            wide = round(max(len(x) for x in lines) * size / 2 + 2 * style.stroke)
            if wide <= r["w"] - 2 * style.padding and tall <= r["h"] - 2 * style.padding:
                break
        assert (r["font_size"], r["text_height"], r["text_width"], [x["line"] for x in r["lines"]]) == (size, tall, wide, lines)
    assert [r["overflow"] for r in got] == [False, False, True, False] and got[1]["lines"][0]["x"] == 6
    with pytest.raises(ValueError):
        typeset.preset("nothing")


def greedy(text, room, advance, stroke):
    """Lines of text, line i at most room(i) wide; a word wider than its line is cut."""
    lines, held = [], []
    for word in text.split():
        if held and len(" ".join([*held, word])) * advance + 2 * stroke > room(len(lines)):
            lines, held = [*lines, " ".join(held)], []
        if not held:
            while len(word) * advance + 2 * stroke > room(len(lines)):
                n = max(1, int((max(1.0, room(len(lines))) - 2 * stroke) // advance))
                start = room(len(lines))
                pieces = [word[i : i + n] for i in range(0, len(word), n)]
                assert start == room(len(lines))
                lines, word = lines + pieces[:-1], pieces[-1]
                break
        held.append(word)
    return [*lines, " ".join(held)]


def in_outline(r, style):
    """The layout of a placement inside its outline, by trying every size."""
    points = [(p[0] - r["x"], p[1] - r["y"]) for p in r["outline"]]

    def across(y):
        xs = [ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]) if min(ay, by) <= y < max(ay, by)]
        return (min(xs), max(xs)) if len(xs) > 1 else None

    for size in range(style.max_size, style.min_size - 1, -1):
        tall, advance, room_h = size + 2 * style.stroke, size / 2, r["h"] - 2 * style.padding
        step = round(tall * style.spacing)

        def bands(n):
            top = style.padding + max(0.0, (room_h - step * (n - 1) - tall) / 2)
            out = []
            for i in range(n):
                cuts = [across(top + i * step + tall * k / 4) for k in range(5)]
                left, right = (0.0, 0.0) if None in cuts else (max(c[0] for c in cuts), min(c[1] for c in cuts))
                out.append((left, right) if right > left else (0.0, 0.0))
            return top, out

        def lines_in(n):
            found = bands(n)[1]
            return greedy(r["text"], lambda i: found[min(i, n - 1)][1] - found[min(i, n - 1)][0] - 2 * style.padding, advance, style.stroke)

        n = len(greedy(r["text"], lambda i: max(1.0, r["w"] - 2 * style.padding), advance, style.stroke))
        for _ in range(3):
            n = len(lines_in(n))
        lines = lines_in(n)
        top, found = bands(len(lines))
        rooms = [b - a - 2 * style.padding for a, b in found]
        block = step * (len(lines) - 1) + tall
        if block <= room_h and all(m > 0 and len(t) * advance + 2 * style.stroke <= m for t, m in zip(lines, rooms)) or size == style.min_size:
            fits = block <= room_h and all(m > 0 and len(t) * advance + 2 * style.stroke <= m for t, m in zip(lines, rooms))
            places = []
            for i, (t, (a, _), m) in enumerate(zip(lines, found, rooms)):
                free = m - (len(t) * advance + 2 * style.stroke)
                places.append((t, round(a + style.padding + (0.0 if style.align == "left" else free / 2)), round(top + i * step)))
            return size, step, round(max(len(t) * advance + 2 * style.stroke for t in lines)), block, not fits, places


def test_outline_fit(spark):
    rng = random.Random(8)
    words = ["a", "some", "words", "to", "lay", "out", "unbreakable" * 3, "é漢字"]
    rows = []
    for i in range(60):
        w, h = rng.choice([60.0, 120.0, 200.0]), rng.choice([40.0, 120.0, 180.0])
        x, y = float(rng.randint(0, 50)), float(rng.randint(0, 50))
        shape = rng.choice([[(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)], [(0, 0), (1, 0), (1, 1), (0, 1)], [(0.5, 0), (1, 0.3), (1, 0.7), (0.5, 1), (0, 0.7), (0, 0.3)], [(0, 0), (1, 0), (0.5, 1)], [(0.2, 0), (0.8, 0), (1.3, 1), (-0.3, 1)], [(0, 0.5), (1, 0.5), (0.5, 0.5)]])
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 9))), x, y, w, h, rng.choice(list(typeset.PRESETS)), [(x + a * w, y + b * h) for a, b in shape]))
    rows += [(100, "no outline here", 0.0, 0.0, 90.0, 60.0, "default", None), (101, "two points", 0.0, 0.0, 90.0, 60.0, "default", [(0.0, 0.0), (1.0, 1.0)])]
    df = spark.createDataFrame(rows, "id int, text string, x double, y double, w double, h double, preset string, outline array<struct<x:double,y:double>>")
    got = {r["id"]: (r["font_size"], r["line_step"], r["text_width"], r["text_height"], r["overflow"], [tuple(q) for q in r["lines"]]) for r in typeset.fitted(df).collect()}
    for r in df.filter("id < 100").collect():
        assert got[r["id"]] == in_outline(r, typeset.PRESETS[r["preset"]]), r
    plain = {r["id"]: (r["font_size"], [tuple(q) for q in r["lines"]]) for r in typeset.fitted(df.drop("outline")).collect()}
    assert all((got[i][0], got[i][5]) == plain[i] for i in (100, 101))
    assert sum(g[4] for g in got.values()) > 3 and sum(len(g[5]) > 1 for g in got.values()) > 20


def test_masks_and_renders(spark):
    page = np.full((60, 80), 230, np.uint8)
    page[20:30, 20:40] = 10
    df = spark.createDataFrame([(1, images.encode_png(page)), (2, images.encode_png(page))], "page_id long, png binary")
    boxes = spark.createDataFrame([(1, 0, 18, 18, 42, 32)], "page_id long, ord int, x0 int, y0 int, x1 int, y1 int")
    got = {r["page_id"]: (images.decode_png(r["png"]), images.decode_png(r["mask"])) for r in vision.mask_images(df, boxes).collect()}
    assert (got[1][0] == 230).all() and got[1][1].sum() == 255 * 24 * 14 and (got[2][0] == page).all() and not got[2][1].any()
    text = spark.createDataFrame([(1, 0, "HI", 10.0, 10.0, 60.0, 40.0, "whisper"), (1, 1, "x" * 90, 0.0, 0.0, 12.0, 12.0, "default")], "page_id long, place int, text string, x double, y double, w double, h double, preset string")
    done = {r["page_id"]: (images.decode_png(r["png"]), r["overflow"]) for r in vision.composite_images(df, typeset.fitted(text)).collect()}
    assert done[1][1] == 1 and done[2][1] == 0 and done[1][0].shape == (60, 80, 3) and (done[1][0] == 60).any() and (done[2][0] == page[:, :, None]).all()
    round_ = typeset.fitted(text.limit(1).withColumn("outline", F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((40.0, 10.0), (70.0, 30.0), (40.0, 50.0), (10.0, 30.0))])))
    shaped = vision.composite_images(df.limit(1), round_).first()
    assert shaped["overflow"] == 0 and (images.decode_png(shaped["png"]) == 60).any()


def test_bundle(spark, tables, tmp_path):
    r, s, u = tables
    pages = spark.createDataFrame([(1, 0, "a.png"), (2, 1, "b.png")], "page_id long, idx int, image_path string")
    artifacts = spark.createDataFrame([(1, "render", 1, "r1.png", 2, "x")], "page_id long, kind string, seq int, path string, overflow long, signature string")
    rows = u.select("page_id", "unit_id", F.posexplode("ordered_region_ids").alias("pos", "region_id"))
    bundle = stages.export_bundle(pages, artifacts, rows, r, s, u, r)
    assert {(x["page_id"], x["source"], x["file"]) for x in bundle.pages.collect()} == {(1, "render", "pages/0000.png"), (2, "original", "pages/0001.png")} and bundle.overflow().first()["overflow"] == 2
    bundle.write(str(tmp_path / "out"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "out/transcript")).collect()]
    assert sorted(lines) == sorted(["## Page 1", "[1] text 1  ->  x", "[2] text 1 text 2 text 3  ->  mine", "## Page 2", "[1]   ->  "])
    assert spark.read.json(str(tmp_path / "out/mapping")).count() == 2 and spark.read.json(str(tmp_path / "out/manifest")).count() == 2


def test_outline_of_single_regions(spark, tables):
    r, _, u = tables
    shaped = r.withColumn("outline", F.array(F.struct(F.col("x"), F.col("y"))))
    rows = u.select("page_id", "unit_id", F.posexplode("ordered_region_ids").alias("pos", "region_id"))
    got = {x["unit_id"]: x["outline"] for x in export.placements(rows, shaped, u, r).collect()}
    assert got["a"] is not None and got["b"] is None


def test_store(spark, tmp_path):
    folder = "file://" + str(tmp_path / "p")
    s = store.Store.create(spark, folder, store.Project("one", version=1))
    with pytest.raises(ValueError):
        store.Store.create(spark, folder, store.Project("two"))
    with pytest.raises(ValueError):
        store.Store(spark, folder + "_none").project()
    spark.createDataFrame([(1, 0, "a.png", 3, 4)], "page_id long, idx int, image_path string, width int, height int").write.parquet(folder + "/pages")
    assert s.read("pages").columns[-1] == "review_rev" and s.read("units").count() == 0
    assert s.migrate() == store.VERSION == s.project().version and s.migrate() == store.VERSION
    assert s.read("pages").count() == 1
    s.write("pages", s.read("pages").withColumn("review_rev", F.lit(5)))
    assert s.read("pages").first()["review_rev"] == 5
    with pytest.raises(ValueError):
        s.read("nothing")
    new = presets.apply(s.project(), {"style": "natural", "glossary_path": "g.json", "pad": 3, "border": 1})
    s.save(new)
    assert s.project().config == {"translate": {"translator": "argos", "style": "natural"}, "render": {"pad": 3, "border": 1}, "series_glossary": "g.json"}


def test_cache_hashes_settings(spark, tmp_path):
    c = store.Cache(spark, "file://" + str(tmp_path / "cache"))
    rows = spark.createDataFrame([("ab12", b"1"), ("ab13", b"2"), ("cd00", b"3")], "key string, content binary")
    assert c.missing(rows).count() == 3 and c.get(rows).count() == 0
    c.put(rows)
    c.put(spark.createDataFrame([("ab12", b"other"), ("ef", b"4")], rows.schema))
    assert {r["key"]: bytes(r["content"]) for r in c.get(spark.createDataFrame([("ab12",), ("ef",), ("zz",)], "key string")).collect()} == {"ab12": b"1", "ef": b"4"}
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"abc")
    assert store.file_hashes(spark, str(tmp_path / "f")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert store.jobs(3) == 3 and store.jobs(0, 16) == 8 and store.jobs(-1, 2) == 2
    assert store.settings('a = 1\nb = "x"', b="y", c=None) == {"a": 1, "b": "y"}


def test_glossary_file_and_assets(spark, tmp_path):
    path = "file://" + str(tmp_path / "g.json")
    assert store.load_glossary(spark, path).count() == 0
    e = spark.createDataFrame([(0, "é", "e", ["a", "b"]), (1, "x", "y", [])], "ord int, source string, target string, aliases array<string>")
    store.save_glossary(e, path, "series")
    assert [tuple(r) for r in store.load_glossary(spark, path).collect()] == [tuple(r) for r in e.collect()]
    a = store.Assets(spark, [store.Asset("det", "detector", "finds text", "d.onnx", "u1"), store.Asset("eng", "ocr", "its own")], "file://" + str(tmp_path / "m"), {"det": "u2"})
    assert (a.status("det"), a.status("eng"), a.path("eng")) == ("missing", "managed", None)
    assert a.pull("det", lambda url: url.encode()) and not a.pull("det", lambda url: b"") and a.status("det") == "cached"
    assert (tmp_path / "m/d.onnx").read_bytes() == b"u2" and a.listing().count() == 2
    with pytest.raises(ValueError):
        a.find("none")


def test_history_still_folds(spark):
    df = spark.createDataFrame([(1, 1, "edit"), (1, 2, "undo")], "page_id long, cmd_seq int, cmd string")
    assert [(r["seq"], r["undone"]) for r in history.listing(df).collect()] == [(1, True)]
    assert isinstance(pd.DataFrame(), pd.DataFrame)
