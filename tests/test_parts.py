"""Parts that no SQL expresses: pixels, files, plans, streams, edits of regions."""

import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions import keys, prompts, shape
from foliospark.functions.registry import Registry
from foliospark.functions.text import fit_size
from foliospark.operators import candidates, detect, history, incremental, vision
from foliospark.plans.dag import JsonState, Pipeline, Stage
from foliospark.sources import images
from foliospark.streaming import history_stream


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape_ in ((7, 5), (4, 6, 3), (1, 1)):
        a = rng.integers(0, 256, shape_).astype(np.uint8)
        assert (images.decode_png(images.encode_png(a)) == a).all()
        assert images.image_size(images.encode_png(a)) == (a.shape[1], a.shape[0])


def test_scan_folder_and_archives(spark, tmp_path):
    png = images.encode_png(np.zeros((3, 4), np.uint8))
    (tmp_path / "a.PNG").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no image at all")
    (tmp_path / "c.txt").write_text("not looked at")
    got = {r["name"]: (r["width"], r["height"], r["reason"]) for r in images.scan_images(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG": (4, 3, None), "b.png": (None, None, "no image")}
    box = tmp_path / "z"
    box.mkdir()
    with zipfile.ZipFile(box / "v.cbz", "w") as z:
        for name in ("p/1.png", "q/1.png", ".h.png", "__MACOSX/2.png", "../3.png", "t.txt"):
            z.writestr(name, png)
    got = {(r["name"], r["reason"]) for r in images.scan_archives(spark, str(box)).collect()}
    assert got == {("1.png", None), ("1.png", "duplicate name"), ("3.png", None)}
    (box / "bad.zip").write_bytes(b"no archive")
    rows = images.scan_archives(spark, str(box), contents=True).collect()
    assert {(r["name"], r["content"] is not None) for r in rows} == {("1.png", True), ("1.png", False), ("3.png", True), ("bad.zip", False)}
    assert next(r["reason"] for r in rows if r["name"] == "bad.zip").startswith("damaged archive")


def test_discovered(spark):
    rows = [("f/p10.png", "p10.png", 1, 1, None), ("f/p2.png", "p2.png", 1, 1, None), ("g/p2.png", "p2.png", 1, 1, None), ("f/bad.png", "bad.png", None, None, "no image"), ("f/q.png", "q.png", 1, 1, None)]
    found = spark.createDataFrame(rows, images.SCAN)
    places = lambda df: {r["path"]: r["place"] for r in df.collect()}
    assert places(images.discovered(found)) == {"f/p2.png": 0, "f/p10.png": 1, "f/q.png": 2, "g/p2.png": None, "f/bad.png": None}
    assert places(images.discovered(found, "name")) == {"f/p10.png": 0, "f/p2.png": 1, "f/q.png": 2, "g/p2.png": None, "f/bad.png": None}
    manifest = spark.createDataFrame([("q.png", 0), ("gone.png", 1)], "name string, pos long")
    got = images.discovered(found, "manifest", manifest)
    assert places(got) == {"f/q.png": 0, "f/p2.png": 1, "f/p10.png": 2, "g/p2.png": None, "f/bad.png": None, None: None}
    assert {r["name"]: r["reason"] for r in got.filter("place is null and path is null").collect()} == {"gone.png": "listed but not found"}
    with pytest.raises(ValueError):
        images.discovered(found, "manifest")


def test_merging_engine(spark):
    boxes = [(1, 0.0, 0.0, 10.0, 10.0, "bubble", 0.9, "auto", "a"), (1, 5.0, 0.0, 10.0, 10.0, "sfx", 0.4, "auto", "b"), (1, 50.0, 0.0, 9.0, 9.0, "sfx", 0.7, "auto", "c"), (1, 0.0, 0.0, 90.0, 90.0, "unknown", 0.1, "ignore", None)]
    df = spark.createDataFrame(boxes, "page_id long, x double, y double, w double, h double, type string, confidence double, status string, text string")
    got = {(r["x"], r["w"], r["type"], r["confidence"], r["status"], r["text"]) for r in detect.merging(lambda pages: df)(spark.range(1)).collect()}
    assert got == {(0.0, 15.0, "bubble", 0.4, "auto", None), (50.0, 9.0, "sfx", 0.7, "auto", "c"), (0.0, 90.0, "unknown", 0.1, "ignore", None)}


def test_png_filters():
    """Every filter undone, on rows that a plain encoder of them made."""
    rng = np.random.default_rng(5)
    for n, kind in ((1, 0), (3, 2)):
        a = rng.integers(0, 256, (6, 7, n)).astype(int)
        lines = b""
        for y in range(6):
            f = y % 5
            row = bytes([f])
            for x in range(7):
                for c in range(n):
                    left, up = (a[y, x - 1, c] if x else 0), (a[y - 1, x, c] if y else 0)
                    corner = a[y - 1, x - 1, c] if x and y else 0
                    p = left + up - corner
                    near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    row += bytes([(a[y, x, c] - [0, left, up, (left + up) // 2, near][f]) & 255])
            lines += row
        whole = images.encode_png(np.zeros((6, 7) if n == 1 else (6, 7, 3), np.uint8))
        at = whole.index(b"IDAT")
        body = zlib.compress(lines)
        data = whole[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + whole[whole.index(b"IEND") - 4 :]
        got = images.decode_png(data)
        assert (got.reshape(6, 7, n) == a).all()


def test_prompts(spark):
    messages = prompts.correction_messages(F.lit("lime"), "en"), prompts.assist_messages(F.lit("a"), F.lit("b"), F.array(F.lit("x")), F.array().cast("array<string>"), "en")
    a, b = spark.range(1).select(*messages).first()
    assert [m["role"] for m in a] == ["system", "user"] and a[1]["content"] == "Line:\nlime" and b[1]["content"] == "Said before: x\n\nLine:\na\n\nDraft:\nb"
    replies = spark.createDataFrame([('{"choices": [{"message": {"content": " hi "}}]}', '{"translations": [{"text": "yo"}]}'), ("{}", "none")], "a string, b string")
    assert [tuple(r) for r in replies.select(prompts.chat_text(F.col("a")), prompts.translations_text(F.col("b"))).collect()] == [("hi", "yo"), (None, None)]
    assert prompts.service_language("pt", {"pt": "PT-PT"}) == "PT-PT" and prompts.service_language("ja") == "JA"


def test_labels_against_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(10):
        mask = rng.random((12, 15)) < 0.4
        numbers, n = vision.label(mask)
        seen, count = np.zeros(mask.shape, bool), 0
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x]:
                continue
            count += 1
            todo, part = [(y, x)], set()
            while todo:
                a, b = todo.pop()
                if 0 <= a < 12 and 0 <= b < 15 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    part.add((a, b))
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            assert len({numbers[p] for p in part}) == 1
        assert n == count and ((numbers > 0) == mask).all()


def test_closing_fills_gaps_only():
    m = np.zeros((9, 9), bool)
    m[4, 2] = m[4, 4] = True
    c = vision.closed(m, 3)
    assert c[4, 3] and c[4, 2] and not c[3].any() and (vision.closed(m, 1) == m).all()


def test_blobs_panels_and_skew(spark):
    page = vision.sample_page(3)
    assert len(vision.panels(page)) == 4
    assert len(vision.text_blobs(np.full((50, 50), 255, np.uint8)).query("status == 'auto'")) == 0
    blob = np.full((200, 200), 255, np.uint8)
    blob[50:70, 60:140] = 0
    (row,) = vision.text_blobs(blob).itertuples(index=False)
    assert (row.x, row.y, row.w, row.h, row.type, row.status) == (60, 50, 80, 20, "narration", "auto")
    stripes = np.full((120, 120), 255, np.uint8)
    stripes[10:110:12, 5:115] = 0
    assert vision.skew_angle(stripes) == 0.0
    assert abs(vision.skew_angle(vision.rotated(stripes, 4).astype(np.uint8)) + 4) <= 1
    got = vision.over_images(vision.sample_pages(spark, 3), vision.panels, "x double, y double, w double, h double").groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in got} == {0: 4, 1: 4, 2: 4}


def test_mask_and_restore():
    page = np.full((40, 40), 240, np.uint8)
    page[10:20, 10:20] = 5
    clean, layer = vision.masked(page, [(10, 10, 20, 20)])
    assert (clean == 240).all() and (vision.restore(page, clean, layer) == page).all()
    out, info = vision.preprocessed(page, longest=20)
    assert out.shape == (20, 20, 3) and info["orientation"] == "square" and info["scale"] == 0.5
    boxed, scale, px, py = vision.letterbox(np.zeros((10, 20), np.uint8), 40)
    assert boxed.shape == (40, 40) and (scale, px, py) == (2.0, 0.0, 10.0) and not boxed[:10].any()
    assert vision.letterbox(np.full((10, 20), 9, np.uint8), 41)[2:] == (0.0, 10.5)
    assert vision.crop(page, 39.6, 39.6, 5, 5).shape == (1, 1)


def test_keys(spark):
    assert keys.content_key_of("a", "b") != keys.content_key_of("ab", "")
    row = spark.range(1).select(keys.content_key(F.lit("a"), F.lit("é")).alias("k")).first()
    assert row["k"] == keys.content_key_of("a", "é")
    assert keys.ulid(0, 0) == "0" * 26 and keys.ulid((1 << 48) - 1, (1 << 80) - 1) == "7" + "Z" * 25
    with pytest.raises(ValueError):
        keys.ulid(1 << 48, 0)


def test_pipeline_skips_what_is_unchanged(spark, tmp_path):
    ran, own = [], {"a": "1"}
    p = Pipeline([Stage("b", lambda t: ran.append("b") or {}, ("a",)), Stage("a", lambda t: ran.append("a") or {}, (), lambda: own["a"]), Stage("c", lambda t: ran.append("c") or {})])
    state = JsonState(spark, str(tmp_path / "state"))
    assert state.load() == {}
    s = state.load()
    p.run({}, s, state.save)
    assert sorted(ran) == ["a", "b", "c"] and ran.index("a") < ran.index("b")
    assert set(p.run({}, state.load()).values()) == {"skipped"}
    own["a"] = "2"
    assert p.run({}, state.load()) == {"a": "ran", "b": "ran", "c": "skipped"}
    assert p.select(start="a") == ["a", "b"] and p.select(end="b") == ["a", "b"] and p.select(only="c") == ["c"]
    for bad in ([Stage("a", dict, ("x",))], [Stage("a", dict), Stage("a", dict)], [Stage("a", dict, ("b",)), Stage("b", dict, ("a",))]):
        with pytest.raises(ValueError):
            Pipeline(bad)
    with pytest.raises(ValueError):
        p.select(only="a", start="a")


def test_registry():
    r = Registry("translators", {"echo": str})
    assert r.get("echo") is str
    with pytest.raises(ValueError, match="echo"):
        r.get("none")


def test_stream_matches_batch(spark, tmp_path):
    rows = [(p, i, c) for i, (p, c) in enumerate([(1, "edit"), (2, "edit"), (1, "edit"), (1, "undo"), (2, "undo"), (1, "redo"), (2, "redo"), (1, "undo"), (2, "edit"), (1, "edit"), (2, "undo")])]
    df = spark.createDataFrame(rows, "page_id long, cmd_seq int, cmd string")
    want = {r["page_id"]: (r["rev"], len(r["done"]), len(r["undone"])) for r in history.folded(df).collect()}
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == i], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = history_stream.history(src).writeStream.format("memory").queryName("h").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in sorted(spark.table("h").collect(), key=lambda r: r["rev"]):
        got[r["page_id"]] = (r["rev"], r["n_done"], r["n_undone"])
    assert got == want


def test_people_win(spark):
    c = "array<struct<id:string,kind:string,text:string,confidence:double>>"
    u = spark.createDataFrame([("u", "m", [("r", "raw", "x", None), ("m", "manual", "mine", None)]), ("v", "gone", [("r", "raw", "x", None)])], f"unit_id string, selected string, candidates {c}")
    new = candidates.candidate(F.lit("n"), "raw", F.lit("y"))
    assert {r["unit_id"]: r["selected"] for r in candidates.attach_raw(u, new).collect()} == {"u": "m", "v": "n"}
    assert {r["unit_id"]: r["selected"] for r in candidates.attach_ai(u, F.lit("z"), F.lit(0.99), "review").collect()} == {"u": "m", "v": "v_ai"}
    assert {r["unit_id"]: r["selected"] for r in candidates.attach_ai(u, F.lit("z"), F.lit(0.1), "auto").collect()} == {"u": "m", "v": "r"}
    assert {r["unit_id"]: r["selected"] for r in candidates.attach_sfx(u, candidates.candidate(F.lit("s"), "sfx", F.lit("DON")), "render").collect()} == {"u": "m", "v": None}


def test_replies_and_alternatives(spark):
    df = spark.createDataFrame([('```json\n{"candidate": " a ", "confidence": 7, "warnings": ["w", " "]}\n```',), ("not json",), ('{"readability": "b"}',)], "reply string")
    a, b, c = (r["p"] for r in df.select(candidates.parsed_reply(F.col("reply")).alias("p")).collect())
    assert (a["candidate"], a["confidence"], a["warnings"]) == ("a", 1.0, ["w"]) and b is None and c["candidate"] == "b"
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    got = spark.range(1).select(candidates.merged_alternatives(F.lit("t"), arr("a", "a"), arr("b", "", "t", "a", "b")).alias("m")).first()["m"]
    assert got == ["a", "a", "b"]
    t, alts = candidates.accepted_alternative(F.lit("t"), arr("a", "b"), F.lit("a"))
    assert tuple(spark.range(1).select(t.alias("t"), alts.alias("a")).first()) == ("a", ["t", "b"])


def test_fit_and_band(spark):
    df = spark.createDataFrame([("aa bb", 40.0, 20.0), ("wordtoolong", 4.0, 4.0)], "text string, w double, h double")
    a, b = fit_size(df, 20, 8).collect()
    assert (a["font_size"], a["n_lines"], a["overflow"]) == (16, 1, False) and b["overflow"]
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))])
    row = spark.range(1).select(shape.band_inner(pts, F.lit(1.0), F.lit(9.0)).alias("b"), shape.band_inner(pts, F.lit(8.0), F.lit(12.0)).alias("n")).first()
    assert tuple(row["b"]) == (0.0, 10.0) and row["n"] is None


def test_store_rules(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "page_id long, v string, ver int")
    assert [r["v"] for r in incremental.select_where(t, "page_id", 2).collect()] == ["b"]
    with pytest.raises(ValueError):
        incremental.select_where(t, "nope", 1)
    new = spark.createDataFrame([(2, "c", 2)], t.schema)
    assert {r["v"] for r in incremental.overwrite_pages(t, new, new).collect()} == {"a", "c"}
    regions = spark.createDataFrame([(1, "r1", "auto"), (1, "r2", "auto"), (1, "r3", "ignore")], "page_id long, region_id string, status string")
    spans = spark.createDataFrame([("r1", 0, "x", 0.5, "det"), ("r2", 0, "y", 0.5, "ocr"), ("r3", 0, "z", 0.5, "det")], "region_id string, seq int, text string, confidence double, source string")
    adopted, rest = incremental.adopt_spans(regions, spans, "det")
    assert [r["region_id"] for r in adopted.collect()] == ["r1"] and [r["region_id"] for r in rest.collect()] == ["r2"]


def test_rows_of_several_pages_leave_together(spark):
    """One frame of rows for many pages, whatever each has; pages without rows are in none."""
    pages = spark.createDataFrame([(k, images.encode_png(np.full((5, 4), k, np.uint8), 1)) for k in range(7)], "page_id long, png binary").coalesce(1)
    sizes = lambda a: pd.DataFrame({"v": [int(a[0, 0])] * int(a[0, 0] % 3)})
    got = sorted(tuple(r) for r in vision.over_images(pages, sizes, "v long").collect())
    assert got == [(k, k) for k in range(7) for _ in range(k % 3)] and vision.TOGETHER > 1
