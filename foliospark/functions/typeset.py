"""Text fitted into boxes and outlines, with a font whose characters are all as wide as another.

A character of size s is s / 2 wide and a line s high; a stroke adds its width on every side. Fitting, to a box or to an
outline, is a fold in the JVM; painting is a numpy function over one placement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shape import band_inner, let
from .text import wrapped


@dataclass(frozen=True)
class Preset:
    """A text style: the range of sizes, line spacing, alignment, margin inside the box, fill and stroke (RGBA)."""

    name: str
    min_size: int = 10
    max_size: int = 48
    spacing: float = 1.05
    align: str = "center"
    padding: int = 4
    fill: tuple[int, int, int, int] = (0, 0, 0, 255)
    stroke: int = 2
    stroke_fill: tuple[int, int, int, int] = (255, 255, 255, 255)

    def signature(self) -> str:
        return "|".join(str(v) for v in (self.name, self.min_size, self.max_size, self.spacing, self.align, self.padding, self.fill, self.stroke, self.stroke_fill))


#: The built-in styles.
PRESETS = {
    p.name: p
    for p in (
        Preset("default"),
        Preset("shout", min_size=14, max_size=72, spacing=1.0, stroke=3),
        Preset("whisper", min_size=8, max_size=28, spacing=1.1, fill=(60, 60, 60, 255), stroke=0, stroke_fill=(0, 0, 0, 0)),
        Preset("caption", min_size=9, max_size=32, spacing=1.15, align="left", padding=6, stroke=0, stroke_fill=(0, 0, 0, 0)),
    )
}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown style {name}; known: {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def _of_preset(name: Column, field: str) -> Column:
    """A field of the style of that name, of the default one if there is none."""
    found = F.when(F.lit(False), F.lit(getattr(PRESETS["default"], field)))
    for p in PRESETS.values():
        found = found.when(name == p.name, F.lit(getattr(p, field)))
    return found.otherwise(F.lit(getattr(PRESETS["default"], field)))


LINE = "struct<line:string,x:long,y:long>"
LAYOUT = f"struct<font_size:int,line_step:int,text_width:int,text_height:int,overflow:boolean,lines:array<{LINE}>>"


def fitted(placements: DataFrame) -> DataFrame:
    """placements(.., text, w, h, preset) with font_size, line_step, text_width, text_height, overflow and lines.

    The largest size whose wrapped block lies inside the box's margins; if none does, the least one, with overflow.
    lines have their places inside the box: aligned by the style, the block in the middle of the height. Where there is
    a column outline (array of struct x, y, as x and y of the box) with three points or more, lines keep inside it.
    """
    chars = F.greatest(F.lit(1), F.length(F.regexp_replace("text", r"\s+", "")))
    out, more = _once(placements, "_chars", chars), ["_chars", "_b"]
    layout = _in_box()
    if "outline" in placements.columns:
        out, shaped, made = _in_outline(out)
        layout, more = F.when(F.size("outline") >= 3, shaped).otherwise(layout), [*more, *made]
    out = _once(out, "_b", layout)
    return out.withColumns({c: F.col(f"_b.{c}") for c in ("font_size", "line_step", "text_width", "text_height", "overflow", "lines")}).drop(*more)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row: a generator keeps the optimizer from copying its expression."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _sizes() -> Column:
    return F.sequence(_of_preset(F.col("preset"), "max_size"), _of_preset(F.col("preset"), "min_size"), F.lit(-1))


def _laid(done: Column, size: Column, step: Column, width: Column, height: Column, lines: Column) -> Column:
    return F.struct(size.cast("int").alias("font_size"), step.cast("int").alias("line_step"), width.cast("int").alias("text_width"), height.cast("int").alias("text_height"), (~done).alias("overflow"), lines.alias("lines")).cast(LAYOUT)


def _aside(free: Column) -> Column:
    """How far from the left a line with so much room beside it stands."""
    align = _of_preset(F.col("preset"), "align")
    return F.when(align == "left", F.lit(0.0)).when(align == "right", free).otherwise(free / 2)


def _in_box() -> Column:
    name = F.col("preset")
    pad, stroke, spacing = _of_preset(name, "padding"), _of_preset(name, "stroke"), _of_preset(name, "spacing")
    room_w, room_h = F.col("w") - 2 * pad, F.col("h") - 2 * pad
    state = "struct<done:boolean,size:int,step:int,width:int,height:int,lines:array<string>>"

    def step(s: Column, z: Column) -> Column:
        advance = z / F.lit(2.0)
        per_line = F.greatest(F.lit(1), F.floor((F.greatest(F.lit(1.0), room_w) - 2 * stroke) / advance)).cast("int")
        lines = wrapped(F.col("text"), per_line)

        def measured(rows: Column) -> Column:
            height = z + 2 * stroke
            down = F.bround(height * spacing).cast("int")
            longest = F.array_max(F.transform(rows, lambda r: F.length(r)))
            width = F.bround(longest * advance + 2 * stroke).cast("int")
            block = down * (F.size(rows) - 1) + height
            fits = (width <= room_w) & (block <= room_h)
            return F.struct(fits.alias("done"), z.alias("size"), down.alias("step"), width.alias("width"), block.alias("height"), rows.alias("lines")).cast(state)

        # sizes at which the characters alone need more lines than there is room for are not wrapped, but for the least
        least = F.ceil(F.col("_chars") / per_line)
        height = z + 2 * stroke
        hopeless = (z > _of_preset(name, "min_size")) & (F.bround(height * spacing) * (least - 1) + height > room_h)
        return F.when(s["done"] | hopeless, s).otherwise(let(lines, measured))

    zero = F.struct(F.lit(False).alias("done"), *[F.lit(0).alias(n) for n in ("size", "step", "width", "height")], F.array().cast("array<string>").alias("lines")).cast(state)

    def layout(s: Column) -> Column:
        top = pad + F.greatest(F.lit(0), F.floor((F.bround("h") - 2 * pad - s["height"]) / 2))
        free = F.bround("w") - 2 * pad

        def placed(line: Column, i: Column) -> Column:
            x = pad + _aside(free - (F.length(line) * s["size"] / F.lit(2.0) + 2 * stroke))
            return F.struct(line.alias("line"), F.bround(x).cast("long").alias("x"), (top + i * s["step"]).cast("long").alias("y")).cast(LINE)

        return _laid(s["done"], s["size"], s["step"], s["width"], s["height"], F.transform(s["lines"], placed))

    return let(F.aggregate(_sizes(), zero, step), layout)


#: Times that a number of lines is worked out from the room that the number before leaves them.
PASSES = 3


def _in_outline(rows: DataFrame) -> tuple[DataFrame, Column, list[str]]:
    """rows with columns to work with, the layout inside the outline, and the names of these columns.

    The room of a line depends on how many lines there are, and on nothing else of them. So what has to settle is a
    number: from that of a wrap at the box's width, each next one is the number of lines in the room of the one before.
    The lines are those in the room of the last number. Each step is a column with an entry for every size that is tried.
    """
    for c in ("padding", "stroke", "spacing", "min_size"):
        rows = _once(rows, f"_{c}", _of_preset(F.col("preset"), c))
    rows = _once(rows, "_room_h", F.col("h") - 2 * F.col("_padding"))
    pad, stroke, spacing, room_h, ws = F.col("_padding"), F.col("_stroke"), F.col("_spacing"), F.col("_room_h"), F.col("_words")
    kind, span = "struct<lines:array<string>,cur:string>", "struct<l:double,r:double>"

    def down(z: Column) -> Column:
        return F.bround((z + 2 * stroke) * spacing).cast("int")

    def wide(t: Column, z: Column) -> Column:
        return F.length(t) * z / F.lit(2.0) + 2 * stroke

    def block(z: Column, n: Column) -> Column:
        return down(z) * (n - 1) + z + 2 * stroke

    def top_of(z: Column, n: Column) -> Column:
        return pad + F.greatest(F.lit(0.0), (room_h - block(z, n)) / 2)

    def bands_of(z: Column, n: Column) -> Column:
        nothing = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("r")).cast(span)

        def one(y: Column) -> Column:
            return F.coalesce(band_inner(F.col("_points"), y, y + z + 2 * stroke).cast(span), nothing)

        return F.transform(let(F.struct(top_of(z, n).alias("a"), down(z).alias("b")), lambda t: F.transform(F.sequence(F.lit(0), n - 1), lambda i: t["a"] + i * t["b"])), one)

    def rooms(bands: Column) -> Column:
        return F.transform(bands, lambda r: r["r"] - r["l"] - 2 * pad)

    def wrap(z: Column, room: Callable[[Column], Column]) -> Column:
        """Greedy lines, line i at most room(i) wide; a word wider than its line is cut."""

        def cut(lines: Column, t: Column) -> Column:
            n = F.greatest(F.lit(1), F.floor((F.greatest(F.lit(1.0), room(F.size(lines))) - 2 * stroke) / (z / F.lit(2.0)))).cast("int")
            parts = let(n, lambda k: F.transform(F.sequence(F.lit(0), F.ceil(F.length(t) / k).cast("int") - 1), lambda i: F.substring(t, i * k + 1, k)))
            return let(parts, lambda c: F.struct(F.concat(lines, F.slice(c, 1, F.size(c) - 1)).alias("lines"), F.element_at(c, -1).alias("cur")).cast(kind))

        def next_line(lines: Column, t: Column) -> Column:
            whole = F.struct(lines.alias("lines"), t.alias("cur")).cast(kind)
            return F.when(wide(t, z) <= room(F.size(lines)), whole).otherwise(cut(lines, t))

        def step(s: Column, t: Column) -> Column:
            longer = F.length(s["cur"]) + F.length(t) + F.when(s["cur"] == "", 0).otherwise(1)
            joined = F.when(s["cur"] == "", t).otherwise(F.concat(s["cur"], F.lit(" "), t))
            on = F.struct(s["lines"].alias("lines"), joined.alias("cur")).cast(kind)
            closed = F.when(s["cur"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["cur"])))
            return F.when(longer * z / F.lit(2.0) + 2 * stroke <= room(F.size(s["lines"])), on).otherwise(let(closed, lambda lines: next_line(lines, t)))

        zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur")).cast(kind)
        return F.aggregate(ws, zero, step, lambda s: F.concat(s["lines"], F.array(s["cur"])))

    def in_room(s: Column) -> Column:
        return wrap(s["z"], lambda i: F.get(s["rooms"], F.least(i, F.size(s["rooms"]) - 1)))

    points = F.transform("outline", lambda p: F.struct((p["x"] - F.col("x")).alias("x"), (p["y"] - F.col("y")).alias("y")))
    out = _once(rows, "_words", F.filter(F.split("text", r"\s+"), lambda t: t != ""))
    out = _once(out, "_points", points)
    # no line holds more than the outline's width does: sizes that need too many lines for that are not tried, but for the least
    xs = F.transform("_points", lambda p: p["x"])
    out = _once(out, "_across", F.array_max(xs) - F.array_min(xs) - 2 * pad - 2 * stroke)

    def promising(z: Column) -> Column:
        per_line = F.greatest(F.lit(1), F.floor(F.col("_across") / (z / F.lit(2.0))))
        return (z == F.col("_min_size")) | (block(z, F.ceil(F.col("_chars") / per_line)) <= room_h)

    tried = F.filter(_sizes(), promising)
    out = _once(out, "_plain", F.greatest(F.lit(1.0), F.col("w") - 2 * pad))
    plain = F.col("_plain")
    out = _once(out, "_try", F.when(F.size("outline") >= 3, F.transform(tried, lambda z: F.struct(z.alias("z"), F.size(wrap(z, lambda i: plain)).alias("n")))))

    def with_rooms(s: Column) -> Column:
        return F.struct(s["z"].alias("z"), rooms(bands_of(s["z"], s["n"])).alias("rooms"))

    for _ in range(PASSES):
        out = _once(out, "_try", F.transform("_try", with_rooms))
        out = _once(out, "_try", F.transform("_try", lambda s: F.struct(s["z"].alias("z"), F.size(in_room(s)).alias("n"))))
    out = _once(out, "_try", F.transform("_try", with_rooms))
    out = _once(out, "_try", F.transform("_try", lambda s: F.struct(s["z"].alias("z"), in_room(s).alias("lines"))))
    out = _once(out, "_try", F.transform("_try", lambda s: F.struct(s["z"].alias("z"), s["lines"].alias("lines"), bands_of(s["z"], F.size(s["lines"])).alias("bands"))))

    def fits(s: Column) -> Column:
        rooms = F.zip_with(s["lines"], s["bands"], lambda t, r: (r["r"] - r["l"] - 2 * pad > 0) & (wide(t, s["z"]) <= r["r"] - r["l"] - 2 * pad))
        return F.forall(rooms, lambda x: x) & (block(s["z"], F.size(s["lines"])) <= room_h)

    out = _once(out, "_good", F.get(F.filter("_try", fits), F.lit(0)))  # sizes fall
    out = _once(out, "_best", F.coalesce("_good", F.try_element_at("_try", F.lit(-1))))
    best, z = F.col("_best"), F.col("_best.z")

    def placed(p: Column, i: Column) -> Column:
        x = p["band"]["l"] + pad + _aside(p["band"]["r"] - p["band"]["l"] - 2 * pad - wide(p["line"], z))
        return F.struct(p["line"].alias("line"), F.bround(x).cast("long").alias("x"), F.bround(top_of(z, F.size(best["lines"])) + i * down(z)).cast("long").alias("y")).cast(LINE)

    lines = F.transform(F.arrays_zip(best["lines"].alias("line"), best["bands"].alias("band")), placed)
    width = F.bround(F.array_max(F.transform(best["lines"], lambda t: wide(t, z))))
    return out, _laid(F.col("_good").isNotNull(), z, down(z), width, block(z, F.size(best["lines"])), lines), ["_padding", "_stroke", "_spacing", "_min_size", "_room_h", "_plain", "_words", "_points", "_across", "_try", "_good", "_best"]


# painting


def bar(char: str, size: int) -> np.ndarray:
    """The default glyph: a bar with a margin, nothing for a blank. A caller with a font passes a function of its own."""
    out = np.zeros((size, max(1, size // 2)), bool)
    if char.strip():
        out[size // 5 : size - size // 5, : max(1, size // 2 - 1)] = True
    return out


def painted(image: np.ndarray, x: float, y: float, w: float, h: float, lines: list[tuple[str, int, int]], size: int, style: Preset, glyph: Callable[[str, int], np.ndarray] = bar) -> np.ndarray:
    """A copy of the image (h, w, 3) with lines (text, x, y) inside a box: strokes below fills, cut at box and image."""
    out, (ih, iw) = image.copy(), image.shape[:2]
    tall, wide = max(1, round(h)), max(1, round(w))
    ink = np.zeros((tall, wide), bool)
    for text, left, top in lines:
        for i, c in enumerate(text):
            g = glyph(c, size)
            px, py = left + style.stroke + round(i * size / 2), top + style.stroke
            a, b = max(0, -py), max(0, -px)
            part = g[a : max(a, min(g.shape[0], tall - py)), b : max(b, min(g.shape[1], wide - px))]
            ink[py + a : py + a + part.shape[0], px + b : px + b + part.shape[1]] |= part
    halo = ink.copy()
    for _ in range(style.stroke):
        halo[1:] |= halo[:-1].copy()
        halo[:-1] |= halo[1:].copy()
        halo[:, 1:] |= halo[:, :-1].copy()
        halo[:, :-1] |= halo[:, 1:].copy()
    ox, oy = round(x), round(y)
    a, b = max(0, -oy), max(0, -ox)
    c, d = max(a, min(tall, ih - oy)), max(b, min(wide, iw - ox))
    for mask, colour in ((halo & ~ink, style.stroke_fill), (ink, style.fill)):
        some, alpha = mask[a:c, b:d], colour[3] / 255
        if alpha and some.any():
            target = out[oy + a : oy + c, ox + b : ox + d]
            target[some] = np.rint(target[some] * (1 - alpha) + np.array(colour[:3]) * alpha).astype(np.uint8)
    return out
