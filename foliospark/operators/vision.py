"""Pixels: text blobs, panels, skew, masks, in numpy, as functions and over tables of images.

An image is a uint8 array (h, w) or (h, w, 3); over a table it is the PNG in a binary column.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.images import decode_png, encode_png

MIN_AREA, MAX_AREA, SUSPECT_AREA, WIDE, CLOSE, MIN_FILL = 0.0004, 0.85, 0.12, 0.85, 0.015, 0.12


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The threshold with most variance between the two classes, the first on a tie."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w = np.cumsum(n)
    m = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def _spread(mask: np.ndarray, k: int) -> np.ndarray:
    """Dilation by a k x k square anchored at its middle."""
    lo = k // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (k - 1 - lo, lo)
        c = np.cumsum(np.pad(mask, pad).astype(np.int32), axis=axis)
        c = np.concatenate([np.zeros_like(c.take([0], axis)), c], axis=axis)
        n = mask.shape[axis]
        mask = c.take(range(k, n + k), axis) - c.take(range(n), axis) > 0
    return mask


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    """Closing by a k x k square; outside the image nothing is eroded."""
    grown = _spread(mask, k)
    return ~_spread(~grown[::-1, ::-1], k)[::-1, ::-1]


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers 1.. of 8-connected components, by runs of rows and union-find."""
    out = np.zeros(mask.shape, np.int32)
    parent: list[int] = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        now = []
        for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            hits = {find(i) for a, b, i in before if a <= e and b >= s}
            i = min(hits) if hits else len(parent)
            if not hits:
                parent.append(i)
            for h in hits:
                parent[h] = i
            out[y, s:e] = i
            now.append((s, e, i))
        before = now
    roots = np.array([find(i) for i in range(len(parent))])
    _, numbers = np.unique(roots, return_inverse=True)
    return numbers[out].astype(np.int32), int(numbers.max()) if len(parent) > 1 else 0


def text_blobs(image: np.ndarray) -> pd.DataFrame:
    """Blobs of ink as regions (x, y, w, h, type, confidence, status), from the top left.

    Specks and blobs over nearly the whole page go; those as large as a panel stay, ignored, with little confidence.
    """
    g = gray(image)
    h, w = g.shape
    columns = ["x", "y", "w", "h", "type", "confidence", "status"]
    if not h * w:
        return pd.DataFrame(columns=columns)
    numbers, n = label(closed(g <= otsu(g), max(1, round(min(h, w) * CLOSE))))
    rows = []
    area = np.bincount(numbers.ravel(), minlength=n + 1)
    ys, xs = np.nonzero(numbers)
    lab = numbers[ys, xs]
    top, left = np.full(n + 1, h), np.full(n + 1, w)
    low, right = np.zeros(n + 1, int), np.zeros(n + 1, int)
    np.minimum.at(top, lab, ys)
    np.minimum.at(left, lab, xs)
    np.maximum.at(low, lab, ys + 1)
    np.maximum.at(right, lab, xs + 1)
    for i in range(1, n + 1):
        bw, bh = int(right[i] - left[i]), int(low[i] - top[i])
        share, fill = bw * bh / (h * w), area[i] / (bw * bh)
        if not MIN_AREA <= share <= MAX_AREA or fill < MIN_FILL:
            continue
        score = round(min(1.0, (0.4 + 0.5 * fill) * (1.0 if 0.003 <= share <= 0.25 else 0.6)), 3)
        doubtful = share >= SUSPECT_AREA or bw / w >= WIDE
        kind = "narration" if bw / bh >= 2.5 else "side_text" if bw / bh <= 0.4 else "bubble"
        rows.append((float(left[i]), float(top[i]), float(bw), float(bh), kind, min(score, 0.3) if doubtful else score, "ignore" if doubtful else "auto"))
    return pd.DataFrame(sorted(rows, key=lambda r: (r[1], r[0])), columns=columns)


def runs(inked: np.ndarray, min_gap: int) -> list[tuple[int, int]]:
    """Runs of true places, end exclusive, joined over gaps shorter than min_gap."""
    at = np.flatnonzero(inked)
    if not len(at):
        return []
    cut = np.flatnonzero(at[1:] - at[:-1] > min_gap)
    return list(zip([int(at[0]), *at[cut + 1].tolist()], [*(at[cut] + 1).tolist(), int(at[-1]) + 1]))


def panels(image: np.ndarray, ink: int = 200, gutter: float = 0.02, depth: int = 8, least: float = 0.01) -> pd.DataFrame:
    """Panels by cutting along empty gutters, rows before columns, again and again; from the top left."""
    mask = gray(image) < ink
    h, w = mask.shape
    gap = max(1, round(min(h, w) * gutter)) if h * w else 1
    found: list[tuple[float, float, float, float]] = []
    todo = [(0, 0, w, h, 0)] if h * w else []
    while todo:
        x, y, bw, bh, d = todo.pop()
        part = mask[y : y + bh, x : x + bw]
        rows, cols = part.any(1), part.any(0)
        if d < depth and len(r := runs(rows, gap)) > 1:
            todo += [(x, y + a, bw, b - a, d + 1) for a, b in r]
        elif d < depth and len(c := runs(cols, gap)) > 1:
            todo += [(x + a, y, b - a, bh, d + 1) for a, b in c]
        elif rows.any():
            a, b = np.flatnonzero(rows)[[0, -1]]
            l, r = np.flatnonzero(cols)[[0, -1]]
            found.append((float(x + l), float(y + a), float(r + 1 - l), float(b + 1 - a)))
    kept = sorted((b for b in found if b[2] * b[3] >= h * w * least), key=lambda b: (b[1], b[0]))
    return pd.DataFrame(kept, columns=["x", "y", "w", "h"])


def rotated(g: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned about the middle with bilinear samples."""
    h, w = g.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    cx, cy = (w - 1) / 2, (h - 1) / 2
    sx = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx
    sy = np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
    padded = np.pad(g.astype(float), 1, constant_values=fill)
    sx, sy = np.clip(sx + 1, 0, w), np.clip(sy + 1, 0, h)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    x1, y1 = np.minimum(x0 + 1, w + 1), np.minimum(y0 + 1, h + 1)
    return padded[y0, x0] * (1 - fx) * (1 - fy) + padded[y0, x1] * fx * (1 - fy) + padded[y1, x0] * (1 - fx) * fy + padded[y1, x1] * fx * fy


def skew_angle(image: np.ndarray, limit: float = 7.0, step: float = 1.0) -> float:
    """The turn that makes row sums change most sharply; the first on a tie."""
    g = gray(image)
    angles = [-limit + i * step for i in range(round(2 * limit / step) + 1)]
    return max(angles, key=lambda a: float(np.var(np.diff(rotated(g, a).sum(1)))))


def orientation(width: int, height: int) -> str:
    return "landscape" if width > height else "portrait" if height > width else "square"


def median3(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, [(1, 1), (1, 1)] + [(0, 0)] * (g.ndim - 2), mode="edge")
    h, w = g.shape[:2]
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def preprocessed(image: np.ndarray, deskew: bool = False, longest: int = 2000) -> tuple[np.ndarray, dict]:
    """Colour, skew, noise and size put right, and what was done."""
    ops, h, w = ["color"], *image.shape[:2]
    out = np.repeat(image[:, :, None], 3, 2) if image.ndim == 2 else image
    if deskew and (angle := skew_angle(out)):
        out = np.stack([rotated(out[:, :, c], angle) for c in range(3)], 2).astype(np.uint8)
        ops.append(f"deskew {angle:g}")
    out = median3(out)
    ops.append("denoise")
    scale = min(1.0, longest / max(h, w, 1))
    if scale < 1:
        y = np.minimum((np.arange(max(1, round(h * scale))) / scale).astype(int), h - 1)
        x = np.minimum((np.arange(max(1, round(w * scale))) / scale).astype(int), w - 1)
        out = out[y][:, x]
        ops.append("downscale")
    return out, {"ops": ops, "scale": scale, "source": (w, h), "size": (out.shape[1], out.shape[0]), "orientation": orientation(w, h)}


def letterbox(image: np.ndarray, size: int, fill: int = 0) -> tuple[np.ndarray, float, float, float]:
    """The image scaled into a square, with the scale and the padding left and above (unrounded: half the rest)."""
    h, w = image.shape[:2]
    scale = size / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    y, x = np.minimum((np.arange(nh) / scale).astype(int), h - 1), np.minimum((np.arange(nw) / scale).astype(int), w - 1)
    px, py = int((size - nw) / 2), int((size - nh) / 2)
    out = np.full((size, size, *image.shape[2:]), fill, np.uint8)
    out[py : py + nh, px : px + nw] = image[y][:, x]
    return out, scale, (size - nw) / 2, (size - nh) / 2


def crop(image: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """The box's pixels, at least one."""
    ih, iw = image.shape[:2]
    x0, y0 = min(max(0, round(x)), iw - 1), min(max(0, round(y)), ih - 1)
    return image[y0 : max(y0 + 1, min(ih, round(y + h))), x0 : max(x0 + 1, min(iw, round(x + w)))]


def ring_median(image: np.ndarray, x0: int, y0: int, x1: int, y1: int, border: int = 4) -> tuple[int, ...]:
    """Median colour just outside a box; white if nothing is there."""
    h, w = image.shape[:2]
    outer = np.zeros((h, w), bool)
    outer[max(0, y0 - border) : y1 + border, max(0, x0 - border) : x1 + border] = True
    outer[y0:y1, x0:x1] = False
    ring = image[outer]
    return tuple(int(round(v)) for v in np.median(ring.reshape(len(ring), -1), axis=0)) if len(ring) else (255,) * (1 if image.ndim == 2 else image.shape[2])


def masked(image: np.ndarray, boxes: list[tuple[int, int, int, int]], border: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The image with boxes (x0, y0, x1, y1) filled one after the other, and where; restore() undoes it."""
    out, layer = image.copy(), np.zeros(image.shape[:2], bool)
    for x0, y0, x1, y1 in boxes:
        out[y0:y1, x0:x1] = ring_median(out, x0, y0, x1, y1, border)
        layer[y0:y1, x0:x1] = True
    return out, layer


def restore(original: np.ndarray, cleaned: np.ndarray, layer: np.ndarray) -> np.ndarray:
    return np.where(layer if original.ndim == 2 else layer[:, :, None], original, cleaned)


def sample_page(number: int, width: int = 320, height: int = 480) -> np.ndarray:
    """A page that depends on its number alone: four panels with a block of strokes in each."""
    page = np.full((height, width), 255, np.uint8)
    rng = np.random.default_rng(number)
    for i in range(2):
        for j in range(2):
            x, y, w, h = 16 + j * (width // 2), 16 + i * (height // 2), width // 2 - 32, height // 2 - 32
            page[y : y + h, [x, x + 1, x + w - 2, x + w - 1]] = 0
            page[[y, y + 1, y + h - 2, y + h - 1], x : x + w] = 0
            bx, by = x + int(rng.integers(20, w - 70)), y + int(rng.integers(20, h - 60))
            for k in range(0, 36, 4):
                page[by + k : by + k + 2, bx : bx + 50] = 40
    return page


#: Pages whose rows leave a task together.
TOGETHER = 64


def over_images(images: DataFrame, function: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """function over images(page_id, png), a page at a time; its rows get the page's id. schema names its columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), TOGETHER):
                ids, pngs = b["page_id"].iloc[i : i + TOGETHER], b["png"].iloc[i : i + TOGETHER]
                found = [function(decode_png(png)) for png in pngs]
                got = pd.concat(found, ignore_index=True)
                got.insert(0, "page_id", np.repeat(ids.to_numpy(), [len(f) for f in found]))
                yield got

    return images.select("page_id", "png").mapInPandas(run, f"page_id long, {schema}")


def sample_pages(spark, count: int) -> DataFrame:
    """(page_id, png) of sample pages, made on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["id"], "png": [encode_png(sample_page(int(i))) for i in b["id"]]})

    return spark.range(count).mapInPandas(run, "page_id long, png binary")


def over_pages(images: DataFrame, rows: DataFrame, function: Callable[[np.ndarray, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function over each page's image, images(page_id, png), and its rows(page_id, ...); pages without rows get none of them."""

    def run(image: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if image.empty:
            return pd.DataFrame(columns=["page_id", *(c.split()[0] for c in schema.split(", "))])
        got = function(decode_png(image["png"].iloc[0]), mine)
        got.insert(0, "page_id", image["page_id"].iloc[0])
        return got

    return images.select("page_id", "png").groupBy("page_id").cogroup(rows.groupBy("page_id")).applyInPandas(run, f"page_id long, {schema}")


def mask_images(images: DataFrame, boxes: DataFrame, border: int = 4) -> DataFrame:
    """(page_id, png, mask): images with boxes(page_id, ord, x0, y0, x1, y1) filled in order, and what was filled."""

    def one(image: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
        some = rows.sort_values("ord")[["x0", "y0", "x1", "y1"]].astype(int).itertuples(index=False, name=None)
        clean, layer = masked(image, list(some), border)
        return pd.DataFrame({"png": [encode_png(clean)], "mask": [encode_png(layer.astype(np.uint8) * 255)]})

    return over_pages(images, boxes, one, "png binary, mask binary")


def composite_images(images: DataFrame, placements: DataFrame) -> DataFrame:
    """(page_id, png, overflow): images with placements, as typeset.fitted gives them, painted in the order of place.

    overflow counts those that do not fit at their least size.
    """
    from ..functions import typeset

    def one(image: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.repeat(image[:, :, None], 3, 2) if image.ndim == 2 else image
        over = 0
        for r in rows.sort_values("place").itertuples(index=False):
            style = typeset.PRESETS.get(r.preset, typeset.PRESETS["default"])
            lines, size, full = [(q["line"], q["x"], q["y"]) for q in r.lines], r.font_size, r.overflow
            over += bool(full)
            out = typeset.painted(out, r.x, r.y, r.w, r.h, lines, size, style)
        return pd.DataFrame({"png": [encode_png(out)], "overflow": [over]})

    return over_pages(images, placements, one, "png binary, overflow long")


def onnx_rows(images: DataFrame, model: str, size: int = 1024, providers: tuple[str, ...] = ("CPUExecutionProvider",)) -> DataFrame:
    """Raw rows (page_id, rn, x1, y1, x2, y2, score, cls), in the page's pixels, of a detection model in ONNX over images(page_id, png).

    The model takes (1, 3, size, size) in 0..1 and gives rows of six. Its file is sent to the executors, each worker opens
    it once. Unavailable if the runtime or the file is missing, so that with_fallback() can take another engine.
    """
    from pyspark import SparkFiles

    from .detect import Unavailable

    if importlib.util.find_spec("onnxruntime") is None:
        raise Unavailable("onnxruntime is not installed")
    if not os.path.exists(model):
        raise Unavailable(f"no model at {model}")
    images.sparkSession.sparkContext.addFile(model)
    name = os.path.basename(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(SparkFiles.get(name), providers=list(providers))
        port = session.get_inputs()[0].name
        for b in batches:
            for page_id, png in zip(b["page_id"], b["png"]):
                page = decode_png(png)
                boxed, scale, px, py = letterbox(np.repeat(page[:, :, None], 3, 2) if page.ndim == 2 else page, size)
                (rows, *_) = session.run(None, {port: boxed.astype(np.float32).transpose(2, 0, 1)[None] / 255})
                rows = np.asarray(rows, np.float64).reshape(-1, 6)
                rows[:, :4] = (rows[:, :4] - np.array([px, py, px, py])) / scale
                out = pd.DataFrame(rows, columns=["x1", "y1", "x2", "y2", "score", "cls"])
                out.insert(0, "rn", np.arange(1, len(out) + 1, dtype=np.int32))
                out.insert(0, "page_id", page_id)
                yield out

    return images.select("page_id", "png").mapInPandas(run, "page_id long, rn int, x1 double, y1 double, x2 double, y2 double, score double, cls double")
