"""Image files and archives of images as tables: names, sizes from headers, reasons for what is skipped."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import manifest_order, natural_order, placed

#: Suffixes of images and of archives.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "tif", "tiff")
ARCHIVE_SUFFIXES = ("cbz", "zip")

SCAN = "path string, name string, width int, height int, reason string"


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) from the header of a PNG, JPEG, WebP or TIFF; ValueError if it has none."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    raise ValueError("damaged JPEG")
                mark = data[at + 1]
                if mark in (0xFF,):
                    at += 1
                elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                else:
                    at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
            if kind == b"VP8L":
                bits = struct.unpack("<I", data[21:25])[0]
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            if kind == b"VP8X":
                return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[:4] in (b"II*\0", b"MM\0*"):
            e = "<" if data[:2] == b"II" else ">"
            at = struct.unpack(e + "I", data[4:8])[0]
            found = {}
            for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
                tag, kind, _ = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
                found[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), data[at + 10 + 12 * i : at + 10 + 12 * i + (2 if kind == 3 else 4)])[0]
            return found[256], found[257]
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError("damaged header") from e
    raise ValueError("no image")


def _row(path: str, name: str, data: bytes) -> tuple:
    try:
        w, h = image_size(data)
        return path, name, w, h, None
    except ValueError as e:
        return path, name, None, None, str(e)


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder: (path, name, width, height, reason); reason says why one cannot be read, null if it can."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    files = files.filter(suffix.isin(*IMAGE_SUFFIXES)).select("path", name.alias("name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_row(p, n, c) for p, n, c in zip(b["path"], b["name"], b["content"])], columns=["path", "name", "width", "height", "reason"]).astype({"width": "Int32", "height": "Int32"})

    return files.mapInPandas(run, SCAN)


def discovered(found: DataFrame, order: str = "natural", manifest: DataFrame | None = None) -> DataFrame:
    """(name, path, width, height, place, reason) of scanned images in the order of import; those that are left out have a reason.

    order: natural, name, or manifest with manifest(name, pos): listed ones first, then the others in natural order. A
    listed name without a file is a row of its own. Of files of one name the first path counts.
    """
    if order not in ("natural", "name", "manifest") or (order == "manifest") != (manifest is not None):
        raise ValueError("order is natural, name, or manifest with a manifest")
    first = Window.partitionBy("name").orderBy("path")
    marked = found.withColumn("_n", F.row_number().over(first)).withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > 1, "duplicate name"))).drop("_n")
    good = marked.filter("reason is null")
    if order == "name":
        places = placed(good.select("name"), F.col("name"), "place", [])
    elif order == "natural":
        places = natural_order(good, "name")
    else:
        places = manifest_order(good, manifest).filter("found").select("name", "place")
    listed = marked.join(places.withColumn("_good", F.lit(True)), "name", "left").withColumn("place", F.when(F.col("reason").isNull(), F.col("place")))
    out = listed.select("name", "path", "width", "height", "place", "reason")
    if manifest is None:
        return out
    lost = manifest.join(found, "name", "left_anti").select("name", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("place"), F.lit("listed but not found").alias("reason"))
    return out.unionByName(lost.distinct())


def archive_entries(data: bytes) -> list[tuple[str, bytes | None, str | None]]:
    """(name, content, reason) of an archive's images by base name; hidden files and other kinds are left out."""
    out, seen = [], set()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            parts = info.filename.split("/")
            name = parts[-1]
            if info.is_dir() or not name or name.startswith(".") or "__MACOSX" in parts or name.rpartition(".")[2].lower() not in IMAGE_SUFFIXES:
                continue
            if name in seen:
                out.append((name, None, "duplicate name"))
                continue
            seen.add(name)
            try:
                out.append((name, z.read(info), None))
            except (zipfile.BadZipFile, zlib.error, EOFError, OSError) as e:
                out.append((name, None, f"damaged entry: {e}"))
    return out


def scan_archives(spark: SparkSession, folder: str, contents: bool = False) -> DataFrame:
    """Images inside the archives of a folder, as scan_images has them; path names archive and entry.

    An archive that cannot be opened is a row with its reason. contents adds the images' bytes.
    """
    files = spark.read.format("binaryFile").load(folder)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    files = files.filter(suffix.isin(*ARCHIVE_SUFFIXES)).select("path", "content")
    names = ["path", "name", "width", "height", "reason", *(["content"] if contents else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, archive in zip(b["path"], b["content"]):
                rows = []
                try:
                    for name, data, reason in archive_entries(archive):
                        row = _row(f"{path}!{name}", name, data) if data is not None else (f"{path}!{name}", name, None, None, reason)
                        rows.append((*row, data if row[4] is None else None) if contents else row)
                except (zipfile.BadZipFile, EOFError, OSError) as e:
                    rows.append((path, path.rpartition("/")[2], None, None, f"damaged archive: {e}", *([None] if contents else [])))
                yield pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32"})

    return files.mapInPandas(run, SCAN + (", content binary" if contents else ""))


def encode_png(image: np.ndarray, level: int = -1) -> bytes:
    """PNG of a uint8 array (h, w) or (h, w, 3); level is zlib's, from fast (1) to small (9)."""
    h, w = image.shape[:2]
    kind = 0 if image.ndim == 2 else 2
    raw = np.pad(image.reshape(h, -1), ((0, 0), (1, 0))).tobytes()  # each row behind the number of its filter, none

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def _undone(kind: int, line: list[int], above: list[int], n: int) -> bytearray:
    """A row whose values are differences to the mean of left and above (3), or to the nearest of three neighbours (4)."""
    row = bytearray(len(line))
    for x, v in enumerate(line):
        a, c = (row[x - n], above[x - n]) if x >= n else (0, 0)
        b = above[x]
        if kind == 3:
            guess = (a + b) // 2
        else:
            to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
        row[x] = (v + guess) & 255
    return row


def decode_png(data: bytes) -> np.ndarray:
    """uint8 array of a PNG with 8 bits a sample, grey, RGB or RGBA (the last without its alpha), not interlaced."""
    w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", data[16:29])
    n = {0: 1, 2: 3, 6: 4}.get(kind)
    if depth != 8 or n is None or lace:
        raise ValueError("unsupported PNG")
    at, body = 8, b""
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += size + 12
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    plain = not raw[:, 0].any()
    out = raw[:, 1:] if plain else np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(0 if plain else h):
        line, f = raw[y, 1:], raw[y, 0]
        if f == 0:
            row = line
        elif f == 1:  # differences to the pixel on the left: running sums of each channel
            row = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).ravel()
        elif f == 2:
            row = line + above
        else:
            row = np.frombuffer(_undone(int(f), line.tolist(), above.tolist(), n), np.uint8)
        out[y] = above = row
    image = out.reshape(h, w, n)
    return image[:, :, 0] if n == 1 else image[:, :, :3]
