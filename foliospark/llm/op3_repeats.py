"""Repeated byte strings across documents, found with sparse enhanced suffix arrays.

Every string of `least` bytes holds a K-byte anchor that its content alone picks: the K-gram with the least hash
(all, if several tie). Two equal strings pick equal anchors at equal places, so they meet among the occurrences of
an anchor. For these the texts around them are sorted from the anchor on: a suffix array with common-prefix
lengths. A stack scan gives the tree of its intervals; within an interval the texts to the left are sorted
outwards and scanned the same way, and an interval of that with differing left extensions is a maximal repeat
around the anchor, with all its occurrences. Contexts reach as far as a string of `least` bytes around the anchor
can; the union of longer repeats' overlapping parts is the longer repeat.

Steps, each a table in the shared folder where a later step reads it twice:
anchors by hash -> those that occur again -> contexts of these by hash -> spans by document.
An anchor that a batch holds more than once is sent on once. An anchor of more than hot_batches batches is not
gathered at all: its strings of `least` bytes are grouped by their hashes, with map-side minima. (A group that large
does not fit one suffix array; the result is the same either way.)
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import Batch, mixed, repeated
from .common import bound_batches, by_bucket, discard, documents, slices, written

K = 32
NO_ID = -(1 << 63)
PAD = 0xFF  # no byte of UTF-8


def _sliding(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours: result i covers a[i : i + n]."""
    have, out = 1, a
    while have < n:
        step = min(have, n - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def pick_anchors(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors of all strings of least bytes inside these texts."""
    w = least - K + 1
    b = Batch.of(texts)
    n = len(b.data)
    if n < least + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - K + 1)
    h = b.hashes(at, at + K) | np.uint64(1)
    m = _sliding(h, w, np.minimum)  # m[i]: least hash in the string at i
    ends = b.bounds[1:] - 1  # of texts, without the line feed
    inside = np.zeros(len(m) + 1, np.int64)
    ok = ends - b.bounds[:-1] >= least
    np.add.at(inside, b.bounds[:-1][ok], 1)
    np.add.at(inside, ends[ok] - least + 1, -1)
    m[np.cumsum(inside[:-1]) <= 0] = 0  # strings that cross texts pick nothing
    padded = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(len(h) - len(m), np.uint64)])
    place = np.flatnonzero(_sliding(padded, w, np.maximum)[: len(h)] == h)
    text = b.doc_of(place)
    return text, place - b.bounds[text], h[place]


def pieces(texts: list[bytes], least: int, size: int) -> Iterator[tuple[list[int], list[int], list[tuple[int, int]], list[bytes]]]:
    """Batches of about size bytes: text numbers, offsets, ranges whose anchors count, and bytes. Long texts are cut with margins."""
    number, offset, core, data, held = [], [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t)), size):
            lo = max(0, a - least)
            part = t[lo : a + size + least]
            number.append(i)
            offset.append(lo)
            core.append((a, a + size))
            data.append(part)
            held += len(part)
            if held >= size:
                yield number, offset, core, data
                number, offset, core, data, held = [], [], [], [], 0
    if data:
        yield number, offset, core, data


def anchors_of(texts: list[bytes], least: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, hash) for each batch of pieces."""
    for number, offset, core, data in pieces(texts, least, size):
        piece, place, h = pick_anchors(data, least)
        place = place + np.array(offset, np.int64)[piece]
        lo, hi = np.array(core, np.int64)[piece].T if len(piece) else (place, place)
        keep = (place >= lo) & (place < hi)
        yield np.array(number, np.int64)[piece[keep]], place[keep], h[keep]


_CELL = np.dtype([("h", "<u8"), ("k", "<i8"), ("p", "<u4")])


def _scan(rows: DataFrame, least: int, buckets: int, size: int) -> DataFrame:
    """Anchors of rows(k, text) by bucket of their hash: blob of new ones, and of those met before in their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["k"].to_numpy()
            for text, place, h in anchors_of(batch["text"].cast(pa.binary()).to_pylist(), least, size):
                cell = np.zeros(len(h), _CELL)
                cell["h"], cell["k"], cell["p"] = h, keys[text], place
                more, later = repeated(h)
                new = cell[~later]
                where = (new["h"] >> np.uint64(8)) % np.uint64(buckets)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                out = [(b, 0, new[order[s:e]].tobytes()) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
                if more.any():  # they occur again, whatever others hold; dealt by their first document
                    out.append((int(cell["k"][0]) % buckets, 1, cell[more].tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))] if out else [pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "kind", "blob"])

    return rows.mapInArrow(run, "bucket int, kind int, blob binary")


def _again(hot_batches: int):
    """Of a bucket's anchors those that occur again: (k, p, h, hot); hot is -1 where only the batch knows."""

    def function(new: list[bytes], known: list[bytes]) -> Iterator[list]:
        if new:
            cell = np.frombuffer(b"".join(new), _CELL)
            order = np.argsort(cell["h"], kind="stable")
            h = cell["h"][order]
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            count = np.diff(edge).repeat(np.diff(edge))
            keep = order[(count > 1)]
            yield [cell["k"][keep], cell["p"][keep].astype(np.int64), cell["h"][keep].view(np.int64), (count[count > 1] > hot_batches).astype(np.int32)]
        for blob in known:
            cell = np.frombuffer(blob, _CELL)
            yield [cell["k"].copy(), cell["p"].astype(np.int64), cell["h"].view(np.int64) if cell["h"].flags.c_contiguous else cell["h"].copy().view(np.int64), np.full(len(cell), -1, np.int32)]

    return function


def contexts(data: bytes, place: np.ndarray, left: int, right: int) -> np.ndarray:
    """Bytes [p - left, p + right) for each place, padded outside the text."""
    padded = np.frombuffer(bytes([PAD]) * left + data + bytes([PAD]) * right, np.uint8)
    return padded[place[:, None] + np.arange(left + right)]


def _lcp(a: int, b: int, n: int) -> int:
    """Equal leading bytes of two n-byte strings given as big-endian numbers."""
    return n - (((a ^ b).bit_length() + 7) >> 3)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (length, first, last) of every interval of neighbours with a common prefix of that length.

    lcp[i] is shared by rows i and i + 1. Children come before parents.
    """
    stack: list[list[int]] = []
    for i, n in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            yield length, first, i
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append([n, first])


def maximal_repeats(rights: list[bytes], lefts: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, rows) of the maximal repeats of at least `least` bytes around a common place.

    rights: bytes from the place on; lefts: bytes before it, outwards; both padded with PAD. A repeat's rows all
    share left and right bytes, and no other row does; they differ in the next byte on either side, or reach the
    end of text or context.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    n, m = len(rights[0]), len(lefts[0])
    right = [int.from_bytes(rights[i], "big") for i in order]
    left = [int.from_bytes(x, "big") for x in lefts]
    size = [len(x.rstrip(b"\xff")) for x in lefts], [len(x.rstrip(b"\xff")) for x in rights]

    def shared(a: int, b: int, i: int, n: int, side: int) -> int:
        return min(_lcp(a, b, n), size[side][i])

    rank = {i: n for n, i in enumerate(order)}
    lcp = [shared(right[i], right[i + 1], order[i], n, 1) for i in range(len(order) - 1)]
    for r, first, last in intervals(lcp):
        if r + m < least:
            continue
        cuts = [p for p in range(first, last) if lcp[p] == r]
        rows = sorted(order[first : last + 1], key=lefts.__getitem__)
        more = [shared(left[a], left[b], a, m, 0) for a, b in zip(rows, rows[1:])]
        for l, s, e in intervals(more):
            if l + r < least:
                continue
            some = rows[s : e + 1]
            ranks = [rank[i] for i in some]
            at = bisect_left(cuts, min(ranks))
            if at < len(cuts) and cuts[at] < max(ranks):  # else all of them share the next byte on the right
                yield l, r, some


_SPAN = np.dtype([("k", "<i8"), ("t", "<i8"), ("s", "<i8"), ("e", "<i8")])


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each document, overlapping or touching ones as one."""
    if len(spans) < 2:
        return spans
    x = spans[np.lexsort((spans["s"], spans["t"], spans["k"]))]
    same = np.concatenate([[False], (x["k"][1:] == x["k"][:-1]) & (x["t"][1:] == x["t"][:-1])])
    base = np.cumsum(~same) * (int(x["e"].max()) + 2)  # documents apart on one line
    reach = np.maximum.accumulate(base + x["e"])
    new = np.concatenate([[True], base[1:] + x["s"][1:] > reach[:-1]])
    out = x[new]
    out["e"] = np.maximum.reduceat(base + x["e"], np.flatnonzero(new)) - base[new]
    return out


def _reduce(least: int, left: int, right: int):
    """Spans (k, t, start, end) that are later occurrences, from the contexts of a bucket."""
    cell = np.dtype([("h", "<u8"), ("k", "<i8"), ("t", "<i8"), ("p", "<u4"), ("c", f"V{left + right}")])

    def function(found: list[bytes], done: list[bytes]) -> Iterator[list]:
        for d in done:
            x = np.frombuffer(zstandard.decompress(d), _SPAN)
            yield [x[c].copy() for c in "ktse"]
        out = [np.zeros(0, _SPAN)]
        if found:
            x = np.concatenate([np.frombuffer(zstandard.decompress(d), cell) for d in found])
            x = x[np.lexsort((x["p"], x["t"], x["k"], x["h"]))]
            edge = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1], [True]]))
            got: list[tuple[int, int, int, int]] = []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if e - s < 2:
                    continue
                g = x[s:e]
                text = [c.tobytes() for c in g["c"]]
                keys = list(zip(g["k"].tolist(), g["t"].tolist(), g["p"].tolist()))
                reach: dict[int, int] = {}  # of a row, the furthest left so far: repeats come with right parts falling
                for l, r, rows in maximal_repeats([c[left:] for c in text], [c[:left][::-1] for c in text], least):
                    one = min(keys[i] for i in rows)
                    for i in rows:
                        if l > reach.get(i, -1) and keys[i] > one:
                            reach[i] = l
                            got.append((*keys[i][:2], keys[i][2] - l, keys[i][2] + r))
                if len(got) > 20_000:
                    out.append(merged(np.array(got, _SPAN)))
                    got = []
            out.append(np.array(got, _SPAN))
        all_ = merged(np.concatenate(out))
        yield [all_[c].copy() for c in "ktse"]

    return function


def find_spans(rows: DataFrame, least: int = 100, bucket_bytes: int | None = None, batch_bytes: int | None = None, hot_batches: int = 4096, copies: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(k, t, start, end) of strings of at least `least` bytes that also start earlier, for rows(k, t, n, text); and the
    tables that are read for it.

    copies(k, t): documents to leave out, as all their text is an earlier one's. Sizes grow with the input unless
    given, so that blobs, of which there is one for each batch and bucket, do not become many and tiny.
    """
    left, right = least - K, least
    total = rows.agg(F.sum("n")).first()[0] or 0
    bucket_bytes = bucket_bytes or max(8 << 20, total // 100_000)
    buckets = max(1, -(-total // bucket_bytes))
    batch_bytes = batch_bytes or min(64 << 20, max(1 << 19, 640 * buckets))
    # documents go by a hash of id and text here: rows of equal or null id stay apart; two that share it only get places too many
    long = rows.filter(F.col("n") >= least).withColumn("d", F.xxhash64("k", "t"))
    anchors = _scan(long.select(F.col("d").alias("k"), "text"), least, buckets, batch_bytes)
    found = written(by_bucket(anchors, buckets, _again(hot_batches), "d long, p long, h long, hot int"), "again")
    hot = written(found.filter("hot = 1").select("h").distinct(), "hot")
    flagged = found.join(hot.withColumn("is_hot", F.lit(1)), "h", "left")
    signed = F.when(F.col("is_hot").isNull(), F.col("p")).otherwise(-F.col("p") - 1)
    if copies is not None:
        flagged = flagged.join(copies.select(F.xxhash64("k", "t").alias("d")), "d", "left_anti")
    places = flagged.groupBy("d").agg(F.sort_array(F.collect_set(signed)).alias("places"))
    packed = long.select("d", "k", "t", "n", "text").mapInArrow(_compress, "d long, k long, t long, n long, z binary").join(places, "d")
    made = packed.mapInArrow(_contexts(least, left, right, buckets, batch_bytes), "bucket int, kind int, blob binary")
    some_hot = not hot.isEmpty()
    if some_hot:
        made = written(made, "contexts")  # read twice, and both times the same contexts must be the first of their batch
    spans = by_bucket(made.filter("kind < 2"), buckets, _reduce(least, left, right), "k long, t long, start long, end long")
    if not some_hot:
        return spans, [found, hot]
    windows = written(made.filter("kind = 2").mapInArrow(_windows, "w long, v long, k long, t long, start long"), "windows")
    first = written(windows.groupBy("w", "v").agg(F.min(F.struct("k", "t", "start")).alias("one")), "first")
    later = windows.join(first, ["w", "v"]).filter(F.struct("k", "t", "start") > F.col("one"))
    return spans.union(later.select("k", "t", "start", (F.col("start") + least).alias("end"))), [found, hot, made, windows, first]


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        data = [z.compress(t.as_buffer().to_pybytes()) for t in b["text"]]
        yield pa.record_batch([*(b[c] for c in b.schema.names if c != "text"), pa.array(data, pa.binary())], [*(c for c in b.schema.names if c != "text"), "z"])


_WINDOW = np.dtype([("w", "<i8"), ("v", "<i8"), ("k", "<i8"), ("t", "<i8"), ("s", "<i8")])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b["blob"].to_pylist():
            x = np.frombuffer(zstandard.decompress(blob), _WINDOW)
            yield pa.record_batch([pa.array(x[c].copy()) for c in "wvkts"], ["w", "v", "k", "t", "start"])


def _contexts(least: int, left: int, right: int, buckets: int, size: int):
    """From rows(k, t, n, z, places): contexts of anchors by bucket; equal ones of a batch but the first give spans here."""
    cell = np.dtype([("h", "<u8"), ("k", "<i8"), ("t", "<i8"), ("p", "<u4"), ("c", f"V{left + right}")])
    weights = mixed(np.arange(1, left + right + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        k, t, p, n, hot = (np.concatenate([x[i] for x in parts]) for i in range(5))
        c = np.concatenate([x[5] for x in parts])
        h = Batch.of([c.tobytes()])  # hashes of anchors by place, as in the first scan
        at = np.arange(len(c)) * (left + right) + left
        h = h.hashes(at, at + K) | np.uint64(1)
        out = []
        order = np.lexsort((p, t, k))
        whole = (c.astype(np.uint64) * weights).sum(1, dtype=np.uint64)
        _, later = repeated(whole[order])
        ahead = {w: i for w, i in zip(whole[order][::-1].tolist(), order[::-1].tolist())}
        later = np.array([bool(x) and bool((c[i] == c[ahead[int(whole[i])]]).all()) for x, i in zip(later, order)], bool)
        back = order[later]
        s, e = np.maximum(p[back] - left, 0), np.minimum(p[back] + right, n[back])
        one = np.array([ahead[int(whole[i])] for i in back], np.int64)
        good = (e - s >= least) & ~((k[back] == k[one]) & (t[back] == t[one]) & (p[back] == p[one]))
        spans = np.zeros(int(good.sum()), _SPAN)
        spans["k"], spans["t"], spans["s"], spans["e"] = k[back][good], t[back][good], s[good], e[good]
        spans = merged(spans)
        zip_ = zstandard.ZstdCompressor(level=1).compress
        if len(spans):
            out.append((int(abs(int(spans["k"][0])) % buckets), 1, zip_(spans.tobytes())))
        keep = order[~later]
        cold = keep[~hot[keep]]
        where = (h[cold] >> np.uint64(8)) % np.uint64(buckets)
        for b in np.unique(where).tolist():
            i = cold[where == b]
            x = np.zeros(len(i), cell)
            x["h"], x["k"], x["t"], x["p"] = h[i], k[i], t[i], p[i]
            x["c"] = c[i].view(f"V{left + right}")[:, 0]
            out.append((int(b), 0, zip_(x.tobytes())))
        warm = keep[hot[keep]]
        if len(warm):
            rows = []
            for i in warm.tolist():
                text = c[i].tobytes()
                for j in range(left + 1):
                    start = int(p[i]) - left + j
                    if start >= 0 and start + least <= n[i]:
                        d = hashlib.blake2b(text[j : j + least], digest_size=16).digest()
                        rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), k[i], t[i], start))
            out.append((0, 2, zip_(np.array(rows, _WINDOW).tobytes())))
        return pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for k, t, n, z, places in zip(b["k"].to_pylist(), b["t"].to_pylist(), b["n"].to_pylist(), b["z"].to_pylist(), b["places"]):
                data = zstandard.decompress(z)
                raw = places.values.to_numpy()
                for i in range(0, len(raw), 1 << 15):
                    some = raw[i : i + (1 << 15)]
                    hot = some < 0
                    p = np.where(hot, -some - 1, some)
                    fits = p + K <= n  # rows that share a key have each other's places
                    p, hot = p[fits], hot[fits]
                    parts.append((np.full(len(p), k, np.int64), np.full(len(p), t, np.int64), p, np.full(len(p), n, np.int64), hot, contexts(data, p, left, right)))
                    held += len(p) * (left + right)
                    if held >= 4 * size:
                        yield flush(parts)
                        parts, held = [], 0
        if held:
            yield flush(parts)

    return run


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, least: int = 100, **sizes: int) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every row of docs(doc_id, text).

    A byte goes if a string of least bytes around it also starts earlier: in a smaller doc_id (null is the
    smallest), for equal ids in the text of smaller hash, or earlier in the same text. Rows equal in id and text
    are one document, each reported. A null or empty text has no bytes. Other columns are not read; an empty
    table gives no row.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    # a document whose whole text is an earlier one's goes altogether; its own anchors add nothing new
    digest = rows.filter(F.col("n") >= least).select("k", "t", F.sha2("text", 256).alias("sha"))
    digest = written(digest, "digest")
    # the first of each text that is there more than once; both sides of the join are tables, so a hot text can be split
    first = written(digest.groupBy("sha").agg(F.min(F.struct("k", "t")).alias("one"), F.count("*").alias("m")).filter("m > 1").drop("m"), "first")
    copies = written(digest.join(first, "sha").filter(F.struct("k", "t") > F.col("one")).select("k", "t", F.lit(True).alias("copy")).distinct(), "copies")
    spans, worked_off = find_spans(rows, least, copies=copies, **sizes)
    spans = written(spans, "spans")
    discard(digest, first, *worked_off)
    merged_ = spans.groupBy("k", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    side = merged_.join(copies, ["k", "t"], "full")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for k, z, copy, spans in zip(b["k"].to_pylist(), b["z"].to_pylist(), b["copy"].to_pylist(), b["spans"].to_pylist()):
                data = zstandard.decompress(z)
                runs: list[list[int]] = [[0, len(data)]] if copy else []
                for s, e in [] if copy or not spans else sorted((x["start"], x["end"]) for x in spans):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                at, kept = 0, hashlib.sha256()
                for s, e in runs:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                out.append((None if k == NO_ID else k, len(data), sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 4, pa.string()])] if out else [pa.array([], t) for t in [*[pa.int64()] * 4, pa.string()]], [c.split()[0] for c in SCHEMA.split(", ")])

    packed = rows.mapInArrow(_compress, "k long, t long, n long, z binary").join(side, ["k", "t"], "left")
    return packed.select("k", "z", "copy", "spans").mapInArrow(cut, SCHEMA)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) b, octet_length(encode(coalesce(text, ''))) n from documents),
s as (select doc_id, n, b, unnest(range(1, greatest(n - 98, 1))) s from d),
w as (select doc_id, s, md5(b[s:s + 99]) h from s),
l as (select doc_id, s from (select *, row_number() over (partition by h order by doc_id, s) k from w) q where k > 1),
m as (select *, case when s > 100 + lag(s) over (partition by doc_id order by s) then 1 else 0 end cut from l),
g as (select doc_id, min(s) s, max(s) + 99 e from (select *, sum(cut) over (partition by doc_id order by s) run from m) q group by doc_id, run),
k as (select d.doc_id, coalesce(lag(g.e) over (partition by d.doc_id order by g.s), 0) + 1 a, g.s - 1 z, g.s from d join g on g.doc_id = d.doc_id
  union all select d.doc_id, coalesce(max(g.e), 0) + 1, d.n, d.n + 1 from d left join g on g.doc_id = d.doc_id group by d.doc_id, d.n),
o as (select d.doc_id, unhex(coalesce(string_agg(hex(d.b[k.a:k.z]), '' order by k.s) filter (k.z >= k.a), '')) kept from d join k on k.doc_id = d.doc_id group by d.doc_id)
select d.doc_id, d.n::bigint n_bytes, coalesce(r.removed, 0)::bigint n_removed, coalesce(r.spans, 0)::bigint n_spans, sha256(o.kept) kept_sha256
from d join o on o.doc_id = d.doc_id left join (select doc_id, sum(e - s + 1) removed, count(*) spans from g group by doc_id) r on r.doc_id = d.doc_id
"""
