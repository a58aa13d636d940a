"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit b is 1 if it is set in over half the hashes of the text's word shingles, repeats
included. For radius r every bit position gets a fixed vector of r + 1 bits, and each non-zero vector v of r + 1
bits gives a mask that keeps the positions whose vector has an odd product with v. Any r positions leave some v
orthogonal to all of theirs, so two fingerprints that differ in at most r bits agree under some mask: no pair
within the radius is missed. There are 2**(r + 1) - 1 tables, one a mask.

Texts with equal fingerprints are one class, whatever their number; only classes meet in the tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocked, grouped, pairs_meet, roots
from .common import components, discard, documents, slices, written

SEED = 42  # of XXH64


def masks(radius: int, seed: int = 1) -> list[int]:
    """The masks of a radius as signed 64-bit integers; position vectors are drawn with a fixed seed."""
    rng = np.random.default_rng(seed)
    while True:
        vectors = rng.integers(1, 1 << (radius + 1), 64)
        kept = [[p for p in range(64) if int(v & vectors[p]).bit_count() & 1] for v in range(1, 1 << (radius + 1))]
        usual = 64 * (1 << radius) / ((2 << radius) - 1)
        if all(abs(len(k) - usual) <= 8 for k in kept):  # neither too few bits to tell texts apart nor too many to be alike
            return [int(np.uint64(sum(1 << p for p in k)).astype(np.int64)) for k in kept]


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of a text in UTF-8: A-Z lower-cased, words joined by one blank.

    A text of fewer words is one shingle; one without words has none.
    """
    words = text.lower().split()  # for bytes: A-Z alone, and blanks are U+0020 and U+0009..U+000D
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """The majority of each bit, as a signed integer; zero for no hash."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), chunk):
        part = hashes[i : i + chunk].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fingerprint fp (long) of every row of docs(doc_id, text); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marks = [fingerprint(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle)) for t in b["text"]]
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(marks, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def within(radius: int):
    """A function for grouped(): links of classes (fp, rep) at most radius bits apart, as (u, v) to the least rep."""

    def links(group: dict, bi: int, bj: int, own: np.ndarray) -> dict[str, np.ndarray] | None:
        fp, rep = group["fp"].to_numpy().view(np.uint64), group["rep"].to_numpy()
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        if (meet := pairs_meet(own, bi, bj)) is not None:
            near &= meet
        root = roots(near, rep)
        moved = root != rep
        return {"u": rep[moved], "v": root[moved]} if moved.any() else None

    return links


def link_fingerprints(classes: DataFrame, radius: int = 3, limit: int = 1024) -> DataFrame:
    """Links (u, v) of classes(fp, rep) that span the components of "at most radius bits apart".

    A bucket over limit classes is compared in blocks: none is cut or dropped.
    """
    table = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius))])
    dealt = classes.select(F.explode(table).alias("key"), "fp", "rep")
    return grouped(blocked(dealt, "key", "rep", limit, dealt.select("key")), "key", ["fp", "rep"], "u long, v long", within(radius))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (least doc_id that links reach, itself included) of every row of docs.

    A null or empty text, or one without words, has fingerprint zero and is linked like any other. Rows that
    repeat a doc_id are kept. A row with a null doc_id links others like any row but names no component; where no
    row of a component has an id, its component_id is null. Other columns are not read; an empty table gives no row.
    """
    signs = written(signed(docs, shingle), "simhash")
    classes = written(signs.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(link_fingerprints(classes.select("fp", F.col("fp").alias("rep")), radius))  # a class is named by its fingerprint
    joined = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return signs.join(joined.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Bytes of a hash that a set carries: two texts of 400 shingles each get one in common by chance in 1.5e-7 of cases.
CARRIED = 5


def carried(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CARRIED].tobytes()


def as_set(data: bytes) -> np.ndarray:
    """The distinct numbers that carried() kept."""
    out = np.zeros((len(data) // CARRIED, 8), np.uint8)
    out[:, :CARRIED] = np.frombuffer(data, np.uint8).reshape(-1, CARRIED)
    return np.unique(out.view("<u8")[:, 0])


def _hashes(text: pa.BinaryScalar | pa.StringScalar, shingle: int) -> np.ndarray:
    return shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle)


def shingle_set(text: pa.BinaryScalar | pa.StringScalar, shingle: int) -> np.ndarray:
    return np.unique(_hashes(text, shingle))


def minima(hashes: np.ndarray, lanes: int, chunk: int = 1 << 12) -> np.ndarray:
    """The least of the hashes under each of `lanes` fixed mixings of 64-bit numbers."""
    rng = np.random.default_rng(5)
    salt, factor = rng.integers(0, 1 << 64, (2, lanes, 1), np.uint64)
    factor |= np.uint64(1)
    least = np.full(lanes, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), chunk):
        np.minimum(least, ((hashes[None, i : i + chunk] ^ salt) * factor).min(1), out=least)
    return least


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    low, high = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist()
    return low, high


def _sets(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a 128-bit digest (a, b) of the text's set of shingles, its size, its fingerprint and the keys of its bands, of every row.

    A band is `rows` minima. tags has the low byte of each minimum. A set without shingles has no keys.
    """
    lanes = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text in b["text"]:
                every = _hashes(text, shingle)
                fp, h = fingerprint(every), np.unique(every)
                low, high = _digest(h)
                if not len(h):
                    out.append((low, high, 0, fp, [], b""))
                    continue
                least = minima(h, lanes).astype("<u8")
                keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(bands, rows))]
                out.append((low, high, len(h), fp, np.array(keys, np.uint64).view(np.int64), (least >> np.uint64(32)).astype(np.uint8).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "a", "b", "size", "fp", "keys", "tags"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a long, b long, size int, fp long, keys array<long>, tags binary")


def _near_marks(classes: DataFrame, radius: int) -> DataFrame:
    """(u, v): each of classes(rep, fp) and the least of its fingerprint; and that one and the least that the covering masks bring it to."""
    marks = written(classes.groupBy("fp").agg(F.min("rep").alias("rep")), "marks")
    alike = classes.select("fp", F.col("rep").alias("u")).join(marks, "fp").filter("u <> rep").select("u", F.col("rep").alias("v"))
    return alike.union(link_fingerprints(marks, radius).select("u", "v"))


def _with_sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(rep, hashes): the sets of shingles, as carried(), of classes(rep, first, a, b): first is the id of a text, a and b its digest.

    Texts are found by their id alone, in a table of ids that is as small as it can be; where an id has several texts, the
    digest of their sets tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(text, shingle) for text in b["text"]]
            low, high = zip(*map(_digest, sets)) if sets else ((), ())
            columns = [b["doc_id"].cast(pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([carried(h) for h in sets], pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "a", "b", "hashes"])

    ids = written(classes.select(F.col("first").alias("doc_id")).distinct(), "first")
    found = docs.select("doc_id", "text").join(ids, "doc_id").mapInArrow(run, "doc_id long, a long, b long, hashes binary")
    once = found.groupBy("doc_id", "a", "b").agg(F.first("hashes").alias("hashes"))
    return once.join(classes.select("rep", F.col("first").alias("doc_id"), "a", "b"), ["doc_id", "a", "b"]).select("rep", "hashes")


def _tested(sets: DataFrame, stars: DataFrame, similarity: float) -> DataFrame:
    """Those of stars(u, v) of ids whose sets(rep, hashes) of shingles share `similarity` or more of their union."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                x, y = as_set(x), as_set(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.record_batch([b["u"], b["v"], pa.array(good, pa.bool_())], ["u", "v", "good"])

    both = stars.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    return both.mapInArrow(share, "u long, v long, good boolean").filter("good").select("u", "v")


def least_matches(similarity: float, lanes: int, risk: float = 1e-9) -> int:
    """The most equal minima of `lanes` that a pair of `similarity` falls short of with a chance of at most risk."""
    short, n = 0.0, 0
    while n < lanes and (short := short + math.comb(lanes, n) * similarity**n * (1 - similarity) ** (lanes - n)) <= risk:
        n += 1
    return n


def _open(similarity: float, lanes: int):
    """A function for grouped(): the classes that have another in their cell, of a different component, that sizes and minima do not rule out."""
    least = least_matches(similarity, lanes)

    def some(group: dict, bi: int, bj: int, own: np.ndarray) -> dict[str, np.ndarray] | None:
        rep, comp, size = (group[c].to_numpy() for c in ("rep", "comp", "size"))
        near = np.triu(comp[:, None] != comp[None, :])
        near &= np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :])
        if (meet := pairs_meet(own, bi, bj)) is not None:
            near &= meet
        u, v = np.nonzero(near)
        if not len(u):
            return None
        tags = np.frombuffer(b"".join(group["tags"].to_pylist()), np.uint8).reshape(-1, lanes)
        rows = np.zeros(len(rep), bool)
        for i in range(0, len(u), 65536):
            x, y = u[i : i + 65536], v[i : i + 65536]
            good = (tags[x] == tags[y]).sum(1) >= least
            rows[x[good]] = rows[y[good]] = True
        return {"cell": group["cell"].to_numpy()[rows], "rep": rep[rows], "size": size[rows]} if rows.any() else None

    return some


def shared(sets: list[np.ndarray], width: int = 1 << 12) -> np.ndarray:
    """How many hashes each two sets have in common, from products of incidence matrices of `width` hashes at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = count > 1  # others are in one set alone
    number = np.cumsum(many) - 1
    keep = many[place]
    row, column = row[keep], number[place[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, int(many.sum()) + width, width))
    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = np.zeros((len(sets), width), np.float32)
        part[row[s:e], column[s:e] - k * width] = 1
        out += part @ part.T
    return out


def _similar(similarity: float):
    """A function for grouped(): links of classes (rep, hashes) that share `similarity` or more, as (u, v) to the least rep reached."""

    def links(group: dict, bi: int, bj: int, own: np.ndarray) -> dict[str, np.ndarray] | None:
        rep = group["rep"].to_numpy()
        sets = [as_set(x) for x in group["hashes"].to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        both = shared(sets).astype(np.float64)
        near = both >= similarity * (size[:, None] + size[None, :] - both)
        if (meet := pairs_meet(own, bi, bj)) is not None:
            near &= meet
        root = roots(near, rep)
        moved = root != rep
        return {"u": rep[moved], "v": root[moved]} if moved.any() else None

    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 30, rows: int = 3, limit: int = 1024, block_hashes: int = 1 << 19, radius: int = 3) -> DataFrame:
    """(doc_id, keep) of docs(doc_id, text) with an id: keep is the least id of the document's group.

    Texts with one set of word shingles are a class; so are all null texts and those without a word. Classes whose fingerprints
    are equal, or at most `radius` bits apart, are brought together by the covering masks. As most pairs of 0.8 are
    further apart, that is not all: classes also meet in a
    cell where all `rows` minima of one of `bands` bands of their sets agree, which a pair of similarity s does in
    none of them with a chance of (1 - s**rows)**bands: 4e-10 at 0.8. A link holds if the sets themselves share
    `similarity` or more of their union. Each class is first tested with the least that the masks bring it to and with the least of each cell, so that large groups
    become components without all their pairs. Then the classes of a cell that have another there, of a different
    component, that sizes and minima do not rule out (a true pair with a chance of at most 1e-9) are compared, in
    blocks of at most about block_hashes shingles, and only links to the least class reached in a block leave it: no
    pairs are listed. Repeated rows change nothing; rows that share an id and differ in text are texts of their own, each with the
    group of its text. Other columns are not read, an empty table gives no row.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    signs = written(_sets(docs, shingle, bands, rows), "signs")
    classes = signs.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("tags").alias("tags"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a name that two texts of one id do not share
    dealt = classes.select(F.explode("keys").alias("key"), "rep")
    least = dealt.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    in_cells = dealt.join(least, "key").filter("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    stars = written(_near_marks(classes.filter("size > 0"), radius).union(in_cells).distinct(), "stars")
    ids = stars.select(F.col("u").alias("rep")).union(stars.select("v")).distinct()
    wanted = written(classes.join(ids, "rep", "left_semi").select("rep", "first", "a", "b"), "ids")
    sets = written(_with_sets(docs, wanted, shingle), "sets")  # of all classes that meet another in a cell
    links = written(_tested(sets, stars, similarity), "links", 4 << 20)
    comp = written(classes.join(components(links), F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp"), "size", "tags", "keys"), "comp")
    dealt = comp.select(F.explode("keys").alias("key"), "rep", "comp", "size", "tags")
    apart = dealt.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    open_ = written(dealt.join(apart, "key", "left_semi").withColumn("cell", F.col("key")), "open")
    doubtful = grouped(blocked(open_, "key", "rep", limit, open_.select("key")), "key", ["cell", "rep", "comp", "size", "tags"], "cell long, rep long, size int", _open(similarity, bands * rows))
    doubtful = written(doubtful.distinct().withColumnRenamed("cell", "key"), "doubtful")
    discard(open_)
    dealt = blocked(doubtful.join(sets, "rep"), "key", "rep", limit, doubtful.select("key", "size"), "size", block_hashes)
    more = written(grouped(dealt, "key", ["rep", "hashes"], "u long, v long", _similar(similarity)), "more", 4 << 20)
    discard(sets, doubtful)
    labels = components(links.union(more))
    known = written(classes.join(labels, F.col("rep") == F.col("node"), "left").select("a", "b", "first", F.coalesce("component", "rep").alias("comp")), "known")
    known = known.join(known.groupBy("comp").agg(F.min("first").alias("keep")), "comp").select("a", "b", "keep")
    discard(stars, links, comp, more, wanted)
    return signs.join(known, ["a", "b"]).select("doc_id", "keep")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash_components(documents(spark, sf_dir))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
