"""Token ids of documents as length-delimited binary records with masked checksums and a separate offset index.

Record: length of the payload (8 bytes), masked checksum of those 8 bytes (4), payload, masked checksum of the
payload (4), line feed. All integers are little-endian and unsigned. Payload: doc_id (signed, 8 bytes; the
least long for a null one), then the ids, two bytes each (four if the vocabulary needs them). A checksum is
CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data that holds checksums stays sound.

Files are written by Spark's own committer, so a lost executor leaves no half record and any file system of
Spark serves. The index (file, position, length, doc_id, first, n_tokens) is a Parquet table beside them: a
reader shuffles its rows and seeks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_path, small_batches
from .tokens import piece_ids, public_path

#: Fixed value: what masking adds to a rotated checksum.
MASK = 0xA282EAD8
NULL_ID = -(1 << 63)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)), b"\n"))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, payload) of the records of one file; ValueError at a wrong checksum or a cut record."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        if len(head) < 8 or struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(head):
            raise ValueError(f"damaged length at {at}")
        (n,) = struct.unpack("<Q", head)
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n or data[at + 12 + n : at + 17 + n] != struct.pack("<I", masked(payload)) + b"\n":
            raise ValueError(f"damaged record at {at}")
        yield at, payload
        at += n + 17


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int | None = None, width: int = 2) -> None:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order, null ids first, about shard_bytes of text a file.

    Unless given, a file takes 24 MB, and more from 2.4 TB of text on, up to 256 MB: a reader holds a file at a time.

    A null or empty text has the end id alone. Rows of one doc_id are ordered by a hash of their text, then the
    text; a doc_id with very many rows is spread over files by that hash. An empty table gives no file.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (shard_bytes or min(256 << 20, max(24 << 20, total // 100_000)))))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    kind = {2: "<u2", 4: "<u4"}[width]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = piece_ids(tokenizer)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                found = np.frombuffer(ids.encode(text), "<u4")
                key = struct.pack("<q", NULL_ID if doc_id is None else doc_id)
                out.append(frame(key + np.append(found, end_id).astype(kind).tobytes()))
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    # the text writer copies the bytes of a string as they are and ends each row with a line feed, part of the record here
    made = rows.mapInArrow(encode, "value binary").select(F.substring("value", 1, F.length("value") - 1).cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        made.write.option("compression", "none").text(f"{path}/records")


def read_records(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Index of the records of all files, from the files: checks every checksum and counts ids.

    Columns: shard int (files in doc_id order), file, position and length (bytes of the record), doc_id, first
    (ids before it in its file), n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers).
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    names = ["shard", "file", "position", "length", "doc_id", "first", "n_tokens", "ids_crc32"]
    schema = "shard int, file string, position long, length long, doc_id long, first long, n_tokens long, ids_crc32 long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, file, content in zip(b["shard"].to_pylist(), b["path"].to_pylist(), b["content"]):
                rows, first = [], 0
                for at, payload in frames(content.as_buffer().to_pybytes()):
                    ids = np.frombuffer(payload, kind, offset=8)
                    (doc_id,) = struct.unpack_from("<q", payload)
                    rows.append((shard, file, at, len(payload) + 17, None if doc_id == NULL_ID else doc_id, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    first += len(ids)
                kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").filter("length > 0")
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return files.select(number.alias("shard"), "path", "content").mapInArrow(scan, schema)


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files back and writes their index beside them."""
    found = read_records(spark, path)
    with small_batches(spark, rows=1):  # one file at a time
        found.write.parquet(f"{path}/index")
    return spark.read.schema(found.schema).parquet(f"{path}/index")


def read_shuffled(index: DataFrame, path: str, seed: int = 42, width: int = 2) -> DataFrame:
    """(doc_id, ids) of all records in an order drawn by seed: each is cut out of its file by the index."""
    kind = {2: "<u2", 4: "<u4"}[width]
    files = index.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select(F.col("path").alias("file"), "content")
    listed = index.groupBy("file").agg(F.collect_list(F.struct("position", "length")).alias("records"))  # of one file
    each = files.join(listed, "file").select("file", "content", F.explode("records").alias("r"))
    cut = each.select(F.xxhash64(F.lit(seed), "file", "r.position").alias("key"), F.substring("content", F.col("r.position").cast("int") + 1, F.col("r.length").cast("int")).alias("record"))
    drawn = cut.repartitionByRange("key").sortWithinPartitions("key").select("record")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [next(frames(r))[1] for r in b["record"].to_pylist()]
            names = [struct.unpack_from("<q", p)[0] for p in found]
            ids = [np.frombuffer(p, kind, offset=8).astype(np.int64) for p in found]
            yield pa.record_batch([pa.array([None if n == NULL_ID else n for n in names], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return drawn.mapInArrow(parse, "doc_id long, ids array<long>")


def starts(index: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before it, from the totals of the files before its own."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return index.join(totals.select("shard", F.coalesce(before, F.lit(0)).alias("base")), "shard").withColumn("start", F.col("base") + F.col("first"))


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "op7")
    write_records(documents(spark, sf_dir), path, public_path())
    index = write_index(spark, path)
    return starts(index).select("doc_id", "start", "n_tokens", "ids_crc32")
