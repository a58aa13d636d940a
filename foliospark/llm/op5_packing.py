"""Cost-balanced packing of token ids into sequences of bounded length.

The cost of a piece is estimated as linear * n + quadratic * n * n (attention inside the piece). Documents over
half a sequence are cut into even parts, as one piece that fills a sequence would cost the most there is. All
parts of a group are taken in descending length, each to the lowest-cost sequence with room for it. When none has
room, the part is cut to fill the lowest-cost sequences with any. A group has as many sequences as its tokens need,
so at most one of them is not full.

A group is what one task has read, about group_tokens at a time: no shuffle, and memory is bounded by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, documents, slices, texts_of
from .tokens import piece_ids, public_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: list[int], capacity: int, linear: float, quadratic: float, longest: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths, none over longest."""
    longest = longest or max(1, capacity // 2)
    total = sum(lengths)
    k = -(-total // capacity)
    parts = []
    for doc, n in enumerate(lengths):
        m = -(-n // longest)  # even parts: a small rest would lie beside long ones
        cuts = [i * n // m for i in range(m + 1)]
        parts += [(b - a, doc, a) for a, b in zip(cuts, cuts[1:])]
    room = np.full(k, capacity, np.int64)
    if total % capacity:
        room[-1] = total - (k - 1) * capacity  # the one sequence that stays short
    limit = room.copy()
    cost = np.zeros(k)
    out = []
    for n, doc, start in sorted(parts, key=lambda r: (-r[0], r[1], r[2])):
        while n:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                fits = np.flatnonzero(room > 0)
            seq = fits[np.argmin(cost[fits])]
            take = int(min(n, room[seq]))
            out.append((doc, start, take, int(seq), int(limit[seq] - room[seq])))
            room[seq] -= take
            cost[seq] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, group_tokens: int = 2_000_000) -> DataFrame:
    """A row for each piece of docs(doc_id, text): where it starts in its document and lies in its sequence.

    Every row has its own pieces, repeated rows and null ids too; a null or empty text has the end id alone.
    Only groups bound by tokens are held; a single longer document is a group. Other columns are not read.
    An empty table gives no row.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = piece_ids(tokenizer)
        end = end_id.to_bytes(4, "little")
        made = TaskContext.get().partitionId() << 33
        group: list[tuple] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            pieces = pack([len(x) // 4 for _, x in group], capacity, linear, quadratic)
            rows = [(group[d][0], s, n, zlib.crc32(group[d][1][4 * s : 4 * (s + n)]), len(group[d][1]) // 4, made + q, o) for d, s, n, q, o in pieces]
            made += 1 + max(q for *_, q, _ in pieces)
            group.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in SCHEMA.split(", ")])

        for b in slices(batches):
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts_of(b["text"])):
                group.append((doc_id, ids.encode(text) + end))
                tokens += len(group[-1][1]) // 4
                if tokens >= group_tokens:
                    yield flush()
                    tokens = 0
        if group:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_path())
