"""Quality rules: how much of a text lies inside repeated n-grams of words and repeated lines.

Rolling hashes of n-grams of several lengths over a whole batch of texts in numpy: one prefix sum of word hashes times
the powers of a base gives the hash of every window as a difference, at the same cost for any length. An n-gram counts
as repeated if it occurs more than once in its text; characters of words in such windows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytesets import Batch, mixed, powers, repeated
from .common import bound_batches, documents, slices

#: n-gram length -> the largest share of characters that may lie in repeated n-grams.
SHARES = {3: 0.6, 5: 0.4, 8: 0.3, 10: 0.25}
#: The largest share of characters on lines equal to an earlier line, and of such lines.
LINE_CHARS, LINE_COUNT = 0.3, 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in SHARES)
)


#: An odd multiplier of word hashes and its inverse modulo 2**64.
ROLL = 0xC2B2AE3D27D4EB4F
ROLL_INV = pow(ROLL, -1, 1 << 64)


def line_groups(texts: list[bytes], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """(text, whole lines of it) in groups of about size bytes. Only a longer line makes a larger piece."""
    group, held = [], 0
    for i, t in enumerate(texts):
        at = 0
        while at == 0 or at < len(t):
            to = len(t) if len(t) - at <= size else t.rfind(b"\n", at, at + size)
            if to < 0:
                to = t.find(b"\n", at + size)
            to = len(t) if to < 0 else to
            group.append((i, t[at:to]))
            held += to - at + 1
            at = to + 1
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def measure(texts: list[bytes], size: int = 4 << 20) -> dict[str, np.ndarray]:
    """The counts and shares of each text. Bytes are looked at in groups of about size; of a text its words and lines are held."""
    n = len(texts)
    none = np.zeros(0, np.int64)
    words, lines, symbols = [(none, none.astype(np.uint64), none)], [(none, none.astype(np.uint64), none)], np.zeros(n, np.int64)
    for group in line_groups(texts, size):
        of, b = np.array([i for i, _ in group]), Batch.of([t for _, t in group])
        chars = b.chars()
        start, end = b.words()
        words.append((of[b.doc_of(start)], b.hashes(start, end), chars[end] - chars[start]))
        np.add.at(symbols, of, np.add.reduceat(_SYMBOL[b.data].astype(np.int64), b.bounds[:-1]))
        first, last = b.lines()
        has = np.zeros(len(first), bool)
        has[np.searchsorted(last, start, side="right")] = True  # a line with a word
        first, last = first[has], last[has]
        lines.append((of[b.doc_of(first)], b.hashes(first, last), chars[last] - chars[first]))
    doc, word, chars = (np.concatenate(x) for x in zip(*words))
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, chars, n).astype(np.int64), "n_symbols": symbols}
    salt = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.maximum(out["word_chars"], 1)
    rolled = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * powers(ROLL, len(word)), dtype=np.uint64)])
    for k in sorted({8, *SHARES}):
        inside = np.zeros(len(word) + 1, np.int64)
        m = len(word) - k + 1
        if m > 0:
            h = (rolled[k:] - rolled[:m]) * powers(ROLL_INV, m)  # of the window at each word, whatever its length
            at = np.flatnonzero(doc[:m] == doc[k - 1 :])  # windows inside one text
            more, _ = repeated(mixed(h[at]) ^ salt[doc[at]])
            inside[:m][at[more]] += 1
            inside[k : k + m][at[more]] -= 1
        covered = np.cumsum(inside[:-1]) > 0
        if k == 8:
            out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
        if k in SHARES:
            out[f"dup_{k}gram_share"] = np.bincount(doc[covered], chars[covered], n) / total
    doc, line, chars = (np.concatenate(x) for x in zip(*lines))
    _, later = repeated(line ^ salt[doc])
    n_lines = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[later], minlength=n)
    out["dup_line_share"] = np.bincount(doc[later], chars[later], n) / np.maximum(np.bincount(doc, chars, n), 1)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    good = (out["dup_line_share"] <= LINE_CHARS) & (out["n_dup_lines"] <= LINE_COUNT * n_lines)
    for k, most in SHARES.items():
        good &= out[f"dup_{k}gram_share"] <= most
    out["kept"] = ~out["base_failed"] & good
    return out


def quality(docs: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Counts, shares and verdict of every row of docs(doc_id, text).

    A null or empty text has no words and fails the base rule. Rows are independent; repeated rows, ties and
    null ids pass through, other columns are not read, an empty table gives no row. About batch_bytes of texts
    are held at a time, or one longer text with the hashes of its words.
    """
    bound_batches(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch["doc_id"], [b"" if t is None else t for t in batch["text"].cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= batch_bytes):
                    held += len(texts[to])
                    to += 1
                got = measure(texts[at:to])
                yield pa.record_batch([ids.slice(at, to - at).cast(pa.int64()), *[pa.array(got[c]) for c in names[1:]]], names)
                at = to

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g3 as (select doc_id, i, count(*) over (partition by doc_id, key) c from (select doc_id, i, array_to_string(w[i:i + 2], ' ') key from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) i from d) q) q2),
c3 as (select g.doc_id, count(*) n, sum(length(d.w[g.j])) chars from (select distinct doc_id, unnest(range(i, i + 3)) j from g3 where c > 1) g join d on d.doc_id = g.doc_id group by g.doc_id),
g5 as (select doc_id, i, count(*) over (partition by doc_id, key) c from (select doc_id, i, array_to_string(w[i:i + 4], ' ') key from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) i from d) q) q2),
c5 as (select g.doc_id, count(*) n, sum(length(d.w[g.j])) chars from (select distinct doc_id, unnest(range(i, i + 5)) j from g5 where c > 1) g join d on d.doc_id = g.doc_id group by g.doc_id),
g8 as (select doc_id, i, count(*) over (partition by doc_id, key) c from (select doc_id, i, array_to_string(w[i:i + 7], ' ') key from (select doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) i from d) q) q2),
c8 as (select g.doc_id, count(*) n, sum(length(d.w[g.j])) chars from (select distinct doc_id, unnest(range(i, i + 8)) j from g8 where c > 1) g join d on d.doc_id = g.doc_id group by g.doc_id),
g10 as (select doc_id, i, count(*) over (partition by doc_id, key) c from (select doc_id, i, array_to_string(w[i:i + 9], ' ') key from (select doc_id, w, unnest(range(1, greatest(len(w) - 8, 1))) i from d) q) q2),
c10 as (select g.doc_id, count(*) n, sum(length(d.w[g.j])) chars from (select distinct doc_id, unnest(range(i, i + 10)) j from g10 where c > 1) g join d on d.doc_id = g.doc_id group by g.doc_id),
l as (select doc_id, line, row_number() over (partition by doc_id, line order by i) k from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from d) q
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
n as (select doc_id, count(*) lines, sum(length(line)) chars, count(*) filter (k > 1) dup, coalesce(sum(length(line)) filter (k > 1), 0) dup_chars from l group by doc_id),
m as (select d.doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols,
    coalesce(n.dup, 0) n_dup_lines, coalesce(c8.n, 0) n_repeat_words, len(w) < 20 or 100 * coalesce(c8.n, 0) > 30 * len(w) base_failed,
    coalesce(n.dup_chars, 0)::double / greatest(coalesce(n.chars, 0), 1) dup_line_share, coalesce(c3.chars, 0)::double as s3, coalesce(c5.chars, 0)::double as s5, coalesce(c8.chars, 0)::double as s8, coalesce(c10.chars, 0)::double as s10, coalesce(n.lines, 0) lines
  from d left join n on n.doc_id = d.doc_id left join c3 on c3.doc_id = d.doc_id left join c5 on c5.doc_id = d.doc_id left join c8 on c8.doc_id = d.doc_id left join c10 on c10.doc_id = d.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_share,
  s3 / greatest(word_chars, 1) dup_3gram_share, s5 / greatest(word_chars, 1) dup_5gram_share, s8 / greatest(word_chars, 1) dup_8gram_share, s10 / greatest(word_chars, 1) dup_10gram_share,
  not base_failed and dup_line_share <= 0.3 and n_dup_lines <= 0.3 * lines and s3 / greatest(word_chars, 1) <= 0.6 and s5 / greatest(word_chars, 1) <= 0.4
    and s8 / greatest(word_chars, 1) <= 0.3 and s10 / greatest(word_chars, 1) <= 0.25 kept
from m
"""
