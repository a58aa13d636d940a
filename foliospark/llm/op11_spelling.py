"""Spelling variants by a symmetric-delete join.

Words are the lower-cased runs of letters that occur often enough. Every word emits itself and its single deletions as
keys; words that share a key are brought together by it. What they share decides exactly whether they are one edit
apart, so nothing has to be compared pair by pair:

- words that share a deletion at the same place differ there alone: one replaced code point. Such a group has at
  most one word for each letter; a word's near words in it are its size less one, and the best of them is its first
  or second, so no pairs leave it.
- a word that is a deletion of another is one inserted or deleted code point away. A word emits each distinct deletion
  once for this (the first place of a run of equal letters), so these links are at most as many as the keys.

Keys are the letters themselves, so a shared key is an equal string. Keys of over LITERAL code points, whose number
times length would grow with the square of a word's length, are SHA-256 digests of two chains, over what is before the
place and what is behind it; such words are carried by the digest of their own, and links to them get their
text back before they are ordered.

A word's form is its best near word if that is frequent enough; roots are found by doubling the step along forms
until none moves. A form occurs ten times as often as its word, so chains are short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, slices, written

#: A run of letters; keys of at most LITERAL code points are kept as they are.
LETTER, LITERAL = r"[A-Za-zÀ-ÿ]", 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = "key string, pos int, letter string, first boolean, name string, n long"


def lowered(run: Column) -> Column:
    """A-Z alone in lower case."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def misspelt(doc_id: Column, run: Column, modulus: int) -> Column:
    """run without one code point, where the checksum of id and run is divisible by modulus."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, modulus: int = 31) -> DataFrame:
    """(word, n): words of docs(doc_id, text) of at least least_length code points that occur least_count times or more.

    A null or empty text has no word; a null doc_id counts as the empty text in the checksum; repeated rows count each.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select(misspelt(F.col("doc_id"), lowered(F.col("run")), modulus).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keys_short(words: DataFrame) -> DataFrame:
    """Keys of words of at most LITERAL code points; place -1 is the word itself."""
    w = F.col("word")

    def without(i: Column) -> Column:
        letter = F.substring(w, i + 1, F.lit(1))
        key = F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w)))
        return F.struct(key.alias("key"), i.alias("pos"), letter.alias("letter"), ((i == 0) | (F.substring(w, i, F.lit(1)) != letter)).alias("first"))

    own = F.struct(w.alias("key"), F.lit(-1).alias("pos"), F.lit("").alias("letter"), F.lit(False).alias("first"))
    emitted = F.concat(F.array(own), F.transform(F.sequence(F.lit(0), F.length(w) - 1), without))
    return words.select(F.explode(emitted).alias("k"), F.col("word").alias("name"), "n").select("k.*", "name", "n")


def _chain(letters: list[bytes]) -> list[bytes]:
    """Digests of the first 0, 1, 2, .. letters."""
    out = [b""]
    for x in letters:
        out.append(hashlib.sha256(out[-1] + x).digest())
    return out


def _long_rows(word: str, n: int) -> Iterator[tuple]:
    name, letters = name_of(word), [c.encode() for c in word]
    before, behind = _chain(letters), _chain(letters[::-1])[::-1]

    def key(i: int, j: int) -> str:
        return hashlib.sha256(before[i] + b"|" + behind[j]).hexdigest()

    for i, letter in enumerate(word):
        deleted = word[:i] + word[i + 1 :] if len(word) <= LITERAL + 1 else key(i, i + 1)
        yield deleted, i, letter, i == 0 or word[i - 1] != letter, name, n
    for i in range(len(word) + 1):  # the word itself, for a longer one that has a letter more at place i
        yield key(i, i), -1, "", False, name, n


def name_of(word: str) -> str:
    return "#" + hashlib.sha256(word.encode()).hexdigest()


def _keys_long(words: DataFrame) -> DataFrame:
    """Keys of longer words, linear in their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [c.split()[0] for c in KEYS.split(", ")], []
        for b in slices(batches):
            for word, n in zip(b["word"].to_pylist(), b["n"].to_pylist()):
                for row in _long_rows(word, n):
                    held.append(row)
                    if len(held) >= 20_000:
                        yield pa.record_batch([pa.array(c) for c in zip(*held)], names).cast(_schema())
                        held = []
        if held:
            yield pa.record_batch([pa.array(c) for c in zip(*held)], names).cast(_schema())

    return words.select("word", "n").mapInArrow(run, KEYS)


def _schema() -> pa.Schema:
    return pa.schema([("key", pa.string()), ("pos", pa.int32()), ("letter", pa.string()), ("first", pa.bool_()), ("name", pa.string()), ("n", pa.int64())])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of those of words(word, n) that have a near word: one inserted, deleted or replaced
    code point away. best is the one of largest n, of ties the smallest in code-point order. Words are distinct."""
    short = F.length("word") <= LITERAL
    emitted = _keys_short(words.filter(short)).union(_keys_long(words.filter(~short))).repartition("key")
    by_key, by_place = Window.partitionBy("key"), Window.partitionBy("key", "pos")
    ranked = by_place.orderBy(F.desc("n"), "letter")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    item = F.struct("name", "n")
    met = emitted.select(
        "*",
        F.max(F.when(F.col("pos") < 0, item)).over(by_key).alias("own"),  # the word that the key is, if there is one
        F.count("*").over(by_place).alias("size"),
        F.row_number().over(ranked).alias("rank"),
        F.first(item).over(whole).alias("top"),
        F.lead(item).over(ranked).alias("next"),
    ).filter("pos >= 0 and (size > 1 or (first and own is not null))")
    replaced = F.when(F.col("size") > 1, F.struct("name", (F.col("size") - 1).alias("links"), F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("top")).alias("to")))
    edge = F.col("first") & F.col("own").isNotNull()
    one = F.lit(1).cast("long").alias("links")
    deleted, inserted = F.when(edge, F.struct("name", one, F.col("own").alias("to"))), F.when(edge, F.struct(F.col("own.name").alias("name"), one, item.alias("to")))
    links = met.select(F.explode(F.array_compact(F.array(replaced, deleted, inserted))).alias("l")).select("l.name", "l.links", F.col("l.to.name").alias("to"), F.col("l.to.n").alias("to_n"))
    # words under a digest get their text back before words are put in order
    longs = words.filter(~short).select("word", F.concat(F.lit("#"), F.sha2("word", 256)).alias("digest"))
    is_long = F.col("to").startswith("#")
    known = links.filter(~is_long).unionByName(links.filter(is_long).join(longs, F.col("to") == F.col("digest")).select("name", "links", F.col("word").alias("to"), "to_n"))
    best = known.groupBy("name").agg(F.sum("links").alias("n_near"), F.min(F.struct((-F.col("to_n")).alias("m"), "to")).alias("b"))
    best = best.select("name", "n_near", F.col("b.to").alias("best"), (-F.col("b.m")).alias("best_n"))
    is_long = F.col("name").startswith("#")
    named = best.filter(is_long).join(longs, F.col("name") == F.col("digest")).select("word", "n_near", "best", "best_n")
    return best.filter(~is_long).withColumnRenamed("name", "word").unionByName(named)


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) of forms(word, form), which have no cycle: the last word that forms lead to. Steps double each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        last, now = now, written(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = now.filter("moved").limit(1).count()
        discard(last)
        if not moved:
            return now.select("word", "root")
    raise RuntimeError(f"forms have chains of over 2 to the power {rounds}")


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, modulus: int = 31, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs(doc_id, text).

    form: the near word of largest n (ties: smallest in code-point order) if it occurs ratio times as often, else null.
    root: the last word along forms, the word itself if it has none. Null and empty texts have no words, repeated rows
    count each, other columns are not looked at; an empty table gives no row. Words may be of any length.
    """
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its word")
    words = written(vocabulary(docs, least_length, least_count, modulus), "words")
    found = words.join(near_words(words), "word", "left")
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "near")
    ends = roots(found.filter("form is not null"))
    discard(words)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots; texts are read whole, a null text has no words."""
    return variants(documents(spark, sf_dir))


#: The checksum is worked out from the 256 remainders of its polynomial. DuckDB's levenshtein() counts bytes, so near words are those that are
#: equal without one letter at the same place, or where one is a deletion of the other.
SQL = r"""
with recursive t as materialized (select list(c order by i) t from (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, s: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i)) q),
o as materialized (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r, count(*) n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) r from documents) x where length(r) >= 7 group by all),
b as materialized (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || r)) x from o),
h as materialized (select r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::bigint, 2))::bigint)),
    lambda c, v: xor(c >> 8, t.t[(xor(c, v) & 255) + 1])), 4294967295) h from b cross join t),
m as (select case when h % 31 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end word, n from h),
w as materialized (select word, sum(n)::bigint n from m where length(word) >= 7 group by word having sum(n) >= 2),
k as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) k from (select word, n, unnest(range(length(word))) i from w) q union all select word, n, null, word from w),
p as (select distinct a.word, a.n, b.word v, b.n vn from k a join k b on a.k = b.k and a.word <> b.word and (a.i = b.i or a.i is null or b.i is null)),
f as materialized (select word, count(*) n_near, arg_min(v, (-vn, v)) best, max(vn) best_n, any_value(n) n from p group by word),
s as (select word, best form, best_n form_n from f where best_n >= 10 * n),
c as (select word, form last from s union all select c.word, s.form from c join s on s.word = c.last),
e as (select c.word, c.last from c left join s on s.word = c.last where s.word is null)
select w.word, s.form, coalesce(e.last, w.word) root, w.n, coalesce(f.n_near, 0)::bigint n_near, s.form_n
from w left join f on f.word = w.word left join s on s.word = w.word left join e on e.word = w.word
"""
