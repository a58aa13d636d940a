"""Secrets in whole texts: three fixed patterns, plus sliding-window entropy over candidate strings.

DataFrame operations only, without a shuffle. A candidate is a maximal run of one character class. Its windows
of fixed width are walked by a fold that keeps the count of each character of the class, five bits a count in a few
longs, and the sum of c * log2(c) over these counts; a step changes two counts and two terms. Entropy is
log2(width) - sum / width. A window at or over its class's threshold counts unless an allow-list pattern matches it;
the unions of overlapping windows that count are spans, unless a span of the fixed patterns covers them. Tokens with
a placeholder word in them are cut out of a candidate first.

Two cheap tests decide which texts any of this is run on: both hold for every text that has a match.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: The patterns, and the least length of what must be long enough (group 2, else the whole match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]

#: What any match of ASSIGN has: the last letter of its word, and what follows up to the separator.
ASSIGN_HINT = r"""[dDtTnNyY]["']?\x20*[:=]"""
#: What any other span lies in: all their characters are of this class, and none has fewer than 20.
LONG_RUN = r"[\w+/=-]{20}"

#: The same matches as ACCESS and HEX after short ones are dropped: a run that is too short has no part that is not.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

#: A token with a word of placeholders. Candidates are cut at these.
PLACEHOLDER = r"(?<![A-Za-z0-9])[A-Za-z0-9]*(?i:example|sample|placeholder|changeme|dummy|xxxx)[A-Za-z0-9]*"
#: Windows that are no secrets: words and paths of one case with two digits at most, words with capitals, numbers, parts
#: of UUIDs, counting sequences.
ALLOW = (
    r"^[a-z+/_=-]*+(?:[0-9][a-z+/_=-]*+){0,2}$",
    r"^[A-Z+/_=-]*+(?:[0-9][A-Z+/_=-]*+){0,2}$",
    r"^[a-z]*+(?:[A-Z][a-z]{2,}+|[+/_=-]++[a-z]*+)*+(?:[A-Z][a-z]?)?$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F-]*-[0-9a-fA-F]{4}-[0-9a-fA-F-]*$",
    r"(?i)01234567|12345678|abcdefgh",
)


@dataclass(frozen=True)
class CharClass:
    """A character class of candidates. threshold: bits a character in the best window."""

    kind: str
    pattern: str
    alphabet: str
    threshold: float


CLASSES = (
    CharClass("entropy_hex", "[0-9a-fA-F]", "0123456789abcdefABCDEF", 3.0),
    CharClass("entropy_base64", "[A-Za-z0-9+/_=-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
)
SCALE = 1_000_000


def _term(c: int) -> int:
    return round(c * math.log2(c) * SCALE) if c > 0 else 0


PIECES = "array<struct<start:bigint,text:string>>"
SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


#: Items that a scan folds together: what a step appends is copied within a block alone.
BLOCK = 256


def scan(items: Column, carry: Column, carry_kind: str, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], finish: Callable[[Column], Column] | None = None) -> Column:
    """A fold over items whose step(carry, item) gives the next carry and an array of results; all results, one after the other.

    finish gives a last array from the last carry. Blocks of items are folded one by one, so the time is proportional to their number.
    """
    inner, outer = f"struct<c:{carry_kind},got:array<{kind}>>", f"struct<c:{carry_kind},got:array<array<{kind}>>>"

    def one(s: Column, x: Column) -> Column:
        c, more = step(s["c"], x)
        return F.struct(c.alias("c"), F.concat(s["got"], more.cast(f"array<{kind}>")).alias("got")).cast(inner)

    def block(s: Column, some: Column) -> Column:
        zero = F.struct(s["c"].alias("c"), _none(f"array<{kind}>").alias("got")).cast(inner)
        return _let(F.aggregate(some, zero, one), lambda r: F.struct(r["c"].alias("c"), F.concat(s["got"], F.array(r["got"])).alias("got")).cast(outer))

    def folded(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / F.lit(BLOCK)).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
        zero = F.struct(carry.alias("c"), _none(f"array<array<{kind}>>").alias("got")).cast(outer)
        last = (lambda s: F.flatten(F.concat(s["got"], F.array(finish(s["c"]).cast(f"array<{kind}>"))))) if finish else (lambda s: F.flatten(s["got"]))
        return F.when(F.size(all_) > 0, F.aggregate(blocks, zero, block, last)).otherwise(_none(f"array<{kind}>"))

    return _let(items, folded)


def _walk(text: Column, pattern: str, gaps: bool) -> Column:
    """Matches of pattern, or the gaps between them, as array of struct(start, text): each one's length gives the next one's place."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        here = F.struct(at.alias("start"), x["gap"].alias("text")) if gaps else F.struct(start.alias("start"), x["hit"].alias("text"))
        got = F.array(here) if gaps else F.when(x["hit"].isNotNull(), F.array(here)).otherwise(_none(PIECES))
        return start + F.coalesce(F.length(x["hit"]), F.lit(0)), got

    return scan(zipped, F.lit(0).cast("bigint"), "bigint", "struct<start:bigint,text:string>", step)


def _found(text: Column, pattern: str) -> Column:
    """Matches as array of struct(start, text)."""
    return F.when(text.rlike(pattern), _walk(text, pattern, False)).otherwise(_none(PIECES))


def _spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["text"])).alias("end"))).cast(SPANS)


#: Counts in a long, five bits each: windows are of 31 characters at most.
SLOTS, SLOT_BITS = 12, 5


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is, an expression in a fold's step is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense_windows(candidate: Column, alphabet: str, width: int, bound: int, allow: tuple[str, ...], chunk: int = 2048) -> Column:
    """Unions, as array of struct(start, end), of the candidate's windows whose sum of c * log2(c), times a million, is at
    most bound and that no pattern of allow matches. Windows are walked in chunks of their starts, so that the time
    is proportional to the candidate's length."""
    if not 0 < width < 1 << SLOT_BITS:
        raise ValueError("width must be between 1 and 31")
    kind = "array<struct<start:int,end:int>>"
    state = f"struct<n:array<bigint>,s:bigint,lo:int,hi:int,runs:{kind}>"
    terms = F.array(*[F.lit(_term(c)).cast("bigint") for c in range(width + 1)])
    places = F.array(*[F.lit((k // SLOTS) * 64 + SLOT_BITS * (k % SLOTS)) for k in range(len(alphabet))])  # long, and bits to shift
    zeros = F.array(*[F.lit(0).cast("bigint")] * -(-len(alphabet) // SLOTS))

    def count(n: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.get(n, F.shiftright(x, 6)), x.bitwiseAND(63)).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))

    def one(x: Column, k: Column) -> Column:
        return F.when(F.shiftright(x, 6) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(63))).otherwise(F.lit(0).cast("bigint"))

    def term(c: Column) -> Column:
        return F.get(terms, c.cast("int"))

    def walked(chars: Column, x: Column, first: Column) -> Column:
        last = F.least(first + chunk, F.size(x) - width + 1) - 1  # start of the chunk's last window

        def step(s: Column, i: Column) -> Column:
            start = i - (width - 1)
            enters, leaves = F.get(x, i), F.when(start > first, F.get(x, start - 1))
            old = F.coalesce(count(s["n"], leaves), F.lit(0).cast("bigint"))  # 0 if none leaves
            had = count(s["n"], enters) - F.when(enters == leaves, 1).otherwise(0)
            total = s["s"] - term(old) + term(F.greatest(old - 1, F.lit(0).cast("bigint"))) - term(had) + term(had + 1)
            n = F.transform(s["n"], lambda c, k: c + one(enters, k) - F.coalesce(one(leaves, k), F.lit(0).cast("bigint")))
            hot = (start >= first) & (total <= bound)
            for a in allow:
                hot = hot & ~F.array_join(F.slice(chars, start + 1, width), "").rlike(a)
            return F.struct(n.alias("n"), total.alias("s"), hot.alias("hot"), start.alias("at"))

        def joined_on(s: Column, i: Column) -> Column:
            def next_(t: Column) -> Column:
                opens = t["hot"] & ((s["lo"] < 0) | (t["at"] > s["hi"]))
                closed = F.when(opens & (s["lo"] >= 0), F.concat(s["runs"], F.array(F.struct(s["lo"].alias("start"), s["hi"].alias("end"))))).otherwise(s["runs"])
                lo, hi = F.when(opens, t["at"]).otherwise(s["lo"]), F.when(t["hot"], t["at"] + width).otherwise(s["hi"])
                return F.struct(t["n"].alias("n"), t["s"].alias("s"), lo.alias("lo"), hi.alias("hi"), closed.alias("runs")).cast(state)

            return _let(step(s, i), next_)

        zero = F.struct(zeros.alias("n"), F.lit(0).cast("bigint").alias("s"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), _none(kind).alias("runs")).cast(state)
        done = lambda s: F.when(s["lo"] < 0, s["runs"]).otherwise(F.concat(s["runs"], F.array(F.struct(s["lo"].alias("start"), s["hi"].alias("end"))))).cast(kind)
        return F.aggregate(F.sequence(first, last + width - 1), zero, joined_on, done)

    def chunks(chars: Column) -> Column:
        codes = F.transform(chars, lambda c: F.get(places, F.instr(F.lit(alphabet), c) - 1))
        return _let(codes, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(x) - width, F.lit(chunk)), lambda first: walked(chars, x, first))))

    def unions(runs: Column) -> Column:  # of chunks: ends do not fall
        starts = F.filter(runs, lambda r, k: (k == 0) | (r["start"] > F.get(runs, k - 1)["end"]))
        ends = F.filter(runs, lambda r, k: (k == F.size(runs) - 1) | (F.get(runs, k + 1)["start"] > r["end"]))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    short = F.length(candidate) < width
    split = F.filter(F.split(candidate, ""), lambda c: c != "")
    return F.when(short, _none(kind)).otherwise(_let(_let(split, chunks), unions))


def _dense_spans(text: Column, c: CharClass, width: int, allow: tuple[str, ...], placeholder: str) -> Column:
    bound = math.floor(width * (math.log2(width) - c.threshold) * SCALE)
    rank = KINDS.index(c.kind)

    def of_piece(start: Column, piece: Column) -> Column:
        return F.transform(dense_windows(piece, c.alphabet, width, bound, allow), lambda r: F.struct((start + r["start"]).alias("start"), F.lit(rank).alias("rank"), (start + r["end"]).alias("end")))

    def of_run(m: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), m["text"].alias("text"))).cast(PIECES)
        pieces = F.when(m["text"].rlike(placeholder), _walk(m["text"], placeholder, True)).otherwise(whole)
        return F.flatten(F.transform(pieces, lambda p: of_piece(m["start"] + p["start"], p["text"])))

    return F.flatten(F.transform(_found(text, f"{c.pattern}{{{width},}}"), of_run)).cast(SPANS)


def find_secrets(docs: DataFrame, width: int = 20, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with _base and _spans added: arrays of struct(start, rank, end), sorted, ends exclusive, in code points.

    rank is the place of the kind in KINDS. A null or empty text has no span. Rows are independent: repeated
    rows and ties change nothing, an empty table stays empty. Other columns stay as they are, but for ones named
    _base, _spans or _all, which the result replaces.
    """
    if width < 20:
        raise ValueError("a width below 20 needs another test than LONG_RUN")
    text = F.coalesce("text", F.lit(""))
    base = {kind: _spans(_found(text, pattern), kind) for kind, pattern in LONG.items()}
    base["assign"] = _spans(F.filter(_found(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= LEAST["assign"]), "assign")
    dense = [_dense_spans(text, c, width, allow, placeholder) for c in classes]
    assigned = F.when(text.rlike(ASSIGN_HINT), base["assign"]).otherwise(_none(SPANS))
    others = F.when(text.rlike(LONG_RUN), F.concat(base["access"], base["hex"], *dense)).otherwise(_none(SPANS))
    out = once(docs.drop("_base", "_spans", "_all"), "_all", F.array_sort(F.concat(assigned, others)))
    out = out.withColumn("_base", F.filter("_all", lambda x: x["rank"] < len(LEAST)))

    def uncovered(furthest: Column, x: Column) -> tuple[Column, Column]:
        """furthest: the end that base spans have reached so far; at one start they come before the others."""
        is_base = x["rank"] < len(LEAST)
        stays = is_base | (x["end"] > furthest)
        return F.when(is_base, F.greatest(furthest, x["end"])).otherwise(furthest), F.when(stays, F.array(x)).otherwise(_none(SPANS))

    return once(out, "_spans", scan(F.col("_all"), F.lit(-1).cast("bigint"), "bigint", "struct<start:bigint,rank:int,end:bigint>", uncovered)).drop("_all")


def once(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """docs with a column that is computed once a row: a generator keeps the optimizer from copying its expression."""
    return docs.withColumn(name, F.explode(F.array(value)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """found with text after replacing each run of overlapping or touching _spans by mark; a null text stays null.

    A column named _runs is dropped.
    """
    kind = "struct<start:bigint,end:bigint>"

    def step(run: Column, s: Column) -> tuple[Column, Column]:
        here = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        joins = F.coalesce(s["start"] <= run["end"], F.lit(False))
        grown = F.struct(run["start"].alias("start"), F.greatest(run["end"], s["end"]).alias("end"))
        return F.when(joins, grown).otherwise(here), F.when(joins | run.isNull(), _none(f"array<{kind}>")).otherwise(F.array(run))

    runs = once(found.drop("_runs"), "_runs", scan(F.col("_spans"), F.lit(None).cast(kind), kind, kind, step, lambda run: F.array(run)))
    n = F.length("text").cast("bigint")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_runs", lambda r: r["end"]))
    starts = F.concat(F.transform("_runs", lambda r: r["start"]), F.array(n))
    gaps = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda z: F.substring(F.col("text"), z["a"].cast("int") + 1, (z["b"] - z["a"]).cast("int")))
    text = F.when(F.size("_runs") == 0, F.col("text")).otherwise(F.array_join(gaps, mark))
    return runs.withColumn("text", text).drop("_runs")


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(F.filter("_base", _of_rank(r))).cast("long").alias(f"n_{KINDS[r]}") for r in range(3)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
