"""The ten operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import common, op1_secrets, op2_simhash, op3_repeats, op4_quality, op5_packing, op6_sharding, op7_records, op8_lattice, op9_langid, op10_mixing, tokens

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows with every awkward value; extra columns clash with names the operators use.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (5, "one", "en", "a", 3),
    (None, "null id text here", "en", "b", 17), (7, "éß 漢字 🙂 words <|endoftext|> it's  two   blanks\x1c", "fr", "b", 9), (8, "la la la " * 3000, "es", "c", 27000), (9, "x" * 30000, "de", "c", 30000),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("key", "size", "row", "component", "_lang", "base", "value", "bucket", "spans"):
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf_dir):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# 1


def base_spans(t):
    word = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{op1_secrets.KINDS[r]}:{s}:{e}" for s, r, e in spans)


def test_secrets_base(spark):
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123abcd", "z", "é", "==", ".x_", "\n", "12345"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op1_secrets.find_secrets(df)
    for r in found.select("doc_id", op1_secrets.joined(F.col("_base")).alias("b"), op1_secrets.joined(F.col("_spans")).alias("s")).collect():
        assert r["b"] == joined(base_spans(texts[r["doc_id"]]))
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))


def all_spans(t, width=20):
    """Base spans, and unions of windows that are dense and not allowed, one class after the other."""
    base, out = base_spans(t), []
    for c in op1_secrets.CLASSES:
        bound = math.floor(width * (math.log2(width) - c.threshold) * op1_secrets.SCALE)
        for m in re.finditer(f"{c.pattern}{{{width},}}", t):
            at = m.start()
            holes = [(at + h.start(), at + h.end()) for h in re.finditer(op1_secrets.PLACEHOLDER, m[0])]
            marks = set()
            for i in range(at, m.end() - width + 1):
                w = t[i : i + width]
                total = sum(op1_secrets._term(n) for n in collections.Counter(w).values())
                if total <= bound and not any(i < e and s < i + width for s, e in holes) and not any(re.search(a, w) for a in op1_secrets.ALLOW):
                    marks |= set(range(i, i + width))
            cuts = sorted(marks)
            runs = [[x, x + 1] for x in cuts[:1]]
            for x in cuts[1:]:
                if x == runs[-1][1]:
                    runs[-1][1] += 1
                else:
                    runs.append([x, x + 1])
            out += [(s, op1_secrets.KINDS.index(c.kind), e) for s, e in runs]
    return sorted(base + [x for x in out if not any(s <= x[0] and x[2] <= e for s, _, e in base)])


def test_secrets_entropy(spark):
    rng = random.Random(2)
    c = op1_secrets.CLASSES[1]
    bits = ["".join(rng.choices(c.alphabet[: rng.choice([4, 20, 64])], k=rng.randint(5, 60))) for _ in range(60)]
    bits += ["".join(rng.choices("0123456789ABCDEF", k=rng.randint(18, 40))) for _ in range(20)]
    bits += [" ", "é", "/", "_", "sample", "_EXAMPLE-", "xxxx", "password=", "/usr/lib/python3/dist-packages/foo", "0123456789", "abcdefgh", "a" * 30, "LongCamelCaseName", "123e4567-e89b-12d3-a456-426614174000"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(400)] + ["".join(rng.choices(c.alphabet, k=9000)), "Q7x K2" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["s"] for r in op1_secrets.find_secrets(df).select("doc_id", op1_secrets.joined(F.col("_spans")).alias("s")).collect()}
    assert got == {i: joined(all_spans(t)) for i, t in enumerate(texts)} and sum("entropy" in x for x in got.values()) > 100


def test_secrets_of_many_matches_take_linear_time(spark):
    def seconds(n):
        text = "token=abcdef " * n + "Q7xK2p9Zr4Lm8Vb1Nc6Ty3Wq5Hd"
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = op1_secrets.find_secrets(df).select(op1_secrets.joined(F.col("_spans")).alias("s")).first()
        took = time.time() - began
        assert r["s"] == joined(base_spans(text)) + f",entropy_base64:{13 * n}:{len(text)}"
        return took

    seconds(300)
    assert seconds(20_000) < 20


def test_secrets_covered_spans_go(spark):
    """A dense span inside a base one goes, one that reaches beyond it stays; and what is redacted is the union."""
    rng = random.Random(6)
    alphabet = op1_secrets.CLASSES[1].alphabet
    texts = []
    for _ in range(150):
        bits = ["".join(rng.choices(alphabet, k=rng.randint(18, 50))) for _ in range(3)] + ["0123456789abcdef" * 2, "AKIA" + "ABCD0123" * 3]
        texts.append("".join(rng.choice(["token=", " secret: ", " ", ",", "AKIA"]) + rng.choice(bits) for _ in range(rng.choice([1, 4, 700]))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in op1_secrets.redact(op1_secrets.find_secrets(df)).select("doc_id", "text", op1_secrets.joined(F.col("_spans")).alias("s")).collect():
        t = texts[r["doc_id"]]
        spans = all_spans(t)
        assert r["s"] == joined(spans)
        out, at = [], 0
        for s, _, e in sorted(spans):
            if s > at or not out:
                out.append([s, e])
            elif e > out[-1][1]:
                out[-1][1] = e
            at = out[-1][1]
        want, last = "", 0
        for s, e in out:
            want, last = want + t[last:s] + "[SECRET]", e
        assert r["text"] == want + t[last:]


def test_secrets_windows_are_judged_singly(spark):
    texts = ["sample_Q7xK2p9Zr4Lm8Vb1Nc6Ty3Wq5Hd", "QxKpZrLmVbNcTyWqHdXbRdMf", "/usr/lib/python3/dist-packages/foo/bar_baz/module2", "word_" * 5 + "Q7xK2p9Zr4Lm8Vb1Nc6T"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in op1_secrets.find_secrets(df).select("doc_id", op1_secrets.joined(F.col("_spans")).alias("s")).collect()}
    assert got[0] == "entropy_base64:6:34" and got[1] == "entropy_base64:0:24" and got[2] == "" and got[3].endswith(":45")


def test_secrets_query_odd_and_clashing(spark, sf_dir, odd, empty):
    texts = dict(documents(spark, sf_dir))
    rows = op1_secrets.op1_secrets(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r["doc_id"]] or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest() and r["spans"] == joined(all_spans(texts[r["doc_id"]] or ""))
    clash = odd
    for c in ("_base", "_spans", "_all", "_runs", "_extra", "start"):
        clash = clash.withColumn(c, F.lit("extra"))
    found = op1_secrets.redact(op1_secrets.find_secrets(clash))
    got = found.select("doc_id", op1_secrets.joined(F.col("_spans")).alias("s"), "start", "_extra").collect()
    assert len(got) == len(ODD) and all(r["start"] == r["_extra"] == "extra" and r["s"] == "" for r in got)
    assert op1_secrets.find_secrets(empty).count() == 0 and op1_secrets.redact(op1_secrets.find_secrets(empty)).count() == 0


def test_secrets_allow_and_redact(spark):
    texts = ["key Q7x/K2p9+Zr4Lm8Vb1Nc6Ty3 end", "id 123e4567-e89b-12d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyzabcdef", "EXAMPLE9Kq3LmP0xVbT7sWcR2h", "1234567890123456789012", None, "", 'é token = "a1b2c3d4e5" x']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = op1_secrets.redact(op1_secrets.find_secrets(df)).select("doc_id", op1_secrets.joined(F.col("_spans")).alias("s"), F.col("text").alias("r")).collect()
    got = {r["doc_id"]: (r["s"], r["r"]) for r in rows}
    assert got[0] == ("entropy_base64:4:28", "key [SECRET] end")
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6)] == [""] * 6 and got[5][1] is None
    assert got[7] == ("assign:2:21", 'é [SECRET]" x')


# 2


def fingerprint(t, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[j : j + k]).encode(), 42) for j in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, linked):
    parent = {i: i for i in values}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in values}


def test_simhash_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fp = {i: fingerprint(t) for i, t in docs}
    want = components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash.op2_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


@pytest.mark.parametrize("limit", [1024, 8])
def test_simhash_links(spark, limit):
    rng, values = random.Random(3), []
    base = rng.getrandbits(64)
    for i in range(200):
        x = base if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 8)):
            x ^= 1 << rng.randint(0, 63)
        values.append(values[-1] ^ 1 << rng.randint(0, 63) if values and i % 5 == 0 else x)
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), i) for i, v in enumerate(values)], "fp long, rep long")
    got = {r["node"]: r["component"] for r in common.components(op2_simhash.link_fingerprints(df, 3, limit)).collect()}
    n = range(len(values))
    want = components(n, [(a, b) for a in n for b in n if a < b and (values[a] ^ values[b]).bit_count() <= 3])
    assert {i: got.get(i, i) for i in n} == want


def test_masks_cover():
    rng = random.Random(4)
    for r in (1, 2, 3):
        kept = [int(np.int64(m).astype(np.uint64)) for m in op2_simhash.masks(r)]
        assert len(kept) == 2 ** (r + 1) - 1
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(range(64), r))
            assert any(not diff & m for m in kept)


def test_simhash_odd(spark, odd, empty):
    got = {(r["doc_id"], r["fp"], r["component_id"]) for r in op2_simhash.simhash_components(odd).collect()}
    by_id = {i: (f, c) for i, f, c in got}
    assert by_id[1] == by_id[2] == by_id[3] == (0, 1) and by_id[4][1] == by_id[5][1] == 4
    assert by_id[None][1] is None
    bridge = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(bridge + [f"w{i}" for i in range(900)] + ["x"] * k) for k in range(3)]
    fps = [fingerprint(t) for t in texts]
    near = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (2, texts[2]), (None, "quite another text"), (None, "quite another text")], "doc_id long, text string")
    linked = lambda a, b: (a ^ b).bit_count() <= 3
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in op2_simhash.simhash_components(near).collect())
    assert linked(fps[0], fps[1]) and linked(fps[1], fps[2]) and got == {(1, 1): 1, (None, 1): 1, (2, 1): 1, (None, None): 2}
    assert op2_simhash.simhash_components(odd).count() == len(ODD)
    assert op2_simhash.simhash_components(empty).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    docs, groups = [], {}
    for g in range(12):
        text = rng.choices(words, k=220)
        for c in range(4 if g % 2 else 1):
            copy = list(text)
            if c:
                copy[rng.randrange(220)] = f"edit{c}"
            groups[len(docs)] = g
            docs.append((len(docs), " ".join(copy)))
    got = {r["doc_id"]: r["keep"] for r in op2_simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, g in groups.items():
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in groups.items()}


# 3


def without_repeats(rows, least):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            if w in seen:
                cover[s : s + least] = b"\1" * least
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[d] = (len(b), sum(cover), sum(1 for j, c in enumerate(cover) if c and (not j or not cover[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 900, "bucket_bytes": 6000}, {"batch_bytes": 900, "bucket_bytes": 8000, "hot_batches": 2}])
def test_repeats(spark, sizes):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices("abcdefghij klé\n", k=n))
    base = [some(rng.randint(80, 400)) for _ in range(8)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            a = rng.randint(0, len(x) // 2)
            t += rng.choice([x[a : a + rng.randint(50, 300)], some(rng.randint(0, 150)), "ab" * rng.randint(1, 90), x])
        rows.append((i, t if i % 17 else None))
    rows += [(100 + i, rows[5 + i % 3][1]) for i in range(5)] + [(200, "x" * 900), (201, "x" * 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op3_repeats.remove_repeats(df, 100, **sizes).collect()}
    assert got == without_repeats(rows, 100)


def test_maximal_repeats_report_all_occurrences():
    texts = ["aaXbb", "caXbd", "caXbb", "zzXzz"]
    got = {(l, r, tuple(sorted(rows))) for l, r, rows in op3_repeats.maximal_repeats([t[2:].encode() for t in texts], [t[:2][::-1].encode() for t in texts], 2)}
    assert got == {(1, 2, (0, 1, 2)), (2, 2, (1, 2)), (1, 3, (0, 2))}


def test_repeats_odd(spark, odd, empty):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in op3_repeats.remove_repeats(odd).collect())
    assert got[(5, 3, 0)] == 2 and got[(1, 0, 0)] == 1 and got[(None, 17, 0)] == 1 and sum(got.values()) == len(ODD)
    assert got[(8, 27000, 26997)] == 1  # every string but the first three repeats
    assert op3_repeats.remove_repeats(empty).count() == 0


# 4


def quality(t):
    w = WORD.findall(t)

    def covered(k):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return {j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}

    seen, dup, dup_chars, chars, lines = set(), 0, 0, 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines, chars = lines + 1, chars + len(line)
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            seen.add(line)
    n, total = len(w), sum(map(len, w))
    shares = {k: sum(len(w[j]) for j in covered(k)) / max(total, 1) for k in op4_quality.SHARES}
    failed = n < 20 or 100 * len(covered(8)) > 30 * n
    good = all(shares[k] <= m for k, m in op4_quality.SHARES.items()) and dup_chars <= op4_quality.LINE_CHARS * max(chars, 1) and dup <= op4_quality.LINE_COUNT * lines
    return n, total, len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered(8)), failed, not failed and good


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_quality_random():
    rng = random.Random(7)
    texts = ["".join(rng.choices("aab \n#é\t", k=rng.randint(0, 90))) for _ in range(300)] + ["", "a", " ", "\n", "\n\n", "a b c d e f g h " * 12]
    texts += ["\n".join("".join(rng.choices("ab \t", k=rng.randint(0, 40))) for _ in range(60)) for _ in range(5)]
    for size in (4 << 20, 50, 1):
        got = op4_quality.measure([t.encode() for t in texts], size)
        for i, t in enumerate(texts):
            assert tuple(got[c][i] for c in NAMES) == quality(t), t
    assert not len(op4_quality.measure([])["kept"])


def test_quality_documents(spark, sf_dir, odd, empty):
    texts = dict(documents(spark, sf_dir))
    for r in op4_quality.op4_quality(spark, sf_dir).collect():
        assert tuple(r[c] for c in NAMES) == quality(texts[r["doc_id"]])
    assert op4_quality.quality(odd).count() == len(ODD) and op4_quality.quality(empty).count() == 0
    assert all(r["base_failed"] for r in op4_quality.quality(odd).collect() if r["doc_id"] in (1, 2, 3, 4, 8))


# 5 and 7


def library_ids(t):
    return tokens.piece_ids(tokens.public_path()).library.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    rng = random.Random(8)
    p = tokens.PieceIds(tokens.public_path(), bound=50)
    bits = list("aab's tvrelldm12²½ \n\t\r\xa0\x0b\x0c_-—’…€\"!?.,éÉßǅƻªº×÷\x7f§") + ["'re", "'ll", "  ", "<|endoftext|>", "漢", " ", "\x1c", "\x85", "word"]
    for i in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 16)))
        assert p.encode(t) == p.whole(t), t
    assert len(p) <= 50


def ids_of(t, end):
    return [*library_ids(t), end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing(spark, sf_dir, odd, empty):
    texts = dict(documents(spark, sf_dir))
    rows = op5_packing.op5_packing(spark, sf_dir).collect()
    used, where = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        where[r["doc_id"]].append((r["start"], r["length"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = ids_of(texts[r["doc_id"]], 1)
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
    for parts, limit in [*((p, None) for p in where.values()), *((p, 2048) for p in used.values())]:
        at = 0
        for s, n in sorted(parts):
            assert s == at and n > 0
            at += n
        assert limit is None or at <= limit
    assert set(where) == set(texts)
    assert sum(n for p in used.values() for _, n in p) > 0.98 * 2048 * len(used)
    assert {r["doc_id"] for r in op5_packing.pack_documents(odd, tokens.public_path()).collect()} == {r[0] for r in ODD}
    assert op5_packing.pack_documents(empty, tokens.public_path()).count() == 0


def test_packing_of_two_layouts(spark, sf_dir):
    """However rows are dealt to tasks, every id is in one piece, a task pads one sequence, and documents are cut alike."""
    docs, found = common.documents(spark, sf_dir), []
    for n in (1, 6):
        rows = op5_packing.pack_documents(docs.repartition(n), tokens.public_path()).collect()
        used, where = collections.Counter(), collections.defaultdict(list)
        for r in rows:
            used[r["sequence_id"]] += r["length"]
            where[r["doc_id"]].append((r["start"], r["length"]))
        for parts in where.values():
            assert all(s + k == t for (s, k), (t, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
        assert sum(k < 2048 for k in used.values()) <= n and max(used.values()) <= 2048
        found.append({d: sum(k for _, k in p) for d, p in where.items()})
    assert found[0] == found[1]


def packed_by_definition(lengths, capacity, longest):
    """Every part in descending length to the lowest-cost sequence with room, one by one."""
    n = -(-sum(lengths) // capacity)
    limit = [capacity] * (n - 1) + [sum(lengths) - (n - 1) * capacity] if n else []
    room, cost, out, parts = list(limit), [0.0] * n, [], []
    for doc, size in enumerate(lengths):
        m = -(-size // longest)
        parts += [((i + 1) * size // m - i * size // m, doc, i * size // m) for i in range(m)]
    for size, doc, start in sorted(parts, key=lambda p: (-p[0], p[1], p[2])):
        while size:
            some = [i for i in range(n) if room[i] >= size] or [i for i in range(n) if room[i]]
            best = min(some, key=lambda i: (cost[i], i))
            take = min(size, room[best])
            out.append((doc, start, take, best, limit[best] - room[best]))
            room[best] -= take
            cost[best] += take + take * take / 2048
            size, start = size - take, start + take
    return out


def test_pack_balances_cost():
    rng = random.Random(9)
    for lengths in ([rng.randint(1, 5000) for _ in range(300)], [rng.randint(1, 300) for _ in range(200)] + [60000], [2048, 4096], [5], []):
        pieces = op5_packing.pack(lengths, 2048, 1.0, 1 / 2048)
        assert pieces == packed_by_definition(lengths, 2048, 1024)
        cost = collections.Counter()
        for _, _, n, s, _ in pieces:
            cost[s] += n + n * n / 2048
        assert len(cost) == -(-sum(lengths) // 2048)
        some = sorted(cost.values())[1:]  # the least may be the short one
        assert not some or some[-1] <= 1.25 * some[0]  # a sequence of one full piece would cost 4096


def test_records(spark, sf_dir, odd, empty, tmp_path):
    want, at = {}, 0
    for i, t in sorted(documents(spark, sf_dir)):
        ids = ids_of(t, 0)
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op7_records.op7_records(spark, sf_dir).collect()} == want
    path = str(tmp_path / "odd")
    op7_records.write_records(odd, path, tokens.public_path(), shard_bytes=20000)
    index = op7_records.write_index(spark, path)
    rows = sorted(op7_records.starts(index).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 7, 8, 9] and len({r["shard"] for r in rows}) > 1
    for r in rows:  # a reader seeks by the index
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["position"])
            ((_, payload),) = op7_records.frames(f.read(r["length"]))
        assert len(payload) == 8 + 2 * r["n_tokens"]
    drawn = [(r["doc_id"], r["ids"]) for r in op7_records.read_shuffled(spark.read.parquet(f"{path}/index"), path).collect()]
    text = collections.Counter((r[0], tuple(ids_of(r[1], 0))) for r in ODD)
    assert collections.Counter((i, tuple(x)) for i, x in drawn) == text and [i for i, _ in drawn] != [r["doc_id"] for r in rows]
    path = str(tmp_path / "empty")
    op7_records.write_records(empty, path, tokens.public_path())
    assert op7_records.starts(op7_records.write_index(spark, path)).count() == 0


def test_frames_notice_damage():
    data = op7_records.frame(b"one") + op7_records.frame(b"")
    assert [p for _, p in op7_records.frames(data)] == [b"one", b""]
    for i in range(len(data)):
        with pytest.raises(ValueError):
            list(op7_records.frames(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]))
    with pytest.raises(ValueError):
        list(op7_records.frames(data[:-3]))


# 6


def test_sharding(spark, sf_dir, odd, empty, tmp_path):
    texts = dict(documents(spark, sf_dir))
    a = op6_sharding.op6_sharding(spark, sf_dir).collect()
    slots = collections.defaultdict(list)
    for r in a:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16)) and {r["doc_id"] for r in a} == set(texts) and len(a) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in op6_sharding.op6_sharding(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in a}
    assert op6_sharding.external_shuffle(odd, 3, ["doc_id", "text"], bucket_rows=2).count() == len(ODD)
    assert op6_sharding.external_shuffle(empty, 3, ["doc_id"]).count() == 0
    op6_sharding.write_shards(odd, str(tmp_path / "s"), 4, bucket_rows=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ODD) and back.select("_shard").distinct().count() == 4


def shuffled_plainly(spark, rows, n, seed=42):
    """The whole order of distinct rows (doc_id, source) as the operator defines it, with Spark's hash for keys and draws."""
    keys = {tuple(r[:2]): r[2] for r in spark.createDataFrame(rows, "doc_id long, source string").select("doc_id", "source", F.xxhash64(F.lit(seed), "doc_id", "source", F.lit(1).cast("long"))).collect()}
    buckets = collections.defaultdict(list)
    for r, k in keys.items():
        buckets[k % n].append((k, r))
    draws = spark.createDataFrame([(b, len(v)) for b, v in buckets.items()], "b long, n int").select("b", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64(F.lit(seed), F.col("b"), i)))
    order = []
    for b, h in sorted(tuple(r) for r in draws.collect()):
        mine = [r for _, r in sorted(buckets[b])]
        for i in range(len(mine)):  # the shuffle, in place
            j = h[i] % (i + 1)
            mine[i], mine[j] = mine[j], mine[i]
        order += mine
    return order


def test_sharding_whole_order(spark):
    rows = [(i, f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    got = {(r["_shard"], r["_slot"]): (r["doc_id"], r["source"]) for r in op6_sharding.external_shuffle(df, 5, ["doc_id", "source"], bucket_rows=700).collect()}
    assert got == {(i % 5, i // 5): r for i, r in enumerate(shuffled_plainly(spark, rows, 5))}


def test_large_buckets_take_linear_time(spark):
    def seconds(n):
        began = time.time()
        p = spark.range(1).select(op6_sharding.fisher_yates(F.lit(n), F.col("id"), 7).alias("p")).first()["p"]
        assert sorted(p) == list(range(n))
        return time.time() - began

    seconds(1000)
    assert seconds(32768) < 30 * max(0.3, seconds(4096))  # eight times the rows; a fold over one array takes 64 times as long


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 50), "a" if i % 3 else None) for i in range(2000)] + [(7, "same", None)] * 900 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("d", F.lit(1)).withColumn("_slot", F.lit("gone"))
    orders = []
    for name, n, task in (("a", 3, 1 << 30), ("b", 7, 20_000)):
        op6_sharding.write_shards(docs.repartition(n), str(tmp_path / name), 4, bucket_rows=300, task_bytes=task)
        found = []
        for shard in range(4):
            files = sorted((tmp_path / name / f"_shard={shard}").glob("part-*"))
            slots = [s for f in files for s in pq.read_table(f)["_slot"].to_pylist()]
            assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 4) < 1  # files in order carry the order
        back = spark.read.parquet(str(tmp_path / name))
        found = sorted((r["_shard"], r["_slot"], r["doc_id"], r["text"], r["source"], r["d"]) for r in back.na.fill(-1, ["doc_id"]).na.fill("none").collect())
        orders.append(found)
        assert collections.Counter(f[2:5] for f in found) == collections.Counter((-1 if i is None else i, "none" if t is None else t, "none" if s is None else s) for i, t, s in rows)
    assert orders[0] == orders[1]
    op6_sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 4)
    assert not list((tmp_path / "none").glob("_shard=*"))


def test_fisher_yates(spark):
    """Against the shuffle written out, with Spark's hash for the draws."""
    df = spark.createDataFrame([(b, n) for b in range(6) for n in (1, 2, 3, 10, 60)], "b long, n int")
    drawn = F.when(F.col("n") > 1, op6_sharding.fisher_yates(F.col("n"), F.col("b"), 7)).otherwise(F.array(F.lit(0)))
    hashes = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64(F.lit(7), F.col("b"), i))
    orders = set()
    for r in df.select("b", "n", drawn.alias("p"), hashes.alias("h")).collect():
        want = []
        for i in range(r["n"]):
            j = r["h"][i] % (i + 1)
            want.append(i)
            want[i], want[j] = want[j], want[i]
        assert r["p"] == want and sorted(want) == list(range(r["n"]))
        if r["n"] == 60:
            orders.add(tuple(want))
    assert len(orders) == 6


def test_sharding_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    docs = docs.union(docs.filter("doc_id < 40")).union(spark.range(300).select(F.lit(7).alias("doc_id"), F.lit("same").alias("source")))
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (3, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = op6_sharding.external_shuffle(docs.repartition(n), 5, ["doc_id", "source"], bucket_rows=50).collect()
            found.append(sorted((r["_shard"], r["_slot"], r["doc_id"], r["source"]) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()
    same = [r[:2] for r in found[0] if r[3] == "same"]
    assert len({s for s, _ in same}) == 5 and max(t for _, t in same) - min(t for _, t in same) > 50  # repeats are spread


# 8


@pytest.mark.parametrize("limit", [512, 8])
def test_lattice(spark, limit):
    rng = np.random.default_rng(10)
    rows = [(i, i % 3, rng.standard_normal(32)) for i in range(150)]
    for i in range(150, 350):
        _, label, v = rows[rng.integers(0, i)]
        u, n, c = v / np.linalg.norm(v), rng.standard_normal(32), rng.uniform(0.9, 1)
        n -= n @ u * u
        rows.append((i, label, v.copy() if i % 7 == 0 else 3 * (c * u + np.sqrt(1 - c * c) * n / np.linalg.norm(n))))
    bad = [(800, 0, None), (801, None, [1.0] * 32), (802, 0, [0.0] * 32), (803, 0, [float("nan")] + [1.0] * 31), (804, 0, []), (805, 0, [None] + [1.0] * 31), (806, 0, [1.0] * 3), (807, 0, [2.0] * 3), (808, 0, [float("inf")] * 32), (None, 0, [1.0] * 32)]
    df = spark.createDataFrame([(i, l, [float(np.float32(x)) for x in v]) for i, l, v in rows] + bad, "vec_id long, label int, embedding array<float>").withColumn("n", F.lit("extra"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op8_lattice.embedding_links(df, limit=limit).collect()}
    x = np.stack([v.astype(np.float32).astype(float) for *_, v in rows])
    u, label = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([l for _, l, _ in rows])
    near = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    comp = components(range(len(rows)), zip(*np.nonzero(near)))
    want = {i: (int(near[i].sum()), comp[i]) for i in range(len(rows))}
    found = sum(got[i][0] for i in want)
    assert found >= 0.97 * near.sum() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 0.03 * len(want)
    assert {i: got[i] for i in (800, 801, 802, 803, 804, 805, 808, None)} == {i: (0, i) for i in (800, 801, 802, 803, 804, 805, 808, None)}
    assert got[806] == (1, 806) and got[807] == (1, 806)


def test_lattice_codes_lose_no_pair():
    """Codes never rule out a pair at the threshold, and rule out nearly all others."""
    rng = np.random.default_rng(12)
    for dim in (1, 2, 7, 64, 65):
        x = rng.standard_normal((120, dim)) * rng.choice([1, 0.001, 50], (120, dim))
        x[60:] = x[:60] + rng.standard_normal((60, dim)) * rng.choice([0.01, 0.1, 0.3], (60, 1)) * np.abs(x[:60]).mean(1, keepdims=True)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        may = op8_lattice.may_be_near(*op8_lattice.decoded(pa.array(op8_lattice.coded(u), pa.binary())), 0.93)
        assert may[u @ u.T >= 0.93].all()
    u = rng.standard_normal((400, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert op8_lattice.may_be_near(*op8_lattice.decoded(pa.array(op8_lattice.coded(u), pa.binary())), 0.93).sum() == 400


def test_lattice_counts_pairs_whose_signs_differ(spark):
    """Pairs at the threshold whose signs under random planes differ far more than usual count like any other pair."""
    rng = np.random.default_rng(13)
    planes = np.random.default_rng(op8_lattice.SEED + 1).standard_normal((64, 64))
    q, _ = np.linalg.qr(planes)
    rows = []
    for i in range(20):
        a = q @ rng.choice([-1.0, 1.0], 64) / 8
        step = rng.standard_normal(64)
        step -= step @ a * a
        c = 0.9302
        rows += [(2 * i, 0, a.tolist()), (2 * i + 1, 0, (c * a + np.sqrt(1 - c * c) * step / np.linalg.norm(step)).tolist())]
    rows += [(100 + i, 0, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    u = np.array([r[2] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    keys = op8_lattice.cells(u)
    meet = np.array([[bool(set(a) & set(b)) for b in keys] for a in keys])
    counted = ((u @ u.T >= 0.93) & meet).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in op8_lattice.embedding_links(df).collect()}
    assert [got[r[0]] for r in rows] == counted.tolist() and counted.sum() >= 0.97 * want.sum() > 30


def test_lattice_points_are_in_e8():
    y = np.random.default_rng(11).standard_normal((500, 8)) * 2
    p = op8_lattice.lattice_points(y, 4)
    assert ((p % 2 == 0).all(2) | (p % 2 == 1).all(2)).all() and (p.sum(2) % 4 == 0).all()
    far = ((p / 2 - y[:, None]) ** 2).sum(2)
    assert (np.diff(far, axis=1) >= -1e-9).all() and (far[:, 0] <= 1 + 1e-9).all()


# 9


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op9_langid.op9_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and {r["doc_id"] for r in test} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got)
    model = op9_langid.train(docs.filter(~op9_langid.held_out()))
    rows = op9_langid.predict(odd, model).collect()
    assert len(rows) == len(ODD) and {r["doc_id"] for r in rows if r["_lang"] == "und"} == {1, 2, 3}
    assert op9_langid.predict(empty, model).count() == 0
    assert op9_langid.train(empty) is None and {r["_lang"] for r in op9_langid.predict(odd, None).collect()} == {"und"}


def test_language_features_and_decision():
    """Counts of n-grams one by one, whatever the pieces; the decision by family and votes of pairs written out."""
    rng = random.Random(14)
    texts = ["".join(rng.choices("abc é漢", k=rng.randint(1, 80))) for _ in range(12)]
    want = np.zeros((len(texts), op9_langid.DIMS))
    for i, t in enumerate(texts):
        b = f" {t.lower()} ".encode()
        for n in (1, 2, 3):
            for a in range(len(b) - n + 1):
                code = 0
                for x in b[a : a + n]:
                    code = (code * 257 + x) % 2**32
                want[i, (code + n * 0x1000193) * 0x9E3779B1 % 2**32 >> 20] += 1
    want = np.sqrt(want)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    for size in (1 << 19, 64, 5, 1):
        assert np.allclose(op9_langid.features(texts, size), np.hstack([want, np.ones((len(texts), 1))]), atol=1e-6)
    langs = [["en", "de", "fr", "es", "it", "xx"][i % 6] for i in range(12)]
    m = op9_langid.fit(texts, langs)
    assert m.families == ["germanic", "romance", "xx"] and set(m.pair_w) == {("de", "en"), ("es", "fr"), ("es", "it"), ("fr", "it")}
    got, scores = m.predict(texts)
    x = np.hstack([want, np.ones((len(texts), 1))])
    for i in range(len(texts)):
        p = np.exp(m.family_scale * x[i] @ m.family_w)
        family = m.families[int(p.argmax())]
        names, score = m.members[family], p.max() / p.sum()
        votes = dict.fromkeys(names, 0.0)
        for (a, b), w in m.pair_w.items():
            if a in votes:
                to_a = 1 / (1 + np.exp(-m.family_scale * x[i] @ w))
                votes[a] += to_a / (len(names) - 1)
                votes[b] += (1 - to_a) / (len(names) - 1)
        if len(names) > 1:
            score *= max(votes.values())
        assert got[i] == max(names, key=votes.get) and scores[i] == pytest.approx(score, abs=1e-5)


def test_language_learns_every_language(spark):
    """Over 200 of them; the sample is bounded, and copies, repeated and null ids fill no place in it."""
    rows = [(None if i % 3 else 7, f"{chr(0x4E00 + n)} word{i} {chr(0x4E00 + n) * 5}", f"l{n:03d}") for n in range(230) for i in range(3)]
    rows += [(i, "the same text", "l000") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = op9_langid.sample(df, per_lang=2, max_rows=500)
    assert collections.Counter(k for k, _ in found) == {f"l{n:03d}": 2 for n in range(230)} and len(set(found)) == 460
    assert len(op9_langid.sample(df, per_lang=400, max_rows=230)) == 230
    with pytest.raises(ValueError):
        op9_langid.sample(df, max_rows=229)
    model = op9_langid.train(df)
    got = op9_langid.predict(df.filter("lang <> 'l000'").limit(600), model).collect()
    assert len(model.families) == 230 and sum(r["lang"] == r["_lang"] for r in got) >= 0.95 * len(got)


# 10


def test_mixing_targets(spark):
    rows = [("a", 1, 100), ("b", 1, 10), ("c", 1, 1000), (None, 1, 0), ("d", 1, 5)]
    got = {r["source"]: r["target"] for r in op10_mixing.targets(spark.createDataFrame(rows, "source string, n long, source_size long")).collect()}
    size = {s: n for s, _, n in rows}
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2]))
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[t] for t in size if t not in capped) for s in size if s not in capped}
        over = {s for s, t in share.items() if t > 3 * size[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * size[s] if s in capped else share[s] for s in size}
    assert got == pytest.approx(want)


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * (i % 7), None, "abcd"[i % 4] if i % 11 else None, 0) for i in range(500)] + [(900 + i, "w " * 50, None, "tiny", 0) for i in range(2)]
    df = spark.createDataFrame(rows, DOCS)
    got = op10_mixing.mix(df, op10_mixing.words_in(F.col("text")), ["doc_id", "source"], bucket_rows=16).select("row.*", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for part in by.values():
        assert sum(r["size"] for r in part) == part[0]["source_size"] and sum(r["taken"] for r in part) == int(part[0]["target"] + 0.5)
        epochs = {r["taken"] // r["size"] for r in part if r["size"]}
        assert len(epochs) <= 2 and sum(1 for r in part if r["size"] and r["taken"] % r["size"]) <= 1
    assert op10_mixing.mix(odd, op10_mixing.words_in(F.col("text")), ["doc_id", "size", "key"]).count() == len(ODD)
    assert op10_mixing.mix(empty, op10_mixing.words_in(F.col("text")), ["doc_id"]).count() == 0


def test_mixing_over_many_buckets(spark):
    """More than 2048 buckets in a source, as it has beyond 8.4 million rows."""
    rows = [(i, "w " * (i % 5), None, "a" if i % 3 else "b", 0) for i in range(5000)]
    df = spark.createDataFrame(rows, DOCS)
    few, many = (
        {r["doc_id"]: r["taken"] for r in op10_mixing.mix(df, op10_mixing.words_in(F.col("text")), ["doc_id"], bucket_rows=n).select("row.doc_id", "taken").collect()} for n in (4096, 1)
    )
    assert few == many and len(few) == 5000


def test_sharding_is_read_from_shards_of_whole_documents(spark, sf_dir, monkeypatch):
    from foliospark.llm import op6_sharding as op6

    paths, real = [], op6.write_shards
    monkeypatch.setattr(op6, "write_shards", lambda docs, path, *a: (paths.append(path), real(docs, path, *a)))
    got = {(r["doc_id"], r["shard"], r["slot"]) for r in op6.op6_sharding(spark, sf_dir).collect()}
    docs, shards = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(paths[0])
    assert shards.select(docs.columns).exceptAll(docs).isEmpty() and shards.count() == docs.count()
    assert {(r["doc_id"], r["_shard"], r["_slot"]) for r in shards.select("doc_id", "_shard", "_slot").collect()} == got
