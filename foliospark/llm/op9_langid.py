"""Language of texts by hierarchical discrimination: a linear model picks the family, pairwise linear SVMs the language.

Features are counts of byte 1-, 2- and 3-grams of the lower-cased whole text, hashed into DIMS bins, square-rooted
and scaled to unit length. Families come from a fixed table of language codes; a code that is not there is a family
of its own. Training fits on a bounded sample of labelled rows, of every language, that is the same on every run;
prediction takes the text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, documents, free_name, slices, texts_of

DIMS = 1 << 12
#: Families of language codes.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "pt": "romance", "it": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "ja": "japonic", "zh": "sinitic", "ko": "koreanic",
    "ar": "semitic", "he": "semitic", "hi": "indic", "bn": "indic", "ur": "indic", "tr": "turkic", "az": "turkic",
}


def features(texts: list[str], size: int = 1 << 19) -> np.ndarray:
    """A row of DIMS numbers and a 1 for each text. Texts go through in pieces of about size bytes, longer ones in several.

    There is one matrix, and no copy of it: with max_rows texts it is what the driver holds when a model is fitted.
    """
    made = np.zeros((len(texts), DIMS + 1), np.float32)
    out = made[:, :DIMS]
    group, held = [], 0
    for i, t in enumerate(texts):
        data = f" {t.lower()} ".encode()
        for a in range(0, len(data), size):
            group.append((i, data[a : a + size + 2], size))  # n-grams that start in the first size bytes count
            held += len(group[-1][1])
            if held >= size:
                _count(group, out)
                group, held = [], 0
    if group:
        _count(group, out)
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
    made[:, DIMS] = 1
    return made


def _count(group: list[tuple[int, bytes, int]], out: np.ndarray) -> None:
    """Adds the n-grams of pieces (text, bytes, how many of them may start one), in the order of texts, to out."""
    lengths = np.array([len(d) for _, d, _ in group])
    code = joined = np.frombuffer(b"".join(d for _, d, _ in group), np.uint8).astype(np.uint32)
    piece = np.repeat(np.arange(len(group)), lengths)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    starts = place < np.repeat([n for *_, n in group], lengths)
    first, last = group[0][0], group[-1][0]
    row = np.array([i - first for i, *_ in group])[piece] * DIMS
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * np.uint32(257) + joined[n - 1 :]
        ok = (piece[: len(code)] == piece[n - 1 :]) & starts[: len(code)]
        h = ((code + np.uint32(n * 0x1000193)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out[first : last + 1] += np.bincount((row[: len(code)] + h)[ok], minlength=(last + 1 - first) * DIMS).reshape(-1, DIMS)


def linear_svms(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights (the last is the bias), a column for each column of y, of least squared hinge loss plus penalty.

    x has a last column of 1. y is +1 or -1, and 0 where a row is none of a column's; the two classes of a column weigh the same.
    """
    each = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1)) * y
    y, each = y.astype(np.float32), each.astype(np.float32)  # any double here would copy x in every step
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    rate = np.float32(1 / (2 * np.einsum("ij,ij->i", x, x).max() + penalty))
    for k in range(steps):  # accelerated gradient steps
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (np.float32(penalty) * v - 2 * (x.T @ (each * slack)))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    family_w: np.ndarray  # a column for each family, one against the rest
    pair_w: dict[tuple[str, str], np.ndarray]
    family_scale: float = 4.0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: family share times the mean share of votes in its pairs."""
        x = features(texts)
        margins = (self.family_scale * (x @ self.family_w)).astype(np.float64)
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        langs, scores = [""] * len(texts), p.max(1)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            names = self.members[name]
            if len(names) == 1:
                for r in rows:
                    langs[r] = names[0]
                continue
            votes = np.zeros((len(rows), len(names)))
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    w = self.pair_w[a, b]
                    to_a = 1 / (1 + np.exp(-self.family_scale * (x[rows] @ w).astype(np.float64)))
                    votes[:, names.index(a)] += to_a
                    votes[:, names.index(b)] += 1 - to_a
            votes /= len(names) - 1
            for r, k in zip(rows, votes.argmax(1)):
                langs[r] = names[k]
            scores[rows] *= votes.max(1)
        return langs, np.clip(scores, 0, 1)


def fit(texts: list[str], langs: list[str], at_once: int = 64) -> Model:
    """All classifiers of families and pairs, at_once of them together.

    Of n texts this holds n * (DIMS + 1) * 4 bytes of features and 20 * n * at_once bytes beside: 0.2 GB of 12,000.
    """
    x, of_lang, names = features(texts), np.array(langs), sorted(set(langs))
    members: dict[str, list[str]] = {}
    for n in names:
        members.setdefault(FAMILIES.get(n, n), []).append(n)
    families = sorted(members)
    of = np.array([FAMILIES.get(n, n) for n in langs])
    pairs = [(a, b) for group in members.values() for i, a in enumerate(group) for b in group[i + 1 :]]
    tasks = [*(families if len(families) > 1 else []), *pairs]

    def signs(task: str | tuple[str, str]) -> np.ndarray:
        if isinstance(task, str):
            return np.where(of == task, 1, -1)
        return (of_lang == task[0]).astype(int) - (of_lang == task[1])

    columns = [linear_svms(x, np.stack([signs(t) for t in tasks[i : i + at_once]], axis=1)) for i in range(0, len(tasks), at_once)]
    w = np.hstack(columns) if columns else np.zeros((DIMS + 1, 0), np.float32)
    n = len(tasks) - len(pairs)
    return Model(families, members, w[:, :n] if n else np.zeros((DIMS + 1, 1), np.float32), {p: w[:, n + i] for i, p in enumerate(pairs)})


def sample(docs: DataFrame, per_lang: int = 400, max_chars: int = 20_000, max_rows: int = 12_000) -> list[tuple[str, str]]:
    """(lang, text) of labelled rows of docs(text, lang): of each language the per_lang different texts of least hash.

    Every language is there: with more than max_rows / per_lang of them each has fewer texts, one at least, so that
    max_rows bounds what the driver holds. ValueError with more than max_rows languages. Texts over max_chars, null
    ones and ones without a letter are not drawn. Copies of a text, rows of equal or null id included, count once.
    """
    usable = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "text", (F.xxhash64(F.lit(9), "text") / F.lit(2.0**64) + F.lit(0.5)).alias("p"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("p", 0.02).alias("n")).limit(max_rows + 1).collect()
    if not counts:
        return []
    if len(counts) > max_rows:
        raise ValueError(f"more than {max_rows} languages")
    k = max(1, min(per_lang, max_rows // len(counts)))
    # how far up the hashes each sample reaches: enough in expectation and beyond; the exact cut follows
    reach = [(r["lang"], min(1.0, (k + 5 * k**0.5 + 10) / max(1, r["n"]))) for r in counts]
    share = F.broadcast(docs.sparkSession.createDataFrame(reach, "l string, share double"))  # max_rows rows at most
    drawn = usable.join(share, F.col("lang") == F.col("l")).filter(F.col("p") <= F.col("share"))
    texts = drawn.groupBy("lang", "p").agg(F.min("text").alias("text"))
    ranked = texts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("p"))).filter(F.col("k") <= k)
    return sorted((r["lang"], r["text"]) for r in ranked.select("lang", "text").collect())


def train(docs: DataFrame, per_lang: int = 400, max_chars: int = 20_000, max_rows: int = 12_000) -> Model | None:
    """A model of all languages of docs(text, lang), from a sample() that is the same on every run; None if no row is labelled."""
    found = sample(docs, per_lang, max_chars, max_rows)
    return fit([t for _, t in found], [lang for lang, _ in found]) if found else None


def predict(docs: DataFrame, model: Model | None, batch_chars: int = 4_000_000, lang_as: str = "_lang", score_as: str = "_score") -> DataFrame:
    """docs with two columns added: `und` and 0 where the text is null, empty or has no letter.

    Rows are independent, repeated ones and ties too; other columns pass through as they are (ones named like the two
    new ones are dropped first); an empty table stays empty; without a model all is `und`.
    """
    spark = docs.sparkSession
    bound_batches(spark, 500)
    docs = docs.drop(lang_as, score_as)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.columns
    letter_as = free_name(docs, "_letter")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{letter_as}` boolean, `{lang_as}` string, `{score_as}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, 500):
            texts, letter = texts_of(b.column(kept.index("text"))), b.column(len(kept)).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, x in enumerate(letter) if x and m is not None]
            at = 0
            while at < len(rows):
                to, held = at, 0
                while to < len(rows) and (to == at or held + len(texts[rows[to]]) <= batch_chars):
                    held += len(texts[rows[to]])
                    to += 1
                got, p = m.predict([texts[i] for i in rows[at:to]])
                for i, lang, score in zip(rows[at:to], got, p):
                    langs[i], scores[i] = lang, score
                at = to
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_as, score_as])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(letter_as, letter).mapInArrow(run, schema).drop(letter_as)


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text is 2 modulo 4. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    made = predict(docs.select("doc_id", "text"), model)
    return made.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
