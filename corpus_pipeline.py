"""From documents to packed sequences: language, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; null ids, repeated rows and empty tables go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, discard, free_name, written
from foliospark.llm.op1_secrets import find_secrets, redact
from foliospark.llm.op2_simhash import near_duplicates
from foliospark.llm.op5_packing import pack_documents
from foliospark.llm.op9_langid import held_out, predict, train
from foliospark.llm.op10_mixing import mix, words_in
from foliospark.llm.tokens import public_path

#: A document whose language is less sure than this is rejected, as is one without a letter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a null lang is filled in. Null, empty and letterless texts go."""
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    made = predict(docs, train(docs.filter(~held_out())), lang_as=lang, score_as=score)
    kept = made.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that shares five-word shingles to 0.8 or more.

    Null texts and those without a word are one group. A null id stays; rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs).filter("doc_id <> keep").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text replaced by a mark; a null text stays null."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    made = redact(find_secrets(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return made.select(*[own[c] if c in own else F.col(f"row.`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes epochs of it; the last may have its leading words alone."""
    made = mix(docs, words_in(F.col("text")), docs.columns).filter("taken > 0")
    copies = made.withColumn("at", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("at") - 1) * F.col("size")).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), 0), 1, words), "")
    text = F.when(words < F.col("size"), head).otherwise(F.col("row.text"))
    own = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return copies.select(*[own[c] if c in own else F.col(f"row.`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 2048 tokens."""
    return pack_documents(docs, public_path())


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("mixed", mixed), ("packed", packed)]

#: No SQL has hashed n-gram models, SimHash or tokenizers: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again; only the last table stays."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return docs
