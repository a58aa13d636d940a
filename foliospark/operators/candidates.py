"""Candidates of units as arrays: attaching machine results without touching what people chose.

A candidate is struct(id, kind, text, confidence); selected is the id of one of them or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import met

AI_KINDS = ("ai", "literal", "natural")


def gathered(candidates: DataFrame, *more: Column, beside: DataFrame | None = None) -> DataFrame:
    """(page_id, unit_id, candidates) from one row a candidate, in the order of ord; more are further aggregates of a unit's rows.

    beside(page_id, unit_id, ...): rows that are no candidates and have no ord, for more.
    """
    item = F.struct("ord", F.struct(F.col("candidate_id").alias("id"), "kind", "text", F.col("confidence").cast("double").alias("confidence")).alias("c"))
    if beside is not None:
        item = F.when(F.col("ord").isNotNull(), item)
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["c"]).alias("candidates")
    return met(["page_id", "unit_id"], [candidates] if beside is None else [candidates, beside], listed, *more)


def candidate(id_: Column, kind: str, text: Column, confidence: Column | None = None) -> Column:
    return F.struct(id_.alias("id"), F.lit(kind).alias("kind"), text.alias("text"), (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"))


def of_kind(cands: Column, kind: str) -> Column:
    """The first candidate of a kind, or null."""
    return F.get(F.filter(cands, lambda c: c["kind"] == kind), F.lit(0))


def by_id(cands: Column, id_: Column) -> Column:
    return F.get(F.filter(cands, lambda c: c["id"] == id_), F.lit(0))


def selected_text(cands: Column, selected: Column) -> Column:
    """The selected candidate's text, empty if there is none."""
    return F.coalesce(by_id(cands, selected)["text"], F.lit(""))


def attach_raw(units: DataFrame, new: Column) -> DataFrame:
    """The new raw candidate replaces earlier ones; the selection stays on any other candidate, else moves to it."""
    rest = F.filter("candidates", lambda c: c["kind"] != "raw")
    stays = F.exists(rest, lambda c: c["id"] == F.col("selected"))
    return units.withColumn("selected", F.when(F.coalesce(stays, F.lit(False)), F.col("selected")).otherwise(new["id"])).withColumn("candidates", F.concat(rest, F.array(new)))


def attach_sfx(units: DataFrame, new: Column, mode: str) -> DataFrame:
    """The new sfx candidate replaces earlier ones. Mode transliterate selects it, but never over a manual choice;
    a selection that is gone becomes null."""
    rest = F.filter("candidates", lambda c: c["kind"] != "sfx")
    held = F.coalesce(F.exists(F.concat(rest, F.array(new)), lambda c: c["id"] == F.col("selected")), F.lit(False))
    kept = F.when(held, F.col("selected"))
    manual = F.coalesce(by_id(F.col("candidates"), F.col("selected"))["kind"] == "manual", F.lit(False))
    chosen = F.when(~manual, new["id"]).otherwise(kept) if mode == "transliterate" else kept
    return units.withColumn("selected", chosen).withColumn("candidates", F.concat(rest, F.array(new)))


def attach_ai(units: DataFrame, text: Column, confidence: Column, mode: str = "assist", min_confidence: float = 0.8) -> DataFrame:
    """An AI candidate replaces those of AI kinds. assist keeps the choice, review moves it to the AI candidate, auto
    does so from min_confidence on; a manual choice is never moved. A choice that is gone falls back to the draft."""
    new = candidate(F.concat("unit_id", F.lit("_ai")), "ai", text, confidence)
    some = F.trim(text) != ""
    rest = F.filter("candidates", lambda c: ~c["kind"].isin(*AI_KINDS))
    all_ = F.when(some, F.concat(rest, F.array(new))).otherwise(rest)
    held = F.coalesce(F.exists(rest, lambda c: c["id"] == F.col("selected")), F.lit(False))
    draft = F.coalesce(of_kind(rest, "manual")["id"], of_kind(rest, "raw")["id"])
    base = F.when(held, F.col("selected")).otherwise(draft)
    approved = F.coalesce(by_id(F.col("candidates"), F.col("selected"))["kind"] == "manual", F.lit(False))
    moves = {"assist": F.lit(False), "review": F.lit(True), "auto": F.coalesce(confidence >= min_confidence, F.lit(False))}[mode]
    chosen = F.when(some & moves & ~approved, new["id"]).otherwise(base)
    chosen = F.coalesce(chosen, F.when(some, new["id"]).otherwise(F.get(all_, F.lit(0))["id"]))
    return units.withColumn("selected", chosen).withColumn("candidates", all_)


def merged_alternatives(text: Column, alternatives: Column, proposed: Column) -> Column:
    """Proposals that are new, not empty and not the text itself, after the alternatives there are."""
    new = F.array_distinct(F.filter(proposed, lambda p: (p != "") & (p != text) & ~F.array_contains(alternatives, p)))
    return F.concat(alternatives, new)


def accepted_alternative(text: Column, alternatives: Column, chosen: Column) -> tuple[Column, Column]:
    """Text and alternatives after choosing one: the old text goes to the front, unless it is empty or there already."""
    others = F.filter(alternatives, lambda a: a != chosen)
    return chosen, F.when((text != "") & ~F.array_contains(others, text), F.concat(F.array(text), others)).otherwise(others)


def parsed_reply(reply: Column) -> Column:
    """struct(candidate, readability, literal, confidence, warnings) of a model's JSON reply, fenced or not.

    Malformed replies give null; confidence is cut to 0..1; warnings keep non-blank strings.
    """
    bare = F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*|\s*```$", "")
    p = F.from_json(bare, "candidate string, readability string, literal string, confidence double, warnings array<string>", {"mode": "PERMISSIVE"})
    text = F.coalesce(F.nullif(F.trim(p["candidate"]), F.lit("")), F.nullif(F.trim(p["readability"]), F.lit("")))
    return F.when(text.isNotNull(), F.struct(
        text.alias("candidate"), F.nullif(F.trim(p["readability"]), F.lit("")).alias("readability"), F.nullif(F.trim(p["literal"]), F.lit("")).alias("literal"),
        F.when(p["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["confidence"]))).alias("confidence"), F.filter(F.coalesce(p["warnings"], F.array().cast("array<string>")), lambda w: F.trim(w) != "").alias("warnings"),
    ))
