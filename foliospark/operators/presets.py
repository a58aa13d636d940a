"""Presets of a series: a name with a translation style, a glossary and the settings of masking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Project

STYLES = ("literal", "balanced", "natural", "localized")
FIELDS = ("style", "glossary_path", "pad", "border")


def upsert(presets: DataFrame, new: DataFrame) -> DataFrame:
    """presets(ord, name, style, glossary_path, pad, border) after new ones: one of a known name takes its place, others follow.

    Of several new ones of a name the last counts. Styles have to be known: others raise nothing and are left out.
    """
    good = new.filter(F.col("style").isin(*STYLES))
    last = good.groupBy("name").agg(F.max_by(F.struct(*FIELDS), "ord").alias("_n"), F.min("ord").alias("_ord"))
    both = presets.join(last, "name", "full")
    w = Window.orderBy(F.col("ord").asc_nulls_last(), "_ord")  # a list of presets is small
    values = [F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS]
    return both.select((F.row_number().over(w) - 1).alias("ord"), "name", *values)


def remove(presets: DataFrame, name: str) -> DataFrame:
    return presets.filter(F.col("name") != name)


def find(presets: DataFrame, name: str) -> DataFrame:
    return presets.filter(F.col("name") == name)


def names(presets: DataFrame) -> DataFrame:
    """(ord, name) in the order they were defined."""
    return presets.select("ord", "name").orderBy("ord")


def apply(project: Project, preset: dict) -> Project:
    """The project with a preset's style, masking settings and, if it has one, glossary; the chosen translator stays."""
    config = dict(project.config)
    config["translate"] = {"translator": (config.get("translate") or {}).get("translator", "argos"), "style": preset["style"]}
    config["render"] = {"pad": preset.get("pad", 2), "border": preset.get("border", 4)}
    if preset.get("glossary_path"):
        config["series_glossary"] = preset["glossary_path"]
    return replace(project, config=config)
