"""Stages that depend on each other, with keys that change with anything before them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import content_key_of
from ..sources.shared import dropped, settled


@dataclass(frozen=True)
class Stage:
    """run takes the tables so far and returns new ones by name; inputs names what its own key depends on."""

    name: str
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    deps: tuple[str, ...] = ()
    inputs: Callable[[], str] = field(default=lambda: "")


class Pipeline:
    def __init__(self, stages: list[Stage]):
        self.by_name = {s.name: s for s in stages}
        if len(self.by_name) < len(stages):
            raise ValueError("two stages share a name")
        for s in stages:
            if missing := set(s.deps) - set(self.by_name):
                raise ValueError(f"{s.name} depends on unknown stages: {', '.join(sorted(missing))}")
        try:
            self.order = list(TopologicalSorter({s.name: s.deps for s in stages}).static_order())
        except CycleError as e:
            raise ValueError(f"stages depend on each other: {e.args[1]}") from e

    def keys(self) -> dict[str, str]:
        """Key of each stage: its name, its own inputs and the keys of what it depends on."""
        found: dict[str, str] = {}
        for name in self.order:
            s = self.by_name[name]
            found[name] = content_key_of(name, s.inputs(), *(found[d] for d in s.deps))
        return found

    def _reach(self, start: str, forward: bool) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            if (name := todo.pop()) not in seen:
                seen.add(name)
                todo += [s.name for s in self.by_name.values() if name in s.deps] if forward else self.by_name[name].deps
        return seen

    def select(self, only: str | None = None, start: str | None = None, end: str | None = None) -> list[str]:
        """Names of the stages to run, in order."""
        if only and (start or end):
            raise ValueError("only stands alone")
        for name in filter(None, (only, start, end)):
            if name not in self.by_name:
                raise ValueError(f"unknown stage {name}")
        chosen = {only} if only else set(self.order)
        chosen &= self._reach(start, True) if start else chosen
        chosen &= self._reach(end, False) if end else chosen
        return [n for n in self.order if n in chosen]

    def run(self, tables: dict[str, DataFrame], state: dict[str, str], save: Callable[[dict[str, str]], None] = lambda s: None, force: bool = False, **which: str) -> dict[str, str]:
        """Runs what changed and records each stage as it ends; (stage -> ran or skipped)."""
        keys, out = self.keys(), {}
        for name in self.select(**which):
            if state.get(name) == keys[name] and not force:
                out[name] = "skipped"
                continue
            tables.update(self.by_name[name].run(tables))
            state[name] = keys[name]
            save(state)
            out[name] = "ran"
        return out


class JsonState:
    """State of a pipeline as JSON text in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> dict[str, str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(self.path, wholetext=True).collect()))

    def save(self, state: dict[str, str]) -> None:
        df = self.spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string")
        df.coalesce(1).write.mode("overwrite").text(self.path)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs that edges(src, dst) connect, each once, in rounds of joins as many as the longest way; cycles end too.

    A round leads on only from the pairs that the last one found. Each is a table in the shared folder, and no number of pairs is too many.
    """
    edges = settled(edges.select("src", "dst").distinct(), "edges")
    step = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"))
    found = [edges]
    while True:
        met = found[-1].join(step, F.col("dst") == F.col("_at")).select("src", F.col("_to").alias("dst")).distinct()
        had = reduce(DataFrame.union, found).toDF("_src", "_dst")
        new = settled(met.join(had, F.col("src").eqNullSafe(F.col("_src")) & F.col("dst").eqNullSafe(F.col("_dst")), "left_anti"), "closure")
        if not new.limit(1).count():
            dropped(new)
            return reduce(DataFrame.union, found)
        found.append(new)
