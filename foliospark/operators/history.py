"""Edit history: a fold of each page's commands, in order.

A command log has (page_id, cmd_seq, cmd). edit drops the page's undone tail, appends an entry and raises the
revision; undo marks the last entry not undone, redo clears the first undone one, each raising the revision if there
is one. The state of a page is a list of entry numbers and which are undone; pages fold in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = "struct<done:array<int>,undone:array<int>,rev:int,conflicts:int>"


def step(s: Column, c: Column) -> Column:
    """done: entries in force, oldest first. undone: entries undone, the one to redo first at the head."""
    done, undone, rev = s["done"], s["undone"], s["rev"]
    n, m = F.size(done), F.size(undone)

    def state(d: Column, u: Column, r: Column) -> Column:
        return F.struct(d.alias("done"), u.alias("undone"), r.alias("rev"), s["conflicts"].alias("conflicts")).cast(STATE)

    edit = state(F.concat(done, F.array(c["cmd_seq"])), F.array().cast("array<int>"), rev + 1)
    undo = state(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.concat(F.slice(done, F.greatest(n, F.lit(1)), 1), undone), rev + 1)
    redo = state(F.concat(done, F.slice(undone, 1, 1)), F.slice(undone, 2, F.greatest(m, F.lit(1))), rev + 1)
    return F.when(c["cmd"] == "edit", edit).when((c["cmd"] == "undo") & (n > 0), undo).when((c["cmd"] == "redo") & (m > 0), redo).otherwise(s)


def zero() -> Column:
    none = F.array().cast("array<int>")
    return F.struct(none.alias("done"), none.alias("undone"), F.lit(0).alias("rev"), F.lit(0).alias("conflicts")).cast(STATE)


def folded(commands: DataFrame) -> DataFrame:
    """(page_id, done, undone, rev, can_undo, can_redo) after all commands. A page's log is one array: people edit it."""
    log = F.array_sort(F.collect_list(F.struct("cmd_seq", "cmd")))
    out = commands.groupBy("page_id").agg(log.alias("log")).select("page_id", F.aggregate("log", zero(), step).alias("s"))
    return out.select("page_id", "s.done", "s.undone", "s.rev", (F.size("s.done") > 0).alias("can_undo"), (F.size("s.undone") > 0).alias("can_redo"))


def listing(commands: DataFrame) -> DataFrame:
    """(page_id, seq, undone): the entries there are at the end, newest first by seq."""
    f = folded(commands)
    live = f.select("page_id", F.explode("done").alias("seq"), F.lit(False).alias("undone"))
    return live.union(f.select("page_id", F.explode("undone").alias("seq"), F.lit(True).alias("undone")))


def claims(commands: DataFrame, claim: str = "claim", release: str = "redo") -> DataFrame:
    """(page_id, cmd_seq) of pages whose last claim or release is a claim."""
    last = commands.filter(F.col("cmd").isin(claim, release)).groupBy("page_id").agg(F.max_by("cmd", "cmd_seq").alias("cmd"), F.max("cmd_seq").alias("cmd_seq"))
    return last.filter(F.col("cmd") == claim).select("page_id", "cmd_seq")


def stale_writes(writes: DataFrame) -> DataFrame:
    """writes(page_id, cmd_seq, expected_rev) with accepted: a write applies if it expects no revision or the page's
    current one, and then raises it. The fold is per page, as each decision needs the ones before."""
    item = F.struct("cmd_seq", "expected_rev")
    log = writes.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("log"))
    state = "struct<rev:int,out:array<struct<cmd_seq:int,accepted:boolean,rev:int>>>"

    def apply(s: Column, w: Column) -> Column:
        ok = w["expected_rev"].isNull() | (w["expected_rev"] == s["rev"])
        rev = s["rev"] + F.when(ok, 1).otherwise(0)
        row = F.struct(w["cmd_seq"].alias("cmd_seq"), ok.alias("accepted"), rev.alias("rev"))
        return F.struct(rev.alias("rev"), F.concat(s["out"], F.array(row)).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("rev"), F.array().cast("array<struct<cmd_seq:int,accepted:boolean,rev:int>>").alias("out")).cast(state)
    return log.select("page_id", F.explode(F.aggregate("log", start, apply, lambda s: s["out"])).alias("r")).select("page_id", "r.*")


def reindexed(regions: DataFrame) -> DataFrame:
    """(page_id, region_id, reading_order): places 0.. by present place (none last) and id."""
    w = Window.partitionBy("page_id").orderBy(F.coalesce("reading_order", F.lit(1 << 30)), "region_id")
    return regions.select("page_id", "region_id", (F.row_number().over(w) - 1).alias("reading_order"))
