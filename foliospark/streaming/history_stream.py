"""The history fold and page claims over a stream of commands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "page_id long, rev int, n_done int, n_undone int, last_seq int"
STATE = "done array<int>, undone array<int>, rev int"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done, undone, rev = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
    last = -1
    rows = pd.concat(list(batches)).sort_values("cmd_seq")  # the commands of one page in one micro-batch
    for seq, cmd in zip(rows["cmd_seq"], rows["cmd"]):
        last = int(seq)
        if cmd == "edit":
            done, undone, rev = [*done, last], [], rev + 1
        elif cmd == "undo" and done:
            done, undone, rev = done[:-1], [done[-1], *undone], rev + 1
        elif cmd == "redo" and undone:
            done, undone, rev = [*done, undone[0]], undone[1:], rev + 1
    state.update((done, undone, rev))
    yield pd.DataFrame({"page_id": [key[0]], "rev": [rev], "n_done": [len(done)], "n_undone": [len(undone)], "last_seq": [last]})


def history(commands: DataFrame) -> DataFrame:
    """A row for each page a micro-batch touches, with its state after it. Commands of a page have to arrive in order
    of cmd_seq between micro-batches."""
    return commands.groupBy("page_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def claims(commands: DataFrame) -> DataFrame:
    """The last claim or release of each page so far; a stateful aggregation in the JVM."""
    return commands.filter(F.col("cmd").isin("claim", "redo")).groupBy("page_id").agg(F.max_by("cmd", "cmd_seq").alias("cmd"), F.max("cmd_seq").alias("cmd_seq"))


def edit_rates(commands: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Commands of each kind by tumbling window; rows later than the watermark are left out."""
    return commands.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "cmd").agg(F.count("*").alias("n")).select("w.start", "cmd", "n")
