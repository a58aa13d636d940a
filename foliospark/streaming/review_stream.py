"""A page's review session as keyed state of a stream: history, claims that run out, and commands that come too late.

State of a page: the entries of its history as a list (in force or undone), the claims on it as a map from editor to the time it
ends, its revision and the last command. Commands of a page are applied in the order of their seq. One that
comes after a later one has been applied changes nothing and goes out marked late, for whoever has to see to it.
A claim ends when it is released, or when the watermark passes its end: then a timer takes it off.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_path

#: kind: state (of a page after a batch), late (a command not applied), claimed, refused, released or expired (an editor's claim).
OUT = "kind string, page_id long, seq long, editor string, rev long, done array<long>, undone array<long>, until long"
#: A state store that keeps lists, maps and timers of keys.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Session(StatefulProcessor):
    """Applies the commands of a page: edit, undo, redo, claim, release. A claim holds for some seconds after its command."""

    def __init__(self, seconds: int):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "seq long, undone boolean")
        self.claims = handle.getMapState("claims", "editor string", "until long")
        self.head = handle.getValueState("head", "rev long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rev, last = self.head.get() if self.head.exists() else (0, None)
        done, undone = [], []
        for entry, is_undone in self.entries.get():
            (undone if is_undone else done).append(entry)
        page, out = int(key[0]), []
        came = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, at, cmd, editor in zip(came["seq"], came["at"], came["cmd"], came["editor"]):
            seq = int(seq)
            if last is not None and seq <= last:
                out.append(_row("late", page, seq, editor))
                continue
            last = seq
            if cmd == "edit":
                done, undone, rev = [*done, seq], [], rev + 1
            elif cmd == "undo" and done:
                done, undone, rev = done[:-1], [done[-1], *undone], rev + 1
            elif cmd == "redo" and undone:
                done, undone, rev = [*done, undone[0]], undone[1:], rev + 1
            elif cmd in ("claim", "release"):
                out.append(self._claim(page, seq, int(at), cmd, editor))
        self.entries.clear()
        if done or undone:
            self.entries.put([*((s, False) for s in done), *((s, True) for s in undone)])
        self.head.update((rev, last))
        yield pd.DataFrame([*out, _row("state", page, last, None, rev, done, undone)])

    def _claim(self, page: int, seq: int, now: int, cmd: str, editor: str) -> dict:
        others = [(e[0], u[0]) for e, u in self.claims.iterator() if e[0] != editor and u[0] > now]
        if cmd == "release":
            if self.claims.containsKey((editor,)):
                self.handle.deleteTimer(self.claims.getValue((editor,))[0])
                self.claims.removeKey((editor,))
            return _row("released", page, seq, editor)
        if others:  # who holds the page keeps it
            return _row("refused", page, seq, editor, until=others[0][1])
        if self.claims.containsKey((editor,)):
            self.handle.deleteTimer(self.claims.getValue((editor,))[0])
        self.claims.updateValue((editor,), (now + self.ms,))
        self.handle.registerTimer(now + self.ms)
        return _row("claimed", page, seq, editor, until=now + self.ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        gone = [e[0] for e, u in self.claims.iterator() if u[0] <= until]
        for editor in gone:
            self.claims.removeKey((editor,))
        if gone:
            yield pd.DataFrame([_row("expired", int(key[0]), None, e, until=until) for e in gone])

    def close(self) -> None:
        pass


def _row(kind: str, page: int, seq: int | None, editor: str | None, rev: int | None = None, done: list | None = None, undone: list | None = None, until: int | None = None) -> dict:
    return {"kind": kind, "page_id": page, "seq": seq, "editor": editor, "rev": rev, "done": done, "undone": undone, "until": until}


def sessions(commands: DataFrame, seconds: int = 900, late: str = "1 hour") -> DataFrame:
    """What happens on the pages of a stream commands(page_id, seq, ts, cmd, editor): rows as in OUT, in append mode.

    seq orders the commands of a page. Those whose ts is behind the watermark are left out by the stream itself.
    The session has to use the state store of STORE.
    """
    kept = commands.select(F.col("page_id").cast("long").alias("page_id"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_millis("ts").alias("at"), "cmd", F.coalesce("editor", F.lit("")).alias("editor"))
    keyed = kept.filter("page_id is not null and seq is not null").withWatermark("ts", late).groupBy("page_id")
    return keyed.transformWithStateInPandas(Session(seconds), OUT, "Append", "EventTime").withColumn("until", F.timestamp_millis("until"))


def latest(rows: DataFrame) -> DataFrame:
    """(page_id, done, undone, rev) of each page from the rows that sessions() has put out so far."""
    last = rows.filter("kind = 'state'").groupBy("page_id").agg(F.max_by(F.struct("done", "undone", "rev"), "seq").alias("s"))
    return last.select("page_id", "s.done", "s.undone", "s.rev")


def replayed(commands: DataFrame, seconds: int = 900, late: str = "1 hour") -> DataFrame:
    """All rows that sessions() puts out for what there is of a stream now, as a table in the shared folder."""
    spark = commands.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        path = shared_path(spark, "sessions")
        started = sessions(commands, seconds, late).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
        query = started.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema(OUT.replace("until long", "until timestamp")).parquet(f"{path}/rows")
