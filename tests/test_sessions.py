"""Sessions of pages over several batches of a stream: history, claims that end, late commands."""

import datetime as dt
import random

from pyspark.sql import functions as F

from foliospark.operators import history
from foliospark.streaming import review_stream

KIND = "page_id long, seq long, ts timestamp, cmd string, editor string"
START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, seconds, late):
    """The rows that come out when these batches arrive one after the other, each in a run of its own."""
    for rows in batches:
        spark.createDataFrame([(p, s, START + dt.timedelta(seconds=t), c, e) for p, s, t, c, e in rows], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.conf.set(*review_stream.STORE)
        made = review_stream.sessions(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), seconds, late)
        q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.conf.unset(review_stream.STORE[0])
    return spark.read.schema(review_stream.OUT.replace("until long", "until timestamp")).parquet(str(tmp_path / "out"))


def test_history_over_batches_is_the_fold(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(1, 4), i, i, rng.choice(["edit", "edit", "undo", "redo"]), "a") for i in range(90)]
    out = run(spark, tmp_path, [rows[:30], rows[30:31], rows[31:]], 60, "1 day")
    table = spark.createDataFrame([(p, s, c) for p, s, _, c, _ in rows], "page_id long, cmd_seq int, cmd string")
    want = {r["page_id"]: (r["done"], r["undone"], r["rev"]) for r in history.folded(table).collect()}
    assert {r["page_id"]: (r["done"], r["undone"], r["rev"]) for r in review_stream.latest(out).collect()} == want
    assert out.filter("kind <> 'state'").count() == 0


def test_claims_end_and_late_commands_go_out(spark, tmp_path):
    batches = [
        [(1, 1, 0, "edit", "a"), (1, 2, 1, "edit", "a"), (1, 3, 2, "undo", "a"), (1, 4, 3, "claim", "a"), (2, 1, 0, "claim", "b"), (1, 6, 5, "claim", "c"), (None, 9, 5, "edit", "x"), (4, 1, 0, "claim", None)],
        [(1, 5, 4, "edit", "a"), (1, 7, 30, "redo", "a"), (1, 8, 31, "release", "a"), (1, 9, 32, "claim", "c"), (3, 1, 30, "release", "z"), (2, 2, 50, "claim", "b")],
        [(3, 2, 900, "edit", "z")],
        [(3, 3, 901, "undo", "z"), (3, 3, 902, "undo", "z")],
        [(3, 4, 2000, "edit", "z"), (1, 10, 0, "edit", "behind the watermark")],
    ]
    out = run(spark, tmp_path, batches, 60, "10 seconds")
    at = F.unix_timestamp("until") - int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    found = {(r["kind"], r["page_id"], r["seq"], r["editor"], r["at"]) for r in out.filter("kind <> 'state'").withColumn("at", at).collect()}
    assert found == {
        ("claimed", 1, 4, "a", 63), ("refused", 1, 6, "c", 63), ("claimed", 2, 1, "b", 60), ("claimed", 4, 1, "", 60),
        ("late", 1, 5, "a", None), ("released", 1, 8, "a", None), ("claimed", 1, 9, "c", 92), ("released", 3, 1, "z", None), ("claimed", 2, 2, "b", 110),
        ("expired", 1, None, "c", 92), ("expired", 2, None, "b", 110), ("expired", 4, None, "", 60), ("late", 3, 3, "z", None),
    }
    state = {r["page_id"]: (r["done"], r["undone"], r["rev"]) for r in review_stream.latest(out).collect()}
    assert state[1] == ([1, 2], [], 4) and state[3] == ([4], [], 3) and state[2] == state[4] == ([], [], 0)
