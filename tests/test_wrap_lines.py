"""wrap_lines covers every line of every text."""

from foliospark.queries import QUERIES


def test_every_line_is_wrapped(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = {(i, k): line.split() for i, t in texts.items() if t is not None for k, line in enumerate(t.split("\n"))}
    got = {(r["doc_id"], r["rk"]): r["lines"] for r in QUERIES["wrap_lines"](spark, sf_dir).collect()}
    assert max(k for _, k in want) >= 4 and set(got) == set(want)
    for at, lines in got.items():
        assert all(len(x) <= 14 for x in lines.split("|")) or any("|" in w for w in want[at])
        assert "".join(lines.replace("|", "").split()) == "".join(want[at]).replace("|", "")
