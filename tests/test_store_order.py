"""Names with numbers of any length, manifests by groups, and tables that a crash leaves whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.operators import ordering
from foliospark.sources import store


def natural(name):
    return [int(c) if c.isdigit() else c.lower() for c in re.split(r"(\d+)", name)]


def test_natural_order_of_numbers_of_any_length(spark):
    rng = random.Random(1)
    names = {f"page{n}{s}" for n in ["1", "2", "10", "007", "9" * 40, "1" + "0" * 40, "0" * 50, "0" * 41 + "3", "8" * 39] for s in ["", "a", ".png", "x" + "5" * 60]} | {"", "a", "A", "10", "9", "9" * 300}
    names |= {"".join(rng.choices("ab019", k=rng.randint(1, 60))) for _ in range(300)}
    got = [r["n"] for r in ordering.natural_order(spark.createDataFrame([(n,) for n in names], "n string"), "n").orderBy("place").collect()]
    assert got == sorted(names, key=lambda n: (natural(n), n))


def test_manifest_order_goes_by_groups(spark):
    rng = random.Random(2)
    files = [f"p{i}" for i in range(3000)]
    manifest = [(n, rng.randint(-50, 50)) for n in rng.sample(files, 700)] + [("p1", 3), ("lost", 1), ("lost", 0), ("p2", -(1 << 40))]
    pos = {}
    for n, p in manifest:
        pos[n] = min(p, pos.get(n, p))
    df = ordering.manifest_order(spark.createDataFrame([(n,) for n in files], "name string").repartition(3), spark.createDataFrame(manifest, "name string, pos long"))
    rows = df.collect()
    found = [r["name"] for r in sorted((r for r in rows if r["found"]), key=lambda r: r["place"])]
    assert found == sorted(files, key=lambda n: (n not in pos, pos.get(n, 0), natural(n), n))
    assert [(r["name"], r["pos"], r["place"]) for r in rows if not r["found"]] == [("lost", 0, None)]


def test_a_crash_leaves_a_table_whole(spark, tmp_path, monkeypatch):
    s = store.Store.create(spark, str(tmp_path / "p"), store.Project("x"))
    page = spark.createDataFrame([(1, 0, "a.png", 10, 20)], store.TABLES["pages"])
    s.write("pages", page)
    real = store.write_text

    def crash(*args):
        raise OSError("the machine is gone")

    monkeypatch.setattr(store, "write_text", crash)
    with pytest.raises(OSError, match="gone"):
        s.write("pages", page.union(page))
    monkeypatch.setattr(store, "write_text", real)
    assert s.read("pages").count() == 1
    s.write("pages", s.read("pages").withColumn("idx", F.col("idx") + 1).union(page.withColumn("review_rev", F.lit(1))))  # from the table itself
    assert sorted(r["idx"] for r in s.read("pages").collect()) == [0, 1]
    with pytest.raises(Exception):
        store.write_text(spark, str(tmp_path / "p" / "manifest.json" / "x"), "not to be written")
    assert s.project().name == "x"
    store.write_text(spark, str(tmp_path / "t"), "one")
    store.write_text(spark, str(tmp_path / "t"), "two")
    assert store.read_text(spark, str(tmp_path / "t")) == "two"


def test_tables_of_an_older_layout_are_read(spark, tmp_path):
    s = store.Store.create(spark, str(tmp_path / "p"), store.Project("x", version=1))
    spark.createDataFrame([(1, 0, "a.png", 10, 20)], store.TABLES["pages"]).write.parquet(str(tmp_path / "p" / "pages"))
    assert s.read("pages").count() == 1
    s.migrate()
    assert s.read("pages").count() == 1 and not (tmp_path / "p" / "pages").exists()
