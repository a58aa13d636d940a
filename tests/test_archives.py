"""Members of archives: ranges, filters taken by the source, damaged files, and writing."""

import os
import zipfile

import pytest

from foliospark.sources import archives


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.cbz", "w") as z:
        for i in range(40):
            z.writestr(f"in/page{i}.png", bytes([i]) * 1000)
        z.writestr("in/", b"")
        z.writestr(".hidden.png", b"x")
        z.writestr("__MACOSX/page1.png", b"x")
        z.writestr("notes.TXT", b"notes")
        z.writestr("page1.png", b"a second of the name")
    os.makedirs(tmp_path / "deep")
    with zipfile.ZipFile(tmp_path / "deep/b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.png", b"g" * 5000)
        z.writestr("bad.png", os.urandom(5000))
    data = bytearray((tmp_path / "deep/b.zip").read_bytes())
    at = data.index(b"bad.png") + 2000
    data[at : at + 50] = bytes(50)
    (tmp_path / "deep/b.zip").write_bytes(bytes(data))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    (tmp_path / "d.png").write_bytes(b"no archive, not asked for")
    zipfile.ZipFile(tmp_path / "e.zip", "w").close()
    return str(tmp_path)


def test_members_of_a_folder(spark, folder):
    rows = archives.members(spark, folder).collect()
    by = {(os.path.basename(r["path"]), r["place"]): r for r in rows}
    assert len(rows) == len(by) == 40 + 2 + 2 + 1, sorted(map(str, by))
    assert all(by["a.cbz", i]["name"] == f"page{i}.png" and by["a.cbz", i]["content"] == bytes([i]) * 1000 and by["a.cbz", i]["size"] == 1000 for i in range(40))
    assert {r["name"] for r in rows if r["path"].endswith("a.cbz")} == {f"page{i}.png" for i in range(40)} | {"notes.TXT"}
    assert by["b.zip", 0]["content"] == b"g" * 5000 and by["b.zip", 1]["content"] is None and "damaged entry" in by["b.zip", 1]["reason"]
    assert "damaged archive" in by["c.zip", None]["reason"] and by["c.zip", None]["name"] == "c.zip"
    assert archives.members(spark, folder, suffixes="txt").filter("place is not null").count() == 1


def test_options_choose_members_before_they_are_opened(spark, folder):
    def names(**options):
        return sorted(r["name"] for r in archives.members(spark, folder, **options).filter("place is not null").collect())

    assert names(names="page7.png") == ["page7.png"] and names(names="nothing") == []
    assert names(names="page3?.png|good*") == ["good.png", *(f"page{i}.png" for i in range(30, 40))]
    assert names(names="page1.png") == ["page1.png"] * 2 and names(least="5000", names="*.png") == ["bad.png", "good.png"] and names(suffixes="txt,gif") == ["notes.TXT"]
    df = archives.members(spark, folder)
    assert df.filter("name = 'page1.png' or name = 'page2.png'").count() == 3 and df.filter("name = 'page7.png'").count() == 1 and df.count() == 45
    reader = archives.MemberReader(["name"], folder, names="page3*")
    assert sum(len(p.places) for p in reader.partitions() if p.path.endswith("a.cbz")) == 11
    assert [r["size"] for r in archives.members(spark, f"{folder}/deep", ["name", "size"], names="bad.png").collect()] == [5000]


def test_large_archives_are_read_by_many_tasks(spark, folder):
    assert archives.members(spark, f"{folder}/a.cbz", size="4000").rdd.getNumPartitions() == 11  # four pages each, the small ones with the last
    assert archives.members(spark, f"{folder}/a.cbz", size="1").rdd.getNumPartitions() == 42
    assert archives.members(spark, f"{folder}/e.zip").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        archives.members(spark, f"{folder}/nowhere").count()


def test_written_archives_read_back(spark, tmp_path):
    rows = [(f"n{i}", os.urandom(i)) for i in range(200)] + [("none", None), ("empty", b"")]
    made = archives.write_archives(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "out"), 3).collect()
    assert sum(r["members"] for r in made) == 202 and sum(r["bytes"] for r in made) == sum(range(200))
    assert sorted(os.listdir(tmp_path / "out")) == [f"part-{r['archive']:05d}.zip" for r in sorted(made)]
    got = {r["name"]: bytes(r["content"]) for r in archives.members(spark, str(tmp_path / "out")).collect()}
    assert got == {n: c or b"" for n, c in rows}
