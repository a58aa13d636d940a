"""A project as a folder of tables with a manifest, a content-addressed cache, settings, assets, hashes of files.

Everything goes through Spark's readers and writers or Hadoop's file system, so the folder may be in any store Spark reaches.
"""

from __future__ import annotations

import json
import os
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a project, with their columns; later versions add columns, see MIGRATIONS.
TABLES = {
    "pages": "page_id long, idx int, image_path string, width int, height int",
    "regions": "page_id long, region_id string, x double, y double, w double, h double, type string, status string, confidence double, reading_order int, panel_index int",
    "spans": "page_id long, region_id string, seq int, text string, confidence double, alternatives array<string>, source string",
    "units": "page_id long, unit_id string, ordered_region_ids array<string>, candidates array<struct<id:string,kind:string,text:string,confidence:double>>, selected string, source string, context string, style string",
    "artifacts": "page_id long, kind string, seq int, path string, overflow long, signature string",
    "edits": "unit_id string, seq long, action string, before string, after string, editor string",
    "provenance": "page_id long, stage string, signature string",
}
#: (version, table, columns added). They are idempotent: a table that has a column keeps it.
MIGRATIONS = [(2, "pages", "review_rev int"), (3, "history", "page_id long, seq long, action string, editor string, undone boolean, before string, after string"), (4, "assignments", "page_id long, editor string, at long")]
VERSION = 4


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file is there as a whole or not at all: it is written beside and renamed over the one before, which nothing deletes first."""
    fs, p = _file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    part = hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), over)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


@dataclass(frozen=True)
class Project:
    """The manifest of a project."""

    name: str
    source_lang: str = "ja"
    target_lang: str = "en"
    direction: str = "rtl"
    config: dict = field(default_factory=dict)
    version: int = VERSION


class Store:
    """Tables of a project in a folder, and manifest.json.

    A table is a Parquet folder for each time it was written; <table>.current names the one that counts and is replaced as a whole.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, project: Project) -> Store:
        store = cls(spark, folder)
        if exists(spark, store._manifest):
            raise ValueError(f"there is a project in {folder}")
        store.save(project)
        return store

    @property
    def _manifest(self) -> str:
        return f"{self.folder}/manifest.json"

    def project(self) -> Project:
        if not exists(self.spark, self._manifest):
            raise ValueError(f"no project in {self.folder}")
        return Project(**json.loads(read_text(self.spark, self._manifest)))

    def save(self, project: Project) -> None:
        write_text(self.spark, self._manifest, json.dumps(asdict(project), ensure_ascii=False, indent=2) + "\n")

    def _columns(self, table: str) -> str:
        parts = [TABLES[table]] if table in TABLES else []
        parts += [columns for _, t, columns in MIGRATIONS if t == table]
        if not parts:
            raise ValueError(f"no table {table}")
        return ", ".join(parts)

    def _current(self, table: str) -> str | None:
        """The folder of the table as it is now; a table of an older project is a folder of its own name."""
        pointer = f"{self.folder}/{table}.current"
        if exists(self.spark, pointer):
            return f"{self.folder}/{read_text(self.spark, pointer)}"
        path = f"{self.folder}/{table}"
        return path if exists(self.spark, path) else None

    def read(self, table: str) -> DataFrame:
        """The table, empty if it was never written; columns that it was written without are null."""
        empty, path = self.spark.createDataFrame([], self._columns(table)), self._current(table)
        return empty.unionByName(self.spark.read.parquet(path), allowMissingColumns=True) if path else empty

    def write(self, table: str, rows: DataFrame) -> None:
        """Replaces the table. rows may come from the table itself. Whenever it breaks off, the table is as before or as after."""
        wanted = self.spark.createDataFrame([], self._columns(table))
        before, name = self._current(table), f"{table}.{uuid.uuid4().hex}"
        wanted.unionByName(rows, allowMissingColumns=True).write.parquet(f"{self.folder}/{name}")
        write_text(self.spark, f"{self.folder}/{table}.current", name)
        if before:
            fs, p = _file_system(self.spark, before)
            fs.delete(p, True)

    def migrate(self) -> int:
        """Brings tables and manifest to the newest version; running it again changes nothing."""
        project = self.project()
        for version, table, _ in MIGRATIONS:
            if project.version < version and self._current(table):
                self.write(table, self.read(table))
        if project.version < VERSION:
            self.save(Project(**(asdict(project) | {"version": VERSION})))
        return VERSION


class Cache:
    """Contents under keys, in folders by the key's first two characters. A key's content never changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _rows(self) -> DataFrame:
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], "key string, content binary, prefix string")
        return self.spark.read.schema("key string, content binary, prefix string").parquet(self.folder)

    def put(self, rows: DataFrame) -> None:
        """rows(key, content); keys that are there already are left alone."""
        new = rows.select("key", "content").withColumn("prefix", F.substring("key", 1, 2)).dropDuplicates(["key"])
        new.join(self._rows().select("prefix", "key"), ["prefix", "key"], "left_anti").write.mode("append").partitionBy("prefix").parquet(self.folder)

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, content) of keys(key) that are there; only their folders are read."""
        wanted = keys.select("key").distinct().withColumn("prefix", F.substring("key", 1, 2))
        return self._rows().join(wanted, ["prefix", "key"], "left_semi").select("key", "content")

    def missing(self, keys: DataFrame) -> DataFrame:
        wanted = keys.select("key").distinct().withColumn("prefix", F.substring("key", 1, 2))
        return wanted.join(self._rows().select("prefix", "key"), ["prefix", "key"], "left_anti").select("key")


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def jobs(wanted: int, cpus: int | None = None) -> int:
    """How many tasks at once: as wanted, or for 0 and below as many as there are processors, eight at most."""
    return wanted if wanted >= 1 else max(1, min(cpus or os.cpu_count() or 1, 8))


def settings(text: str, **overrides) -> dict:
    """Settings of a TOML text, with those given that are not None over them."""
    return tomllib.loads(text) | {k: v for k, v in overrides.items() if v is not None}


def save_glossary(entries: DataFrame, path: str, name: str) -> None:
    """entries(ord, source, target, aliases) with their name as a JSON file."""
    rows = [r.asDict() for r in entries.orderBy("ord").select("source", "target", "aliases").collect()]  # a glossary is small
    write_text(entries.sparkSession, path, json.dumps({"version": 1, "name": name, "entries": rows}, ensure_ascii=False, indent=2) + "\n")


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source, target, aliases); empty if there is no such file."""
    kind = "ord int, source string, target string, aliases array<string>"
    rows = json.loads(read_text(spark, path))["entries"] if exists(spark, path) else []
    return spark.createDataFrame([(i, r["source"], r["target"], list(r.get("aliases") or [])) for i, r in enumerate(rows)], kind)


# assets


@dataclass(frozen=True)
class Asset:
    """Something an engine needs: a file in the model folder, or managed by the engine itself (no filename)."""

    name: str
    kind: str
    summary: str
    filename: str = ""
    url: str = ""


class Assets:
    """A catalog of assets with a folder; urls come from the catalog or from overrides by name."""

    def __init__(self, spark: SparkSession, catalog: list[Asset], folder: str, urls: dict[str, str] | None = None):
        self.spark, self.catalog, self.folder, self.urls = spark, {a.name: a for a in catalog}, folder.rstrip("/"), dict(urls or {})

    def find(self, name: str) -> Asset:
        if name not in self.catalog:
            raise ValueError(f"unknown asset {name}; known: {', '.join(sorted(self.catalog))}")
        return self.catalog[name]

    def path(self, name: str) -> str | None:
        return f"{self.folder}/{a.filename}" if (a := self.find(name)).filename else None

    def status(self, name: str) -> str:
        path = self.path(name)
        return "managed" if path is None else "cached" if exists(self.spark, path) else "missing"

    def listing(self) -> DataFrame:
        """(name, kind, summary, status, url) of the whole catalog."""
        rows = [(a.name, a.kind, a.summary, self.status(a.name), self.urls.get(a.name, a.url)) for a in self.catalog.values()]
        return self.spark.createDataFrame(rows, "name string, kind string, summary string, status string, url string")

    def pull(self, name: str, fetch: Callable[[str], bytes]) -> bool:
        """Fetches a missing file by its url and puts it there as a whole; whether something was fetched."""
        asset, path = self.find(name), self.path(name)
        if path is None or exists(self.spark, path):
            return False
        url = self.urls.get(name, asset.url)
        if not url:
            raise ValueError(f"no url for {name}")
        fs, part = _file_system(self.spark, path + ".part")
        out = fs.create(part, True)
        out.write(bytearray(fetch(url)))
        out.close()
        return fs.rename(part, self.spark._jvm.org.apache.hadoop.fs.Path(path))
