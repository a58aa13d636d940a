"""Members of archives as a data source: spark.read.format("members").load(folder).

A task reads a range of one archive's members, so an archive of any size is read by many tasks and none holds more than one member.
Planning reads the directories at the archives' ends alone. Options choose members by name and size before any is opened, and a
schema without the content opens none. Filters are not taken from the plan: Spark 4.1 keeps what a reader was told for one query
when the same DataFrame is filtered otherwise, which loses rows. Paths are those that pyarrow's file systems
know: local or mounted folders, s3://, gs://, hdfs://. What is only Spark's to read goes through images.scan_archives.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import shared_path

#: place: of the member in its archive. reason: why a member or a whole archive (place null) cannot be read.
SCHEMA = "path string, place int, name string, size long, content binary, reason string"
SUFFIXES = ("cbz", "zip")


@dataclass
class Members(InputPartition):
    path: str
    places: tuple[int, ...]
    reason: str | None = None


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """The archives at a path: itself, or those in the folder and below."""
    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    kept = sorted(i.path for i in found if i.type == fs.FileType.File and i.path.rpartition(".")[2].lower() in SUFFIXES)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [head + p for p in kept]


class _File(io.RawIOBase):
    """A file of an Arrow file system that fails as Python's files do: zipfile seeks before the start of short files."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        return self.file.readinto(into)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, to: int, whence: int = 0) -> int:
        try:
            return self.file.seek(to, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(path: str) -> zipfile.ZipFile:
    system, inner = _system(path)
    return zipfile.ZipFile(io.BufferedReader(_File(system.open_input_file(inner)), 1 << 16))


class MemberReader(DataSourceReader):
    def __init__(self, columns: list[str], path: str, size: str = "16777216", suffixes: str = "", names: str = "", least: str = "0"):
        self.columns, self.path, self.size, self.least = columns, path, int(size), int(least)
        self.suffixes, self.names = tuple(filter(None, suffixes.lower().split(","))), tuple(filter(None, names.split("|")))

    def _wanted(self, info: zipfile.ZipInfo) -> bool:
        name = info.filename.rpartition("/")[2]
        if info.is_dir() or not name or name.startswith(".") or "__MACOSX" in info.filename.split("/"):
            return False
        if self.suffixes and name.rpartition(".")[2].lower() not in self.suffixes:
            return False
        return info.file_size >= self.least and (not self.names or any(fnmatch.fnmatchcase(name, n) for n in self.names))

    def partitions(self) -> list[Members]:
        """Ranges of members of about self.size bytes; an archive that cannot be opened is one of its own."""
        out: list[Members] = []
        for path in _listed(self.path):
            try:
                with _opened(path) as z:
                    held, n = [], 0
                    for place, info in enumerate(z.infolist()):
                        if not self._wanted(info):
                            continue
                        if held and n + info.compress_size > self.size:
                            out.append(Members(path, tuple(held)))
                            held, n = [], 0
                        held.append(place)
                        n += info.compress_size
                    if held:
                        out.append(Members(path, tuple(held)))
            except (zipfile.BadZipFile, pa.ArrowInvalid, OSError, EOFError) as e:
                out.append(Members(path, (), f"damaged archive: {e}"))
        return out or [Members("", ())]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("place", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("reason", pa.string())])

        def batch(place: int | None, name: str | None, size: int | None, content: bytes | None, reason: str | None) -> pa.RecordBatch:
            row = {"path": partition.path, "place": place, "name": name, "size": size, "content": content, "reason": reason}
            return pa.RecordBatch.from_pylist([row], schema).select(self.columns)

        if partition.reason is not None:
            yield batch(None, partition.path.rpartition("/")[2], None, None, partition.reason)
            return
        if not partition.places:
            return
        with _opened(partition.path) as z:
            infos = z.infolist()
            for place in partition.places:
                info, content, reason = infos[place], None, None
                if "content" in self.columns or "reason" in self.columns:
                    try:
                        content = z.read(info)
                    except (zipfile.BadZipFile, zlib.error, pa.ArrowInvalid, EOFError, OSError, NotImplementedError, RuntimeError) as e:
                        reason = f"damaged entry: {e}"
                yield batch(place, info.filename.rpartition("/")[2], info.file_size, content, reason)


class MemberSource(DataSource):
    """Options: path; size, the bytes of a task's members (default 16 MB); suffixes of members, comma-separated; names,
    patterns with * and ?, divided by |; least, the bytes a member has at least. Without them all members count."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(schema.names, **{k: v for k, v in self.options.items() if k in ("path", "size", "suffixes", "names", "least")})


def members(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """The members of the archives at path; of columns (all of SCHEMA if None) only those are read."""
    spark.dataSource.register(MemberSource)
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    return spark.read.format("members").schema(", ".join(fields)).options(**options).load(path)


def write_archives(rows: DataFrame, path: str, archives: int) -> DataFrame:
    """rows(name, content binary) as archives of a folder, dealt by a hash of the name; (archive, members, bytes) of each.

    An archive is written by one task, member by member, under another name until it is whole; a task that runs again writes it anew.
    """
    dealt = rows.select(F.pmod(F.xxhash64("name"), F.lit(archives)).cast("int").alias("archive"), "name", "content").repartition(archives, "archive").sortWithinPartitions("archive", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _system(path)
        system.create_dir(inner, recursive=True)
        now, z, out, n, size, part = None, None, None, 0, 0, ""

        def settle() -> pa.RecordBatch:
            z.close()
            out.close()
            system.move(part, f"{inner}/part-{now:05d}.zip")
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([n]), pa.array([size])], ["archive", "members", "bytes"])

        for b in batches:
            for archive, name, content in zip(b["archive"].to_pylist(), b["name"].to_pylist(), b["content"].to_pylist()):
                if archive != now:
                    if now is not None:
                        yield settle()
                    now, n, size = archive, 0, 0
                    part = f"{inner}/.part-{now:05d}-{hashlib.sha256(repr((id(z), name)).encode()).hexdigest()[:12]}"
                    out = system.open_output_stream(part)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(name, content or b"")
                n, size = n + 1, size + len(content or b"")
        if now is not None:
            yield settle()

    return dealt.mapInArrow(run, "archive int, members long, bytes long")


def archived(rows: DataFrame, archives: int = 16) -> str:
    """Writes rows(name, content) as archives in the shared folder; their path."""
    path = shared_path(rows.sparkSession, "archives")
    write_archives(rows, path, archives).agg(F.sum("members")).collect()
    return path
