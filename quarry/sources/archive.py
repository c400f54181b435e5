"""ZIP archives as a data source: executors read the members that they need, and nothing is unpacked anywhere.

The driver reads an archive's directory only, refuses unsafe names, and deals the members that pass the pushed filters over
partitions of about ``PART`` bytes. Filters on a path's end and on the length are pushed (with
``spark.sql.python.filterPushdown.enabled``, which ``archive_files`` sets), so other members are never opened.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
)

#: Bytes (unpacked) of a partition, and of an archive at most.
PART, MOST = 32 << 20, 4 << 30
_SCHEMA = "rel_path string, length bigint, content binary"
_BOUNDS = {LessThan: "__lt__", LessThanOrEqual: "__le__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__"}


def _opened(path: str) -> zipfile.ZipFile:
    """An archive on any file system that Arrow knows; a path without a scheme is one of this machine or a mounted one."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return zipfile.ZipFile(inner if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner))


def safe_members(names: Iterable[str]) -> dict[str, str]:
    """Relative path by member name, without directories and archive litter; one folder around all is left out.

    Names that would lead out of the archive's root (absolute, with "..", with a drive or a backslash) are refused.
    """
    kept = {}
    for name in names:
        path = PurePosixPath(name)
        if path.is_absolute() or ".." in path.parts or "\\" in name or ":" in name.split("/")[0]:
            raise ValueError(f"unsafe path in archive: {name}")
        if not name.endswith("/") and path.parts and path.parts[0] != "__MACOSX":
            kept[name] = path
    tops = {p.parts[0] for p in kept.values()}
    inside = len(tops) == 1 and all(len(p.parts) > 1 for p in kept.values())
    return {name: "/".join(p.parts[inside:]) for name, p in kept.items()}


class _Members(InputPartition):
    def __init__(self, members: list[tuple[str, str, int]]):
        self.members = members


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.part = options["path"], int(options.get("partBytes", PART))
        self.most = int(options.get("maxBytes", MOST))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if isinstance(f, StringEndsWith) and column == "rel_path":
                self.tests.append(("rel_path", "endswith", f.value))
            elif type(f) in _BOUNDS and column == "length":
                self.tests.append(("length", _BOUNDS[type(f)], f.value))
            else:
                yield f

    def _wanted(self, path: str, length: int) -> bool:
        have = {"rel_path": path, "length": length}
        return all(getattr(have[column], test)(value) for column, test, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as archive:
            infos = {i.filename: i.file_size for i in archive.infolist()}
        if sum(infos.values()) > self.most:
            raise ValueError(f"archive of more than {self.most} bytes")
        parts, size = [[]], 0
        for name, path in safe_members(infos).items():
            if self._wanted(path, infos[name]):
                if size and size + infos[name] > self.part:
                    parts.append([])
                    size = 0
                parts[-1].append((name, path, infos[name]))
                size += infos[name]
        return [_Members(p) for p in parts]

    def read(self, partition: _Members) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rel_path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        if partition.members:
            with _opened(self.path) as archive:
                for name, path, length in partition.members:
                    yield pa.RecordBatch.from_pylist([{"rel_path": path, "length": length, "content": archive.read(name)}], schema)


class ProjectArchive(DataSource):
    """``spark.read.format("project_archive").load(path)``: one row for each file of a ZIP archive."""

    @classmethod
    def name(cls) -> str:
        return "project_archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def archive_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """rel_path, length, content of an archive's files. ``options``: partBytes, maxBytes."""
    if not path.endswith(".zip"):
        raise ValueError("only .zip archives are accepted")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProjectArchive)
    return spark.read.format("project_archive").options(**{k: str(v) for k, v in options.items()}).load(path)


def read_archive(spark: SparkSession, path: str, scan_id: int, project: str = "multi", **options: object) -> DataFrame:
    """The corpus of an uploaded archive, as ``corpus.read_tree`` gives that of a folder."""
    from quarry.sources.corpus import as_corpus

    return as_corpus(archive_files(spark, path, **options), scan_id, project)


def archive_of(rows: DataFrame, path: str) -> None:
    """Write files (rel_path, text) as one archive, in the order of their paths. For downloads of bounded size."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for r in rows.select("rel_path", F.coalesce("text", F.lit("")).alias("text")).orderBy("rel_path").toLocalIterator():
            archive.writestr(r.rel_path, r.text)
