"""A folder of sources as a Spark data source that passes over ignored folders while it lists.

``spark.read.format("repository").load(root)`` and ``spark.readStream``. The folder must be mounted where the
driver and the executors run; ``scan`` reads other stores. Folders are listed from the driver without
entering ignored ones, files are dealt out by size, and their contents are read in the tasks. Filters on ``path`` and
``size`` are pushed into the listing. A stream gives each file again whenever it was modified.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from textloom.sources.scan import IGNORED, MAX_FILE_SIZE

#: Endings of files that are no sources (fixed values).
PASSING = (".tmp", ".swp", ".lock", ".log")
#: Bytes of files that a task reads.
PART_SIZE = 32 << 20
SCHEMA = "path string, size bigint, modified_ms bigint, text string"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified_ns: int


@dataclass
class Files(InputPartition):
    files: list[File]


class Listing:
    """The files below a root: which folders are entered and which files count."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a repository needs a path")
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.most = int(options.get("maxfilesize", MAX_FILE_SIZE))
        self.ignored = frozenset(x for x in options.get("ignored", ",".join(IGNORED)).split(",") if x)
        self.paths: set[str] | None = None
        self.prefix = ""

    def push(self, filter_: Filter) -> bool:
        """Take a filter in, if the listing can do all of its work."""
        if getattr(filter_, "attribute", None) == ("path",):
            if isinstance(filter_, (EqualTo, In)):
                wanted = {filter_.value} if isinstance(filter_, EqualTo) else set(filter_.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
                return True
            if isinstance(filter_, StringStartsWith) and (self.prefix.startswith(filter_.value) or filter_.value.startswith(self.prefix)):
                self.prefix = max(self.prefix, filter_.value, key=len)
                return True
        if getattr(filter_, "attribute", None) == ("size",) and isinstance(filter_, (LessThan, LessThanOrEqual)):
            self.most = min(self.most, filter_.value - isinstance(filter_, LessThan))
            return True
        return False

    def _may_hold(self, folder: str) -> bool:
        """Whether what is asked for can lie in a folder (with a slash at its end)."""
        by_prefix = folder.startswith(self.prefix) or self.prefix.startswith(folder)
        return by_prefix and (self.paths is None or any(p.startswith(folder) for p in self.paths))

    def files(self, after_ns: int = -1, until_ns: int | None = None) -> Iterator[File]:
        waiting = [""]
        while waiting:
            folder = waiting.pop()
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in sorted(entries, key=lambda e: e.name):
                    path = folder + entry.name
                    if entry.is_dir(follow_symlinks=False):
                        if entry.name not in self.ignored and self._may_hold(path + "/"):
                            waiting.append(path + "/")
                    elif entry.is_file() and path.startswith(self.prefix) and (self.paths is None or path in self.paths) and not path.endswith(PASSING):
                        at = entry.stat()
                        if at.st_size <= self.most and at.st_mtime_ns > after_ns and (until_ns is None or at.st_mtime_ns <= until_ns):
                            yield File(path, at.st_size, at.st_mtime_ns)

    def parts(self, after_ns: int = -1, until_ns: int | None = None) -> list[Files]:
        out, size = [Files([])], 0
        for file in self.files(after_ns, until_ns):
            if out[-1].files and size + file.size > PART_SIZE:
                out.append(Files([]))
                size = 0
            out[-1].files.append(file)
            size += file.size
        return out

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        """The UTF-8 texts of a part; a file that has gone meanwhile or is no text has no row."""
        for file in part.files:
            try:
                with open(os.path.join(self.root, file.path), "rb") as at:
                    text = at.read().decode("utf-8")
            except (FileNotFoundError, UnicodeDecodeError):
                continue
            yield pa.RecordBatch.from_pydict({"path": [file.path], "size": [file.size], "modified_ms": [file.modified_ns // 1_000_000], "text": [text]})


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = Listing(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self.listing.push(f))

    def partitions(self) -> list[Files]:
        return self.listing.parts()

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.listing.read(partition)


class RepositoryStream(DataSourceStreamReader):
    """Offsets are times of modification: a batch has what was modified after one and up to the other."""

    def __init__(self, options: dict[str, str]):
        self.listing = Listing(options)

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": max((f.modified_ns for f in self.listing.files()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.listing.parts(start["ns"], end["ns"])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.listing.read(partition)

    def commit(self, end: dict) -> None:
        pass


class Repository(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(dict(self.options))

    def streamReader(self, schema) -> RepositoryStream:
        return RepositoryStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Repository)
