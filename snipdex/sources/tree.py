"""Source trees as a Spark data source: folders are listed in parallel, and only what passes the filters is opened.

`spark.read.format("source_tree")` takes these options: `path` (a folder in any store that Arrow's file systems reach),
`include` and `exclude` (JSON lists of patterns), `recursive`, `max_size` and `content` (false: only list). An excluded
folder is not entered, so nothing in it is listed or read. Filters on size, modification time, name and relative path
that Spark pushes down are applied to the listing, before a file is opened. A file that cannot be read, or that is larger
than a row may be, is a row with `error` and without content.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from snipdex.functions.paths import exclude_regex, include_regex

SCHEMA = "rel_path string, name string, size bigint, modified timestamp, content binary, error string"
#: Folders are listed on the driver until there are so many; the rest is listed by tasks.
MIN_PARTITIONS = 64
MAX_LISTED = 512
#: A row holds no more.
MAX_CONTENT = (1 << 31) - (1 << 20)
BATCH_BYTES = 32 << 20


@dataclass
class Part(InputPartition):
    """Folders with all that is below them, and files, each by its path below the root."""

    folders: list[str]
    files: list[str]

    def __post_init__(self):
        super().__init__(None)


def _compare(filter: Filter):
    """A test of (rel_path, name, size, modified) for a filter that can be told from the listing; None for others."""
    place = {"rel_path": 0, "name": 1, "size": 2, "modified": 3}
    column = getattr(filter, "attribute", ())
    if len(column) != 1 or column[0] not in place:
        return None
    if isinstance(filter, IsNotNull):
        return lambda row: True  # a listing has no nulls
    if not hasattr(filter, "value"):
        return None
    at, value = place[column[0]], filter.value
    tests = {
        EqualTo: lambda x: x == value,
        GreaterThan: lambda x: x > value,
        GreaterThanOrEqual: lambda x: x >= value,
        LessThan: lambda x: x < value,
        LessThanOrEqual: lambda x: x <= value,
        In: lambda x: x in value,
        StringStartsWith: lambda x: x.startswith(value),
        StringEndsWith: lambda x: x.endswith(value),
    }
    test = tests.get(type(filter))
    return None if test is None else (lambda row: test(row[at]))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.include = json.loads(options.get("include", "[]"))
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.max_size = int(options["max_size"]) if options.get("max_size") else None
        self.content = options.get("content", "true").lower() == "true"
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for filter in filters:
            if _compare(filter) is None:
                yield filter
            else:
                self.pushed.append(filter)

    def _open(self):
        from pyarrow import fs

        scheme = re.match(r"^([A-Za-z][A-Za-z0-9+.-]+):", self.root)
        if scheme and scheme[1] != "file":
            system, base = fs.FileSystem.from_uri(quote(self.root, safe=":/?#[]@!$&'()*+,;=%~"))
        else:
            system, base = fs.LocalFileSystem(), re.sub("^file:/*", "/", self.root)
        return system, base.rstrip("/") or "/"

    def _patterns(self):
        wanted = re.compile(include_regex(self.include, self.recursive)) if self.include else None
        unwanted = re.compile(exclude_regex(self.exclude)) if self.exclude else None
        return wanted, unwanted

    def _listed(self, system, base: str, folder: str) -> tuple[list[str], list[tuple]]:
        """Folders to enter, and files (rel_path, name, size, modified) that pass all tests."""
        from pyarrow import fs

        wanted, unwanted = self._patterns()
        tests = [_compare(f) for f in self.pushed]
        folders, files = [], []
        for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
            rel = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == fs.FileType.Directory:
                # What an excluded folder holds is excluded too: any name below it matches.
                if self.recursive and not (unwanted and unwanted.match(rel + "/x") and unwanted.match(rel + "/x/x")):
                    folders.append(rel)
                continue
            if wanted is not None and not wanted.match(rel) or unwanted is not None and unwanted.match(rel):
                continue
            row = (rel, info.base_name, info.size, info.mtime)
            if (self.max_size is None or info.size <= self.max_size) and all(test(row) for test in tests):
                files.append(row)
        return folders, files

    def partitions(self) -> list[Part]:
        """Folders of the upper levels, listed until there are enough to share out."""
        system, base = self._open()
        waiting, files, listed = [""], [], 0
        while waiting and len(waiting) < MIN_PARTITIONS and listed < MAX_LISTED:
            found, some = self._listed(system, base, waiting.pop(0))
            listed += 1
            waiting += found
            files += [row[0] for row in some]
        parts = [Part([folder], []) for folder in waiting]
        step = max(1, -(-len(files) // MIN_PARTITIONS))
        return parts + [Part([], files[i : i + step]) for i in range(0, len(files), step)] or [Part([], [])]

    def _rows(self, part: Part) -> Iterator[tuple]:
        from pyarrow import fs

        system, base = self._open()
        for info in system.get_file_info([f"{base}/{name}" for name in part.files]) if part.files else []:
            if info.type != fs.FileType.NotFound:
                yield system, base, (info.path[len(base) :].lstrip("/"), info.base_name, info.size, info.mtime)
        waiting = list(part.folders)
        while waiting:
            try:
                found, files = self._listed(system, base, waiting.pop())
            except FileNotFoundError:
                continue  # it went since its parent was listed
            waiting += found
            for row in files:
                yield system, base, row

    def read(self, partition: Part) -> Iterator:
        import pyarrow as pa

        names = ["rel_path", "name", "size", "modified", "content", "error"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string()]
        rows, held = [], 0
        for system, base, row in self._rows(partition):
            content, error = None, None
            if self.content and row[2] > MAX_CONTENT:
                error = f"{row[2]} bytes are more than a row holds"
            elif self.content:
                try:
                    with system.open_input_stream(f"{base}/{row[0]}") as stream:
                        content = stream.read()
                except FileNotFoundError:
                    continue
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((*row, content, error))
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make `source_tree` known to the session, and let filters reach it."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
