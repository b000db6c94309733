"""Data sources of the library's own, where place in a file or in a listing matters.

`catalogue`: CSV files with two header rows (group, field) and perhaps a row of index labels, which are told by their place, so a
data row that equals a header stays. A file is a partition, and streams through its task.
`audio_tree`: the files below a root in order of their paths, empty ones too, in partitions of bounded bytes.

Both open files through Arrow's file systems (local paths, hdfs://, s3:// and others), on the driver to list them and in
tasks to read them.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: What archives leave behind.
JUNK = re.compile(r"(^|/)(\._[^/]*|__MACOSX(/.*)?)$|(^|/)__MACOSX/")
TREE = "path string, length long, modificationTime timestamp, place long, content binary"


def located(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:", uri) else (fs.LocalFileSystem(), uri)


def listed(uri: str) -> list:
    """What lies at or below a path, in order of paths: Arrow's facts of each file."""
    from pyarrow import fs

    system, path = located(uri)
    at = system.get_file_info(path)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    files = [at] if at.is_file else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file]
    return sorted(files, key=lambda x: x.path)


@dataclass
class Files(InputPartition):
    paths: list[str]
    first: int = 0

    def __post_init__(self):
        super().__init__(self.first)


def _lines(uri: str, path: str) -> Iterator[list[str]]:
    with located(uri)[0].open_input_stream(path) as raw:
        yield from csv.reader(io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8-sig", newline=""))


def _headers(uri: str, path: str) -> tuple[list[str], bool]:
    """The columns of a file, and whether its third row holds index labels alone."""
    rows = _lines(uri, path)
    groups, names, third = (next(rows, []) for _ in range(3))
    names += [""] * (len(groups) - len(names))
    return ["track_id", *(f"{g}.{n}" if n else g for g, n in zip(groups[1:], names[1:]))], bool(third) and not any(c.strip() for c in third[1:])


class Catalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def _files(self) -> list[str]:
        found = [x.path for x in listed(self.options["path"]) if not re.match(r"[_.]", x.path.rsplit("/", 1)[-1])]
        if not found:
            raise FileNotFoundError(self.options["path"])
        return found

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in _headers(self.options["path"], self._files()[0])[0]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CatalogueReader(self.options["path"], self._files(), schema.names, self.options.get("strict", "false").lower() == "true")


class _CatalogueReader(DataSourceReader):
    def __init__(self, uri: str, files: list[str], columns: list[str], strict: bool):
        self.uri, self.files, self.columns, self.strict = uri, files, columns, strict

    def partitions(self) -> list[Files]:
        return [Files([path], k) for k, path in enumerate(self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        n = len(self.columns)
        for path in partition.paths:
            columns, labels = _headers(self.uri, path)
            if columns != self.columns:
                raise ValueError(f"{path}: other columns than the first file's")
            for place, row in enumerate(_lines(self.uri, path)):
                if place < 2 + labels or not row or self.strict and not re.fullmatch(r"\d+", row[0].strip()):
                    continue
                yield tuple(x if x != "" else None for x in [*row, *[""] * n][:n])


class AudioTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema: StructType) -> DataSourceReader:
        suffixes = tuple(s for s in self.options.get("suffixes", "").lower().split(",") if s)
        return _TreeReader(self.options["path"], suffixes, int(self.options.get("partitionBytes", 128 << 20)))


class _TreeReader(DataSourceReader):
    def __init__(self, uri: str, suffixes: tuple[str, ...], size: int):
        self.uri, self.suffixes, self.size = uri, suffixes, size

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        held = self.size
        files = [x for x in listed(self.uri) if not JUNK.search(x.path) and (not self.suffixes or x.path.lower().endswith(self.suffixes))]
        for place, x in enumerate(files):
            if held + x.size > self.size and (not out or out[-1].paths):
                out.append(Files([], place))
                held = 0
            out[-1].paths.append(x.path)
            held += x.size + 4_096
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system = located(self.uri)[0]
        for k, path in enumerate(partition.paths):
            info = system.get_file_info(path)
            with system.open_input_stream(path) as f:
                yield path, info.size, info.mtime, partition.first + k, f.read()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Catalogue)
    spark.dataSource.register(AudioTree)
