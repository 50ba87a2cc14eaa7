"""Zipped catalogs as a data source of their own: ``spark.read.format("packages")``.

A partition is one entry of one package, so a large package is read by as many
tasks as it has entries, and an entry is unpacked as a stream: no task holds a
package, or an entry, whole. Conditions on ``package`` and ``entry`` are
answered before anything is unpacked: what they leave out is no partition.

Files are opened through Arrow's file systems, which every executor must reach
by the path's scheme. Where only Spark's readers reach a store, ``read_lines``
reads the same rows from ``binaryFile``.
"""

from __future__ import annotations

import codecs
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .catalogs import LINE_ENDS, LINES, entry_lines

#: Bytes of an entry that are unpacked at once.
CHUNK = 1 << 20


def streamed_lines(stream, ends: re.Pattern, errors: str = "replace", chunk: int = CHUNK) -> Iterator[tuple]:
    """``line_no, raw, newline, key, value, problem`` of a stream of UTF-8 bytes, as ``entry_lines`` gives them of a whole text."""
    decode = codecs.getincrementaldecoder("utf-8")(errors).decode
    rest, done, mark = "", 0, ""
    while True:
        data = stream.read(chunk)
        rest += decode(data, final=not data)
        if not done and not mark and rest[:1] == "﻿":
            mark, rest = rest[0], rest[1:]
        # A line end at the very end may be the first half of one.
        cut = len(rest) if not data else max((m.end() for m in ends.finditer(rest) if m.end() < len(rest)), default=0)
        for n, raw, *more in entry_lines(rest[:cut], ends):
            yield done + n, (mark if done + n == 1 else "") + raw, *more
            last = n
        if cut:
            done += last
        rest = rest[cut:]
        if not data:
            return


@dataclass
class Entry(InputPartition):
    path: str
    entry: str


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(where)


class PackageReader(DataSourceReader):
    def __init__(self, paths: list[str], wanted: list[str], ends: str, strict: bool):
        self.paths, self.wanted, self.ends, self.strict = paths, wanted, ends, strict
        self.only: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else ""
            if name in ("package", "entry"):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def _lets(self, name: str, value: str) -> bool:
        return name not in self.only or value in self.only[name]

    def partitions(self):
        found = []
        for path in self.paths:
            if self._lets("package", path):
                with _open(path) as file, zipfile.ZipFile(file) as z:  # the directory alone
                    have = set(z.namelist())
                names = [e for e in self.wanted or sorted(have) if e in have]
                if self.strict and (missing := set(self.wanted) - have):
                    raise ValueError(f"{path}: no entry {sorted(missing)}")
                found += [Entry(path, e) for e in names if self._lets("entry", e)]
        return found or [Entry("", "")]

    def read(self, partition: Entry):
        if partition.path:
            with _open(partition.path) as file, zipfile.ZipFile(file) as z, z.open(partition.entry) as stream:
                for line in streamed_lines(stream, LINE_ENDS[self.ends], "strict" if self.strict else "replace"):
                    yield partition.path, partition.entry, *line


class PackageSource(DataSource):
    """Options: ``paths`` and ``entries`` as lines (all entries if none are named), ``ends`` (``unicode`` or ``feed``), ``strict``."""

    @classmethod
    def name(cls):
        return "packages"

    def schema(self):
        return LINES

    def reader(self, schema):
        listed = lambda option: [x for x in self.options.get(option, "").split("\n") if x]
        return PackageReader(listed("paths"), listed("entries"), self.options.get("ends", "unicode"), self.options.get("strict", "false") == "true")


def read_entries(spark: SparkSession, paths: list[str], entries: list[str] = (), ends: str = "unicode", strict: bool = False):
    """Lines (see ``read_lines``) of packages named one by one, a task an entry, with conditions on package and entry pushed down."""
    spark.dataSource.register(PackageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"paths": "\n".join(paths), "entries": "\n".join(entries), "ends": ends, "strict": str(strict).lower()}
    return spark.read.format("packages").options(**options).load()
