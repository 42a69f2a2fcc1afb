"""Logs of an archive as a table, without unpacking it: a data source whose partitions are the archive's members.

The driver reads only the list of members. A member of a .zip or of a plain .tar is a partition of its own, and a task seeks to it and streams its lines; a compressed .tar can't be sought, so it is one partition that is streamed. Member names are never used as paths, so none can lead out of a folder. The archive must lie where all executors see it, as a shared or mounted folder.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "file string, pos long, line string"
#: Lines of a batch, and what the logs of a report are called.
BATCH, LOGS = 5000, r"(?:\A|.*/)Logs/[^/]+\.log"


@dataclass
class Member(InputPartition):
    name: str | None  # None: all members that match, in one stream
    offset: int = 0
    size: int = 0

    def __post_init__(self):
        super().__init__(self.name)


class LogArchive(DataSource):
    """Format `log_archive`; options: path, and members, a pattern that member names match as a whole."""

    @classmethod
    def name(cls) -> str:
        return "log_archive"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LogArchiveReader:
        return LogArchiveReader(self.options["path"], self.options.get("members", LOGS))


class LogArchiveReader(DataSourceReader):
    def __init__(self, path: str, members: str):
        self.path, self.members = path.removeprefix("file://"), members

    def _wanted(self, name: str) -> bool:
        return re.fullmatch(self.members, name) is not None

    def partitions(self) -> list[Member]:
        if zipfile.is_zipfile(self.path):
            with zipfile.ZipFile(self.path) as z:
                found = [Member(i.filename, i.header_offset, i.file_size) for i in z.infolist() if not i.is_dir() and self._wanted(i.filename)]
        elif _plain_tar(self.path):
            with tarfile.open(self.path, "r:") as t:
                found = [Member(m.name, m.offset_data, m.size) for m in t if m.isfile() and self._wanted(m.name)]
        elif tarfile.is_tarfile(self.path):
            return [Member(None)]
        else:
            raise ValueError(f"unknown kind of archive: {self.path}")
        return found or [Member("")]  # a source without partitions isn't allowed

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.name == "":
            return
        if partition.name is None:
            with tarfile.open(self.path, "r:*") as t:
                for m in t:
                    if m.isfile() and self._wanted(m.name):
                        yield from _lines(m.name, t.extractfile(m))
        elif zipfile.is_zipfile(self.path):
            with zipfile.ZipFile(self.path) as z, z.open(partition.name) as f:
                yield from _lines(partition.name, f)
        else:
            with open(self.path, "rb") as f:
                f.seek(partition.offset)
                yield from _lines(partition.name, io.BufferedReader(_Part(f, partition.size)))


class _Part(io.RawIOBase):
    """The next bytes of a file, as a file."""

    def __init__(self, f, size: int):
        self.f, self.left = f, size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.f.read(min(len(into), self.left))
        into[: len(got)] = got
        self.left -= len(got)
        return len(got)


def _plain_tar(path: str) -> bool:
    try:
        with tarfile.open(path, "r:"):
            return True
    except tarfile.ReadError:
        return False


def _lines(name: str, f) -> Iterator[pa.RecordBatch]:
    """Batches of a member's lines, numbered from 0; a file is called by its last name."""
    lines, pos, short = [], 0, name.rsplit("/", 1)[-1]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([short] * len(lines), pa.string()), pa.array(range(pos, pos + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "pos", "line"])

    for line in io.TextIOWrapper(f, "utf-8", "replace", newline=None):
        lines.append(line.removesuffix("\n"))
        if len(lines) == BATCH:
            yield batch()
            pos, lines = pos + BATCH, []
    if lines:
        yield batch()


def log_lines(spark: SparkSession, path: str, members: str = LOGS) -> DataFrame:
    """(file, pos, line) of the logs in an archive, like bundle.log_lines of an unpacked one."""
    spark.dataSource.register(LogArchive)
    return spark.read.format("log_archive").option("path", path).option("members", members).load()
