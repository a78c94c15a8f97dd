"""Zipped bulk dumps as a Spark data source: one partition per archive member, filters before any is opened.

Dumps lie as ``root/SYMBOL/timeframe/*.zip``, one or more CSV files in each. The archive's directory, at its end, is all
that planning reads; a task then reads the bytes of its own member alone. Filters on ``symbol`` are decided on
folder names, filters on ``day`` on the dates in member names, so other archives or members are not opened.
Paths are resolved by Arrow's file systems: local paths, ``file:``, ``s3:``, ``gs:`` and ``hdfs:`` where the cluster has them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FIELDS = "symbol string, day string, file string, value string"
DAY = re.compile(r"(\d{4}-\d{2}(?:-\d{2})?)(?=\.[^.]*$)")
LINES = 20_000
_BELOW = {LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, EqualTo: lambda a, b: a == b}


def day_of(name: str) -> str | None:
    """The date (or month) a file is named after: ``X-1m-2024-01-31.csv``."""
    found = DAY.search(name)
    return found.group(1) if found else None


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    symbol: str
    day: str | None

    def __post_init__(self):
        super().__init__(0)


def _passes(value: str | None, filters: list[Filter]) -> bool:
    """Whether a column that has this one value in a whole file can pass. Unknown values never compare true."""
    for f in filters:
        if isinstance(f, In):
            if value is None or value not in f.value:
                return False
        elif value is None or not _BELOW[type(f)](value, f.value):
            return False
    return True


class ZippedDumps(DataSource):
    """``spark.read.format("zipped_dumps").option("timeframe", "1m").load(root)``: symbol, day, file, value (a line)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_dumps"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> "ZipReader":
        return ZipReader(self.options["path"], self.options.get("timeframe", "1m"))


class ZipReader(DataSourceReader):
    def __init__(self, root: str, timeframe: str):
        self.root, self.timeframe = root, timeframe
        self.filters: dict[str, list[Filter]] = {"symbol": [], "day": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of ``symbol`` and ``day`` with constants; all others are Spark's to apply."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and column[0] in self.filters and isinstance(f, (*_BELOW, In)):
                self.filters[column[0]].append(f)
            else:
                yield f

    def _system(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.root or self.root.startswith("file:"):
            return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.root))
        return fs.LocalFileSystem(), self.root

    def partitions(self) -> list[Member]:
        system, root = self._system()
        found = []
        folders = [x for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory]
        for folder in sorted(folders, key=lambda x: x.base_name):
            if not _passes(folder.base_name, self.filters["symbol"]):
                continue
            inside = system.get_file_info(fs.FileSelector(f"{folder.path}/{self.timeframe}", allow_not_found=True))
            for archive in sorted((x.path for x in inside if x.base_name.endswith(".zip"))):
                # An archive named after a day or month holds that one.
                outer = day_of(archive)
                if outer and not self._overlaps(outer):
                    continue
                with zipfile.ZipFile(system.open_input_file(archive)) as z:
                    for name in z.namelist():
                        day = day_of(name) or outer
                        if name.endswith(".csv") and (not self.filters["day"] or _passes(day, self.filters["day"])):
                            found.append(Member(archive, name, folder.base_name, day))
        return found

    def _overlaps(self, outer: str) -> bool:
        """An archive of a whole month is opened unless no day of it passes."""
        if not self.filters["day"] or len(outer) == 10:
            return not self.filters["day"] or _passes(outer, self.filters["day"])
        return any(_passes(day, self.filters["day"]) for day in (outer, *(f"{outer}-{d:02d}" for d in range(1, 32))))

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        with zipfile.ZipFile(system.open_input_file(partition.archive)) as z, z.open(partition.name) as raw:
            held: list[str] = []
            for line in io.TextIOWrapper(raw, "utf-8", errors="replace"):
                held.append(line.rstrip("\r\n"))
                if len(held) == LINES:
                    yield self._batch(partition, held)
                    held = []
            if held:
                yield self._batch(partition, held)

    @staticmethod
    def _batch(member: Member, lines: list[str]) -> pa.RecordBatch:
        same = lambda x: pa.array([x] * len(lines), pa.string())
        return pa.RecordBatch.from_arrays([same(member.symbol), same(member.day), same(f"{member.archive}/{member.name}"), pa.array(lines, pa.string())], names=["symbol", "day", "file", "value"])


def zipped_lines(spark: SparkSession, root: str, timeframe: str = "1m") -> DataFrame:
    """``symbol, day, file, value``: the lines of all members; filters on the first two are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZippedDumps)
    return spark.read.format("zipped_dumps").option("timeframe", timeframe).load(root)
