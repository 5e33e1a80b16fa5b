"""Versions of a folder of month layers: each is made once only, and seen whole or not at all.

A version is a folder ``commits/version=n`` of one row a month (month, and the folder that
holds its rows) and one row without a month, for the layers of all months. It is written
under a name that readers skip, and renamed; a name that is taken is never renamed over,
so of two writers one finds its number taken. Renaming is one step on HDFS and on a local
disk; a store that has no such step needs a committer that has.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ROW = "ym string, folder string"


class Conflict(Exception):
    """Another writer has changed what a change was made from."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    months: dict[str, str] = field(default_factory=dict)
    whole: str | None = None

    def changed(self, other: Version) -> set[str]:
        """Months that differ between two versions."""
        return {ym for ym in {*self.months, *other.months} if self.months.get(ym) != other.months.get(ym)}


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def _listed(self, name: str) -> list:
        path = self._path(name)
        files = path.getFileSystem(self._conf)
        return list(files.listStatus(path)) if files.exists(path) else []

    def numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self._listed("commits"))
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def read(self, number: int) -> Version:
        rows = self.spark.read.schema(ROW).parquet(f"{self.folder}/commits/version={number}").collect()  # a row a month
        return Version(number, {r["ym"]: r["folder"] for r in rows if r["ym"] is not None}, next((r["folder"] for r in rows if r["ym"] is None), None))

    def last(self) -> Version:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else Version()

    def publish(self, version: Version) -> bool:
        """Make a version; False if its number is taken."""
        new, name = f"commits/_new-{uuid.uuid4().hex}", f"commits/version={version.number}"
        rows = [*version.months.items(), (None, version.whole)]
        self.spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{self.folder}/{new}")
        files = self._path(new).getFileSystem(self._conf)
        source, target = (files.makeQualified(self._path(n)) for n in (new, name))
        never_over = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        never_over[0] = self._hadoop.Options.Rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(source, target, never_over)
        except Py4JJavaError as e:
            if not files.exists(target):
                raise
            files.delete(source, True)
            if "Exists" not in e.java_exception.getClass().getSimpleName() and self.read(version.number) == version:
                return True
            return False
        return True

    def remove_unreachable(self, keep: int = 2, older_than: float = 24 * 3600) -> list[str]:
        """Delete versions before the last ``keep``, and data that no version left names and that is older than some seconds; what was deleted.

        Readers of the versions kept, and writers that began within that time, are not disturbed.
        """
        numbers, gone = self.numbers(), []
        kept = [self.read(n) for n in numbers[-keep:]]
        named = {f for v in kept for f in (*v.months.values(), v.whole) if f}
        before = (time.time() - older_than) * 1000
        for n in numbers[:-keep]:
            gone.append(f"commits/version={n}")
        for f in self._listed("commits"):
            if f.getPath().getName().startswith("_new-") and f.getModificationTime() < before:
                gone.append(f"commits/{f.getPath().getName()}")
        for f in self._listed("data"):
            name = f.getPath().getName()
            if f.getModificationTime() < before and not any(x == f"{self.folder}/data/{name}" or x.startswith(f"{self.folder}/data/{name}/") for x in named):
                gone.append(f"data/{name}")
        for name in gone:
            self._path(name).getFileSystem(self._conf).delete(self._path(name), True)
        return gone
