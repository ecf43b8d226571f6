"""Parquet tables with upserts: whole versions, and between them the rows that came, changed or went.

An upsert writes its own rows alone; a reader takes the newest whole version and what came after it, and of each key the
newest rows. Numbers are claimed one by one, and an upsert never depends on what it would replace: of two writers at once,
both stay, and the higher number holds where they meet. Every MOST upserts the table is written whole again.
"""

from __future__ import annotations

import functools
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, CHANGED, GONE, CLAIM = "version", "changed", "gone", "_claim"
MOST = 8
"""Upserts before the table is written whole again: a reader joins at most so many."""
STALE = 24 * 3600
"""Seconds after which a claim without a version is taken to be a writer's that ended."""


def scratch(spark: SparkSession) -> str:
    """A folder for tables of this application: in the one that driver and executors share, or a local one for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="lexquarry-")
        _local[spark.sparkContext.applicationId] = folder
    return f"{folder.rstrip('/')}/lexquarry-{spark.sparkContext.applicationId}"


_local: dict[str, str | None] = {}


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(table: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes the table, whose job's shuffle files go as soon as it stands: nothing reads them again."""
    conf, writer = table.sparkSession.conf, table.write.option("compression", "zstd")
    had = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        conf.unset(CLEAN) if had is None else conf.set(CLEAN, had)


def materialised(table: DataFrame, name: str) -> DataFrame:
    """The table, written to the application's folder and read back: what refers to it sees the same rows each time."""
    path = f"{scratch(table.sparkSession)}/{name}-{uuid.uuid4().hex}"
    saved(table, path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


class Store:
    """A table under a folder that Spark can read: version=N holds it whole, changed.KEY=N new rows of some keys, gone.KEY=N keys that left."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self) -> list[tuple[int, str]]:
        """Number and kind of all that was committed."""
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName().split("=") for s in self._fs.listStatus(root)]
        return sorted((int(n[1]), n[0]) for n in names if n[0].split(".")[0] in (VERSION, CHANGED, GONE) and self._fs.exists(self._path(f"{self.folder}/{n[0]}={n[1]}/_SUCCESS")))

    def versions(self) -> list[int]:
        return [number for number, _ in self._parts()]

    def _open(self, part: tuple[int, str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part[1]}={part[0]}")

    def _current(self) -> list[tuple[int, str]]:
        """The newest whole version and what came after it."""
        have = self._parts()
        whole = max((k for k, part in enumerate(have) if part[1] == VERSION), default=None)
        return [] if whole is None else have[whole:]

    def read(self) -> DataFrame | None:
        have = self._current()
        out = None
        for k, part in enumerate(have):
            if part[1].startswith(GONE):
                continue
            rows = self._open(part)
            # what is newer says which rows no longer hold; Spark broadcasts its keys where they are few
            later: dict[str, list[DataFrame]] = {}
            for p in have[k + 1 :]:
                key = p[1].split(".", 1)[1]
                later.setdefault(key, []).append(self._open(p).select(key))
            for key, keys in later.items():
                rows = rows.join(functools.reduce(DataFrame.unionAll, keys).distinct(), key, "left_anti")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def claimed(self) -> int:
        """The next number that no other writer has: claims are files that only one can create."""
        number = (self.versions() or [0])[-1] + 1
        while not self._fs.createNewFile(self._path(f"{self.folder}/{CLAIM}-{number}")):
            number += 1
        return number

    def _open_claims(self, below: int) -> bool:
        """Whether a writer with a lower number may still be at work."""
        done, now = set(self.versions()), time.time()
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name.startswith(f"{CLAIM}-"):
                number = int(name.rsplit("-", 1)[1])
                if number < below and number not in done and number > min(done, default=0) and now - s.getModificationTime() / 1000 < STALE:
                    return True
        return False

    def _write(self, table: DataFrame, kind: str, number: int, partition_by: list[str] | None) -> None:
        saved(table, f"{self.folder}/{kind}={number}", partition_by)

    def write(self, table: DataFrame, partition_by: list[str] | None = None) -> int:
        """A new whole version, visible once its job has committed."""
        number = self.claimed()
        self._write(table, VERSION, number, partition_by)
        return number

    def _add(self, rows: DataFrame, kind: str, partition_by: list[str] | None) -> int:
        number = self.claimed()
        self._write(rows, kind, number, partition_by)
        newest = [n for n, k in self._parts() if k == VERSION]
        if newest and newest[-1] > number:  # the table was written whole meanwhile, and may not have seen these rows
            return self._add(self._open((number, kind)), kind, partition_by)
        if len(self._current()) > MOST:
            self.whole()
        return number

    def upsert(self, rows: DataFrame, key: str = "id", partition_by: list[str] | None = None) -> int:
        """rows in place of those with the same keys; the first rows are the first version."""
        if not self._current():
            return self.write(rows, partition_by)
        return self._add(rows, f"{CHANGED}.{key}", partition_by)

    def remove(self, keys: DataFrame, key: str = "id") -> int:
        """Takes the rows of these keys away."""
        return self._add(keys.select(key).distinct(), f"{GONE}.{key}", None)

    def whole(self) -> None:
        """Writes the table whole, partitioned as it was, unless a writer is at work that this could miss; what the version before
        had replaced is deleted."""
        number = self.claimed()
        if self._open_claims(number):
            self._fs.delete(self._path(f"{self.folder}/{CLAIM}-{number}"), False)
            return
        before = self._current()[0]
        own = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{before[1]}={before[0]}"))]
        self._write(self.read(), VERSION, number, sorted({n.split("=")[0] for n in own if "=" in n}))
        for n, kind in self._parts():
            if n < before[0]:  # readers of the version before may still be at work: that one stays
                self._fs.delete(self._path(f"{self.folder}/{kind}={n}"), True)

    def get(self, ids: DataFrame, key: str = "id") -> DataFrame:
        """Rows with these keys."""
        return self.read().join(ids.select(key).distinct(), key, "left_semi")

    def where(self, limit: int | None = None, order: str = "id", **equal) -> DataFrame:
        """Rows that equal all given values (None: is null), the first ones by order."""
        rows = self.read()
        for name, value in equal.items():
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        return rows.orderBy(order).limit(limit) if limit else rows
