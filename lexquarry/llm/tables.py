"""Where intermediate tables go, and what is known of their size."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
WHILE_WRITING = {CLEAN: "true", BATCH: str(8 << 20)}
"""Settings of the jobs that write tables: what goes to Python workers at once takes 8 MB, or one row."""


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        here = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = here.get() if here.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lexquarry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The job's shuffle files go as soon as the table stands, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    if Scratch.now is not None:
        Scratch.now.paths.append(path)
    writer = df.write.option("compression", "zstd")
    had = {name: spark.conf.get(name, None) for name in WHILE_WRITING}
    for name, value in WHILE_WRITING.items():
        spark.conf.set(name, value)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        for name, value in had.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _at(table: DataFrame, part: str):
    """A written table's folder or that of a partition, and its file system."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{_folders[table]}/{part}" if part else _folders[table])
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())


def forget(table: DataFrame, part: str = "") -> None:
    """Deletes a written table, or one partition of it, that nothing reads any more."""
    path, files = _at(table, part)
    files.delete(path, True)


def has(table: DataFrame, part: str) -> bool:
    """Whether a written table has rows in a partition."""
    path, files = _at(table, part)
    return files.exists(path)


def orderable(kind: T.DataType) -> bool:
    """Whether rows can be hashed and ordered by a column of this type."""
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    return orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(salt: int | str, *columns: str | Column) -> Column:
    """Hash of the columns and of which of them are null: Spark's own passes over nulls, so that a value and a null could
    change places unseen."""
    of = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(F.lit(salt), *of, *(c.isNull() for c in of))


class Scratch:
    """Deletes the tables that were written inside, except the last, which holds the result."""

    now: Scratch | None = None

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.outer, Scratch.now = Scratch.now, self
        return self

    def __exit__(self, *failed) -> None:
        Scratch.now = self.outer
        self.drop(self.paths[:-1])

    def drop(self, paths: list[str]) -> None:
        sc = self.spark.sparkContext
        for p in paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return n, size or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
