"""Incremental ingest as a stream: new files become chunks, each content once.

Which contents have come is keyed state of the stream: of the files of a content that come together, the first by path is taken, and
of those that come later none, so no batch reads what is stored. A batch that failed is run again from the state before it, and
upserts the same chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexquarry.plans.pipeline import Settings, chunk
from lexquarry.sources import files
from lexquarry.sources.store import Store

FILES = "path string, modificationTime timestamp, length long, content binary"
BATCH_FILES = 1000
"""Files of a batch, at most; the driver names those that are new."""


def first_path(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first path of a content that is new; of one that came before, nothing."""
    if state.exists:
        for _ in rows:
            pass
        return
    path = min(part["path"].min() for part in rows)
    state.update((path,))
    yield pd.DataFrame({"source_sha1": [key[0]], "path": [path]})


def new_contents(stream: DataFrame) -> DataFrame:
    """source_sha1 and path of each content of a stream of files, once. Contents are hashed where they are read; hashes and paths alone are dealt."""
    hashed = stream.where(files.suffix(F.col("path")).isin(*files.MIME)).select(F.sha1("content").alias("source_sha1"), "path")
    return hashed.groupBy("source_sha1").applyInPandasWithState(first_path, "source_sha1 string, path string", "path string", "append", GroupStateTimeout.NoTimeout)


def elements_of(new: DataFrame, extractor: files.Extractor) -> DataFrame:
    """Elements of files: path and content."""
    named = new.select("path", F.sha1("content").alias("source_sha1"), "content", *(c.alias(n) for n, c in files.source_columns(F.col("path")).items()))
    return files.extracted(named, extractor)


def ingest(spark: SparkSession, folder: str, chunks: Store, checkpoint: str, extractor: files.Extractor | None = None, settings: Settings = Settings()) -> StreamingQuery:
    """Runs over all files that came since the last run, and stops. Chunks are upserted by id, so a repeated batch changes nothing."""
    extractor = extractor or files.OFFLINE

    def step(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # BATCH_FILES at most
        if not paths:
            return
        made = chunk(elements_of(spark.read.format("binaryFile").load(paths), extractor), settings=settings).persist()
        try:
            if made.limit(1).count():
                chunks.upsert(made, "chunk_id")
        finally:
            made.unpersist()

    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", BATCH_FILES).load(folder)
    return new_contents(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
