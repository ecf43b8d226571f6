"""Publishes the chunks that retrieval reads: documents, each content once, cut to sentences and packed to a token budget.

    python -m jobs.publish_chunks DOCUMENTS OUTPUT [--config jobs/publish_chunks.json]

DOCUMENTS: Parquet with doc_id, text and source. OUTPUT/chunks: doc_id, j, chunk_id, text, n_tokens, partitioned by source; OUTPUT/report:
per source, how many documents, chunks and tokens there are. Of documents with equal text, the one with the smallest id is
published, under its source (null and empty: "unknown"). With `sources`, only their partitions are replaced, and what other
sources hold is read only to know whose copies these documents are. A rerun replaces what it wrote, by the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from lexquarry.functions import text
from lexquarry.operators import chunks

DEFAULTS = {"chunk_tokens": 120, "overlap_tokens": 20, "sources": None}
UNKNOWN = "unknown"


def first_of_each_text(docs: DataFrame) -> DataFrame:
    """Of all documents with equal text, the first. Texts meet by digest, partial minima first."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.coalesce(text.filled(F.col("source")), F.lit(UNKNOWN)).alias("source")).where(text.strip(F.coalesce("text", F.lit(""))) != "")
    rows = rows.withColumn("sha", F.sha1("text"))
    # the digests alone are grouped; texts travel only for the documents that stay
    first = rows.groupBy("sha").agg(F.min(F.struct("doc_id", "source")).alias("first")).select("sha", "first.doc_id", "first.source")
    # rows of one id, source and text are one; the join has dealt them by these already
    return rows.join(first, ["sha", "doc_id", "source"], "left_semi").dropDuplicates(["doc_id", "source", "sha"])


def chunked(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """doc_id, j, chunk_id, text, n_tokens, source of first documents."""
    packed = chunks.pack(text.sentences(F.col("text")), most, overlap)
    rows = docs.select("doc_id", "source", "sha", F.posexplode(packed).alias("j", "text"))
    return rows.select("doc_id", "j", text.sha16(F.col("sha"), F.lit("TXT"), F.col("j").cast("string")).alias("chunk_id"), "text", text.token_len(F.col("text")).alias("n_tokens"), "source")


def run(spark: SparkSession, documents: str, output: str, settings: dict | None = None) -> dict:
    """Publishes; returns how many rows were read and what the output holds."""
    own = DEFAULTS | (settings or {})
    docs = spark.read.parquet(documents).select("doc_id", "text", "source")
    first = first_of_each_text(docs)
    if own["sources"] is not None:
        first = first.where(F.col("source").isin(list(own["sources"])))
    rows = chunked(first, own["chunk_tokens"], own["overlap_tokens"])
    # a source that holds most of the rows is written by many tasks
    writer = rows.hint("rebalance", "source").write.mode("overwrite").partitionBy("source")
    writer.option("partitionOverwriteMode", "static" if own["sources"] is None else "dynamic").parquet(f"{output}/chunks")
    made = spark.read.schema(rows.schema).parquet(f"{output}/chunks")
    # chunks of a document count by one of them: no ids are gathered
    per_source = made.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("j") == 0).alias("n_documents"))
    per_source.coalesce(1).write.mode("overwrite").parquet(f"{output}/report")  # a row per source
    report = spark.read.schema(per_source.schema).parquet(f"{output}/report")
    done = {"rows": docs.count()} | report.agg(*(F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in ("documents", "chunks", "tokens"))).first().asDict()
    log.info("read %d rows from %s", done["rows"], documents)
    log.info("%s holds %d different documents in %d chunks of %d tokens", f"{output}/chunks", done["documents"], done["chunks"], done["tokens"])
    return done


if __name__ == "__main__":
    command(__doc__, ("documents", "output"), run, DEFAULTS)
