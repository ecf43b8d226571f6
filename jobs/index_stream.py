"""Keeps a search index up to date with a folder of documents: each run takes the files that came since the last one.

    python -m jobs.index_stream DOCUMENTS OUTPUT CHECKPOINT [--config jobs/index_stream.json]

DOCUMENTS: a folder of Parquet files, or one file, with text. Contents are indexed once, however often and whenever they come: their
hashes are keyed state of the stream, so that no run reads what earlier ones indexed. OUTPUT/postings (term, id, tf, dl), OUTPUT/terms
(term, df) and OUTPUT/sizes (n, length) are partitioned by batch; a batch that is done again replaces its own partition, by the
same rows. Document frequencies and lengths of batches add up, so what is written grows with what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, has_table, log, settings
from lexquarry.functions import text
from lexquarry.operators import lexical

DEFAULTS = {"max_files_per_batch": 1000, "shuffle_partitions": None}
TABLES = {"postings": "term string, id string, tf int, dl int", "terms": "term string, df long", "sizes": "n long, length long"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def contents(docs: DataFrame) -> DataFrame:
    """id (of the content), text: each content once; documents without text have none."""
    return docs.where("text IS NOT NULL").select(F.sha1("text").alias("id"), "text").dropDuplicates(["id"])


def indexed(batch: DataFrame, number: int, output: str) -> None:
    """Writes a batch's postings, and from these its terms and sizes."""
    spark = batch.sparkSession

    def write(name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{output}/{name}/batch={number}")

    new = batch.select("id", text.tokens(F.col("text")).alias("t")).persist()  # read for the postings and for the sizes
    terms = new.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    write("postings", terms.groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl")))
    write("terms", table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    write("sizes", new.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("length")))
    new.unpersist()
    n, length = table("sizes").select("n", "length").first()
    log.info("batch %d: indexed %d new contents of %d tokens into %s", number, n, length, output)


def opened(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, vocabulary and statistics of all batches, as `lexical.okapi` reads them."""
    postings, terms, sizes = (spark.read.schema(f"{TABLES[t]}, batch long").parquet(f"{output}/{t}").drop("batch") for t in TABLES)
    stats = sizes.agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))
    df = terms.groupBy("term").agg(F.sum("df").alias("df")).join(F.broadcast(stats.select("n")), how="cross")  # one row
    return postings, df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), stats


def search(spark: SparkSession, output: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """The best k contents of each query (query_id, query): query_id, id, rn, bm25."""
    postings, terms, stats = opened(spark, output)
    found = lexical.okapi(postings, stats, queries, terms=terms)
    return lexical.top(found, [F.col("bm25").desc(), F.col("id")], k)


def watched(path: str) -> str:
    """The path as a pattern of itself alone: a stream takes a single file, too, if a pattern names it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/{{{name}}}" if folder else f"{{{name}}}"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, own: dict | None = None) -> dict:
    """Indexes what is new, waits for it, and returns what was read and how much of it was new."""
    own = DEFAULTS | (own or {})
    schema = spark.read.parquet(documents).select("text").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", own["max_files_per_batch"]).parquet(watched(documents))
    some = {"spark_sql_shuffle_partitions": str(own["shuffle_partitions"])} if own["shuffle_partitions"] else {}
    with settings(spark, spark_sql_streaming_stateStore_providerClass=ROCKS, **some):
        stream = contents(source).writeStream.foreachBatch(lambda batch, number: indexed(batch, number, output)).option("checkpointLocation", checkpoint)
        query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    done = {"batches": len({p["batchId"] for p in progress if p["numInputRows"]}), "rows": sum(p["numInputRows"] for p in progress)}
    log.info("read %d new rows in %d batches from %s", done["rows"], done["batches"], documents)
    if has_table(spark, f"{output}/sizes"):
        done["contents"], done["tokens"] = spark.read.schema(f"{TABLES['sizes']}, batch long").parquet(f"{output}/sizes").agg(F.sum("n"), F.sum("length")).first()
        log.info("the index in %s holds %d contents of %d tokens", output, done["contents"], done["tokens"])
    return done


if __name__ == "__main__":
    command(__doc__, ("documents", "output", "checkpoint"), run, DEFAULTS)
