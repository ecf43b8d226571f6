"""The jobs as queries: each runs twice into one new folder, and its whole output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import index_stream, publish_chunks
from lexquarry.plans import oracles
from lexquarry.sources.store import scratch


def job1_publish_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/publish-{uuid.uuid4().hex}"
    for _ in range(2):
        publish_chunks.run(spark, f"{sf_dir}/documents.parquet", folder)
    return spark.read.parquet(f"{folder}/chunks").select("doc_id", "j", "chunk_id", "text", "n_tokens", "source")


def job2_index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        index_stream.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return index_stream.opened(spark, f"{folder}/index")[0].select("term", "id", "tf", "dl")


QUERIES = {f.__name__: f for f in (job1_publish_chunks, job2_index_stream)}
ORACLES = {
    "job1_publish_chunks": f"""WITH RECURSIVE first AS (SELECT text, min(doc_id) AS doc_id, arg_min(coalesce(nullif(source, ''), '{publish_chunks.UNKNOWN}'), doc_id) AS source FROM documents WHERE regexp_matches(text, '\\S') GROUP BY text),
      sentences AS (SELECT doc_id AS key, unnest(range(len(x))) AS k, unnest(x) AS s FROM (SELECT doc_id, {oracles._SENTENCES} AS x FROM first)), {oracles._packed(120, 20)}
      SELECT doc_id, j::INT AS j, sha1(sha1(first.text) || '|TXT|' || j)[1:16] AS chunk_id, chunk AS text, greatest(1, length(chunk) // 2)::INT AS n_tokens, source FROM packed JOIN first ON doc_id = key""",
    "job2_index_stream": f"""SELECT term, id, count(*)::INT AS tf, any_value(dl)::INT AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM (SELECT sha1(text) AS id, {oracles._tokens("text")} AS t
      FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL))) GROUP BY id, term""",
}
