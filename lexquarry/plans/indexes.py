"""Registered queries of the vector index, Unicode forms, spanning tables and vocabulary tokens, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import legal, tables, text
from lexquarry.operators import cells, dense, merges, sections
from lexquarry.plans import oracles
from lexquarry.plans import views as V
from lexquarry.sources.store import scratch

K = 20


def _cells(spark: SparkSession, d: str) -> cells.Cells:
    return cells.build(V.vectors(spark, d), f"{scratch(spark)}/cells-{uuid.uuid4().hex}", k=K)


def ivf_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of every vector whose number is divisible by 20, from the cells that it looks into."""
    return cells.search(V.asked_vectors(spark, d), _cells(spark, d), K).select("query_id", "id", "rn", F.round("distance", 6).alias("distance"))


def ivf_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether every vector is in a cell, and whether the same queries find nine in ten of their true nearest."""
    at, asked, rows = _cells(spark, d), V.asked_vectors(spark, d).where("vector IS NOT NULL"), V.vectors(spark, d).where("embedding IS NOT NULL")
    truth = dense.nearest(asked, rows, K, at.centers.shape[1]).select("query_id", "id")
    hits = truth.join(cells.search(asked, at, K).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    found = F.coalesce(F.sum(F.coalesce("hit", F.lit(0))), F.lit(0))  # where nothing is asked, nothing is missed
    share = hits.agg(F.count_distinct("query_id").alias("n_queries"), (found >= 0.9 * F.count(F.lit(1))).alias("good"))
    n = rows.agg(F.count(F.lit(1)).alias("n_vectors"))
    held = at.vectors.agg(F.count(F.lit(1)).alias("n_indexed"))
    return n.join(F.broadcast(held), how="cross").join(F.broadcast(share), how="cross")  # one row each


def unicode_forms(spark: SparkSession, d: str) -> DataFrame:
    """All documents, decomposed and composed again, and how many characters they have decomposed."""
    apart = V.table(spark, d, "documents").select("doc_id", text.normalized(F.col("text"), "NFD").alias("apart"))
    return apart.select("doc_id", F.length("apart").alias("n_apart"), text.normalized(F.col("apart"), "NFC").alias("nfc"))


def spanning_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as an HTML table whose title spans its columns and whose order number spans its rows, in Markdown."""
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("long").cast("string"), F.lit("</td>"))
    line = F.concat(cell(F.col("l_partkey")), cell(F.col("l_quantity")))
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", line.alias("line")))).alias("x"))  # an order has few
    key = F.col("l_orderkey").cast("string")
    body = F.array_join(F.transform("x", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan='"), F.size("x").cast("string"), F.lit("'>"), key, F.lit("</td>"))).otherwise(""), x["line"], F.lit("</tr>"))), "")
    html = F.concat(F.lit('<table><tr><th colspan="3">Order '), key, F.lit("</th></tr>"), body, F.lit("</table>"))
    return rows.select("l_orderkey", tables.html_to_markdown(html).alias("markdown"))


def section_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The sections of every element, found in blocks that cut documents anywhere."""
    rows = sections.sectioned_by_blocks(V.elements(spark, d), blocks=50)
    return rows.select("doc_id", F.col("ord").alias("i"), F.col("section").cast("int").alias("section"), "flush", *(F.col(f"state.{f}").alias(f) for f in legal.FIELDS))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def vocabulary_tokens(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """How many tokens of a vocabulary every document has."""
    held = spark.sparkContext.broadcast(merges.ranks(spark, vocabulary))
    return merges.counted(V.table(spark, d, "documents").select("doc_id", "text"), held).select("doc_id", "n_tokens")


QUERIES = {f.__name__: f for f in (ivf_knn_topk, ivf_report, unicode_forms, spanning_tables, section_blocks, vocabulary_tokens)}
ORACLES = {
    "section_blocks": oracles.ORACLES["section_windows"],
    "ivf_report": "SELECT count(*) AS n_vectors, count(*) AS n_indexed, count(*) FILTER (vec_id % 20 = 0) AS n_queries, true AS good FROM embeddings WHERE embedding IS NOT NULL",
    "unicode_forms": """WITH m AS (SELECT doc_id, nfc_normalize(text) AS nfc FROM documents),
      c AS (SELECT doc_id, unnest(string_split(nfc, '')) AS c FROM m)
      SELECT m.doc_id, nfc, CASE WHEN nfc IS NOT NULL THEN length(nfc) + coalesce((SELECT count(*) FROM c WHERE c.doc_id = m.doc_id AND strip_accents(c.c) <> c.c), 0) END::INT AS n_apart FROM m""",
    "spanning_tables": """SELECT l_orderkey, '| Order ' || l_orderkey || ' |  |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || CASE WHEN k = 1 THEN l_orderkey::VARCHAR ELSE '' END || ' | ' || l_partkey || ' | ' || trunc(l_quantity)::BIGINT || ' |', chr(10) ORDER BY k) AS markdown
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem) GROUP BY l_orderkey""",
}
