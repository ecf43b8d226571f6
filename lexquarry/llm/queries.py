"""The query of each operator over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import credentials, decontamination, katz, language, mixing, neardup, quality, sharding, substrings, suffixes, toxicity, tries
from lexquarry.llm.oracles import ORACLES


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(n))


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.scored(documents(spark, sf_dir), remainder(10) != 0)
    return found.withColumns({"held_out": remainder(10) == 0, "base_score": F.round("base_score", 6), "score": F.round("score", 6)})


def katz_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations, scored from the stored tables of a model of all documents."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    found = katz.scored_with(turns, katz.fit(documents(spark, sf_dir)))
    return found.withColumns({"held_out": F.lit(True), "base_score": F.round("base_score", 6), "score": F.round("score", 6)})


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(documents(spark, sf_dir)).drop("kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.shard(docs, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3's law asks of its shards: rows, and slots without gaps; with the whole table's rows and sizes."""
    placed = op3_sharding(spark, sf_dir)
    total = placed.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("all_sizes"))
    of = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"))
    return of.join(F.broadcast(total), how="cross")  # one row


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.stored(quality.ledger(documents(spark, sf_dir)))
    base = found["failed"].bitwiseAND(F.lit(quality.BASE).cast("long")) != 0
    return found.select("doc_id", *quality.MEASURES, base.alias("base_failed"), (~base & quality.passes()).alias("kept"), "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the stored ledger's bits alone."""
    found = quality.stored(quality.ledger(documents(spark, sf_dir)))
    return functools.reduce(DataFrame.unionAll, [quality.ablations(found, p) for p in quality.POLICIES])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", mixing.n_words("text").alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mixing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of op5's mix: its size and target, whether the words taken miss it by no more than its largest document, and
    whether no document exceeds twice its size."""
    mixed = op5_mixing(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    near = F.abs(F.sum("taken") - F.first("target")) <= F.max("size")
    return mixed.groupBy("source", "source_size").agg(F.round(F.first("target"), 4).alias("target"), near.alias("near"), F.every(F.col("taken") <= 2 * F.col("size")).alias("within"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(documents(spark, sf_dir), texts=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.item_id", "x.distance", "x.end")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(remainder(4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "cosine")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(remainder(3) != 1).select("doc_id", "toxic"))
    return toxicity.score(docs, model).withColumns({"held_out": remainder(3) == 1, "predicted": (F.col("score") >= toxicity.CUT).cast("int")})


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tries.numbered(tries.keyed(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return tries.nodes(tries.regrafted(turns))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credentials.found(documents(spark, sf_dir))
    hardest = F.array_max(F.transform("values", lambda v: v["cost"]))
    return rows.select("doc_id", *(credentials.n_of(k).alias(f"n_{k}") for k in credentials.KINDS[:3]), F.sha2(credentials.said("base"), 256).alias("base_sha256"), credentials.said("spans").alias("spans"), F.round(hardest, 6).alias("hardest"))


def secrets_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have how many spans of each base kind."""
    kinds = [f"n_{k}" for k in credentials.KINDS[:3]]
    return op12_secrets(spark, sf_dir).groupBy(*kinds).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("ids"))


QUERIES = {f.__name__: f for f in (op1_katz, op2_suffix_dedup, op3_sharding, op4_quality, op5_mixing, op6_substring_dedup, op7_decontamination, op8_near_dedup, op9_language, op10_toxicity, op11_prefix_trie, op12_secrets, katz_conversations, mixing_report, quality_ablations, secrets_report, sharding_report)}

__all__ = ["ORACLES", "QUERIES"]
