"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, sharding.

Stages rename the columns of their rows while an operator works on them, so that any column may have any name and comes out
as it went in. Defined cases, for all stages: an empty table gives an empty table; texts are read whole, at what each
operator's docstring says a long one costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import decontamination, language, mixing, neardup, sharding
from lexquarry.llm.tables import Scratch, orderable, written

MIN_COSINE, SAYS_NOTHING = 0.04, 100
"""A text goes if no language's prototype is nearer than MIN_COSINE, as with random letters, less what chance may take from a text
of its length: the cut rises from 0 at SAYS_NOTHING characters with the inverse root of the length. A text without letters goes always."""

NEAR = 80
"""Percent of the union of shingles from which documents are near copies; 85 is op8's own."""


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1, ..., and what each column is called now."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null and empty texts, texts without a letter, and texts that are like
    no language. Labels (null: none) train the profiles; the text alone decides, row by row."""
    rows, at = renamed(docs)
    found = language.identify(rows, language.fit(rows, at["text"], at["lang"]), at["text"])
    alien = F.col("cosine") < MIN_COSINE * (1 - F.sqrt(SAYS_NOTHING / F.greatest(F.length(at["text"]), F.lit(1))))
    return restored(found.where((F.col("lang_pred") != language.UNKNOWN) & ~alien), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group. Of several rows of one id, the first by text and then by the
    other columns stays; rows without an id, and documents without words, are nobody's copies and stay."""
    rows, at = renamed(docs)
    doc_id, text = at["doc_id"], at["text"]
    gone = neardup.grouped(rows, doc_id, text, threshold=NEAR).where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
    known = rows.where(F.col(doc_id).isNotNull()).join(gone, doc_id, "left_anti")
    first = [text, *(c for c in rows.columns if c not in (doc_id, text) and orderable(rows.schema[c].dataType))]
    least = known.select(doc_id, F.struct(*rows.columns).alias("row"), F.struct(*first).alias("by")).groupBy(doc_id).agg(F.min_by("row", "by").alias("row"))
    return restored(least.select("row.*").unionByName(rows.where(F.col(doc_id).isNull())), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, row by row; null and empty texts hold none and stay, as do all documents
    with an empty benchmark."""
    rows, at = renamed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return restored(decontamination.matched(rows, benchmark, at["text"]).where(F.size("items") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Null is a source, the last one; rows without words, null texts included, are
    taken once; repeated rows and null ids are rows like others."""
    rows, at = renamed(docs)
    mixed = mixing.mix(rows.withColumn("words", mixing.n_words(at["text"])), at["doc_id"], at["source"], "words")
    return restored(mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; copies and repeated rows are drawn as separate rows, nulls hashed like other values.
    Columns that are already called shard or slot get an underscore."""
    rows, _ = renamed(docs)
    names = list(docs.columns)
    for added in ("shard", "slot"):
        name = added
        while name in names:
            name += "_"
        names = [name if n == added else n for n in names]
    return sharding.shard(rows, 8).toDF(*names, "shard", "slot")


STAGES = [("language", identify), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None
"""SQL can't express the language profiles, Unicode edit matching and tilted rates; tests compare with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table replaces the one before; what the operators wrote on the way is deleted."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop(old)
        old = scratch.paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
