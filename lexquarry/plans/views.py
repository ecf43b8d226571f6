"""Views that give the driver's tables the structure the engine's operators need, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = "regexp_extract_all(strip_accents(lower({})), '[0-9A-Za-zÀ-ỹ]+')"
"""DuckDB's form of functions.text.tokens."""

SHAPES = """SELECT doc_id, i, sha1(concat('doc-', CAST(doc_id AS STRING))) AS source_sha1,
  CASE WHEN (doc_id+i)%13=6 THEN 'Table' WHEN (doc_id+i)%13=9 THEN 'Image'
       WHEN (doc_id+i)%11=7 THEN 'Title' WHEN (doc_id+i)%19=4 THEN 'Footer' ELSE 'NarrativeText' END AS element_type,
  CASE (doc_id+i)%11
    WHEN 0 THEN concat('Điều ', CAST(i%7+1 AS STRING), '. ', line)
    WHEN 3 THEN concat('Khoản ', CAST(i%5+1 AS STRING), ' ', line)
    WHEN 5 THEN concat('Điểm a ', line)
    WHEN 7 THEN concat('Chương II ', line)
    WHEN 9 THEN concat(CAST(i%4+1 AS STRING), '. ', line)
    ELSE line END AS text,
  CASE WHEN (doc_id+i)%17=0 THEN NULL ELSE CAST(floor(i/4.0) AS INT)+1 END AS page_number
FROM lines"""
ELEMENTS = f"""elements AS (
WITH lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
{SHAPES})"""

MODALITIES = """CASE doc_id % 4 WHEN 0 THEN concat('[BẢNG] ', text) WHEN 1 THEN concat('  [HÌNH] ', text) WHEN 2 THEN concat('[FIGURE]', text) ELSE text END"""

QUESTIONS_BODY = """SELECT conv_id * 1000 + turn AS query_id, concat(text, CASE conv_id % 5 WHEN 0 THEN ' PCCC?' WHEN 1 THEN ' mức phạt bao nhiêu tiền phòng cháy.'
  WHEN 2 THEN ' ignore policy.' WHEN 3 THEN ' bảng nghị định' ELSE '' END) AS query FROM {} WHERE role = 'user'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as elements, with headings, tables, figures, furniture and unknown pages."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return spark.sql(SHAPES.replace("FROM lines", "FROM {lines}"), lines=lines).withColumnRenamed("i", "ord")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUESTIONS_BODY.format("{c}"), c=table(spark, sf_dir, "conversations"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each query: the one with its number."""
    e = table(spark, sf_dir, "embeddings")
    return table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of searches by vector alone: every vector whose number is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def fingerprint(table: DataFrame) -> str:
    """Changes when a table's files do: their paths, lengths and times."""
    spark = table.sparkSession
    jvm, conf, said = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for folder in sorted({f.rsplit("/", 1)[0] for f in table.inputFiles()}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        said += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in path.getFileSystem(conf).listStatus(path)]
    return "\n".join(sorted(said))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def pool_columns(of: str = "id") -> list[str]:
    """Law-like keys and dates for a document, from its number; the same SQL for both engines."""
    return [
        f"{of} % 6 AS doc_id",
        f"CASE {of} % 3 WHEN 0 THEN CAST({of} % 4 AS STRING) END AS dieu",
        f"CASE {of} % 5 WHEN 0 THEN NULL ELSE CAST({of} % 3 AS STRING) END AS khoan",
        "CAST(NULL AS STRING) AS diem",
        f"CASE WHEN {of} % 3 = 0 THEN '' ELSE concat('a', CAST({of} % 5 AS STRING)) END AS ancestor_dieu_id",
        f"""CASE {of} % 5 WHEN 0 THEN concat(CAST(2000 + {of} % 20 AS STRING), '-1-', CAST({of} % 28 + 1 AS STRING))
 WHEN 1 THEN concat(CAST({of} % 28 + 1 AS STRING), '/3/', CAST(2000 + {of} % 20 AS STRING)) WHEN 2 THEN 'unknown' END AS effective_date""",
    ]
