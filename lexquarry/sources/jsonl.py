"""JSON lines: tolerant reading, appending, and the two element schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.tables import once
from lexquarry.functions.text import filled, page_number


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with `row` (variant): blank lines are dropped, malformed ones have none."""
    # inside brackets, since the parser ignores what follows a value
    inside = F.try_parse_json(F.concat(F.lit("["), F.col(value), F.lit("]")))
    one = once(inside, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))
    # exploded, as conditions on a plain column would move below it and parse the line again for each of its uses
    return lines.where(F.trim(F.col(value)) != "").select("*", F.explode(F.array(one)).alias("row"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """row: the well-formed lines of the files."""
    return parsed(spark.read.text(path)).where("row IS NOT NULL").select("row")


def malformed(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: lines read, and those that don't parse."""
    return parsed(lines, value).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("row").isNull()).alias("n_bad"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def flat(elements: DataFrame) -> DataFrame:
    """Elements as flat rows, with what readers expect under metadata there too; nulls are left out of the file."""
    meta = F.struct("page_number", "slide_number", "text_as_html", F.col("source_sha1").alias("file_sha1"), F.col("source_name").alias("file_name"), F.col("source_path").alias("file_path"))
    # a page on top would hide the slide in metadata, so it stands there alone
    return elements.select("ord", "element_id", F.col("element_type").alias("type"), "text", "source_sha1", "source_name", "source_path", "source_ext", "doc_id", meta.alias("metadata"))


def known(spark: SparkSession, path: str) -> DataFrame | None:
    """source_sha1 of the sources that the files hold; None where there are none yet."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    return elements(read(spark, path)).select("source_sha1").distinct()


def ordered(spark: SparkSession, path: str) -> DataFrame:
    """row and ord: the order within a source is the file's own number where it has one, else that of its line."""
    rows = parsed(spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())).where("row IS NOT NULL")
    return rows.select("row", F.coalesce(at(F.col("row"), "$.ord", "long"), F.col("_line")).alias("ord"))


def at(row: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(row, path, kind)


def elements(rows: DataFrame, row: str = "row", order: str | None = None) -> DataFrame:
    """Typed elements from flat rows (type and text on top) or nested ones (under `element`); others are dropped.

    Empty source fields fall back to metadata's. A page on top, even a null one, hides the one in metadata.
    """
    r = F.col(row)
    flat = at(r, "$.text").isNotNull() & at(r, "$.type").isNotNull()
    either = lambda a, b: F.when(flat, a).otherwise(b)
    first = lambda *c: F.coalesce(*(filled(x) for x in c))
    meta = lambda f: F.coalesce(at(r, f"$.metadata.{f}"), at(r, f"$.element.metadata.{f}"))
    top = at(r, "$.page_number", "variant").isNotNull()  # a null of JSON is a value
    page = F.when(top, at(r, "$.page_number")).otherwise(F.coalesce(meta("page_number"), meta("slide_number")))
    out = rows.select(
        *([F.col(order).alias("ord")] if order else []),
        either(at(r, "$.element_id"), F.coalesce(at(r, "$.element.id"), at(r, "$.element_id"))).alias("element_id"),
        either(at(r, "$.type"), F.coalesce(at(r, "$.element.type"), at(r, "$.element_type"))).alias("element_type"),
        F.coalesce(either(at(r, "$.text"), F.coalesce(at(r, "$.element.text"), at(r, "$.text"))), F.lit("")).alias("text"),
        page_number(page).alias("page_number"),
        meta("text_as_html").alias("text_as_html"),
        first(at(r, "$.source_sha1"), meta("file_sha1")).alias("source_sha1"),
        first(at(r, "$.source_name"), meta("file_name")).alias("source_name"),
        first(at(r, "$.source_path"), meta("file_path")).alias("source_path"),
        first(at(r, "$.source_ext")).alias("source_ext"),
        first(at(r, "$.doc_id"), at(r, "$.source_name"), meta("file_name")).alias("doc_id"),
    )
    return out.where("element_type IS NOT NULL AND source_sha1 IS NOT NULL")
