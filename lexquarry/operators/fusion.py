"""Reciprocal-rank fusion, hybrid scores, and expansion to the surrounding article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_rank(hits: DataFrame) -> DataFrame:
    """A document listed twice has its last rank and its first record."""
    others = [c for c in hits.columns if c not in ("query_id", "id", "rn")]
    return hits.groupBy("query_id", "id").agg(F.max("rn").alias("rn"), *(F.min_by(c, "rn").alias(c) for c in others))


def reciprocal(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 60, limit: int = 50, compat: bool = False) -> DataFrame:
    """query_id, rank, id, bm25, distance, score_rrf of the fused top.

    dense: query_id, id, rn, distance; lexical: query_id, id, rn, bm25. compat: hits of both lists lose their bm25, as
    the dense record wins. Ties: hits of both first, then the nearer (a missing distance counts as 0), then id.
    """
    d = dense.select("query_id", "id", F.col("rn").alias("rd"), "distance")
    x = lexical.select("query_id", "id", F.col("rn").alias("rl"), "bm25")
    both = d.join(x, ["query_id", "id"], "full_outer")
    score = F.coalesce(reciprocal(F.col("rd"), k), F.lit(0.0)) + F.coalesce(reciprocal(F.col("rl"), k), F.lit(0.0))
    bm25 = F.when(F.col("rd").isNotNull() & F.col("rl").isNotNull(), 0.0).otherwise(F.col("bm25")) if compat else F.col("bm25")
    scored = both.select("query_id", "id", bm25.alias("bm25"), "distance", score.alias("score_rrf"))
    paired = (F.col("bm25").isNotNull() & F.col("distance").isNotNull()).cast("int")
    order = Window.partitionBy("query_id").orderBy(F.col("score_rrf").desc(), paired.desc(), F.coalesce(-F.col("distance"), F.lit(0.0)).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def hybrid(lexical: DataFrame, dense: DataFrame, k: int = 60, w_lex: float = 0.45, w_vec: float = 0.55, final: int = 12) -> DataFrame:
    """query_id, rank, id, score_lex, score_vec, rrf, score_hybrid: weighted scores added to the ranks'.

    lexical: query_id, id, rn, score_lex; dense: query_id, id, rn, score_vec (0 to 1).
    """
    x = lexical.select("query_id", "id", F.col("rn").alias("rl"), "score_lex")
    d = dense.select("query_id", "id", F.col("rn").alias("rd"), "score_vec")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = x.join(d, ["query_id", "id"], "full_outer").select("query_id", "id", zero(F.col("score_lex")).alias("score_lex"), zero(F.col("score_vec")).alias("score_vec"), (zero(reciprocal(F.col("rl"), k)) + zero(reciprocal(F.col("rd"), k))).alias("rrf"))
    scored = both.withColumn("score_hybrid", w_lex * F.col("score_lex") + w_vec * F.col("score_vec") + F.col("rrf"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score_hybrid").desc(), "id"))).where(F.col("rank") <= final)


def looked_up(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their stored text; blank where the store has none."""
    return hits.join(chunks.select("id", "text"), "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def scope(doc: str = "doc_id", article: str = "ancestor_dieu_id", number: str = "dieu") -> Column:
    """What a hit is grouped by: its document and article, by id or else by number."""
    by_id = F.nullif(F.col(article), F.lit(""))
    return F.struct(F.col(doc).alias("doc"), by_id.alias("article"), F.when(by_id.isNull(), F.col(number)).alias("number"))


def expand(pool: DataFrame, chunks: DataFrame, groups: int = 3, per_group: int = 12, most: int = 36) -> DataFrame:
    """The pool with chunks of the same article as its strongest groups.

    pool: query_id, rank, id, doc_id, ancestor_dieu_id, dieu, score_rrf, bm25; chunks: id, seq and the same keys. The
    per_group first chunks of a group by seq count, known ones included. Extras rank after the pool; see `room`.
    """
    keyed = pool.withColumn("k", scope())
    score = F.coalesce("score_rrf", F.lit(0.0)) + F.coalesce("bm25", F.lit(0.0)) * 1e-4
    strong = keyed.groupBy("query_id", "k").agg(F.sum(score).alias("g"), F.min("rank").alias("at"))
    strong = strong.withColumn("gr", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("g").desc(), "at"))).where(F.col("gr") <= max(1, groups))
    # null-safe on each part: a group without an article is the document's chunks without one
    by_id = strong.where("k.article IS NOT NULL").select("query_id", "gr", F.col("k.doc").alias("doc_id"), F.col("k.article").alias("ancestor_dieu_id"))
    by_number = strong.where("k.article IS NULL").select("query_id", "gr", F.col("k.doc").alias("doc_id"), F.col("k.number").alias("n"))
    # a group's first chunks are the same for every query: found once, by article and by number
    first = lambda *of: chunks.withColumn("i", F.row_number().over(Window.partitionBy(*of).orderBy("seq", "id"))).where(F.col("i") <= per_group)
    numbered = first("doc_id", "dieu").join(by_number, "doc_id").where(F.col("dieu").eqNullSafe(F.col("n")))
    siblings = first("doc_id", "ancestor_dieu_id").join(by_id, ["doc_id", "ancestor_dieu_id"]).select("query_id", "gr", "id", "seq", "i").unionByName(numbered.select("query_id", "gr", "id", "seq", "i"))
    new = siblings.join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = new.groupBy("query_id", "id").agg(F.min(F.struct("gr", "i")).alias("o"))
    new = new.withColumn("x", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "id"))).where(F.col("x") <= most)
    size = pool.groupBy("query_id").agg(F.max("rank").alias("size"))
    placed = new.join(size, "query_id").join(chunks, "id")
    extra = placed.select("query_id", (F.col("size") + F.col("x")).cast("int").alias("rank"), *(F.col(c) for c in pool.columns if c in chunks.columns and c not in ("query_id", "rank")), F.lit(True).alias("extra"))
    return pool.withColumn("extra", F.lit(False)).unionByName(extra, allowMissingColumns=True)


def room(pool: DataFrame, rerank: int = 30, extras: int = 12) -> DataFrame:
    """Ranks anew so that up to `extras` expanded rows fall inside the part that reranking reads."""
    own = F.when(F.col("extra"), F.row_number().over(Window.partitionBy("query_id", "extra").orderBy("rank")))
    place = F.when(F.col("extra") & (own <= extras), F.lit(rerank - extras) + own / 1000.0).otherwise(F.col("rank").cast("double"))
    return pool.withColumn("_p", place).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "id"))).drop("_p")
