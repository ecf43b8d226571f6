"""Registered queries of the retrieval engine and their SQL, over the driver's whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import guarding, legal, tables, text
from lexquarry.operators import answering, chunks, dense, fusion, incremental, lexical, ranking, sections
from lexquarry.plans import oracles
from lexquarry.plans import views as V
from lexquarry.sources import jsonl
from lexquarry.sources.store import Store, materialised, scratch

DENSE_K, LEXICAL_K, POOL = 20, 50, 50


_indexed: dict[tuple[str, str], tuple[str, str]] = {}


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counted documents, vocabulary and statistics, stored once per application and built anew when the files change."""
    docs = V.corpus(spark, d)
    state = V.fingerprint(docs)
    key = (spark.sparkContext.applicationId, d)
    if _indexed.get(key, ("", ""))[0] != state:
        folder = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
        counted, terms, stats = (Store(spark, f"{folder}/{n}") for n in ("documents", "terms", "statistics"))
        # dealt before the texts are cut to words: few files need not mean few tasks
        counted.write(lexical.documents(docs.repartition(4 * spark.sparkContext.defaultParallelism, "id")))
        stats.write(counted.read().agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).select("n", F.try_divide(F.coalesce("length", F.lit(0)), "n").alias("avgdl")))
        terms.write(lexical.vocabulary(lexical.postings_of(counted.read()), stats.read()))
        _indexed[key] = state, folder
    folder = _indexed[key][1]
    return tuple(Store(spark, f"{folder}/{n}").read() for n in ("documents", "terms", "statistics"))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, vocabulary and statistics of all documents."""
    counted, terms, stats = _stored(spark, d)
    return lexical.postings_of(counted), terms, stats


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    counted, terms, stats = _stored(spark, d)
    return lexical.best(counted, stats, V.items(spark, d), LEXICAL_K, terms)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return dense.nearest(V.item_vectors(spark, d), V.vectors(spark, d), DENSE_K, 64)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Written, as it is small and what follows reads it more than once."""
    near = _dense(spark, d).withColumn("distance", F.round("distance", 6))
    return materialised(fusion.fuse(near, _lexical(spark, d), limit=POOL), "fused")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and nearest neighbours of every item, fused by reciprocal ranks; the best 12."""
    return _fused(spark, d).where("rank <= 12").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "bm25", "distance", F.round("score_rrf", 6).alias("score_rrf"))


def bm25_okapi_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).select("query_id", "id", "rn", "bm25")


def bm25_fts_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold all terms of an item."""
    postings, terms, stats = _index(spark, d)
    found = lexical.fts(postings, stats, V.items(spark, d), terms=terms).withColumn("rank", F.round("rank", 8))
    return lexical.top(found, [F.col("rank"), F.col("id")], LEXICAL_K).select("query_id", "id", "rn", F.col("rank").alias("fts_rank"), lexical.fts_score(F.col("rank")).alias("score_lex"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return dense.nearest(V.asked_vectors(spark, d), V.vectors(spark, d), DENSE_K, 64)


def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("query_id", "id", "rn", F.round("distance", 6).alias("distance"))


def distance_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("query_id", "id", F.round(dense.similarity(F.col("distance")), 6).alias("similarity"))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.round("score_rrf", 6).alias("score_rrf"))


def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Lexical share, similarity and reciprocal ranks in one score, with the text looked up."""
    near = _dense(spark, d)
    near = near.select("query_id", "id", "rn", dense.similarity(F.col("distance")).alias("score_vec"))
    best = _lexical(spark, d)
    best = best.select("query_id", "id", "rn", ranking.minmax(F.col("bm25")).alias("score_lex"))
    found = fusion.hybrid(best, near).withColumn("score_hybrid", F.round("score_hybrid", 6))
    return fusion.looked_up(found, V.corpus(spark, d)).select("query_id", "id", "score_hybrid", F.length("text").alias("n_chars"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    own = V.table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_join("t", " ").alias("tokens"))


def accent_strip(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", text.strip_accents(F.lower("text")).alias("plain"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    own = text.sentences(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", F.posexplode(own).alias("pos", "sentence"))


def token_truncate(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", text.token_len(F.col("text")).alias("n_tokens"), text.truncate_tokens(F.col("text"), 520).alias("cut"))


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("excerpt"), text.strip_html(F.col("html"), 10**9).alias("plain"), tables.html_to_text(F.col("html")).alias("table_text"))


def heading_detect(spark: SparkSession, d: str) -> DataFrame:
    return V.elements(spark, d).withColumn("h", legal.heading(F.col("text"))).select("doc_id", F.col("ord").alias("i"), *(F.col(f"h.{f}").alias(f) for f in legal.FIELDS))


def section_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = sections.sectioned(V.elements(spark, d))
    return rows.select("doc_id", F.col("ord").alias("i"), F.col("section").cast("int").alias("section"), "flush", *(F.col(f"state.{f}").alias(f) for f in legal.FIELDS))


def section_table(spark: SparkSession, d: str) -> DataFrame:
    """Key, title, header, citation, and parents of every section."""
    s = sections.sections(sections.sectioned(V.elements(spark, d)))
    page = lambda f: f(F.filter(F.transform("items", lambda i: i["page_number"]), lambda p: p.isNotNull()))
    work = F.concat(F.lit("VB"), F.col("doc_id").cast("string"))
    state, title = F.col("state"), F.col("title")
    parent = legal.parent_id(F.col("source_sha1"), legal.parent_key(state), legal.parent_level(state))
    return s.select(
        "doc_id", F.col("section").cast("int").alias("section"), "title", legal.section_key(state, title).alias("section_key"), legal.header_line(state, title).alias("header"),
        legal.citation(work, state, page(F.array_min), page(F.array_max)).alias("citation"), legal.parent_level(state).alias("parent_level"), legal.parent_key(state).alias("parent_key"), parent.alias("parent_id"), F.size("items").alias("n_items"),
    )


def parent_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Elements' pages and text lengths by parent."""
    rows = sections.sectioned(V.elements(spark, d)).withColumn("key", legal.parent_key(F.col("state"))).withColumn("level", legal.parent_level(F.col("state")))
    made = rows.groupBy("source_sha1", "doc_id", "key", "level").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.count(F.lit(1)).alias("n_items"), F.sum(F.length("text")).alias("n_chars"))
    return made.select("doc_id", legal.parent_id(F.col("source_sha1"), F.col("key"), F.col("level")).alias("parent_id"), "page_start", "page_end", "n_items", "n_chars")


def pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document packed to 120 tokens with an overlap of 20."""
    packed = chunks.pack(text.sentences(F.col("text")), 120, 20)
    return V.table(spark, d, "documents").select("doc_id", F.posexplode(packed).alias("j", "text"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Children and parents of every document."""
    captioned = sections.nearby_captions(V.elements(spark, d))
    made = chunks.chunked(sections.sections(sections.sectioned(captioned)))
    return made.select("doc_id", "chunk_id", "doc_type", "modality", "section_key", "citation", "parent_id", F.length("text").alias("n_chars"))


def nearby_caption(spark: SparkSession, d: str) -> DataFrame:
    return sections.nearby_captions(V.elements(spark, d)).select("doc_id", F.col("ord").alias("i"), "caption")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    made = text.sha16(F.col("source_sha1"), F.lit("TXT"), F.col("ord").cast("string"))
    return V.elements(spark, d).select("doc_id", F.col("ord").alias("i"), made.alias("chunk_id"), text.sha16(F.col("source_sha1"), F.col("text")).alias("content_id"))


def incremental_new(spark: SparkSession, d: str) -> DataFrame:
    """Elements of sources that no label knows."""
    known = V.table(spark, d, "labels").select(F.sha1(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("source_sha1"))
    return incremental.unseen(V.elements(spark, d), known).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_new"))


def incremental_counters(spark: SparkSession, d: str) -> DataFrame:
    known = V.table(spark, d, "labels").select(F.sha1(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("source_sha1"))
    return incremental.counters(V.elements(spark, d), known)


def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = V.elements(spark, d).withColumn("k", F.col("ord") % 5)
    return incremental.last_wins(rows, ["source_sha1", "k"], "ord").select("doc_id", F.col("k").cast("int").alias("k"), F.col("ord").alias("i"), "text")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Documents, with those that have labels replaced."""
    base = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("value"))
    new = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("toxic="), F.col("toxic").cast("string")).alias("value")).distinct()
    return incremental.upserted(base, new)


def modality(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.expr(V.MODALITIES)
    flag = F.when(F.col("doc_id") % 7 == 3, "yes")
    return V.table(spark, d, "documents").select("doc_id", tables.modality(tagged, flag, F.lit(None)).alias("modality"), tables.text_modality(tagged).alias("by_text"), tables.query_modality(F.concat(F.col("source"), F.lit(" ảnh "), F.col("lang"))).alias("asked"))


def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = V.elements(spark, d).withColumn("citation", F.when(F.col("ord") % 9 != 4, "c"))
    return rows.groupBy(F.coalesce(incremental.problem(), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def guard_segments(spark: SparkSession, d: str) -> DataFrame:
    asked = V.questions(spark, d).select("query_id", F.posexplode(guarding.segments(guarding.fix_spelling(F.col("query")))).alias("pos", "segment"))
    return asked.withColumn("label", guarding.label(F.col("segment")))


def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    asked = answering.guarded(V.questions(spark, d))
    return asked.select("query_id", "guard.status", "guard.normalized_query", "guard.reason", F.size("guard.removed_segments").alias("n_removed"), "guard.user_warning", F.array_join("guard.suggestions", "|").alias("suggestions"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """The fused pool of every item, with keys and dates derived from the document's number."""
    docs = V.corpus(spark, d).selectExpr("id", "text", "source AS van_ban", "'text' AS modality", *V.pool_columns("id"))
    return _fused(spark, d).withColumn("score_rrf", F.round("score_rrf", 8)).join(docs, "id")


def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    docs = V.corpus(spark, d).selectExpr("id", "id AS seq", "text", "source AS van_ban", "'text' AS modality", *V.pool_columns("id"))
    return fusion.expand(_pool(spark, d), docs).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "extra")


def rerank_features(spark: SparkSession, d: str) -> DataFrame:
    """Every feature and the final score of the best 8 of each item, without a scorer."""
    asked = V.items(spark, d).withColumn("prefer_modality", F.lit(None).cast("string"))
    best = ranking.rerank(_pool(spark, d), asked)
    kept = ("score_vec", "score_prior_modality", "score_prior_recency", "score_prior_cohesion", "score_prior_lexical", "score_prior_scope", "score_prior_money", "score_rerank")
    return best.select("query_id", "id", *(F.round(c, 5).alias(c) for c in kept))


def redundancy(spark: SparkSession, d: str) -> DataFrame:
    rows = _pool(spark, d).withColumn("penalised", ranking.redundancy(F.lit(1.0)))
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "penalised")


def recency_prior(spark: SparkSession, d: str) -> DataFrame:
    """Order dates in four forms, as text of seconds (no date) and as numbers of seconds, brought to 0 .. 1 per customer."""
    o = V.table(spark, d, "orders")
    date = F.col("o_orderdate")
    forms = [F.date_format(date, f) for f in ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "d-M-yyyy")]
    said = F.when(F.col("o_orderkey") % 6 == 4, F.unix_timestamp(date).cast("string"))
    for k, form in enumerate(forms):
        said = F.when(F.col("o_orderkey") % 6 == k, form).otherwise(said)
    number = F.when(F.col("o_orderkey") % 6 == 5, F.unix_timestamp(date))
    read = F.coalesce(ranking.parsed_date(said), ranking.parsed_date(number, number=True))
    rows = o.select("o_orderkey", F.col("o_custkey").alias("query_id"), read.alias("seconds"))
    return rows.select("o_orderkey", "seconds", F.round(ranking.recency(F.col("seconds")), 6).alias("recency"))


def money_prior(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("phạt "), F.col("l_extendedprice").cast("long").cast("string"), F.when(F.col("l_linenumber") == 1, " đồng").otherwise(""))
    question = F.when(F.col("l_orderkey") % 2 == 0, "mức phạt là gì").otherwise("điều nào")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ranking.money(question, said).alias("money"))


def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = sections.sectioned(V.elements(spark, d))
    work = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("VB"), F.col("doc_id").cast("string")))
    return rows.select("doc_id", F.col("ord").alias("i"), legal.citation_label(work, F.col("state"), F.col("page_number"), F.col("page_number"), F.lit("none")).alias("label"))


def unique_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as hits of 97 queries: the labels of each in order, each once."""
    rows = V.corpus(spark, d).selectExpr("id AS final_rank", "id % 97 AS query_id", "source AS van_ban", "CAST(NULL AS STRING) AS dieu", "CAST(NULL AS STRING) AS khoan", "CAST(NULL AS STRING) AS diem", "CAST(NULL AS INT) AS page_start", "CAST(NULL AS INT) AS page_end", "'' AS citation")
    return answering.sources(rows).select("query_id", F.array_join("sources", ", ").alias("sources"))


def _brands(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's parts as a Markdown table, tagged for even brands, with two blank lines and more text after it."""
    line = F.concat(F.lit("| "), F.col("p_name"), F.lit(" | "), F.col("p_partkey").cast("string"), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), line.alias("l")))), lambda x: x["l"]), "\n")
    made = V.table(spark, d, "part").groupBy("p_brand").agg(body.alias("body"))
    tag = F.when(F.regexp_extract("p_brand", r"(\d)$", 1).cast("int") % 2 == 0, "[BẢNG]\n").otherwise("")
    return made.select("p_brand", F.concat(tag, F.lit("| name | key |\n| --- | --- |\n"), F.col("body"), F.lit("\n\n\nafter | the | table")).alias("text"))


def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    found = _brands(spark, d).withColumn("block", tables.extract_table(F.col("text")))
    return found.select("p_brand", tables.is_table(F.col("text")).alias("is_table"), "block", tables.truncate_table(F.col("block"), 5).alias("short"))


def json_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = V.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, F.concat(F.col("props"), F.lit("{"))).otherwise(F.col("props")).alias("value"))
    return jsonl.malformed(lines)


def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Questions to prompts: guard, retrieval over all documents, reranking and context."""
    hits = rerank_hits(spark, d)
    return answering.prompts(V.items(spark, d), hits).select("query_id", "is_table", F.size("sources").alias("n_sources"), F.length("user").alias("n_chars"))


def rerank_hits(spark: SparkSession, d: str) -> DataFrame:
    asked = V.items(spark, d).withColumn("prefer_modality", F.lit(None).cast("string"))
    empty: Column = F.lit(None).cast("int")
    return ranking.rerank(_pool(spark, d), asked).withColumns({"page_start": empty, "page_end": empty, "citation": F.lit("")})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, bm25_okapi_topk, bm25_fts_topk, knn_l2_topk, distance_similarity, rrf_fuse, hybrid_weighted, tokenize_counts, accent_strip, sentence_split, token_truncate, html_strip,
        heading_detect, section_windows, section_table, parent_aggregate, pack_chunks, document_chunks, nearby_caption, chunk_ids, incremental_new, incremental_counters, dedup_last_wins, upsert_merge,
        modality, validate_rows, guard_segments, guard_verdicts, parent_expand, rerank_features, redundancy, recency_prior, money_prior, citation_labels, unique_sources, markdown_tables, json_scan, answer_prompts,
    )
}
ORACLES = oracles.ORACLES
