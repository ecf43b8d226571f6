"""Registered queries of the engine's smaller parts over the driver's whole tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import legal, tables
from lexquarry.operators import answering, chunks, dense, incremental, lexical, ranking, sections
from lexquarry.plans import catalog, oracles, pipeline
from lexquarry.plans import views as V
from lexquarry.sources import files, jsonl, providers
from lexquarry.sources.store import Store, materialised, scratch

PATHS = """SELECT s_suppkey, concat('hdfs://host/in/', s_name, '.v', CAST(s_suppkey % 3 AS STRING),
  CASE s_suppkey % 10 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.doc' WHEN 3 THEN '.ppt' WHEN 4 THEN '.pptx' WHEN 5 THEN '.PPTM' WHEN 6 THEN '.ppsx' WHEN 7 THEN '.potx' WHEN 8 THEN '.txt' ELSE '' END) AS path,
  CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE s_suppkey * 1000003 END AS n FROM {}"""


def file_parameters(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a file by its path and length, for the suppliers as files."""
    rows = spark.sql(PATHS.format("{s}"), s=V.table(spark, d, "supplier"))
    path = F.col("path")
    own = files.source_columns(path)
    return rows.select("s_suppkey", *(own[c].alias(c) for c in ("source_name", "source_ext", "doc_id")), files.mime(path).alias("mime"), files.strategy(path).alias("strategy"), F.round(files.upload_timeout(F.col("n")), 4).alias("timeout"))


def page_slices(spark: SparkSession, d: str) -> DataFrame:
    pages = F.when(F.col("p_partkey") % 9 == 4, 0).otherwise(F.col("p_size") * 7).cast("int")
    rows = V.table(spark, d, "part").select("p_partkey", F.posexplode(files.slices(pages)).alias("k", "s"))
    return rows.select("p_partkey", "k", F.col("s.first").cast("int").alias("first"), F.col("s.last").cast("int").alias("last"))


def element_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON of both schemas, with sources and pages in all the places where they may stand."""
    k = F.col("doc_id")
    sha, name, page = F.sha1(F.concat(F.lit("doc-"), k.cast("string"))), F.concat(F.lit("f"), k.cast("string")), (k % 40).cast("string")
    flat = F.struct(
        F.when(k % 6 != 4, F.lit("Text")).alias("type"), F.col("text"), F.concat(F.lit("e"), k.cast("string")).alias("element_id"), F.when(k % 5 == 0, F.lit("")).when(k % 5 < 4, sha).alias("source_sha1"), F.when(k % 7 < 3, name).alias("source_name"),
        F.struct(F.when(k % 3 > 0, page).alias("page_number"), page.alias("slide_number"), F.when(k % 10 != 9, sha).alias("file_sha1"), name.alias("file_name")).alias("metadata"),
    )
    nested = F.struct(F.struct(F.lit("Title").alias("type"), F.col("text"), F.concat(F.lit("n"), k.cast("string")).alias("id"), F.struct(page.alias("page_number")).alias("metadata")).alias("element"), F.struct(sha.alias("file_sha1")).alias("metadata"), F.when(k % 8 == 3, F.concat(F.lit("d"), k.cast("string"))).alias("doc_id"))
    lines = V.table(spark, d, "documents").select(F.when(k % 4 == 1, F.to_json(nested)).otherwise(F.to_json(flat)).alias("value"), k.alias("ord"))
    rows = jsonl.elements(jsonl.parsed(lines).where("row IS NOT NULL"), order="ord")
    return rows.select("ord", "element_id", "element_type", F.length("text").alias("n_chars"), "page_number", "source_sha1", "source_name", "doc_id")


def store_lookups(spark: SparkSession, d: str) -> DataFrame:
    """A stored table after an upsert: the rows of some ids, and the first that equal a value or have none."""
    store = Store(spark, f"{scratch(spark)}/lookups-{uuid.uuid4().hex}")
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("value"))
    store.write(docs)
    store.upsert(docs.where("id % 3 = 0").select("id", "lang", F.lit("new").alias("value")))
    asked = docs.where("id % 20 = 0").select("id")
    parts = [("ids", store.get(asked)), ("equal", store.where(limit=30, value="new")), ("null", store.where(limit=30, value=None)), ("two", store.where(lang="en", value="new"))]
    out = [df.select(F.lit(name).alias("lookup"), "id", "lang", "value") for name, df in parts]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def modality_filters(spark: SparkSession, d: str) -> DataFrame:
    """What a dense search looks at if only a modality is wanted, and what stays of lexical hits."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(V.MODALITIES).alias("text"))
    hits = docs.withColumn("modality", tables.modality(F.col("text")))
    out = None
    for want, only in (("table", True), ("image", True), ("image", False), ("text", True), (None, True)):
        for name, df in (("dense", dense.tagged(docs, want, only)), ("lexical", dense.of_modality(hits, want, only))):
            part = df.select(F.lit(name).alias("side"), F.lit(want).alias("want"), F.lit(only).alias("strict"), "id")
            out = part if out is None else out.unionAll(part)
    return out


def inline_headers(spark: SparkSession, d: str) -> DataFrame:
    """Elements whose text opens with the article they stand under."""
    rows = sections.sectioned(V.elements(spark, d))
    return rows.select("doc_id", F.col("ord").alias("i"), legal.opens_with_article(F.trim("text"), F.col("state")).alias("opens"))


PAGES = """SELECT page_id, html, concat(CASE page_id % 3 WHEN 0 THEN ' [BẢNG] ' ELSE '' END, url) AS text, CASE page_id % 4 WHEN 1 THEN 'table' WHEN 2 THEN 'text' END AS modality FROM {}"""


def rerank_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(PAGES.format("{p}"), p=V.table(spark, d, "pages")).withColumn("html", F.when(F.col("page_id") % 5 > 0, F.col("html")).otherwise(" "))
    return rows.select("page_id", ranking.rerank_text(F.col("text"), F.col("modality"), F.col("html")).alias("read"))


def lexical_zeros(spark: SparkSession, d: str) -> DataFrame:
    """The best 50 of every item and of every nation's name, filled up with documents that score 0."""
    counted, terms, stats = catalog._stored(spark, d)
    names = V.table(spark, d, "nation").select((F.col("n_nationkey") + 1_000_000).cast("long").alias("query_id"), F.col("n_name").alias("query"))
    asked = V.items(spark, d).unionAll(names)
    return lexical.best(counted, stats, asked, 50, terms, zeros=True).select("query_id", "id", "rn", "bm25")


def slide_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each region's nations as a grid of cells."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), F.concat(F.lit(" "), x["n_name"], F.lit("\n!"))))
    return V.table(spark, d, "nation").groupBy("n_regionkey").agg(tables.grid(cells).alias("grid"))


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's parts as an HTML table, brought to Markdown, and one without rows."""
    cell = F.concat(F.lit("<tr><td>"), F.replace("p_name", F.lit(" "), F.lit("<br/>")), F.lit("</td><TD class='n'>"), F.col("p_partkey").cast("string"), F.lit(" &amp; &lt;"), F.when(F.col("p_partkey") % 3 == 0, "</td><td>x").otherwise(""), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cell.alias("c")))), lambda x: x["c"]), "\n")
    made = V.table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.lit("<table><thead><tr><th>Name</th><th>a|b</th></tr></thead>"), body, F.lit("</table>")).alias("html"))
    return made.select("p_brand", tables.html_to_markdown(F.col("html")).alias("markdown"), tables.html_to_markdown(F.concat(F.lit("<p>no <b>table</b> "), F.col("p_brand"), F.lit("</p>"))).alias("plain"))


def table_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The first two tables of every manufacturer's brands, at most five rows and 300 characters each."""
    none = F.lit(None).cast("string")
    brands = catalog._brands(spark, d).withColumn("k", F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int"))
    text = F.when(F.col("k") % 10 == 3, F.lit("no table")).otherwise(F.col("text"))
    hits = brands.select((F.col("k") / 10).cast("int").alias("query_id"), (F.col("k") % 10).alias("final_rank"), text.alias("text"), F.lit("text").alias("modality"), F.col("p_brand").alias("van_ban"), none.alias("dieu"), none.alias("khoan"), none.alias("diem"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.lit("").alias("citation"))
    return answering.table_blocks(hits, 2, 5, 300).select("query_id", F.col("n").cast("int").alias("n"), "label", "block")


def metadata_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of every document brought to scalars in both ways."""
    k = F.col("doc_id")
    rows = V.table(spark, d, "documents").select(
        "doc_id", F.when(k % 7 == 0, float("nan")).when(k % 7 == 1, float("inf")).when(k % 7 > 2, F.length("text") / 2).alias("n"), F.array_repeat("source", F.when(k % 5 == 0, 900).otherwise(2)).alias("tags"),
        F.when(k % 3 > 0, k % 3 == 1).alias("flag"), F.when(k % 2 == 0, F.struct("lang")).alias("own"),
    )
    first, second = incremental.metadata(rows, ["tags", "flag", "own"], 4000), incremental.metadata(rows, ["n", "tags", "flag", "own"], finite=True, version=True)
    made = rows.select("doc_id", first.alias("a"), second.alias("b"))
    keys = lambda c: F.array_join(F.json_object_keys(c), ",")
    return made.select("doc_id", keys("a").alias("keys_a"), keys("b").alias("keys_b"), F.get_json_object("a", "$.tags").alias("tags_a"), F.length(F.get_json_object("b", "$.tags")).alias("tags_b"), F.get_json_object("b", "$.n").cast("double").alias("n"), F.get_json_object("b", "$.own").alias("own"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The elements of all documents, appended to JSON lines in two parts and read again."""
    none = F.lit(None).cast("string")
    rows = V.elements(spark, d).select("ord", F.concat_ws("-", "doc_id", "ord").alias("element_id"), "element_type", "text", "page_number", F.lit(None).cast("int").alias("slide_number"), none.alias("text_as_html"),
                                       "source_sha1", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_name"), none.alias("source_path"), F.lit(".pdf").alias("source_ext"), F.col("doc_id").cast("string").alias("doc_id"))
    path = f"{scratch(spark)}/elements-{uuid.uuid4().hex}"
    for part in (0, 1):
        jsonl.append(jsonl.flat(rows.where(F.col("ord") % 2 == part)), path)
    return jsonl.elements(jsonl.ordered(spark, path), order="ord").select("doc_id", "ord", "element_id", "element_type", "text", "page_number", "source_sha1", "source_name")


def extracted_elements(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text files, of equal ones the first, read to elements in slices of one page."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\f"))
    rows = V.table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.encode(text, "utf-8").alias("content"))
    found = rows.select("path", F.sha1("content").alias("source_sha1"), "content", *(c.alias(n) for n, c in files.source_columns(F.col("path")).items()))
    known = found.where("doc_id LIKE '%7'").select("source_sha1")
    made = files.extracted(files.new_files(found, known), files.PlainText(), most=1)
    return made.select("doc_id", "ord", "element_type", "text", "page_number", "source_sha1", "source_name", "source_ext")


def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The index of the chunks of all documents' elements: its size by modality, and its vocabulary."""
    rows = chunks.chunked(sections.sections(sections.sectioned(sections.nearby_captions(V.elements(spark, d)))))
    made = pipeline.index(rows, f"{scratch(spark)}/built-{uuid.uuid4().hex}")
    size = made.chunks.join(made.vectors.select("id", F.size("embedding").alias("dim")), "id").groupBy("modality").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("dim").alias("dim"))
    words = made.postings.agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens")).join(F.broadcast(made.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.max("df").alias("top_df"))), how="cross")
    return size.join(F.broadcast(words), how="cross").join(F.broadcast(made.statistics.select("n", F.round("avgdl", 6).alias("avgdl"))), how="cross")  # one row each


def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    """The offline embedder's vectors of all documents: 64 numbers of length 1, or zeros without words."""
    made = providers.embedded(V.table(spark, d, "documents"), providers.HashEmbedder(), "doc_id")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("doc_id", F.size("embedding").alias("dim"), F.round(F.sqrt(square), 3).alias("norm"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Every user's question, guarded and answered from the two documents that BM25 finds first among all."""
    asked = answering.guarded(V.questions(spark, d)).persist()  # of the questions alone; Spark drops it when memory is short
    good = asked.where("guard.status = 'ok'").select("query_id", F.col("guard.normalized_query").alias("query"))
    none, n = F.lit(None).cast("string"), F.lit(None).cast("int")
    counted, terms, stats = catalog._stored(spark, d)
    hits = materialised(lexical.best(counted, stats, good, 2, terms).withColumnRenamed("rn", "final_rank"), "hits")  # two rows a question
    docs = V.corpus(spark, d).select("id", "text", F.col("source").alias("van_ban"))
    ranked = hits.join(docs, "id").select("query_id", "final_rank", "text", F.lit("text").alias("modality"), "van_ban", none.alias("dieu"), none.alias("khoan"), none.alias("diem"), n.alias("page_start"), n.alias("page_end"), F.lit("").alias("citation"))
    return answering.answered(asked, ranked, providers.Extractive()).select("query_id", "answer", F.array_join("sources", "|").alias("sources"), "notice", F.array_join("suggestions", "|").alias("suggestions"))


QUERIES = {f.__name__: f for f in (file_parameters, page_slices, element_rows, store_lookups, modality_filters, inline_headers, rerank_texts, lexical_zeros, slide_grid, html_tables, table_blocks, metadata_scalars, jsonl_round_trip, extracted_elements, index_statistics, embedding_norms, answers)}

_EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_TAGGED = "SELECT doc_id AS id, text, CASE WHEN regexp_matches(text, '^\\s*\\[(BẢNG|BANG)\\]') THEN 'table' WHEN regexp_matches(text, '^\\s*\\[(HÌNH|HINH|FIGURE)\\]') THEN 'image' ELSE 'text' END AS modality FROM (SELECT doc_id, " + V.MODALITIES + " AS text FROM documents)"
_SHA = "sha1('doc-' || doc_id)"
_PLAIN = oracles._STRIP_TAGS
ORACLES = {
    "file_parameters": f"""SELECT s_suppkey, regexp_extract(path, '([^/]*)$', 1) AS source_name, {_EXT} AS source_ext, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS doc_id,
      CASE {_EXT} WHEN '.pdf' THEN 'application/pdf' WHEN '.doc' THEN 'application/msword' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.ppt' THEN 'application/vnd.ms-powerpoint'
        WHEN '.pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' WHEN '.pptm' THEN 'application/vnd.ms-powerpoint.presentation.macroEnabled.12'
        WHEN '.ppsx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.slideshow' WHEN '.potx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.template' ELSE 'application/octet-stream' END AS mime,
      CASE {_EXT} WHEN '.pdf' THEN 'hi_res' ELSE 'auto' END AS strategy, round(CASE WHEN n > 0 THEN least(1800.0, greatest(120.0, n::DOUBLE / 1024 / 256 * 3 + 45)) ELSE 300.0 END, 4) AS timeout FROM ({PATHS.format("supplier")})""",
    "page_slices": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 4 THEN 0 ELSE p_size * 7 END AS n FROM part), c AS (SELECT *, unnest(range(greatest(1, ceil(n / 60.0))::BIGINT)) AS k FROM p)
      SELECT p_partkey, k::INT AS k, CASE WHEN n = 0 THEN 0 ELSE k * 60 END::INT AS first, CASE WHEN n = 0 THEN -1 ELSE least(n, (k + 1) * 60) END::INT AS last FROM c""",
    "element_rows": f"""WITH r AS (SELECT *, doc_id % 4 = 1 AS nested, {_SHA} AS sha, 'f' || doc_id AS name, doc_id % 6 <> 4 AS typed FROM documents),
      s AS (SELECT *, CASE WHEN nested THEN sha WHEN doc_id % 5 IN (1, 2, 3) THEN sha WHEN doc_id % 10 <> 9 THEN sha END AS source_sha1 FROM r)
      SELECT doc_id AS ord, CASE WHEN nested THEN 'n' ELSE 'e' END || doc_id AS element_id, CASE WHEN nested THEN 'Title' ELSE 'Text' END AS element_type, length(coalesce(text, ''))::INT AS n_chars,
        (doc_id % 40)::INT AS page_number, source_sha1, CASE WHEN nested THEN NULL WHEN doc_id % 7 < 3 THEN name ELSE name END AS source_name, CASE WHEN nested THEN CASE WHEN doc_id % 8 = 3 THEN 'd' || doc_id END ELSE name END AS doc_id
      FROM s WHERE (nested OR (typed AND text IS NOT NULL)) AND source_sha1 IS NOT NULL""",
    "store_lookups": """WITH t AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 4 > 0 THEN source END AS value FROM documents)
      SELECT 'ids' AS lookup, * FROM t WHERE id % 20 = 0 UNION ALL SELECT 'equal', * FROM (SELECT * FROM t WHERE value = 'new' ORDER BY id LIMIT 30) UNION ALL SELECT 'null', * FROM (SELECT * FROM t WHERE value IS NULL ORDER BY id LIMIT 30)
      UNION ALL SELECT 'two', * FROM t WHERE lang = 'en' AND value = 'new'""",
    "modality_filters": f"""WITH t AS ({_TAGGED}), w(want, strict) AS (VALUES ('table', true), ('image', true), ('image', false), ('text', true), (NULL, true))
      SELECT 'dense' AS side, want, strict, id FROM t, w WHERE CASE WHEN strict AND want = 'table' THEN contains(text, '[BẢNG]') WHEN strict AND want = 'image' THEN contains(text, '[HÌNH]') ELSE true END
      UNION ALL SELECT 'lexical', want, strict, id FROM t, w WHERE CASE WHEN strict AND want IN ('table', 'image') THEN modality = want ELSE true END""",
    "inline_headers": f"WITH {oracles.SECTIONED} SELECT doc_id, i::INT AS i, dieu IS NOT NULL AND {oracles._OPENS.format('trim(text)')} AS opens FROM rows_",
    "rerank_texts": f"""SELECT page_id, CASE WHEN (coalesce(modality, '') = 'table' OR page_id % 3 = 0) AND page_id % 5 > 0 THEN text || chr(10) || '[BẢNG_HTML_TRÍCH] ' || CASE WHEN length(p) > 1200 THEN p[1:1200] || ' ...' ELSE p END ELSE text END AS read
      FROM (SELECT *, {_PLAIN} AS p FROM ({PAGES.format("pages")}))""",
    "lexical_zeros": f"""WITH {oracles.OKAPI.split("asked AS")[0]}
      q AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT n_nationkey + 1000000, n_name FROM nation), asked AS (SELECT query_id, unnest({oracles._tokens("text")}) AS term FROM q),
      scored AS (SELECT query_id, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) AS bm25 FROM asked JOIN fixed USING (term) JOIN post USING (term) JOIN dls USING (id), st GROUP BY query_id, id),
      every_ AS (SELECT query_id, id, bm25 FROM scored UNION ALL SELECT query_id, doc_id, 0.0 FROM q, documents WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.query_id = q.query_id AND s.id = doc_id))
      SELECT query_id, id, rn::INT AS rn, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rn FROM every_) WHERE rn <= 50""",
    "slide_grid": "WITH l AS (SELECT n_regionkey, list('| ' || n_nationkey || ' | ' || n_name || ' ! |' ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey) SELECT n_regionkey, array_to_string(list_concat(list_concat(l[1:1], ['| --- | --- |']), l[2:]), chr(10)) AS grid FROM l",
    "html_tables": """WITH r AS (SELECT p_brand, list('| ' || p_name || ' | ' || p_partkey || ' & < | ' || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END || ' |' ORDER BY p_partkey) AS three, list('| ' || p_name || ' | ' || p_partkey || ' & < |' ORDER BY p_partkey) AS two, bool_or(p_partkey % 3 = 0) AS wide FROM part GROUP BY p_brand)
      SELECT p_brand, CASE WHEN wide THEN '| Name | a\\|b |  |' || chr(10) || '| --- | --- | --- | --- |' ELSE '| Name | a\\|b |' || chr(10) || '| --- | --- | --- |' END || chr(10) || array_to_string(CASE WHEN wide THEN three ELSE two END, chr(10)) AS markdown, 'no table ' || p_brand AS plain FROM r""",
    "table_blocks": """WITH b AS (SELECT p_brand, regexp_extract(p_brand, '(\\d+)$', 1)::INT AS k, list('| ' || p_name || ' | ' || p_partkey || ' |' ORDER BY p_partkey) AS l FROM part GROUP BY p_brand),
      t AS (SELECT k // 10 AS query_id, k % 10 AS fr, p_brand, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(l[1:5], chr(10)) || CASE WHEN len(l) > 5 THEN chr(10) || '... (cắt bớt, còn ' || (len(l) - 5) || ' dòng)' ELSE '' END AS x FROM b WHERE k % 10 <> 3),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fr) AS n FROM t)
      SELECT query_id::INT AS query_id, n::INT AS n, p_brand AS label, CASE WHEN length(x) > 300 THEN x[1:300] || chr(10) || '... (cắt bớt theo giới hạn ký tự)' ELSE x END AS block FROM o WHERE n <= 2""",
    "metadata_scalars": """WITH r AS (SELECT *, '[' || array_to_string(list_transform(range(CASE WHEN doc_id % 5 = 0 THEN 900 ELSE 2 END), lambda i: '"' || source || '"'), ',') || ']' AS tags, concat_ws(',', CASE WHEN doc_id % 3 > 0 THEN 'flag' END, CASE WHEN doc_id % 2 = 0 THEN 'own' END) AS more FROM documents)
      SELECT doc_id, concat_ws(',', 'tags', nullif(more, '')) AS keys_a, concat_ws(',', CASE WHEN doc_id % 7 > 2 AND text IS NOT NULL THEN 'n' END, 'tags', nullif(more, ''), 'schema_version') AS keys_b, tags[1:4000] AS tags_a, length(tags)::INT AS tags_b,
        CASE WHEN doc_id % 7 > 2 THEN length(text) / 2.0 END::DOUBLE AS n, CASE WHEN doc_id % 2 = 0 THEN '{"lang":"' || lang || '"}' END AS own FROM r""",
    "jsonl_round_trip": f"""WITH {V.ELEMENTS} SELECT doc_id::VARCHAR AS doc_id, i::BIGINT AS ord, doc_id || '-' || i AS element_id, element_type, text, page_number, source_sha1, 'f' || doc_id AS source_name FROM elements""",
    "extracted_elements": f"""WITH c AS (SELECT doc_id, replace(text, '. ', '.' || chr(12)) AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT *, sha1(t) AS sha, min('/in/' || doc_id || '.pdf') OVER (PARTITION BY sha1(t)) AS first FROM c),
      n AS (SELECT * FROM f WHERE first = '/in/' || doc_id || '.pdf' AND sha NOT IN (SELECT sha FROM f WHERE doc_id % 10 = 7)),
      p AS (SELECT doc_id, sha, unnest(range(len(x))) AS page, unnest(x) AS y FROM (SELECT *, string_split(t, chr(12)) AS x FROM n)),
      e AS (SELECT doc_id, sha, page, unnest(range(len(x))) AS k, unnest(x) AS z FROM (SELECT *, string_split(y, chr(10) || chr(10)) AS x FROM p)),
      s AS (SELECT doc_id, sha, page, k, {oracles._strip("z")} AS text FROM e)
      SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS ord, CASE WHEN upper(text) = text AND lower(text) <> text THEN 'Title' ELSE 'NarrativeText' END AS element_type, text, (page + 1)::INT AS page_number,
        sha AS source_sha1, doc_id || '.pdf' AS source_name, '.pdf' AS source_ext FROM s WHERE text <> ''""",
    "index_statistics": f"""{oracles.CHUNKS},
      ok AS (SELECT chunk_id, text, modality FROM both_ WHERE text <> '' AND citation <> ''),
      w AS (SELECT chunk_id, unnest({oracles._tokens("text")}) AS term FROM ok), p AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY ALL), v AS (SELECT term, count(*) AS df FROM p GROUP BY term)
      SELECT CASE WHEN regexp_matches(text, '^\\s*\\[(BẢNG|BANG)\\]') THEN 'table' WHEN modality = 'image' OR regexp_matches(text, '^\\s*\\[(HÌNH|HINH|FIGURE)\\]') THEN 'image' ELSE 'text' END AS modality, count(*) AS n_chunks, 64 AS dim, (SELECT count(*) FROM p) AS n_postings, (SELECT sum(tf) FROM p)::BIGINT AS n_tokens, (SELECT count(*) FROM v) AS n_terms,
        (SELECT max(df) FROM v) AS top_df, (SELECT count(*) FROM ok) AS n, round((SELECT avg(len({oracles._tokens("text")})) FROM ok), 6) AS avgdl FROM ok GROUP BY 1""",
    "embedding_norms": "SELECT doc_id, 64 AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
    "answers": f"""WITH {oracles.OKAPI.split("asked AS")[0]} {oracles.VERDICTS},
      asked AS (SELECT query_id, unnest({oracles._tokens("normalized_query")}) AS term FROM v WHERE status = 'ok'),
      scored AS (SELECT query_id, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) AS bm25 FROM asked JOIN fixed USING (term) JOIN post USING (term) JOIN dls USING (id), st GROUP BY query_id, id),
      hit AS (SELECT query_id, doc_id, text, source, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS k FROM scored) JOIN documents ON doc_id = id WHERE k <= 2),
      s AS (SELECT query_id, arg_min(text, k) AS best, CASE WHEN arg_min(source, k) = arg_max(source, k) THEN any_value(source) ELSE string_agg(source, '|' ORDER BY k) END AS sources FROM hit GROUP BY query_id),
      a AS (SELECT v.*, sources, coalesce(nullif({oracles._strip("string_split(best, chr(10) || chr(10))[1]")}, ''), '{answering.REFUSAL}') AS said FROM v LEFT JOIN s USING (query_id))
      SELECT query_id, CASE WHEN status <> 'ok' THEN replace(suggestions, '|', chr(10)) WHEN user_warning <> '' THEN '> ' || replace(user_warning, chr(10), chr(10) || '> ') || chr(10) || chr(10) || said ELSE said END AS answer,
        CASE WHEN status = 'ok' THEN coalesce(sources, '') ELSE '' END AS sources, user_warning AS notice, suggestions FROM a""",
}
