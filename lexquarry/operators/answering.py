"""Guarded questions, table blocks, contexts and prompts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import guarding
from lexquarry.functions.legal import FIELDS, citation_label
from lexquarry.functions.tables import CUT_NOTE, extract_table, query_modality, truncate_table
from lexquarry.functions.text import distinct_in_order, strip
from lexquarry.ship import ship

# Prompts and refusals.
REFUSAL = "Không đủ thông tin từ nguồn đã lập chỉ mục."
SYSTEM = (
    "Bạn là trợ lý pháp lý PCCC. Trả lời bằng tiếng Việt, đầy đủ, có cấu trúc, "
    f'chỉ dùng NGỮ CẢNH cung cấp; nếu không đủ căn cứ, trả: "{REFUSAL}".\n'
    "- Chèn trích dẫn dạng [n] trỏ tới danh sách SOURCES ở cuối.\n"
    "- Với câu hỏi về HÌNH: tóm lược nội dung/caption, nêu điều/khoản/điểm và trang.\n"
)
SYSTEM_TABLE = (
    "- Với câu hỏi về BẢNG: TRƯỚC HẾT hãy in BẢNG (nguyên văn) ở định dạng Markdown (giữ nguyên tiêu đề cột), "
    "sau đó tóm lược điểm chính và nêu căn cứ (điều/khoản/điểm, trang). Nếu context chứa HTML bảng trong "
    "khối ```html```, hãy chuyển sang bảng Markdown trước khi trả lời.\n"
)
QUESTION, TABLES, CONTEXT = "CÂU HỎI: ", "BẢNG NGUYÊN VĂN (để bạn sử dụng, nếu phù hợp):\n", "NGỮ CẢNH (trích từ kho liệu):\n"
TASK = (
    "YÊU CẦU TRẢ LỜI:\n"
    "- Nếu có bảng phù hợp: in bảng Markdown trước, rồi giải thích/đối chiếu căn cứ. Nếu nhiều bảng, chọn bảng phù hợp nhất.\n"
    "- Trả lời rõ ràng, từng ý; nêu điều/khoản/điểm, trang; chèn chỉ mục [n] cho câu/ý có căn cứ.\n"
    "- Nếu văn bản mới và cũ khác nhau, hãy ưu tiên văn bản mới và nêu rõ khác biệt.\n"
    "- Nếu không đủ căn cứ: trả đúng thông điệp chuẩn."
)
TABLE_HEAD = "### BẢNG "


def guarded(queries: DataFrame, notify: bool = True) -> DataFrame:
    """queries with `guard`, the verdict on each question."""
    return queries.withColumn("guard", guarding.guard(F.col("query"), notify))


def rewritten(queries: DataFrame, rewrite) -> DataFrame:
    """Lets a rewrite (a function of the question column; null: none) replace the cleaned question where one is left."""
    new = F.coalesce(F.nullif(strip(rewrite(F.col("guard.normalized_query"))), F.lit("")), F.col("guard.normalized_query"))
    return queries.withColumn("guard", F.col("guard").withField("normalized_query", F.when(F.col("guard.status") == "ok", new).otherwise(F.col("guard.normalized_query"))))


def label(rows: DataFrame) -> Column:
    """How a hit is cited."""
    state = F.struct(*((F.col(f) if f in rows.columns else F.lit(None).cast("string")).alias(f) for f in FIELDS))
    return citation_label(F.col("van_ban"), state, F.col("page_start"), F.col("page_end"), F.col("citation"))


def with_table(rows: DataFrame, max_rows: int = 30, max_chars: int = 12_000, out: str = "block") -> DataFrame:
    """rows with each hit's table: from its text, else its HTML; null if it has none."""
    html = strip(F.coalesce(F.col("table_html_excerpt"), F.lit(""))) if "table_html_excerpt" in rows.columns else F.lit("")
    fenced = F.when((F.lower(F.col("modality")) == "table") & (html != ""), F.concat(F.lit("```html\n"), html, F.lit("\n```")))
    cut = rows.withColumn(out, F.coalesce(extract_table(F.col("text")), fenced)).withColumn(out, truncate_table(F.col(out), max_rows))
    return cut.withColumn(out, F.when(F.length(out) > max_chars, F.concat(F.substring(out, 1, max_chars), F.lit(CUT_NOTE))).otherwise(F.col(out)))


def table_blocks(ranked: DataFrame, most: int = 2, max_rows: int = 30, max_chars: int = 12_000, rank: str = "final_rank") -> DataFrame:
    """query_id, n, block, label: the first tables of each query, in rank order."""
    rows = with_table(ranked, max_rows, max_chars).where("block IS NOT NULL").select("query_id", rank, "block", label(ranked).alias("label"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(rank))).where(F.col("n") <= most).select("query_id", "n", "block", "label")


def sources(ranked: DataFrame, rank: str = "final_rank") -> DataFrame:
    """query_id, sources: labels in rank order, each once. Hits of one label are brought to its best rank first, so that a query's
    list grows with its labels alone."""
    best = ranked.select("query_id", F.col(rank).alias("r"), label(ranked).alias("l")).groupBy("query_id", "l").agg(F.min("r").alias("r"))
    named = F.array_sort(F.collect_list(F.when(F.col("l") != "", F.struct("r", "l"))))
    return best.groupBy("query_id").agg(F.transform(named, lambda x: x["l"]).alias("sources"))


def prompts(queries: DataFrame, ranked: DataFrame, rank: str = "final_rank") -> DataFrame:
    """query_id, query, is_table, system, user and sources. An excerpt carries the number of its own source."""
    rows = ranked.select("query_id", F.col(rank).alias("r"), label(ranked).alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "label", "text"))).alias("hits"))
    listed = listed.withColumn("sources", distinct_in_order(F.transform("hits", lambda h: h["label"])))
    excerpt = lambda h: F.concat(F.lit("["), F.array_position(F.col("sources"), h["label"]).cast("string"), F.lit("] SOURCE: "), h["label"], F.lit("\nEXCERPT:\n"), h["text"])
    context = F.array_join(F.transform("hits", excerpt), "\n\n")
    shown = table_blocks(ranked, rank=rank)
    shown = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "label", "block"))), lambda t: F.concat(F.lit(TABLE_HEAD), t["n"].cast("string"), F.lit(" — "), t["label"], F.lit("\n"), t["block"])), "\n\n").alias("tables"))
    table = F.coalesce(query_modality(F.col("query")) == "table", F.lit(False))
    made = queries.join(listed, "query_id").join(shown, "query_id", "left").withColumn("is_table", table)
    block = F.when(F.col("is_table") & F.col("tables").isNotNull(), F.concat(F.lit(TABLES), F.col("tables"), F.lit("\n\n"))).otherwise("")
    user = F.concat(F.lit(QUESTION), F.col("query"), F.lit("\n\n"), block, F.lit(CONTEXT), context, F.lit("\n\n" + TASK))
    return made.select("query_id", "query", "is_table", F.concat(F.lit(SYSTEM), F.when(F.col("is_table"), SYSTEM_TABLE).otherwise("")).alias("system"), user.alias("user"), "sources")


def answered(queries: DataFrame, ranked: DataFrame, generator, rank: str = "final_rank") -> DataFrame:
    """query_id, answer, sources, notice, suggestions of every question; those without hits or refused get their text.

    queries: query_id, query and guard.
    """

    ship(queries.sparkSession)

    def run(batches):
        for batch in batches:
            said = [generator.answer(s, u) for s, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["query_id", "answer"])

    asked = queries.where("guard.status = 'ok'").select("query_id", F.col("guard.normalized_query").alias("query"))
    made = prompts(asked, ranked, rank)
    kind = queries.schema["query_id"].dataType.simpleString()
    said = made.select("query_id", "system", "user").mapInArrow(run, f"query_id {kind}, answer string").join(made.select("query_id", "sources"), "query_id")
    notice = F.col("guard.user_warning")
    ok = F.col("guard.status") == "ok"
    text = F.coalesce(F.nullif(strip(F.coalesce("answer", F.lit(""))), F.lit("")), F.lit(REFUSAL))
    answer = F.when(~ok, F.array_join(F.col("guard.suggestions"), "\n")).when(notice != "", F.concat(F.lit("> "), F.replace(notice, F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), text)).otherwise(text)
    none = F.array().cast("array<string>")
    return queries.join(said, "query_id", "left").select("query_id", answer.alias("answer"), F.coalesce("sources", none).alias("sources"), notice.alias("notice"), F.col("guard.suggestions").alias("suggestions"))
