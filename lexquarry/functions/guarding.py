"""Query cleaning, segmentation and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.functions.tables import once
from lexquarry.functions.text import collapse, strip

# Spelling fixes in the order they apply (pattern, replacement).
FIXES = (
    (r"(?U)\s+", " "),
    (r"(?iU)\bbị?ệ?n\b", "biện"),
    (r"(?iU)\bphòng\s*cháy\s*chữa\s*cháy\b", "phòng cháy chữa cháy"),
    (r"(?iU)\bphòng\s*chấy\b", "phòng cháy"),
    (r"(?iU)\bchửa\s*cháy\b", "chữa cháy"),
    (r"(?iU)\bP\s*C\s*C\s*C\b", "PCCC"),
    (r"(?iU)\bCNCH\b", "CNCH"),
    (r"(?U)\s*,\s*", ", "),
    (r"(?U)\s*:\s*", ": "),
)
# Words that speak for and against the domain.
DOMAIN = (
    "pccc", "phòng cháy", "chữa cháy", "cnch", "cứu nạn", "cứu hộ", "nghị định", "thông tư", "quy chuẩn", "tiêu chuẩn",
    "điều", "khoản", "điểm", "phương án chữa cháy", "phương tiện chữa cháy", "phương án cứu nạn",
)
OFF_TOPIC = ("ăn chay", "nấu ăn", "thời trang", "chứng khoán", "bóng đá", "du lịch", "chu vi", "diện tích", "1 + 1", "1+1")
# Patterns of injections and hijacks.
OVERRIDE = r"(?iU)(bỏ qua|ignore|quên hết|vô hiệu hóa|disable|override).{0,40}(hướng dẫn|ràng buộc|luật|quy tắc|guard|policy)"
ROLE = r"(?iU)(đóng vai|hóa thân|pretend|act as).{0,40}(thầy|cô|giáo viên|kỹ sư|luật sư|bác sĩ|chuyên gia)"
OWNERSHIP = r"(?iU)\b(của\s*nước\s*nào|thuộc\s*nước\s*nào)\b"
SENSITIVE = r"(?iU)\b(hoàng\s*sa|trường\s*sa|paracel|spratly|biển\s*đông|đường\s*lưỡi\s*bò)\b"
# Messages to the user.
EMPTY_HINT = "Bạn muốn hỏi quy định PCCC nào? Ví dụ: 'Các biện pháp PCCC cho chung cư'"
HINTS = (
    "Vui lòng đặt câu hỏi liên quan PCCC. Ví dụ: 'Không xuất trình hồ sơ PCCC khi kiểm tra bị phạt bao nhiêu tiền?'",
    "Hoặc: 'Nêu các biện pháp PCCC cho nhà xưởng'.",
)
REMOVED_HINT = "Một số nội dung đã bị loại bỏ do ngoài phạm vi/tiềm ẩn 'prompt injection'."
OK_HINT = "Một số nội dung ngoài chủ đề đã được loại bỏ."
WARNING = "Đã loại bỏ một số nội dung ngoài phạm vi/tiềm ẩn 'prompt injection' để đảm bảo trả lời đúng chủ đề PCCC:\n"
MORE = ("\n- ... và ", " phần khác")


def fix_spelling(query: Column) -> Column:
    out = strip(F.coalesce(query, F.lit("")))
    for pattern, right in FIXES:
        out = F.regexp_replace(out, pattern, right)
    return collapse(out)


def segments(query: Column) -> Column:
    """Parts at ? and line ends and after . ! ; — trimmed, without empties."""
    parts = F.split(strip(query), r"[?\n]+|(?<=[.!;])(?U:\s)+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def domain_score(text: Column) -> Column:
    low, score = F.lower(F.coalesce(text, F.lit(""))), F.lit(0)
    for word in DOMAIN:
        score = score + low.contains(word).cast("int")
    for word in OFF_TOPIC:
        score = score - low.contains(word).cast("int")
    return score


def label(segment: Column) -> Column:
    """The first that holds: injection, sensitive_hijack, off_topic, in_domain."""
    return (
        F.when(segment.rlike(OVERRIDE) | segment.rlike(ROLE), "injection")
        .when(segment.rlike(OWNERSHIP) & segment.rlike(SENSITIVE), "sensitive_hijack")
        .when(domain_score(segment) < 1, "off_topic")
        .otherwise("in_domain")
    )


def reason(kind: Column) -> Column:
    return F.when(kind == "injection", "override_or_roleplay").when(kind == "sensitive_hijack", "national_ownership_sensitive").when(kind == "off_topic", "not_pccc").otherwise("")


def summary(removed: Column, items: int = 2, chars: int = 90) -> Column:
    """The gravest removed segments in a message; removed: array of (text, label) in order."""
    weight = lambda k: F.when(k == "sensitive_hijack", 0).when(k == "injection", 1).when(k == "off_topic", 2).otherwise(9)
    ranked = F.array_sort(F.transform(removed, lambda r, i: F.struct(weight(r["label"]).alias("w"), i.alias("i"), r["text"].alias("text"), r["label"].alias("label"))))
    text = lambda r: F.replace(strip(r["text"]), F.lit("\n"), F.lit(" "))
    short = lambda t: F.when(F.length(t) > chars, F.concat(F.regexp_replace(F.substring(t, 1, chars), r"(?U)\s+$", ""), F.lit(" ..."))).otherwise(t)
    says = F.transform(F.slice(ranked, 1, items), lambda r: F.concat(F.lit("- ("), r["label"], F.lit(") "), short(text(r))))
    more = F.when(F.size(removed) > items, F.concat(F.lit(MORE[0]), (F.size(removed) - items).cast("string"), F.lit(MORE[1]))).otherwise("")
    return F.when(F.size(removed) == 0, "").otherwise(F.concat(F.lit(WARNING), F.array_join(says, "\n"), more))


def guard(query: Column, notify: bool = True) -> Column:
    """status, normalized_query, suggestions, reason, removed_segments and user_warning of a question."""
    parts = F.transform(segments(fix_spelling(query)), lambda s: F.struct(s.alias("text"), label(s).alias("label")))
    # the segments are labelled once, however many fields of the verdict are read
    return once(parts, lambda p: judged(strip(F.coalesce(query, F.lit(""))) == "", p, notify))


def judged(empty: Column, parts: Column, notify: bool = True) -> Column:
    """The verdict from labelled segments; a rewrite of the question may replace normalized_query afterwards."""
    kept = F.array_join(F.transform(F.filter(parts, lambda p: p["label"] == "in_domain"), lambda p: p["text"]), " ")
    removed = F.filter(parts, lambda p: p["label"] != "in_domain")
    warning = summary(removed) if notify else F.lit("")
    hints = F.array(*map(F.lit, HINTS))
    off = F.when(warning != "", F.concat(F.array(F.lit(REMOVED_HINT)), hints)).otherwise(hints)
    none = F.array().cast("array<string>")
    no_parts = F.filter(parts, lambda p: F.lit(False))
    status = F.when(empty, "empty").when(kept == "", "off_topic").otherwise("ok")
    return F.struct(
        status.alias("status"),
        F.when(empty, "").otherwise(kept).alias("normalized_query"),
        F.when(empty, F.array(F.lit(EMPTY_HINT))).when(kept == "", off).when(warning != "", F.array(F.lit(OK_HINT))).otherwise(none).alias("suggestions"),
        F.when(empty, "empty").when(kept == "", "no_in_domain_after_filter").otherwise("ok").alias("reason"),
        F.when(empty, no_parts).otherwise(removed).alias("removed_segments"),
        F.when(empty, "").otherwise(warning).alias("user_warning"),
    )
