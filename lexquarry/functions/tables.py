"""Markdown tables and modality, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.functions.text import collapse, strip, truthy

# Tags that mark tables and figures in text, and the words that ask for them.
TABLE_TAG, IMAGE_TAG = "[BẢNG]", "[HÌNH]"
TABLE_TAGS, IMAGE_TAGS = ("[BẢNG]", "[BANG]"), ("[HÌNH]", "[HINH]", "[FIGURE]")
TABLE_WORDS = r"(?iU)\b(bảng|bang|table|biểu|biểu)\b"
IMAGE_WORDS = r"(?iU)\b(hình|hinh|ảnh|anh|figure|sơ đồ|so do|biểu đồ|biểu đồ)\b"
MORE_ROWS = ("... (cắt bớt, còn ", " dòng)")
CUT_NOTE = "\n... (cắt bớt theo giới hạn ký tự)"

# Fixed value: how the line below a Markdown table's header looks.
SEPARATOR = r"(?U)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"


def left_strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+", "")


def opens_with(text: Column, tags: tuple[str, ...]) -> Column:
    t, out = left_strip(text), F.lit(False)
    for tag in tags:
        out = out | t.startswith(tag)
    return out


def modality(text: Column, has_table: Column | None = None, has_image: Column | None = None) -> Column:
    """table, image or text: flags first, then the tag that the text opens with."""
    table, image = opens_with(text, TABLE_TAGS), opens_with(text, IMAGE_TAGS)
    table = table if has_table is None else truthy(has_table) | table
    image = image if has_image is None else truthy(has_image) | image
    return F.when(table, "table").when(image, "image").otherwise("text")


def text_modality(text: Column) -> Column:
    """By the two tags that the chunker writes."""
    return F.when(opens_with(text, (TABLE_TAG,)), "table").when(opens_with(text, (IMAGE_TAG,)), "image").otherwise("text")


def query_modality(query: Column) -> Column:
    """What a question asks for; tables win, null if neither."""
    return F.when(query.rlike(TABLE_WORDS), "table").when(query.rlike(IMAGE_WORDS), "image")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")


def is_table(text: Column) -> Column:
    """A line with two bars among the first five, and a separator among the first six lines with text."""
    own = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    bars = F.exists(F.slice(own, 1, 5), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    return (F.size(own) >= 2) & bars & F.exists(F.slice(own, 1, 6), lambda x: x.rlike(SEPARATOR))


def extract_table(text: Column) -> Column:
    """The first table in a text, up to two blank lines; null if there is none."""
    t = left_strip(F.regexp_replace(left_strip(F.regexp_replace(text, "\r\n?", "\n")), r"^\[BẢNG\]", ""))
    # from the first line with a bar whose next line has dashes, to two lines without text
    rest = F.regexp_extract(t, r"(?:^|\n)([^\n]*\|[^\n]*\n[^\n]*-{3,}(?s:.*))", 1)
    block = strip(F.split(rest, r"\n[^\S\n]*\n[^\S\n]*(?=\n|\z)", 2)[0])
    return F.when(is_table(block), block)


def truncate_table(table: Column, rows: int = 30) -> Column:
    """The first rows below the separator, and a note on how many were cut."""
    own = lines(table)
    separator = F.array_min(F.filter(F.transform(F.slice(own, 1, 6), lambda x, i: F.when(x.rlike("-{3,}"), i)), lambda i: i.isNotNull()))
    left = F.size(own) - separator - 1 - rows
    cut = F.concat(F.array_join(F.slice(own, 1, separator + 1 + rows), "\n"), F.lit("\n" + MORE_ROWS[0]), left.cast("string"), F.lit(MORE_ROWS[1]))
    return F.when((F.size(own) > 2) & separator.isNotNull() & (left > 0), cut).otherwise(table)


def html_to_text(html: Column) -> Column:
    """A table without its tags: line breaks and tags become spaces."""
    own = F.coalesce(html, F.lit(""))
    return collapse(F.when(own.contains("<"), F.regexp_replace(F.regexp_replace(own, r"(?i)<\s*br\s*/?>", "\n"), r"<[^>]+>", " ")).otherwise(own))


OPENS = r"(?i)<t[hd](?=[\s>])([^>]*)>"
SPAN = r"""(?i)(?:^|\s){}\s*=\s*["']?\s*(\d+)"""
# How far a cell may reach, by the rules of HTML; 0 rows are all that follow.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


BLOCK = 256
"""Rows of a table that are folded at once."""


def spanning_cells(html: Column) -> Column:
    """Rows of cells (text, columns, rows) of an HTML table, each without its tags; tables inside cells are read as their rows."""
    after = lambda c, tag: F.slice(F.split(c, f"(?i)<{tag}(?=[\\s>])[^>]*>"), 2, 10**9)
    until = lambda c, tag: F.regexp_replace(c, f"(?is)</{tag}\\s*>.*", "")  # noqa: E731; a split would compile its pattern for every cell
    # a cell's attributes stand between two characters that no text has
    marked = lambda r: F.slice(F.split(F.regexp_replace(F.when(r.contains("\x01") | r.contains("\x02"), F.translate(r, "\x01\x02", "")).otherwise(r), OPENS, "\x01$1\x02"), "\x01"), 2, 10**9)
    said = lambda c, name: F.regexp_extract(F.substring_index(c, "\x02", 1), SPAN.format(name), 1)
    number = lambda c, name, most: F.when(F.length(said(c, name)) > 9, most).when(said(c, name) != "", F.least(said(c, name).cast("int"), F.lit(most))).otherwise(1)
    first = lambda c: F.substring_index(c, "</", 1)
    content = lambda c: F.when(c.startswith(F.concat(first(c), F.lit("</td>"))), first(c)).otherwise(until(c, "t[hd]"))  # noqa: E731; most need no pattern
    text = lambda c: once(content(F.substring_index(c, "\x02", -1)), lambda x: F.replace(plain(x), F.lit("|"), F.lit("\\|")))
    rows = lambda c: once(number(c, "rowspan", MOST_ROWS), lambda n: F.when(n == 0, MOST_ROWS).otherwise(n))
    spans = lambda c, n: F.when(c.startswith("\x02"), 1).otherwise(n)  # noqa: E731; most cells have no attributes
    cell = lambda c: F.struct(text(c).alias("text"), spans(c, F.greatest(number(c, "colspan", MOST_COLUMNS), F.lit(1))).alias("columns"), spans(c, rows(c)).alias("rows"))
    return F.transform(after(html, "tr"), lambda r: F.transform(marked(until(until(r, "tr"), "table")), cell))


def cells(html: Column, repeat: bool = False) -> Column:
    """Rows of texts of an HTML table, with every cell in the columns that it spans.

    A row's cells fill its free columns from the left; a cell over several rows keeps its columns in those below. Its text
    stands in its first place (repeat: in all). Where two cells would overlap, the one from above stays. Rows without cells of
    their own are left out.
    """
    spot = "struct<left:int,text:string>"
    none = F.lit(None).cast(spot)
    of = lambda left, text: F.struct(left.cast("int").alias("left"), text.alias("text"))

    def put(line: Column, c: Column) -> Column:
        free = F.coalesce(F.array_min(F.filter(F.transform(line, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())), F.size(line))
        placed = lambda at: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(line), at + c["columns"]) - 1),
            lambda i: F.coalesce(F.get(line, i), F.when((i >= at) & (i < at + c["columns"]), of(c["rows"], F.when((i == at) | F.lit(repeat), c["text"]).otherwise("")))),
        )
        return once(free, placed)

    def row(state: Column, r: Column) -> Column:
        # where no cell spans columns and no place is free between those held from above, the cells just follow these
        held = F.filter(state["open"], lambda x: x["left"] > 0)
        follow = lambda held: ~F.exists(r, lambda c: c["columns"] > 1) & ~F.exists(F.slice(state["open"], F.lit(1), F.size(held)), lambda x: x["left"] <= 0)
        between = F.aggregate(r, F.transform(state["open"], lambda x: F.when(x["left"] > 0, x).otherwise(none)), put)
        line = once(held, lambda held: F.when(follow(held), F.flatten(F.array(held, F.transform(r, lambda c: of(c["rows"], c["text"]))))).otherwise(between))
        last = lambda line: F.array_max(F.transform(line, lambda x, i: F.when(x.isNotNull(), i + 1)))
        width = lambda line: F.when(F.get(line, F.size(line) - 1).isNotNull(), F.size(line)).otherwise(F.coalesce(last(line), F.lit(0)))
        said = lambda line: F.transform(F.slice(line, F.lit(1), width(line)), lambda x: F.coalesce(x["text"], F.lit("")))
        below = lambda line: F.transform(line, lambda x: of(F.coalesce(x["left"] - 1, F.lit(0)), F.when(F.lit(repeat), F.coalesce(x["text"], F.lit(""))).otherwise("")))
        added = lambda line: F.when(F.size(r) > 0, F.flatten(F.array(state["out"], F.array(said(line))))).otherwise(state["out"])
        return once(line, lambda line: F.struct(added(line).alias("out"), below(line).alias("open")))

    # a fold copies its list at every step, so rows are folded in blocks, and blocks to the table
    texts, none_open = F.array().cast("array<array<string>>"), F.array().cast(f"array<{spot}>")
    blocks = lambda rows: F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK)), lambda at: F.slice(rows, at, F.lit(BLOCK)))).otherwise(F.slice(F.array(rows), 1, 0))

    def block(state: Column, rows: Column) -> Column:
        folded = F.aggregate(rows, F.struct(texts.alias("out"), state["open"].alias("open")), row)
        return once(folded, lambda f: F.struct(F.concat(state["out"], F.array(f["out"])).alias("out"), f["open"].alias("open")))

    start = F.struct(F.array().cast("array<array<array<string>>>").alias("out"), none_open.alias("open"))
    return once(spanning_cells(html), lambda rows: F.aggregate(blocks(rows), start, block, lambda s: F.flatten(s["out"])))


def plain(html: Column) -> Column:
    """Text of HTML with the five named entities and the hard space read."""
    def read(said: Column) -> Column:
        out = said
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            out = F.replace(out, F.lit(name), F.lit(char))
        return F.when(said.contains("&"), strip(out)).otherwise(said)

    return once(html_to_text(html), read)


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)  # [0] would derive the type of the whole expression anew for every row


def html_to_markdown(html: Column) -> Column:
    """A Markdown table of an HTML one, short rows filled up; the text without its tags where it holds no table."""
    even = lambda rows, width: F.transform(rows, lambda r: F.when(F.size(r) < width, F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))).otherwise(r))
    made = lambda rows: F.when(F.size(rows) > 0, once(once(F.array_max(F.transform(rows, F.size)), lambda width: even(rows, width)), grid))
    return F.coalesce(once(cells(html), made), html_to_text(html))


def grid(cells: Column) -> Column:
    """Markdown of an array of rows of cells; the first row is the header."""
    clean = lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    written = F.transform(cells, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, clean), " | "), F.lit(" |")))
    bars = lambda rows: F.length(rows[0]) - F.length(F.replace(rows[0], F.lit("|"), F.lit("")))
    rule = lambda rows: F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), bars(rows) - 1))
    lined = lambda rows: F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule(rows)), F.slice(rows, 2, F.size(rows))), "\n")
    return F.when(F.size(cells) == 0, "").otherwise(once(written, lined))
