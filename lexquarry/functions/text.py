"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case letters with marks, as Vietnamese and the western European languages use them.
ACCENTED = {
    "a": "àáâãäåāăąảạằắẳẵặầấẩẫậ", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęěẻẽẹềếểễệ", "g": "ĝğġģ", "h": "ĥ",
    "i": "ìíîïĩīĭįỉị", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņňǹ", "o": "òóôõöōŏőơỏọồốổỗộờớởỡợ", "r": "ŕŗř",
    "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűųưủụừứửữự", "w": "ŵẁẃẅ", "y": "ýÿŷỳỷỹỵ", "z": "źżž",
}
FROM = "".join(ACCENTED.values())
TO = "".join(k * len(v) for k, v in ACCENTED.items())
# Combining marks that Unicode 14, 15 and 15.1 added, which the JVM's \p{Mn} doesn't know;
# U+1734 no longer is one.
LATER_MARKS = (
    r"\x{898}-\x{89f}\x{8ca}-\x{8d2}\x{c3c}\x{ece}\x{180f}\x{1ac1}-\x{1ace}\x{1dfa}\x{10efd}-\x{10eff}\x{10f82}-\x{10f85}\x{11070}\x{11073}-\x{11074}\x{110c2}\x{11241}"
    r"\x{11f00}-\x{11f01}\x{11f36}-\x{11f3a}\x{11f40}\x{11f42}\x{13440}\x{13447}-\x{13455}\x{1cf00}-\x{1cf2d}\x{1cf30}-\x{1cf46}\x{1e08f}\x{1e2ae}\x{1e4ec}-\x{1e4ef}"
)
MARK = rf"[\p{{Mn}}{LATER_MARKS}&&[^\x{{1734}}]]"
FORMS = {"NFD": ("decompose", False), "NFKD": ("decompose", True), "NFC": ("compose", False), "NFKC": ("compose", True)}
"""Unicode's normal forms, as the JVM's Unicode library names them, and whether compatibility forms are replaced."""

TOKEN = "[0-9A-Za-zÀ-ỹ]+"
# Fixed value: what (?U)\s matches in the JVM's patterns.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.btrim(c, F.lit(WHITE))  # a pattern would try every place of the text


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def filled(c: Column) -> Column:
    """null instead of an empty text."""
    return F.nullif(c, F.lit(""))


def normalized(c: Column, form: str) -> Column:
    """The text in a Unicode normal form, by the tables that come with Spark. Spark takes calls of Java methods for not
    deterministic, which they are here: they may not stand inside an aggregate, but in a column before it."""
    method, compatible = FORMS[form]
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(compatible))


def strip_accents(c: Column) -> Column:
    """Without combining marks, be they of their own or part of a letter; what is left in composed compatibility form."""
    # most texts hold no other letters than these, and need no tables
    common = F.translate(c, FROM, TO)
    every = normalized(F.regexp_replace(normalized(c, "NFD"), MARK, ""), "NFKC")
    return F.when(common.rlike(r"[^\x00-\x7fđß]"), every).otherwise(common)


def tokens(c: Column) -> Column:
    """Lower-cased words without accents."""
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit(TOKEN), 0)


def token_len(c: Column) -> Column:
    """The length estimate used where no vocabulary is at hand: two characters a token, one token at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 2)).cast("int")


def truncate_tokens(c: Column, n: int) -> Column:
    return F.when(token_len(c) <= n, c).otherwise(F.substring(c, 1, 2 * n))


def sentences(c: Column) -> Column:
    """Split after . ! ? … and at line ends; empties dropped."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), r"(?<=[.!?…])(?U:\s)+|\n+(?=\S)")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def strip_html(c: Column, most: int = 1200) -> Column:
    """Text between tags, collapsed, cut at `most` characters."""
    plain = collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit(" ..."))).otherwise(plain)


def distinct_in_order(a: Column) -> Column:
    """First occurrences, without nulls and empties."""
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))


def sha16(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts, joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def page_number(c: Column) -> Column:
    """An integer page from text: digits alone; anything else is null."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).cast("int"))


def truthy(c: Column) -> Column:
    """Flags that come as booleans or as text."""
    return F.coalesce(F.lower(c.cast("string")).isin("1", "true", "yes"), F.lit(False))
