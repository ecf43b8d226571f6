"""Secrets in texts: three fixed patterns, and values after credential words that would take many guesses.

Base spans are matches of BASE. Besides, what stands after a credential word and a separator is a value, and a value is
secret by itself where guessing it takes 10 ** CUT tries or more. Guesses are counted by dynamic programming: the
cheapest way to cut the value into segments, each of one kind:

- word: 3 to LONGEST letters that are a word of the corpus, in letters of any case; its guesses are the inverse of its share of all words;
- date: a year, or day, month and year in any usual order, with or without separators;
- repeat: a unit of up to UNIT characters, said as often as it can be; its unit's guesses times how often;
- walk: 3 or more neighbours on the keyboard: where it starts, how long it is and how often it turns;
- brute: any characters, each out of its alphabet.

Costs are logarithms to base 10; each cut costs SPLIT, which kind comes next. "changeme" is two words, "qwerty" a walk, and
a random string is brute force.

1. One pass over the texts finds base spans and values, and where they stand, in code points.
2. Words of all texts are counted, values blanked out, so that a value is no evidence for itself.
3. Of each different value, once, all runs of letters are joined with the counts: there is no dictionary to hold or to cut.
4. The program runs per value, and its cost is joined to where the value stands.

Defined cases: a null text is empty; rows are rows, whatever their ids; repeated rows are found each; extra columns are not
read. A long text is held once as characters; a value of n characters costs n steps and 20 * n candidate words, made one after another.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.tables import written
from lexquarry.llm.text import LOWER, block_of, gathered, in_blocks, released, words_of
from lexquarry.ship import ship

# The base patterns, their kinds in order, and how long what they find must be.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGNED = 8

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|(?<![a-z0-9])(?:pass|pwd|pin|login|auth)|secret|token|credentials?|(?:api|access)[\x20_-]?key)s?["']?\x20*(?::=|=>|[:=]|(?<=\x20)is\x20)\x20*["'`]?([^\s"'`<>,;]+)""", re.I | re.A,
)
"""A credential word, a separator and a value; after "is", a value has more than letters."""
QUICK = ("pass", "pwd", "pin", "login", "auth", "secret", "token", "credential", "key")
TRAILING = ".:!?)]}"

CUT = 8.0
SPLIT = math.log10(4)
LONGEST, UNIT = 20, 8
# The keyboard's rows and how far each is shifted, in keys.
ROWS = (("1234567890-=", 0.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
SHIFTED = dict(zip("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./", strict=True))
PLACE = {key: (x + shift, y) for y, (row, shift) in enumerate(ROWS) for x, key in enumerate(row)}
NEXT = {a: {b: (q > p, z - y) for b, (q, z) in PLACE.items() if a != b and abs(y - z) <= 1 and abs(q - p) <= 1} for a, (p, y) in PLACE.items()}
"""Each key's neighbours, and in which direction they lie."""
DEGREE = sum(map(len, NEXT.values())) / len(NEXT)
_DAY, _MONTH = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])"
_YEAR = r"(?:19|20)\d\d"
DATES = (
    (re.compile(_YEAR), math.log10(200)),
    *((re.compile(form), math.log10(366 * 200)) for form in (f"{_YEAR}([-/._]?){_MONTH}\\1{_DAY}", f"{_DAY}([-/._]?){_MONTH}\\1{_YEAR}", f"{_MONTH}([-/._]?){_DAY}\\1{_YEAR}")),
    *((re.compile(form), math.log10(366 * 100)) for form in (f"\\d\\d([-/._]?){_MONTH}\\1{_DAY}", f"{_DAY}([-/._]?){_MONTH}\\1\\d\\d", f"{_MONTH}([-/._]?){_DAY}\\1\\d\\d")),
)
LETTERS = re.compile(r"[a-z\u0080-\U0010ffff]{3,}")
_SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[ord("a") : ord("z") + 1] = _IS_LETTER[128:] = True
SEGMENT = "array<struct<kind:string,start:int,end:int,cost:double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def values_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of what stands after credential words."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(TRAILING)
        said = text[m.start() : m.start(1)].rstrip(" \"'`")[-2:].lower() == "is"
        if value and not (said and value.isalpha()):
            out.append((m.start(1), m.start(1) + len(value), value))
    return out


def likely(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in QUICK)


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (start, kind, end) and values (start, end, value, covered: inside a base span) of every row."""
    ship(docs.sparkSession)

    def scan(batches):
        for batch in in_blocks(batches):
            base, found = [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                own = base_spans(t)
                inside = Covered(own)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
                found.append([{"start": a, "end": b, "value": v, "covered": inside(a, b)} for a, b, v in values_of(t)] if likely(t) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE), pa.array(found, _VALUES)], ["doc_id", "base", "values"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, values array<struct<start:int,end:int,value:string,covered:boolean>>")


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_VALUES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("covered", pa.bool_())]))


class Covered:
    """Whether a place is inside a base span: those of a kind don't overlap, so the last one to start decides."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.kinds = [[(x, y) for x, k, y in spans if k == kind] for kind in range(3)]

    def __call__(self, a: int, b: int) -> bool:
        last = (own[at - 1] for own in self.kinds if (at := bisect.bisect_right(own, (a, math.inf))))
        return any(b <= y for _, y in last)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: runs of letters, lower-cased in A-Z, over all texts without their values."""
    ship(docs.sparkSession)

    def blanked(t: str) -> str:
        for a, b, _ in values_of(t):
            t = t[:a] + " " * (b - a) + t[b:]
        return t

    def count(batches):
        for batch in in_blocks(batches):
            texts = pa.array([t if t is None or not likely(t) else blanked(t) for t in batch.column(0).to_pylist()], pa.large_string())
            buf, off = block_of(texts)
            low = LOWER[buf]
            start, end, _ = words_of(np.where(_IS_LETTER[low], low, 32).astype(np.uint8), off)
            fit = (end - start >= 3) & (end - start <= 4 * LONGEST)
            counts = gathered(low, start[fit], end[fit]).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.large_string()).cast(pa.string()), counts.field(1)], ["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def candidates(values: DataFrame) -> DataFrame:
    """value, word: every run of 3 to LONGEST letters of every value."""

    def cut(batches):
        for batch in batches:
            out: tuple[list, list] = [], []
            for value in batch.column(0).to_pylist():
                for w in runs_of(value):
                    out[0].append(value)
                    out[1].append(w)
                    if len(out[0]) >= 10_000 or len(out[0]) * len(value) > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["value", "word"])
                        out = [], []
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["value", "word"])

    return values.select("value").mapInArrow(cut, "value string, word string")


def runs_of(value: str):
    low = value.translate(_SMALL)
    for m in LETTERS.finditer(low):
        for a in range(m.start(), m.end() - 2):
            for b in range(a + 3, min(a + LONGEST, m.end()) + 1):
                yield low[a:b]


def alphabet(c: str) -> float:
    if c.isascii():
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 2.0


def equal_runs(same: np.ndarray) -> np.ndarray:
    """How many places from each one on are true."""
    n = len(same)
    stop = np.where(same, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n) if n else np.zeros(0, np.int64)


def cheapest(value: str, words: dict[str, float]) -> tuple[float, list[tuple[str, int, int, float]]]:
    """The least cost of a value, and its segments (kind, start, end, cost). words: cost of each word of the value's letters."""
    n, low = len(value), value.translate(_SMALL)
    of_char = [alphabet(c) for c in value]
    codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    periods = [equal_runs(codes[:-u] == codes[u:]) if n > u else np.zeros(0, np.int64) for u in range(1, UNIT + 1)]
    keys = [SHIFTED.get(c, c) for c in low]
    steps = [NEXT.get(a, {}).get(b) for a, b in zip(keys, keys[1:])]
    walked, turns = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        if steps[i] is not None:
            on = i + 1 < n - 1 and steps[i + 1] is not None
            walked[i] = walked[i + 1] + 1
            turns[i] = turns[i + 1] + (steps[i] != steps[i + 1]) if on else 1
    letters = [0] * (n + 1)
    for m in LETTERS.finditer(low):
        for i in range(m.start(), m.end()):
            letters[i] = m.end() - i

    def brute(a: int, b: int) -> float:
        return sum(of_char[a:b])

    def word(a: int, b: int) -> float | None:
        cost = words.get(low[a:b])
        return None if cost is None else cost + (math.log10(2) if value[a:b] != low[a:b] else 0.0)

    total, back = [math.inf] * (n + 1), [("", 0)] * (n + 1)
    total[0], open_, since = 0.0, math.inf, 0
    for j in range(n + 1):
        if j:
            start = total[j - 1] + (SPLIT if j > 1 else 0.0)
            if start < open_:
                open_, since = start, j - 1
            open_ += of_char[j - 1]
            if open_ < total[j]:
                total[j], back[j] = open_, ("brute", since)
        found = []
        if words:
            found += [("word", j + k, c) for k in range(3, min(LONGEST, letters[j]) + 1) if (c := word(j, j + k)) is not None]
        if j < n and value[j].isdigit():
            found += [("date", m.end(), cost) for form, cost in DATES if (m := form.match(value, j))]
        for u, run in enumerate(periods, 1):
            if j < len(run) and run[j] >= u:
                times = int(run[j]) // u + 1
                unit = brute(j, j + u)
                own = word(j, j + u)
                found.append(("repeat", j + u * times, (unit if own is None else min(unit, own)) + math.log10(times)))
        if walked[j] >= 2:
            found.append(("walk", j + walked[j] + 1, math.log10(len(NEXT)) + turns[j] * math.log10(DEGREE) + math.log10(walked[j] + 1)))
        for kind, end, cost in found:
            cost += total[j] + (SPLIT if j else 0.0)
            if cost < total[end]:
                total[end], back[end] = cost, (kind, j)
    segments, at = [], n
    while at:
        kind, start = back[at]
        segments.append((kind, start, at, total[at] - total[start]))
        at = start
    return total[n], segments[::-1]


def guesses(values: DataFrame, counts: DataFrame) -> DataFrame:
    """value, cost (log10 of its guesses) and segments of every different value. counts: word, n."""
    values = values.select("value").distinct()
    every = counts.agg(F.sum("n").alias("all"))  # one row
    known = candidates(values).distinct().join(counts, "word").join(F.broadcast(every), how="cross")
    known = known.groupBy("value").agg(F.collect_list(F.struct("word", F.log10(F.col("all") / F.col("n")).alias("cost"))).alias("words"))  # of its own letters

    def solve(batches):
        for batch in batches:
            out = [cheapest(v, {x["word"]: x["cost"] for x in w or ()}) for v, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            segments = [[{"kind": k, "start": a, "end": b, "cost": c} for k, a, b, c in s] for _, s in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in out], pa.float64()), pa.array(segments, _SEGMENTS)], ["value", "cost", "segments"])
        released()

    return values.join(known, "value", "left").mapInArrow(solve, f"value string, cost double, segments {SEGMENT}")


_SEGMENTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, base and spans (start, kind: place in KINDS, end), values (start, end, value, cost, segments) of every row."""
    seen = written(scanned(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "scanned")
    at = seen.select("row", F.explode("values").alias("x")).select("row", "x.*")
    costs = written(guesses(at, written(word_counts(docs, text), "words")), "guesses")
    priced = at.join(costs, "value").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value", "cost", "segments", "covered"))).alias("priced"))  # of one text
    rows = seen.select("row", "doc_id", "base").join(priced, "row", "left").withColumn("priced", F.coalesce("priced", F.array().cast(priced.schema["priced"].dataType)))
    more = F.transform(F.filter("priced", lambda v: (v["cost"] >= cut) & ~v["covered"]), lambda v: F.struct(v["start"].alias("start"), F.lit(KINDS.index("guess")).alias("kind"), v["end"].alias("end")))
    values = F.transform("priced", lambda v: F.struct(*(v[c].alias(c) for c in ("start", "end", "value", "cost", "segments"))))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"), values.alias("values"))


def said(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
