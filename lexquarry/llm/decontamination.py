"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and runs of white space become one space. An item of m characters may occur in a document with up
to k = floor(m * budget) edits. Cut into k + 1 pieces, one piece at least must then occur unchanged; an Aho-Corasick
automaton over all pieces finds those hits in one pass over the text. Each hit says where the item would begin; hits
that agree within k are one candidate, and Myers' bit-parallel edit distance decides on the text around it.

The benchmark is read in blocks of at most BLOCK characters, each one automaton sent to the executors and one pass over
the documents; documents are never shuffled. Defined cases: null and empty items match nothing; items whose budget is no
edit are found as whole words, since as parts of words they would say nothing; null and empty
documents match nothing; repeated rows each give their matches; item ids that repeat give a match each. A text is searched
whole, in memory of about 10 times its bytes.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.text import in_blocks
from lexquarry.ship import ship

BUDGET = 0.05
"""Edits per character of the item: pieces of about 20 characters."""
BLOCK = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edits(item: str, budget: float = BUDGET) -> int:
    return int(len(item) * budget)


def pieces(item: str, budget: float = BUDGET) -> list[tuple[int, str]]:
    """k + 1 pieces and where they begin."""
    n = edits(item, budget) + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern (m characters, masks peq) to any part of the text, and where that ends."""
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[object, str]], budget: float = BUDGET):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.peq: dict[int, dict[str, int]] = {}
        self.budget = budget
        found: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.texts):
            for at, piece in pieces(t, budget) if t else ():
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def find(self, text: str) -> list[tuple[object, int, int]]:
        """(item id, distance, end in the normalised text) of each item in it."""
        text = normal(text)
        out = []
        begins: dict[int, set[int]] = {}
        if self.any:
            for end, (size, where) in self.automaton.iter(text):
                for n, at in where:
                    begins.setdefault(n, set()).add(end - size + 1 - at)
        for n, starts in begins.items():
            item = self.texts[n]
            m, k = len(item), edits(item, self.budget)
            if not k:
                ends = [a + m for a in sorted(starts) if _alone(text, a, a + m)]
                out += [(self.ids[n], 0, ends[0])] if ends else []
                continue
            if n not in self.peq:
                self.peq[n] = masks(item)
            best = None
            for low, high in _together(sorted(starts), k):
                a = max(0, low - k)
                region = text[a : high + m + k]
                at = region.find(item)
                d, end = (0, at + m) if at >= 0 else distance(self.peq[n], m, region)
                if d <= k and (best is None or d < best[0]):
                    best = d, a + end
                if d == 0:
                    break
            if best:
                out.append((self.ids[n], *best))
        return out


def _alone(text: str, a: int, b: int) -> bool:
    """Whether no letter or digit goes on before or after."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def _together(starts: list[int], k: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s - out[-1][1] <= k:
            out[-1] = out[-1][0], s
        else:
            out.append((s, s))
    return out


_matchers: dict[str, Matcher] = {}
"""The last matcher made in this worker, by the name of its block."""


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    block, size = [], 0
    for i, t in benchmark.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        t = normal(t)
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """docs with `items` added: an array of (item_id, distance, end), empty where nothing matches."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    kind = T.ArrayType(T.StructType().add("item_id", benchmark.schema[item_id].dataType).add("distance", T.IntegerType()).add("end", T.LongType()))
    given = [c for c in docs.columns if c != "items"]
    docs = docs.select(*given, F.array().cast(kind).alias("items"))
    schema = T.StructType([docs.schema[c] for c in given]).add("items", kind)

    for block in _blocks(benchmark, item_id, item_text):
        sent = sc.broadcast(block)

        def look(batches, sent=sent, key=uuid.uuid4().hex):
            matcher = _matchers.get(key)
            if matcher is None:
                _matchers.clear()
                matcher = _matchers[key] = Matcher(sent.value, budget)
            arrow = None
            for batch in in_blocks(batches, text):
                arrow = arrow or batch.schema.field("items").type
                had = batch.column(len(given)).to_pylist()
                new = [h + [{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.find(t)] if t else h for h, t in zip(had, batch.column(given.index(text)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, arrow)], schema=batch.schema)

        docs = docs.mapInArrow(look, schema)
    return docs
