"""Tokens by byte-pair merges of a vocabulary's ranks, once per distinct piece of text.

A text is cut into pieces by PATTERN. A piece starts as its bytes; of all neighbours that together are a token, those
with the lowest rank, the leftmost first, are merged, until none are left. `token_table` does this for each distinct piece of a
table, and what is truncated is joined with it; what counts, or packs sentences inside a task, uses the same merges through `Merges`,
which remembers recent pieces. No library is called.

Defined cases: null and empty texts have no tokens of their own, and count as one like everywhere; bytes that are no token by
themselves count as one; a text is cut where whole characters end. The vocabulary is held whole, and has LARGEST tokens at most.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.ship import ship
from lexquarry.sources.vocabularies import Load, once

# Fixed value: how texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LARGEST = 1_000_000
RECENT = 1 << 16
_PIECE = regex.compile(PATTERN)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where each token ends. Pairs wait in a heap by rank and place, so that a long piece costs n log n."""
    if piece in ranks or len(piece) < 2:
        return [len(piece)] if piece else []
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the next part's start, and the one before

    def pair(at: int) -> tuple[int, int, int, int] | None:
        middle = after[at]
        if middle >= n:
            return None
        rank = ranks.get(piece[at : after[middle]])
        return None if rank is None else (rank, at, middle, after[middle])

    heap = [p for at in range(n) if (p := pair(at))]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, at, middle, end = heapq.heappop(heap)
        if gone[at] or after[at] != middle or middle >= n or after[middle] != end:
            continue  # one of the two has been merged since
        gone[middle], after[at] = 1, end
        if end < n:
            before[end] = at
        for start in (before[at], at):
            if start >= 0 and (p := pair(start)):
                heapq.heappush(heap, p)
    ends, at = [], 0
    while at < n:
        at = after[at]
        ends.append(at)
    return ends


def whole_characters(piece: bytes, ends: list[int]) -> list[int]:
    """How many characters of the piece are complete at each token's end."""
    starts = [i for i, b in enumerate(piece) if b & 0xC0 != 0x80] + [len(piece)]
    out, k = [], 0
    for end in ends:
        while k + 1 < len(starts) and starts[k + 1] <= end:
            k += 1
        out.append(k)
    return out


def ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary file's tokens: a line each, base64 and rank."""
    lines = spark.read.text(path).where("value <> ''").select(F.unbase64(F.substring_index("value", " ", 1)).alias("token"), F.substring_index("value", " ", -1).cast("int").alias("rank"))
    rows = lines.limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"{path}: over {LARGEST} tokens")
    return {bytes(r.token): r.rank for r in rows}


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){PATTERN}"), 0)


def token_table(words: DataFrame, held: Broadcast) -> DataFrame:
    """piece, ends (whole characters at the end of each of its tokens) of distinct pieces. held: the ranks, broadcast."""
    ship(words.sparkSession)

    def encode(batches):
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                raw = p.encode()
                found.append(whole_characters(raw, merged(raw, held.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["piece", "ends"])

    return words.select("piece").mapInArrow(encode, "piece string, ends array<int>")


def counted(docs: DataFrame, held: Broadcast, text: str = "text") -> DataFrame:
    """docs with n_tokens, at least 1. A worker merges a piece once as long as it remembers it; nothing is dealt anew."""
    ship(docs.sparkSession)
    counter = once(functools.partial(Merges, held))

    @functools.partial(F.arrow_udf, returnType="long")
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten().dictionary_encode()
        sizes = np.array([len(counter().of_piece(p)) for p in flat.dictionary.to_pylist()], np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes[flat.indices.to_numpy()])]) if len(flat) else np.zeros(1, np.int64)
        ends = np.cumsum(column.value_lengths().to_numpy())
        return pa.array(np.maximum(np.diff(upto[ends], prepend=0), 1))

    return docs.withColumn("n_tokens", run(pieces(F.col(text))))


def truncated(docs: DataFrame, held: Broadcast, n: int, text: str = "text") -> DataFrame:
    """docs with cut: the first n tokens of the text, whole characters alone. Null stays null."""
    rows = docs.withColumn("_text", F.sha1(F.coalesce(text, F.lit(""))))
    texts = rows.select("_text", F.col(text).alias("_t")).where("_t <> ''").dropDuplicates(["_text"])
    own = texts.select("_text", F.posexplode(pieces(F.col("_t"))).alias("at", "piece")).where(F.col("at") < n)  # a piece has a token at least
    table = token_table(own.select("piece").distinct(), held)
    before = F.sum(F.size("ends")).over(Window.partitionBy("_text").orderBy("at")) - F.size("ends")
    kept = own.join(table, "piece").withColumn("before", before).where(F.col("before") < n)
    part = F.when(F.col("before") + F.size("ends") <= n, F.col("piece")).otherwise(F.substring("piece", F.lit(1), F.get("ends", (F.lit(n) - 1 - F.col("before")).cast("int"))))
    cut = kept.select("_text", F.struct("at", part.alias("p")).alias("x")).groupBy("_text").agg(F.array_sort(F.collect_list("x")).alias("x"))  # n pieces at most
    joined = F.array_join(F.transform("x", lambda x: x["p"]), "")
    return rows.join(cut.select("_text", joined.alias("cut")), "_text", "left").withColumn("cut", F.when(F.col(text).isNotNull(), F.coalesce("cut", F.lit("")))).drop("_text")


class Merges:
    """A vocabulary for what counts and cuts inside a task; see `vocabularies.Counter`."""

    def __init__(self, held: Broadcast | dict[bytes, int]):
        own = held if isinstance(held, dict) else held.value

        @functools.lru_cache(maxsize=RECENT)
        def ends(piece: str) -> tuple[int, ...]:
            raw = piece.encode()
            return tuple(whole_characters(raw, merged(raw, own)))

        self.of_piece = ends

    def _ends(self, text: str) -> list[int]:
        """Where the tokens of a text end, in characters."""
        out, at = [], 0
        for m in _PIECE.finditer(text):
            out += [at + e for e in self.of_piece(m[0])]
            at = m.end()
        return out

    def count(self, text: str) -> int:
        return max(1, len(self._ends(text)))

    def head(self, text: str, n: int) -> str:
        ends = self._ends(text)
        # one character at least, so that a cut always gets on
        return text if len(ends) <= n else text[: max(1, ends[n - 1])]

    def tail(self, text: str, n: int) -> str:
        ends = self._ends(text)
        return text if len(ends) <= n else text[ends[-n - 1] :]


def load(spark: SparkSession, path: str) -> Load:
    """What packing and cutting take as their vocabulary: read once, by Spark, and broadcast."""
    return functools.partial(Merges, spark.sparkContext.broadcast(ranks(spark, path)))


def from_base64(lines: list[str]) -> dict[bytes, int]:
    """The ranks of a vocabulary's lines."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
