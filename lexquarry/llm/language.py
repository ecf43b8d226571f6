"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A trigram's vector binds (multiplies) its letters' vectors, each permuted
(rolled) by its place; a language's prototype bundles (adds) the vectors of all trigrams of its training texts. A
document is compared with each prototype by cosine.

Binding and bundling are linear in the trigram counts, so a document's product with a prototype is the sum, over its
trigrams, of a number that depends on trigram and prototype alone. `projection` makes that table (letters**3 x
languages) once; documents are then scored with one lookup per trigram, at any dimension. The document's own norm is
taken as sqrt(dim * sum of squared counts): bundled random vectors are orthogonal up to a relative 1/sqrt(dim), and the
norm is the same for all languages, so it never changes which one is closest.

The tables are made by Spark, a language each, and stored. A document is compared with BLOCK languages at a time, each
block a broadcast of at most BLOCK * LETTERS**3 numbers (64 MB) and one more pass over the documents in the same stage.

Defined cases: a null text or one without a letter gives `und` with score 0; null labels teach nothing; equal cosines
go to the first language by code point; with nothing learned every text is `und`. Extra columns are kept by `identify`;
one named as an added column is replaced. A text is read whole, in memory of about 45 times its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.tables import written
from lexquarry.llm.text import block_of, in_blocks
from lexquarry.ship import ship

LETTERS = 64
"""Vectors for letters: 0 is any run of other characters, 1 to 26 are a to z, further letters share the rest."""
DIM = 2048
BLOCK = 64
SHARPNESS = 25.0
UNKNOWN = "und"

_codes: np.ndarray | None = None


def _code(point: int) -> int:
    c = chr(point)
    if not c.isalpha():
        return 0
    low = ord(c.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (LETTERS - 27)


def letter_codes(points: np.ndarray) -> np.ndarray:
    global _codes
    if _codes is None:
        _codes = np.fromiter((_code(i) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)), np.uint8, 0x10000)
    out = _codes[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        values, where = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_code(int(v)) for v in values], np.uint8)[where]
    return out


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers of a block, their row, and whether each row has a letter."""
    n = len(off) - 1
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(points) != chars[-1]:  # text that isn't UTF-8: row by row
        rows = [bytes(buf[a:b]).decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        chars = np.cumsum([0, *map(len, rows)])
        points = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32)
    codes = np.zeros(len(points) + n + 1, np.uint8)
    row = np.repeat(np.arange(n), np.diff(chars))
    codes[np.arange(len(points)) + row + 1] = letter_codes(points)
    edge = np.zeros(len(codes), bool)
    edge[chars + np.arange(n + 1)] = True
    rows = np.cumsum(edge) - 1
    keep = (codes > 0) | edge
    keep[1:] |= codes[:-1] > 0
    codes, edge, rows = codes[keep], edge[keep], rows[keep]
    # a run of other characters that touches a row's edge is part of that edge
    keep = (codes > 0) | edge
    keep[1:-1] |= ~(edge[:-2] | edge[2:])
    codes, edge, rows = codes[keep].astype(np.int64), edge[keep], rows[keep]
    lettered = np.bincount(rows[codes > 0], minlength=n)[:n] > 0
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    whole = ~edge[1:-1]
    grams = codes[:-2] * LETTERS**2 + codes[1:-1] * LETTERS + codes[2:]
    return grams[whole], rows[1:-1][whole], lettered


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n: how often each trigram occurs in the texts of each language, over all rows with a label."""

    ship(docs.sparkSession)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in in_blocks(batches, "text"):
            grams, rows, _ = trigrams(*block_of(batch.column(0)))
            labels = batch.column(1).dictionary_encode()
            code = labels.indices.to_numpy(zero_copy_only=False)[rows]
            for k, name in enumerate(labels.dictionary.to_pylist()):
                total.setdefault(name, np.zeros(LETTERS**3, np.int64))
                total[name] += np.bincount(grams[code == k], minlength=LETTERS**3)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "gram": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def letter_vectors(dim: int = DIM, seed: int = 9) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (LETTERS, dim))


def prototype(n: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bundle of all trigram vectors, each as often as counted."""
    first, second, n = np.roll(letters, 2, 1), np.roll(letters, 1, 1), n.reshape(LETTERS, LETTERS, LETTERS).astype(np.float32)
    return sum(((first[a] * second) * (n[a] @ letters)).sum(0, dtype=np.float64) for a in range(LETTERS))


@dataclass(frozen=True)
class Model:
    """lang, profile: a row per language, stored; and the languages in order."""

    profiles: DataFrame
    names: list[str]


def projected(n: np.ndarray, dim: int = DIM, seed: int = 9) -> np.ndarray:
    """The product of each trigram's vector with the prototype of these counts, scaled to length 1."""
    letters = letter_vectors(dim, seed)
    first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
    p = prototype(n, letters)
    p = (p / max(np.linalg.norm(p), 1e-12)).astype(np.float32)
    return np.stack([(first[a] * second * p) @ letters.T for a in range(LETTERS)]).reshape(LETTERS**3).astype(np.float32)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, seed: int = 9) -> Model:
    """Prototypes from all labelled rows. The driver gets the languages' names."""

    def profile(table: pa.Table) -> pa.Table:
        n = np.zeros(LETTERS**3, np.int64)
        n[table.column("gram").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang").slice(0, 1), "profile": pa.array([projected(n, dim, seed).tobytes()], pa.binary())})

    profiles = written(gram_counts(docs, text, lang).groupBy("lang").applyInArrow(profile, "lang string, profile binary"), "language-profiles")
    return Model(profiles, sorted(r.lang for r in profiles.select("lang").collect()))


def cosines(buf: np.ndarray, off: np.ndarray, table: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each row with each prototype, and whether the row has a letter."""
    n = len(off) - 1
    grams, rows, lettered = trigrams(buf, off)
    dots = np.stack([np.bincount(rows, t[grams], n) for t in table], 1) if len(table) else np.zeros((n, 0))
    keys = np.sort(rows * LETTERS**3 + grams)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    often = np.diff(np.r_[new, len(keys)]).astype(np.float64)
    square = np.bincount(keys[new] // LETTERS**3, often**2, n)
    return dots / np.sqrt(dim * np.maximum(square, 1))[:, None], lettered


def identify(docs: DataFrame, model: Model, text: str = "text", dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """docs with lang_pred, score (the softmax share of the closest language) and cosine added."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    added = {"lang_pred": "string", "score": "double", "cosine": "double"}
    given = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in given])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    # until the end, score is the sum of exp(SHARPNESS * cosine) relative to the closest language so far
    found = docs.select(*given, F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cosine"))

    def against(names: list[str], shared):
        def compare(batches):
            for batch in in_blocks(batches, text):
                n = len(given)
                cos, lettered = cosines(*block_of(batch.column(given.index(text))), shared.value, dim)
                had, total, top = batch.column(n).to_pylist(), batch.column(n + 1).to_numpy(), batch.column(n + 2).to_numpy()
                best = cos.argmax(1)
                now = cos[np.arange(len(best)), best]
                new = np.array([h is None for h in had], bool) | (now > top)
                high = np.where(new, now, top)
                total = np.where([h is None for h in had], 0.0, total * np.exp(SHARPNESS * (top - high))) + np.exp(SHARPNESS * (cos - high[:, None])).sum(1)
                picked = [(names[b] if w else h) if ok else None for b, w, h, ok in zip(best, new, had, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(picked, pa.string()), pa.array(total), pa.array(high)], schema=batch.schema)

        return compare

    for k in range(0, len(model.names), block):
        names = model.names[k : k + block]
        profiles = {r.lang: bytes(r.profile) for r in model.profiles.where(F.col("lang").isin(names)).collect()}
        shared = sc.broadcast(np.stack([np.frombuffer(profiles[n], np.float32) for n in names]))
        found = found.mapInArrow(against(names, shared), schema)
    known = F.col("lang_pred").isNotNull()
    return found.select(*given, F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, 1 / F.col("score")).otherwise(0.0).alias("score"), F.when(known, F.col("cosine")).otherwise(0.0).alias("cosine"))
