"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic model of its distinct features, which are its words
and their beginnings of PREFIXES bytes (offensive stems take many endings); the document's is their
noisy-or, 1 - prod(1 - s): one offending sentence is enough. Labels exist for documents alone; the gradient of the
document's likelihood shares the blame among its sentences, so that the trained model also says which ones offend.

Sentences end at . ! ? and line ends; words are runs of letters and digits, lower-cased in A-Z. The model is fitted on
at most SAMPLE labelled documents of each class, picked by hash of id until they have SAMPLE_BYTES together, each class
weighted by the root of its size; its features are those of at least LEAST_DOCS sampled documents that occur in more or fewer
documents of one class by SIGNIFICANT standard errors. Everything else reads whole texts of all rows.

Defined cases: null and empty texts have no sentence and score 0; without labels of both classes no score exceeds 1e-9;
documents with several labels count as toxic if any label says so, and of several texts of one id the first in order
teaches. Extra columns are dropped by `score`. A text is read
whole, in memory of about 60 times its bytes; smaller texts share blocks of 512 KB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.text import LOWER, block_of, hashed, in_blocks
from lexquarry.ship import ship

SAMPLE = 1000
SAMPLE_BYTES = 32 << 20
LEAST_DOCS = 5
SIGNIFICANT = 4.0
STEPS = 200
PREFIXES = (3, 4, 5)
RIDGE = 2e-5
CUT = 0.7
OFFENDING = 0.5
"""Least score of a sentence that is listed."""

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass(frozen=True)
class Model:
    words: np.ndarray
    """Sorted hashes."""
    weights: np.ndarray
    bias: float


def sentences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of features, the sentence of each, and row, first and last byte of each sentence (those with a word)."""
    n = len(buf)
    low = LOWER[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    word = _WORD[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, "right") - 1
    stop = np.concatenate([[0], np.cumsum(_STOP[buf])])[start] + row * (n + 1)
    new = np.r_[True, stop[1:] != stop[:-1]][: len(stop)]
    of = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(start)][: len(heads)] - 1
    h, at = [hashed(low, start, end, 4)], [of]
    for k in PREFIXES:
        long = np.flatnonzero(end - start > k)
        h.append(hashed(low, start[long], start[long] + k, 4) + np.uint64(k))
        at.append(of[long])
    return np.concatenate(h), np.concatenate(at), row[heads], start[heads], end[tails]


def distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)]
    return h[keep], of[keep]


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit_bags(word: np.ndarray, sentence: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray, n_words: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of words and bias by Adam on the noisy-or likelihood. word, sentence: pairs; row: of each sentence."""
    n = len(row)
    p = np.zeros(n_words + 1)
    p[-1] = -5.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, p[word], n) + p[-1], -30, 30)
        total = np.maximum(np.bincount(row, _soft(z), len(y)), 1e-9)
        pull = np.where(y == 1, -np.exp(-total) / -np.expm1(-total), 1.0) * weight
        d = pull[row] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(word, d[sentence], n_words), [d.sum()]])
        grad[:-1] += RIDGE * p[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    return p[:-1], float(p[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """labels: doc_id and 0 or 1. The driver gets the word hashes of at most `sample` documents of each class, which before the last of them have less than sample_bytes."""
    ship(docs.sparkSession)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    y = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    share = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    if len(share) < 2:
        return none
    picked = y.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionAll(y.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most 2 * sample ids are broadcast, and as many texts ordered in the windows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    upto = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("size", F.octet_length("text").cast("long")).withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).where(F.col("before") < sample_bytes)

    def bags(batches):
        for batch in in_blocks(batches):
            h, of, row, _, _ = sentences(*block_of(batch.column(1)))
            h, of = distinct(h, of)
            cut = np.searchsorted(row[of], np.arange(batch.num_rows + 1))
            base = np.searchsorted(row, np.arange(batch.num_rows))
            yield pa.record_batch({"y": batch.column(0), "words": pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), "of": pa.array([(of[a:b] - s).astype(np.int32).tobytes() for a, b, s in zip(cut[:-1], cut[1:], base, strict=True)], pa.binary())})

    got = texts.select("y", "text").mapInArrow(bags, "y int, words binary, of binary").toArrow()
    y_ = got.column("y").to_numpy()
    if len(set(y_.tolist())) < 2:
        return none
    words = [np.frombuffer(w, np.uint64) for w in got.column("words").to_pylist()]
    of = [np.frombuffer(o, np.int32).astype(np.int64) for o in got.column("of").to_pylist()]
    # the order in which rows came must not matter
    order = sorted(range(len(words)), key=lambda i: (int(y_[i]), len(words[i]), words[i].tobytes()))
    words, of, y_ = [words[i] for i in order], [of[i] for i in order], y_[order]
    size = np.array([o[-1] + 1 if len(o) else 0 for o in of])
    row = np.repeat(np.arange(len(of)), size)
    sentence = np.concatenate([o + s for o, s in zip(of, np.cumsum(size) - size, strict=True)])
    h = np.concatenate(words)
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    in_docs, of_doc = distinct(h, doc)
    names, at, n = np.unique(in_docs, return_inverse=True, return_counts=True)
    of_class = np.maximum(np.bincount(y_, minlength=2), 1)
    share1 = np.bincount(at[y_[of_doc] == 1], minlength=len(names)) / of_class[1]
    share0 = np.bincount(at[y_[of_doc] == 0], minlength=len(names)) / of_class[0]
    both = n / len(y_)
    apart = np.abs(share1 - share0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / of_class[0] + 1 / of_class[1]))
    names = names[(n >= LEAST_DOCS) & (apart >= SIGNIFICANT)]
    if not len(names):
        return none
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    known = names[at] == h
    weight = np.sqrt([share[k] for k in (0, 1)]) / of_class
    w, b = fit_bags(at[known], sentence[known], row, y_, weight[y_], len(names))
    return Model(names, w, b)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, the worst sentence with its score, first and last byte (null if none), and `offending`: all
    sentences that score OFFENDING or more, in order, as structs of begin, end and score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        m = shared.value
        for batch in in_blocks(batches):
            n = batch.num_rows
            h, of, row, begin, end = sentences(*block_of(batch.column(1)))
            z = np.full(len(row), m.bias)
            if len(m.words):
                at = np.minimum(np.searchsorted(m.words, h), len(m.words) - 1)
                known = m.words[at] == h
                at, of = distinct(at[known], of[known])
                z += np.bincount(of, m.weights[at], len(row))
            z = np.clip(z, -30, 30)
            p = -np.expm1(-np.bincount(row, _soft(z), n))
            order = np.lexsort((-z, row))
            worst = order[np.r_[True, row[order][1:] != row[order][:-1]][: len(order)]]
            s, a, b = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            none = np.ones(n, bool)
            none[row[worst]] = False
            _, off = block_of(batch.column(1))
            s[row[worst]] = 1 / (1 + np.exp(-z[worst]))
            a[row[worst]], b[row[worst]] = begin[worst] - off[row[worst]], end[worst] - off[row[worst]]
            each = 1 / (1 + np.exp(-z))
            bad = np.flatnonzero(each >= OFFENDING)
            bad = bad[np.argsort(row[bad], kind="stable")]
            listed = pa.StructArray.from_arrays([pa.array(begin[bad] - off[row[bad]], pa.int64()), pa.array(end[bad] - off[row[bad]], pa.int64()), pa.array(each[bad])], ["begin", "end", "score"])
            offending = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[bad], np.arange(n + 1)), pa.int32()), listed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(s, mask=none), pa.array(a, mask=none), pa.array(b, mask=none), offending], ["doc_id", "score", "n_sentences", "worst_score", "worst_begin", "worst_end", "offending"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rate, f"doc_id {kind}, score double, n_sentences long, worst_score double, worst_begin long, worst_end long, offending array<struct<begin:bigint,end:bigint,score:double>>")
