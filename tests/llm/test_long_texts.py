"""Texts over the block of 512 KB, beside short ones: each operator reads them whole."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import decontamination, katz, language, mixing, neardup, quality, sharding, substrings, suffixes, toxicity
from lexquarry.llm.text import in_blocks

RNG = np.random.default_rng(12)
WORDS = np.array([f"w{i}x{i * 7919 % 1000}" for i in range(50_000)])
LONG = " ".join(RNG.choice(WORDS, 180_000))
TAIL = " ".join(RNG.choice(WORDS, 500))
WITH_TAIL = LONG + " " + TAIL


@pytest.fixture(scope="module")
def docs(frame):
    assert len(LONG) > 1.5 * 2**20
    return frame(["short one", WITH_TAIL, None, TAIL, LONG.replace("w1x", "w2x")]).persist()


def test_blocks(docs):
    sizes = [b.num_rows for b in in_blocks(docs.orderBy("doc_id").select("doc_id", "text").toArrow().to_batches())]
    assert sum(sizes) == 5 and max(sizes) < 5


def test_quality(docs):
    rows = {r.doc_id: r for r in quality.ledger(docs).collect()}
    assert rows[1].n_words == 180_500 and rows[1].word_chars == len(WITH_TAIL.replace(" ", "")) and rows[3].n_words == 500


def test_katz(docs):
    rows = {r.doc_id: r for r in katz.scored(docs, F.col("doc_id") == 1).collect()}
    assert rows[1].n_tokens == 180_501 == rows[1].train_tokens and rows[3].n_known == 501 and rows[0].n_known == 1


def test_substrings(docs):
    rows = {r.doc_id: r for r in substrings.removed(docs, n_groups=3).collect()}
    assert (rows[3].n_removed, rows[3].longest) == (500, 13 * 32) and rows[1].n_removed == 0
    # windows of the last text that hold none of the changed words
    words, other = LONG.split(), LONG.replace("w1x", "w2x").split()
    same = np.array([a == b for a, b in zip(words, other, strict=True)])
    whole = np.convolve(same, np.ones(13, int), "valid") == 13
    gone = np.zeros(len(words), bool)
    for k in range(13):
        gone[k : k + len(whole)] |= whole
    assert rows[4].n_removed == gone.sum() > 100_000


def test_suffixes(docs):
    rows = {r.doc_id: r for r in suffixes.removed(docs.where("doc_id < 4"), n_groups=3).collect()}
    assert rows[3].n_removed == len(TAIL) and rows[1].n_removed >= len(TAIL) and rows[1].n_bytes == len(WITH_TAIL)
    assert rows[1].kept_sha256 in {hashlib.sha256(WITH_TAIL[: -len(TAIL) - k].encode()).hexdigest() for k in (0, 1)}


def test_decontamination(docs, spark):
    item = spark.createDataFrame([(1, TAIL[200:320])], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matched(docs, item).where("size(items) > 0").collect()} == {1, 3}


def test_near_duplicates(docs):
    rows = {r.doc_id: r for r in neardup.grouped(docs).collect()}
    words, other = WITH_TAIL.split(), LONG.replace("w1x", "w2x").split()
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other)]
    assert rows[1].n_shingles == len(sets[0])
    assert (rows[4].component_id == 1) == (100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1]))


def test_language_and_toxicity(docs, spark):
    model = language.fit(docs)
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()} == {0: "en", 1: "en", 2: "und", 3: "en", 4: "en"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert rows[1].n_sentences == 1 and 0 <= rows[1].score <= 1


def test_mixing_and_sharding(docs):
    rows = {r.doc_id: r for r in mixing.mix(docs.withColumn("size", mixing.n_words("text"))).collect()}
    assert {i: r.size for i, r in rows.items()} == {i: len(re.findall(r"\S+", t or "")) for i, t in enumerate(["short one", WITH_TAIL, None, TAIL, LONG])}
    assert sorted(r.slot for r in sharding.shard(docs, 1).collect()) == list(range(5))
