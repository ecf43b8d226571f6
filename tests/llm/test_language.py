import numpy as np
import pyarrow as pa
import pytest

from lexquarry.llm import language as L
from lexquarry.llm.text import block_of

TEXTS = [None, "", "123 !", "Hello, world", "a", "ÀÉ ñ", "über Straße", "x" * 50, "日本 語", "  lead and trail  ", "A\x00B"]


def encoded(text, letters):
    """A document's bundle, letter by letter."""
    codes = [0]
    for c in text or "":
        k = int(L.letter_codes(np.array([ord(c)], np.uint32))[0])
        if k or codes[-1]:
            codes.append(k)
    if codes[-1]:
        codes.append(0)
    out = np.zeros(letters.shape[1])
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_projection_equals_explicit_vectors():
    dim = 256
    letters = L.letter_vectors(dim)
    train = {"x": "the cat and the dog sat on the mat", "y": "der hund und die katze auf der matte"}
    counts = {}
    for name, t in train.items():
        grams, _, _ = L.trigrams(*block_of(pa.array([t])))
        counts[name] = np.bincount(grams, minlength=L.LETTERS**3)
        assert L.prototype(counts[name], letters) == pytest.approx(encoded(t, letters))
    names = sorted(counts)
    table = np.stack([L.projected(counts[n], dim) for n in names])
    cos, lettered = L.cosines(*block_of(pa.array(TEXTS)), table, dim)
    grams, rows, _ = L.trigrams(*block_of(pa.array(TEXTS)))
    for k, t in enumerate(TEXTS):
        v = encoded(t, letters)
        norm = np.sqrt(dim * max(1, (np.unique(grams[rows == k], return_counts=True)[1] ** 2.0).sum()))
        for j, name in enumerate(names):
            p = encoded(train[name], letters)
            assert cos[k, j] == pytest.approx(v @ p / np.linalg.norm(p) / norm, abs=1e-4)
    assert lettered.tolist() == [False, False, False, True, True, True, True, True, True, True, True]


def test_norm_is_near_the_exact_one():
    letters = L.letter_vectors(L.DIM)
    t = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest"
    grams, _, _ = L.trigrams(*block_of(pa.array([t])))
    near = np.sqrt(L.DIM * (np.unique(grams, return_counts=True)[1] ** 2.0).sum())
    assert near == pytest.approx(np.linalg.norm(encoded(t, letters)), rel=0.1)


def test_learns_and_predicts(spark, frame):
    say = {"en": "the cat sat on the mat and the dog was with them", "fr": "le chat est sur la table et le chien dort bien", "de": "der hund liegt auf der matte und die katze schläft"}
    docs = spark.createDataFrame([(i, say[k], k) for i, k in enumerate(say)] + [(9, "no label here", None)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.names == ["de", "en", "fr"]
    asked = frame(["the dog and the cat", "le chien et la table", "die katze und der hund", None, "", "42", (None, "the mat")])
    got = {(r.doc_id, r.text): r for r in L.identify(asked, model).collect()}
    assert [got[i, t].lang_pred for i, t in ((0, "the dog and the cat"), (1, "le chien et la table"), (2, "die katze und der hund"), (None, "the mat"))] == ["en", "fr", "de", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and {got[i, t].lang_pred for i, t in ((3, None), (4, ""), (5, "42"))} == {"und"}
    assert got[3, None].score == 0
    for block in (1, 2):
        again = {(r.doc_id, r.text): r for r in L.identify(asked, model, block=block).collect()}
        for k, r in again.items():
            assert r.lang_pred == got[k].lang_pred and r.score == pytest.approx(got[k].score) and r.cosine == pytest.approx(got[k].cosine)


def test_predictions_match_explicit_vectors(spark, frame):
    """Documents compared with prototypes letter by letter, with exact norms: the same language wins."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").select("doc_id", "text", "lang")
    rows = docs.collect()
    letters = L.letter_vectors()
    learn = [r for r in rows if r.doc_id % 2 and r.lang is not None and r.text]
    prototypes = {k: sum(encoded(r.text, letters) for r in learn if r.lang == k) for k in sorted({r.lang for r in learn})}
    found = {r.doc_id: r for r in L.identify(docs, L.fit(docs.where("doc_id % 2 = 1"))).collect()}
    right = asked = 0
    for r in rows:
        if r.text and any(c.isalpha() for c in r.text):
            v = encoded(r.text, letters)
            cos = {k: float(v @ p / np.linalg.norm(p) / max(np.linalg.norm(v), 1e-9)) for k, p in prototypes.items()}
            first, second = sorted(cos.values())[-1:-3:-1]
            assert first - second < 1e-3 or found[r.doc_id].lang_pred == max(cos, key=cos.get)
            if r.doc_id % 2 == 0 and r.lang:
                asked, right = asked + 1, right + (found[r.doc_id].lang_pred == r.lang)
        else:
            assert found[r.doc_id].lang_pred == "und"
    assert asked > 20 and right / asked > 0.9


def test_nothing_learned_and_empty_table(frame):
    model = L.fit(frame([]))
    assert model.names == [] and [r.lang_pred for r in L.identify(frame(["text"]), model).collect()] == ["und"]
    assert L.identify(frame([]), model).collect() == []
