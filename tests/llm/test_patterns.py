"""Strings whose polynomial hashes modulo 2**64 meet under every base and salt: each operator tells them apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import katz, neardup, quality, substrings, suffixes, text, toxicity


def mirrored(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


A, B = mirrored(1024)
LONG_A, LONG_B = mirrored(4096)


def test_hashes_differ():
    for n in (2, 8, 16, 64, 128, 1024, 4096):
        a, b = mirrored(n)
        buf = np.frombuffer((a + b).encode(), np.uint8)
        at, end = np.array([0, n]), np.array([n, 2 * n])
        for h in (text.hashed(buf, at, end), text.hashed(buf, at, end, 7), text.Exact(buf).spans(at, end)[:, 0], text.Exact(buf).spans(at, end)[:, 1]):
            assert h[0] != h[1], n
        words = np.frombuffer(" ".join(a + b).encode(), np.uint8)
        s, e, _ = text.words_of(words, np.array([0, len(words)]))
        runs = text.runs(text.hashed(words, s, e), n)
        assert runs[0] != runs[n]


def test_katz_counts(frame):
    rows = {r.doc_id: r for r in katz.scored(frame([A, B]), F.col("doc_id") == 0, n_groups=1).collect()}
    assert rows[0].n_known == 2 and rows[1].n_known == 1


def test_quality_lines_and_windows():
    body = f"{A}\n{B}\n{A} x y {B} x y".encode()
    found = quality.measure(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    assert found["n_dup_lines"][0] == 0 and found["n_repeat_words"][0] == 0


def test_substrings_stay(frame):
    rest = " ".join(f"w{i}" for i in range(12))
    found = substrings.removed(frame([f"{A} {rest}", f"{B} {rest}"]), n_groups=2).collect()
    assert [r.n_removed for r in found] == [0, 0] and [r.longest for r in found] == [0, 0]


@pytest.mark.parametrize("n_groups", [1, 2])
@pytest.mark.parametrize("hot", [0, 20_000])
def test_suffixes_stay(frame, hot, n_groups):
    # equal anchors around what differs, so that both strings reach the comparison
    docs = ["x" * 200 + LONG_A + "y" * 200, "x" * 200 + LONG_B + "y" * 200]
    assert [r.n_removed for r in suffixes.removed(frame(docs), length=4496, anchor=100, n_groups=n_groups, hot=hot).collect()] == [0, 0]


def test_near_duplicates_stay_apart(frame):
    found = neardup.grouped(frame([" ".join([A] * 4), " ".join([B] * 4), A, B])).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in found)


def test_toxicity_features_differ():
    body = f"{A} {B}".encode()
    h, *_ = toxicity.sentences(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    assert h[0] != h[1]
