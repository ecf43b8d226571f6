import hashlib
import re

import pytest

from lexquarry.llm import substrings


def brute(pairs, width=13):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in pairs]
    big = float("inf")
    least = {}
    for i, w in docs:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, big), big if i is None else i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (big if i is None else i):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n_groups", [1, 7])
def test_matches_brute_force(frame, corpus, n_groups):
    pairs = list(enumerate(corpus)) + [(None, corpus[20]), (None, corpus[20]), (30, corpus[31]), (7, corpus[7])]
    found = substrings.removed(frame(pairs), n_groups=n_groups)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()), key=str) == brute(pairs)


def test_other_widths(frame, corpus):
    pairs = list(enumerate(corpus))
    for width in (1, 2, 4):
        found = substrings.removed(frame(pairs), width=width, n_groups=3)
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()), key=str) == brute(pairs, width)


def reach(pairs, width=13):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in pairs]
    out, length = [0] * len(docs), width
    while True:
        where = {}
        for i, w in docs:
            for k in range(len(w) - length + 1):
                where.setdefault(tuple(w[k : k + length]), set()).add(i)
        again = [any(len(where[tuple(w[k : k + length])]) > 1 for k in range(len(w) - length + 1)) for _, w in docs]
        if not any(again):
            return sorted(((i, x) for (i, _), x in zip(docs, out, strict=True)), key=str)
        out = [length if a else x for a, x in zip(again, out, strict=True)]
        length *= 2


@pytest.mark.parametrize("n_groups", [1, 7])
def test_doubles_until_no_candidate_survives(frame, corpus, n_groups):
    pairs = list(enumerate(corpus)) + [(None, corpus[20]), (30, corpus[30]), (7, corpus[7]), (2**63 - 1, corpus[20]), (5, corpus[5] + " end")]
    want = reach(pairs)
    assert max(x for _, x in want) >= 13 * 64
    assert sorted(((r.doc_id, r.longest) for r in substrings.removed(frame(pairs), n_groups=n_groups).collect()), key=str) == want


def test_null_id_comes_after_the_largest_id(frame, corpus):
    pairs = [(2**63 - 1, corpus[5]), (None, corpus[5])]
    found = {r.doc_id: r.n_removed for r in substrings.removed(frame(pairs), n_groups=3).collect()}
    assert found == {2**63 - 1: 0, None: len(corpus[5].split())}


def test_empty_table(frame):
    assert substrings.removed(frame([])).collect() == []
