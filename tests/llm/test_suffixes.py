import hashlib
from collections import Counter

import numpy as np
import pytest

from lexquarry.llm import suffixes


def brute(pairs, length):
    docs = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(t[k : k + length] for _, t in docs for k in range(len(t) - length + 1))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [20_000, 0, 2])
@pytest.mark.parametrize("n_groups", [1, 5])
def test_matches_brute_force(frame, corpus, hot, n_groups):
    pairs = list(enumerate(corpus)) + [(None, corpus[20]), (None, corpus[20]), (100, "ab" * 300), (101, "ab" * 250 + "c"), (102, "x" * 500)]
    assert found(suffixes.removed(frame(pairs), length=60, anchor=16, n_groups=n_groups, hot=hot)) == brute(pairs, 60)


def test_production_length(frame, corpus):
    pairs = list(enumerate(corpus))
    assert found(suffixes.removed(frame(pairs), n_groups=3)) == brute(pairs, 400)


def test_empty_table(frame):
    assert suffixes.removed(frame([])).collect() == []


@pytest.mark.parametrize("length", [7, 12, 60, 400])
def test_block_sort_is_the_order_of_the_strings(length):
    rng = np.random.default_rng(length)
    parts = [rng.integers(97, 99, rng.integers(length, 4 * length)).astype(np.uint8) for _ in range(12)]
    parts += [parts[0], parts[1][1:] if len(parts[1]) > length else parts[1], np.full(3 * length, 97, np.uint8)]
    buf = np.concatenate(parts)
    stops = np.cumsum([len(p) for p in parts])
    starts = np.concatenate([np.arange(e - len(p), e - length + 1) for p, e in zip(parts, stops, strict=True)])
    rank = suffixes.sort_block(buf, np.repeat(stops, [len(p) for p in parts]), starts, length)
    strings = [buf[s : s + length].tobytes() for s in starts]
    first = {}
    for k, x in enumerate(sorted(strings)):
        first.setdefault(x, k)
    assert [first[x] for x in strings] == rank.tolist()


def test_cover_has_an_offset_for_each_pair():
    for v in (1, 2, 5, 80, 97):
        inside, offset = suffixes.cover(v)
        i = np.arange(v)
        assert inside[(i[:, None] + offset) % v].all() and inside[(i[None, :] + offset) % v].all()


def test_texts_that_repeat_themselves(frame):
    rng = np.random.default_rng(9)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    texts = ["a" * 900, "a" * 61, "a" * 60, "a" * 59, "ab" * 40, "ab" * 30 + "a", noise(50) + "xyz" * 60 + noise(70), noise(30) + "z" * 62 + "y" * 61 + "yz" * 45 + noise(10), "abcdefghijk" * 12, "abcdefghijk" * 5 + "abcdef" + noise(90)]
    texts += [noise(20) + "k" * m + noise(20) for m in (58, 60, 61, 63, 119, 120, 121)] + [("four words said again " * 30)[k : 400 + 7 * k] for k in range(5)] + ["é" * 80, "q" * 130 + "é" * 70]
    for _ in range(30):
        unit = noise(int(rng.integers(1, 40)))
        texts.append(noise(int(rng.integers(0, 40))) + (unit * 60)[: int(rng.integers(50, 200))] + noise(int(rng.integers(0, 40))))
    pairs = list(enumerate(texts))
    for n_groups in (1, 4):
        assert found(suffixes.removed(frame(pairs), length=60, anchor=16, n_groups=n_groups)) == brute(pairs, 60)
    assert found(suffixes.removed(frame(pairs), length=60, anchor=16, n_groups=3, hot=1)) == brute(pairs, 60)


def test_one_letter_takes_no_more_memory_than_other_texts():
    import time
    import tracemalloc

    from lexquarry.llm import exchange

    import pyarrow as pa
    import zstandard

    size = 4_000_000
    noise = np.random.default_rng(1).integers(97, 123, size).astype(np.uint8).tobytes()
    for text in (b"a" * size, b"ab" * (size // 2), b"four words said again " * (size // 22), noise):
        table = pa.table({"g": pa.array([0], pa.int32()), "doc_id": pa.array([1], pa.int64()), "flag": [False], "body": pa.array([zstandard.compress(text)], pa.binary())})
        exchange.flagged(table)
        suffixes.Stretches(table.slice(0, 0), 400, 100, 16)
        tracemalloc.start()
        began = time.time()
        s = suffixes.Stretches(table, 400, 100, 16)
        took = time.time() - began
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80 * size and took < 10, (text[:8], peak / size, took)
        if text is not noise:
            assert len(s.start) < 1000
