import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import neardup


def sets(t, width=5):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(pairs, threshold=85):
    s = {i: sets(t) for i, t in pairs}
    parent = {i: i for i in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(s[a] & s[b])
            if s[a] and s[b] and 100 * n >= threshold * len(s[a] | s[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), root(i), root(i) == i) for i in ids}


def wanted(docs):
    return docs.select(F.col("doc_id").alias("id"), "doc_id", *neardup.text_key("text"))


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_matches_brute_force(frame, corpus):
    words = [f"w{i}" for i in range(400)]
    texts = list(corpus)
    for group in range(5):  # chains of edits: ends of a chain are not alike
        now = list(np.random.default_rng(group).permutation(words))[: 60 + 50 * group]
        for step in range(12):
            texts.append(" ".join(now).title() if step % 3 else " ".join(now))
            now[(17 * step + group) % len(now)] = f"edit{group}x{step}"
    texts += ["One", "two words", "Two  words", texts[70]]
    pairs = list(enumerate(texts))
    assert found(neardup.grouped(frame(pairs))) == brute(pairs)


def test_buckets_of_many_components(frame):
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(40):  # alike to the base at about 0.7, and to each other less
        now = list(base)
        for e in range(6):
            now[(31 * k + 29 * e) % 200] = f"x{k}-{e}"
        texts.append(" ".join(now))
    texts += [" ".join(base), texts[3] + " tail", "tail " + texts[9]]
    pairs = list(enumerate(texts))
    assert found(neardup.grouped(frame(pairs))) == brute(pairs)


@pytest.mark.parametrize("cell", [7, 1000])
def test_cells_link_whole_buckets(spark, frame, cell):
    """One bucket, no links known but a few: cells of any size find what brute force finds."""
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(60):
        now = list(base)
        for e in range(k % 7):
            now[(37 * k + 29 * e) % 150] = f"x{k}-{e}"
        texts.append(" ".join(now))
    docs = frame(list(enumerate(texts)))
    reps = neardup.signatures(docs).select("doc_id", F.array(F.lit(1)).cast("array<bigint>").alias("bands"), "sig")
    bands = reps.select(F.explode("bands").alias("key"), "doc_id")
    known = [(k, 0) for k in (7, 14)]
    found = spark.createDataFrame(known, "id long, component long")
    bodies = neardup.bodies_of(docs, wanted(docs))
    links = neardup.cells(bands, reps, found, bodies, cell=cell).select("a", "b").collect()
    parent = {k: k for k in range(60)} | dict(known)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    # brute force, for pairs whose signatures are near enough to be looked at
    assert {k: root(k) for k in parent} == {k: c for k, (_, c, _) in brute(list(enumerate(texts))).items()}


def test_null_ids_repeated_rows_and_empty_table(frame):
    t = "a long enough text of words that is repeated here"
    rows = neardup.grouped(frame([(1, t), (1, t), (None, t), (5, t), (2, None), (3, "")])).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str)
    assert got == sorted([(1, 6, 1, True), (1, 6, 1, True), (None, 6, None, True), (5, 6, 1, False), (2, 0, 2, True), (3, 0, 3, True)], key=str)
    assert neardup.grouped(frame([])).collect() == []


@pytest.mark.parametrize("share", [0.5, 0.85, 0.95])
def test_signatures_estimate_similarity(share):
    rng = np.random.default_rng(1)
    n, common = 400, round(400 * 2 * share / (1 + share))
    errors = []
    for _ in range(60):
        h = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        both = np.concatenate([h[:n], h[n - common :]])
        v = neardup.superminhash(both, np.repeat([0, 1], [n, n]), 2)
        assert np.isfinite(v).all()
        errors.append((v[0] == v[1]).mean() - share)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (share * (1 - share) / neardup.SIZE) ** 0.5 * 1.1


def test_one_element_fills_every_place():
    v = neardup.superminhash(np.array([7], np.uint64), np.array([0]), 1, 16)
    assert sorted(v[0].astype(int)) == list(range(16))


def test_bands_follow_the_threshold():
    assert (neardup.rows_of(85), neardup.rows_of(80)) == (6, 5)
    for t in (50, 60, 70, 80, 85, 90, 95):
        r = neardup.rows_of(t)
        assert neardup.SIZE % r == 0 and (1 - (t / 100) ** r) ** (neardup.SIZE // r) <= 1e-4


@pytest.mark.parametrize("part", [1, neardup.PART])
def test_cells_compare_pairs_whatever_their_signatures_say(spark, frame, part):
    base = [f"w{i}" for i in range(150)]
    docs = frame([(k, " ".join([*base, *(f"x{k}-{e}" for e in range(3))])) for k in range(4)] + [(4, " ".join(base[:75]))])
    # signatures that agree in no place, as of a pair whose estimate is far off
    reps = neardup.signatures(docs).select("doc_id", F.array(F.lit(1)).cast("array<bigint>").alias("bands"), F.expr(f"unhex(repeat(lpad(hex(doc_id), 2, '0'), {neardup.SIZE}))").alias("sig"))
    found = spark.createDataFrame([], "id long, component long")
    links = neardup.cells(reps.select(F.explode("bands").alias("key"), "doc_id"), reps, found, neardup.bodies_of(docs, wanted(docs)), part=part).collect()
    assert len(links) == 3 and {x for r in links for x in (r.a, r.b)} == {0, 1, 2, 3}


def links_of(texts, threshold=85, step=20):
    """Links between documents divisible by `step` and all others of a different set, by an inverted index of exact shingles."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets, index = {}, {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        for x in sets[i]:
            index.setdefault(x, []).append(i)
    out = []
    for i in (i for i in sets if i % step == 0):
        common = {}
        for x in sets[i]:
            for j in index[x]:
                common[j] = common.get(j, 0) + 1
        out += [(i, j) for j, n in common.items() if j != i and sets[i] != sets[j] and 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n)]
    return out


def test_recall_against_an_inverted_index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    links = links_of([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], step=2)
    component = {r.doc_id: r.component_id for r in neardup.grouped(docs).collect()}
    assert links and sum(component[a] == component[b] for a, b in links) == len(links)


def test_an_id_with_several_texts_links_what_each_of_them_is_near(frame):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    got = found(neardup.grouped(frame([(1, a), (1, b), (2, a + " tail"), (3, b + " tail")])))
    assert {i: c for i, (_, c, _) in got.items()} == {1: 1, 2: 1, 3: 1}


def test_ids_with_several_texts_match_brute_force(frame):
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(120):
        base = [f"g{k % 17}w{j}" for j in range(50)]
        for e in range(int(rng.integers(0, 3))):
            base[int(rng.integers(50))] = f"e{k}-{e}"
        pairs.append((int(rng.integers(0, 70)), " ".join(base)))
    pairs += [(5, None), (6, ""), (71, pairs[0][1]), (None, pairs[1][1])]
    of = {}
    for i, t in pairs:
        of.setdefault(i, []).append(sets(t))
    parent = {i: i for i in of if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in parent:
        for j in parent:
            if i < j and any(s and t and 100 * len(s & t) >= 85 * len(s | t) for s in of[i] for t in of[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    want = sorted(((i is None, i or 0, len(sets(t)), i if i is None or not sets(t) else root(i)) for i, t in pairs), key=str)
    rows = neardup.grouped(frame(pairs)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in rows), key=str) == want
