import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def mixed(docs, **options):
    return mixing.mix(docs.withColumn("size", mixing.n_words("text")), **options)


def test_targets_by_hand():
    # weights 3, 1, 2, 3 over 1500 words: b would get 1/9, a is held at 2 * 100 and the rest is shared again
    sizes = {"b": 400, "a": 100, None: 200, "é": 300}
    got = mixing.targets(sizes)
    assert got["a"] == 200 and sum(got.values()) == pytest.approx(1500)
    assert got["b"] / 1 == pytest.approx(got["é"] / 2)
    assert mixing.targets({"a": 10}, share=3) == {"a": 20} and mixing.targets({}) == {}


def test_taken_words_meet_targets(frame):
    rng = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(n)) for n in rng.lognormal(3, 1, 600)]
    rows = mixed(frame(texts)).collect()
    assert len(rows) == 600
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        sizes = [words(texts[r.doc_id]) for r in own]
        assert {r.source_size for r in own} == {sum(sizes)}
        taken = sum(r.copies * s for r, s in zip(own, sizes, strict=True))
        assert abs(taken - own[0].target) <= max(1, 0.02 * own[0].target)
        assert sum(r.rate * s for r, s in zip(own, sizes, strict=True)) == pytest.approx(own[0].target, rel=1e-6)
        assert all(0 <= r.copies <= 2 for r in own)
    assert sum(t for t in {r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(map(words, texts)))


def test_rates_are_an_exponential_tilt(frame):
    rng = np.random.default_rng(4)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(1, 80, 300)]
    rows = mixed(frame(texts)).collect()
    tilted = 0
    for source in {r.source for r in rows}:
        free = [(words(texts[r.doc_id]), np.log(r.rate)) for r in rows if r.source == source and r.rate < 2]
        slope = [y / x for x, y in free]
        if slope:  # else the source is taken twice over
            assert np.ptp(slope) <= 1e-9 + 1e-6 * abs(np.mean(slope))
            tilted += 1
    assert tilted


def test_a_source_that_misses_its_target_is_an_error(spark):
    counts = spark.createDataFrame([("a", n, 10) for n in range(1, 60)], "source string, size long, n long")
    size = {"a": 10 * sum(range(1, 60))}
    lam, scale = mixing.balance(counts, {"a": 0.8 * size["a"]}, size)["a"]
    assert sum(10 * n * min(2, np.exp(lam * n / scale)) for n in range(1, 60)) == pytest.approx(0.8 * size["a"])
    with pytest.raises(RuntimeError, match="'a'"):
        mixing.balance(counts, {"a": 0.8 * size["a"]}, size, steps=2)


def test_query_matches_brute_force(spark):
    """Sizes, targets, the tilt by its own bisection, and systematic rounding of a source's taken words."""
    from lexquarry.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r for r in queries.documents(spark, folder).collect()}
    rows = queries.op5_mixing(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    own = {}
    for r in rows:
        assert r.size == words(texts[r.doc_id].text) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        own.setdefault(texts[r.doc_id].source, []).append(r)
    want = mixing.targets({s: sum(r.size for r in of) for s, of in own.items()})
    for s, of in own.items():
        sizes = np.array([r.size for r in of], float)
        low, high = -5000.0, 5000.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (sizes * np.minimum(2, np.exp(np.minimum(mid * sizes / sizes.mean(), 50)))).sum() < want[s] else (low, mid)
        rate = np.minimum(2, np.exp(np.minimum(low * sizes / sizes.mean(), 50)))
        assert all(r.target == pytest.approx(want[s]) for r in of) and {r.source_size for r in of} == {sizes.sum()}
        assert [r.rate for r in of] == pytest.approx(rate.tolist(), abs=1e-5)
        assert abs(sum(r.taken for r in of) - want[s]) <= sizes.max()
        assert all(abs(r.copies - r.rate) < 1 + 1e-6 for r in of)


def test_hot_source_of_copies_and_reruns(frame):
    docs = frame([(i, "the same five words here") for i in range(900)] + [(1000 + i, f"w{i} x y") for i in range(60)])
    docs = docs.withColumn("source", F.when(F.col("doc_id") < 900, "hot").when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise("other"))
    place = lambda: {r.doc_id: r.copies for r in mixed(docs).collect()}
    first = place()
    assert first == place()
    hot = [c for i, c in first.items() if i < 900]
    assert abs(5 * sum(hot) - 4680 * 1.5 * 0.5) <= 5 or set(hot) <= {0, 1, 2}


def test_empty_texts_and_table(frame):
    rows = mixed(frame([None, "", "a b", (None, "c d e"), (3, "x")])).collect()
    assert len(rows) == 5 and all(r.copies <= 2 for r in rows)
    assert mixed(frame([])).collect() == []


def test_arrival_does_not_decide_which_row_is_taken(spark):
    """Rows without an id, of one source and size, that differ in text or in where a value and a null stand."""
    rows = [(None, "a", f"x{i // 2} y z", "v" if i % 2 else None, None if i % 2 else "v") for i in range(60)]

    def taken(order):
        docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, source string, text string, m string, n string").repartition(1)
        return sorted((r.text, r.m or "", r.copies) for r in mixed(docs, share=0.8).collect())

    first = taken(range(60))
    assert len({c for *_, c in first}) > 1 and first == taken(range(59, -1, -1))


def test_a_text_thousands_of_times_longer_than_the_others(spark):
    sources = {"a": (43_500, 300, 300), "b": (900_000, 10, 4_000_000), "c": (22_000, 400, 500)}
    parts = [spark.range(n).select((F.col("id") + 10_000_000 * k).alias("doc_id"), F.lit(s).alias("source"), F.when(F.col("id") == 0, top).otherwise(size).cast("long").alias("size")) for k, (s, (n, size, top)) in enumerate(sources.items())]
    docs = parts[0].unionAll(parts[1]).unionAll(parts[2])
    of = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.sum("size").alias("size")).collect()}
    for s, (n, size, top) in sources.items():
        assert of[s].size == size * (n - 1) + top and of[s].most <= 2
        assert abs(of[s].taken - of[s].target) <= top
    assert of["b"].target < 900_000 * 10 - 10  # less than the short texts alone have


def test_the_pipelines_stage_takes_a_very_long_text(spark, frame):
    import corpus_pipeline

    docs = frame([" ".join(["word"] * 4_000_000), *["ten words are said here and they are quite short"] * 300, None, ""])
    got = {r.doc_id: r.n for r in corpus_pipeline.mix(spark, docs, "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(1 <= n <= 2 for n in got.values()) and {301, 302} <= set(got)
