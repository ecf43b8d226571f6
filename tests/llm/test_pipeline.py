import re

import pytest

import corpus_pipeline
from lexquarry.llm import decontamination, mixing, queries, sharding, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["input"] = docs.collect()
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(f(spark, docs, FOLDER), f"test-{name}")
        out[name] = docs.collect()
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]
    columns = stages["input"][0].__fields__
    assert all(stages[n][0].__fields__ == columns for n in ("language", "near_dedup", "decontamination", "mixing"))


def test_language_keeps_texts_with_letters(stages):
    assert {r.doc_id for r in stages["language"]} == {r.doc_id for r in stages["input"] if r.text and re.search(r"[^\W\d_]", r.text)}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies string, c0 string, row string, items int, size int, shard string, slot string, `a b` map<string,int>"


def odd(texts):
    return [(i, t, lang, source, None, 0.25, "x", "y", "z", 7, 8, "mine", "own", {"k": 1}) for i, t, lang, source in texts]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Null ids and texts, repeated rows, a text over the block's size, and every clashing name; rows after each stage."""
    folder = str(tmp_path_factory.mktemp("edges"))
    item = "which of these long questions would anyone ever want to find inside of a training text"
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    say = "the cat and the dog sat on the mat with all of their friends from the town "
    long = " ".join(f"word{k} and" for k in range(150_000))
    texts = [(1, say * 3, "en", "a"), (2, say * 3, "en", "a"), (None, say * 3, "en", None), (None, say * 3, "en", None), (3, None, "en", "a"), (4, "", None, "b"), (5, "12 34", "en", "b"),
             (6, long, "en", "b"), (7, long + " more", "en", "c"), (8, f"before {item} after", "en", "c"), (9, "b text here", "en", "c"), (9, "a text here", "en", "c"), (9, "a text here", "en", "c"),
             (10, "was", None, None), (11, "is", "en", None), (2**63 - 1, say + "alone", "en", "d")]
    docs, out = spark.createDataFrame(odd(texts), SCHEMA), {}
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(f(spark, docs, folder), f"edges-{name}")
        out[name] = docs.collect()
    return out


def test_edges_of_each_stage(edges):
    ids = {n: sorted((r.doc_id is None, r.doc_id) for r in rows) for n, rows in edges.items()}
    of = lambda n: [None if null else i for null, i in ids[n]]
    top = 2**63 - 1
    assert of("language") == [1, 2, 6, 7, 8, 9, 9, 9, 10, 11, top, None, None]
    assert of("near_dedup") == [1, 6, 8, 9, 10, 11, top, None, None]
    assert [r.text for r in edges["near_dedup"] if r.doc_id == 9] == ["a text here"]
    assert of("decontamination") == [1, 6, 9, 10, 11, top, None, None]
    assert set(of("mixing")) <= set(of("decontamination")) and of("sharding") == of("mixing")


def test_clashing_columns_stay_as_they_were(edges):
    for name, rows in edges.items():
        for r in rows:
            own = r.asDict()
            assert (own["score"], own["copies"], own["c0"], own["row"], own["items"], own["size"], own["a b"]) == (0.25, "x", "y", "z", 7, 8, {"k": 1})
            if name == "sharding":
                assert (r.shard_, r.slot_) == ("mine", "own") and 0 <= r.shard < 8 and r.slot >= 0
            else:
                assert (r.shard, r.slot) == ("mine", "own")


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, str(tmp_path)).collect() == []


def test_run_leaves_one_table(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(tables, "shared", lambda _: str(tmp_path))
    corpus_pipeline.run(spark, FOLDER)
    assert [n.rsplit("-", 1)[0] for n in os.listdir(tmp_path)] == ["pipeline-mixing"]


def test_near_dedup_takes_similarity_from_080(spark, stages):
    from test_neardup import brute

    want = {i for i, (_, _, kept) in brute([(r.doc_id, r.text) for r in stages["language"]], 80).items() if kept}
    assert sorted(r.doc_id for r in stages["near_dedup"]) == sorted(want)


def test_decontamination_matches_brute_force(spark, stages):
    items = [(r.item_id, decontamination.normal(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in stages["decontamination"]}
    for r in stages["near_dedup"]:
        text = decontamination.normal(r.text)
        near = any(decontamination.distance(decontamination.masks(t), len(t), text)[0] <= int(len(t) * decontamination.BUDGET) for _, t in items)
        assert (r.doc_id in kept) != near


def test_mixing_and_sharding(stages):
    sizes, n = {}, {}
    for r in stages["decontamination"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want, taken, largest = mixing.targets(sizes), {}, {}
    for r in stages["mixing"]:
        k = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        taken[r.source] = taken.get(r.source, 0) + k
        largest[r.source] = max(largest.get(r.source, 0), k)
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert max(n.values()) <= 2
    assert all(abs(taken.get(s, 0) - t) <= largest.get(s, 0) for s, t in want.items())
    per = [sorted(r.slot for r in stages["sharding"] if r.shard == s) for s in range(8)]
    assert all(p == list(range(len(p))) for p in per) and max(map(len, per)) - min(map(len, per)) <= 1
    assert sorted(r.doc_id for r in stages["sharding"]) == sorted(r.doc_id for r in stages["mixing"])
    assert sharding and queries


def test_copies_are_dealt_as_separate_rows(stages):
    at = {}
    for r in stages["sharding"]:
        at.setdefault(r.doc_id, []).append(r.shard)
    twice = [x for x in at.values() if len(x) == 2]
    n = len(twice)
    assert n > 50 and abs(sum(x == y for x, y in twice) - n / 8) < 4 * (n * 7 / 64) ** 0.5


def test_run_applies_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == len(stages["sharding"])


def test_queries_have_the_contracts_columns(spark):
    want = {
        "op1": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op2": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op3": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op4": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op5": {"doc_id", "size", "source_size", "target", "taken"}, "op6": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op7": {"doc_id", "item_id"},
        "op8": {"doc_id", "n_shingles", "component_id", "kept"}, "op9": {"doc_id", "held_out", "lang_pred", "score"}, "op10": {"doc_id", "held_out", "score", "predicted"},
        "op11": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"}, "op12": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    }
    own = {n: f for n, f in queries.QUERIES.items() if n.startswith("op")}
    assert {n.split("_")[0] for n in own} == set(want)
    for name, f in own.items():
        assert want[name.split("_")[0]] <= set(f(spark, FOLDER).columns), name
