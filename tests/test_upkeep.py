"""What a store and an index write and hold after changes, and approximate neighbours."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.operators import cells, dense, lexical
from lexquarry.plans import indexes, pipeline
from lexquarry.sources import providers
from lexquarry.sources import store as stores
from lexquarry.sources.store import Store

TWO = "id long, v string"


def held(store):
    return {tuple(r) for r in store.read().collect()}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    first, second = (Store(spark, str(tmp_path / "t")) for _ in range(2))
    first.write(spark.createDataFrame([(1, "a"), (2, "a")], TWO))
    write = first._write

    def slowly(rows, kind, number, partition_by):  # while it writes, another one upserts and ends
        second.upsert(spark.createDataFrame([(2, "second"), (4, "second")], TWO))
        write(rows, kind, number, partition_by)

    first._write = slowly
    first.upsert(spark.createDataFrame([(3, "first")], TWO))
    assert held(first) == {(1, "a"), (2, "second"), (3, "first"), (4, "second")}


def test_a_slow_writer_is_not_lost_by_a_whole_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST", 2)
    slow, quick = (Store(spark, str(tmp_path / "t")) for _ in range(2))
    slow.write(spark.createDataFrame([(0, "a")], TWO))
    write = slow._write

    def late(rows, kind, number, partition_by):
        slow._write = write
        for k in range(1, 6):
            quick.upsert(spark.createDataFrame([(k, "quick")], TWO))
        assert not any(kind == "version" for n, kind in quick._parts() if n > 1)  # a writer is at work
        write(rows, kind, number, partition_by)

    slow._write = late
    slow.upsert(spark.createDataFrame([(9, "slow")], TWO))
    quick.upsert(spark.createDataFrame([(6, "quick")], TWO))
    assert any(kind == "version" for n, kind in quick._parts() if n > 1)
    assert held(slow) == {(0, "a"), (9, "slow"), *((k, "quick") for k in range(1, 7))}
    # a claim so old that its writer must have ended doesn't keep the table from being written whole; its rows come back if it does commit
    monkeypatch.setattr(stores, "STALE", 0)

    def later(rows, kind, number, partition_by):
        slow._write = write
        for k in range(3):
            quick.upsert(spark.createDataFrame([(20 + k, "quick")], TWO))
        write(rows, kind, number, partition_by)

    slow._write = later
    slow.upsert(spark.createDataFrame([(10, "slow")], TWO))
    assert (10, "slow") in held(quick) and len(held(quick)) == 12


def test_a_store_equals_its_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST", 3)
    rng, store, want = random.Random(8), Store(spark, str(tmp_path / "t")), {}
    for step in range(12):
        rows = {rng.randint(0, 30): f"{step}-{rng.randint(0, 9)}" for _ in range(rng.randint(1, 6))}
        if step and step % 4 == 0:
            gone = rng.sample(sorted(want), 2)
            store.remove(spark.createDataFrame([(g,) for g in gone], "id long"))
            want = {k: v for k, v in want.items() if k not in gone}
        store.upsert(spark.createDataFrame(sorted(rows.items()), TWO), partition_by=["v"])
        want |= rows
        assert held(store) == set(want.items())
    kinds = [k for _, k in store._parts()]
    assert kinds.count("version") <= 3 and "v=" in "".join(store.read().inputFiles())  # old versions go; partitions stay


CHUNK = "chunk_id string, text string, source_sha1 string, doc_id string, section int, seq int, citation string"


def chunk_rows(spark, texts):
    return spark.createDataFrame([(i, t, "s", "d", 0, k, "cite") for k, (i, t) in enumerate(sorted(texts.items()))], CHUNK)


def contents(at):
    return (
        {(r.id, r.text) for r in at.chunks.collect()}, {r.id for r in at.vectors.collect()}, {(r.term, r.id, r.tf, r.dl) for r in at.postings.collect()},
        {(r.term, r.df, round(r.raw, 9)) for r in at.terms.collect()}, [(r.n, round(r.avgdl, 9)) for r in at.statistics.collect()],
    )


def test_an_index_kept_up_equals_one_built_anew(spark, tmp_path):
    rng, texts = random.Random(3), {}
    at = str(tmp_path / "kept")
    say = lambda: " ".join(rng.choice("một hai ba bốn năm sáu bảy tám chín mười".split()) for _ in range(rng.randint(1, 7)))
    for step in range(4):
        batch = {f"c{rng.randint(0, 40)}": say() for _ in range(15)} | ({"c0": "..."} if step == 2 else {"c0": say()})  # c0 has no tokens for a while
        texts |= batch
        now = pipeline.index(chunk_rows(spark, batch), at)
        if step == 1:
            gone = sorted(texts)[:4]
            texts = {i: t for i, t in texts.items() if i not in gone}
            now = pipeline.remove(spark, at, spark.createDataFrame([(g,) for g in gone], "id string"))
        assert contents(now) == contents(pipeline.index(chunk_rows(spark, texts), str(tmp_path / f"anew{step}")))


def test_a_first_build_writes_each_table_once_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(stores._local, spark.sparkContext.applicationId, str(tmp_path / "scratch"))
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    shuffled = lambda: {p for p in local.rglob("shuffle_*.data")}
    before = shuffled()
    at = pipeline.index(chunk_rows(spark, {f"c{k}": f"w{k} w{k % 7} w{k % 11}" for k in range(500)}), str(tmp_path / "i"))
    assert shuffled() <= before
    assert not list((tmp_path / "scratch").rglob("*.parquet")) and at.chunks.count() == 500
    assert all(len(list((tmp_path / "i" / name).glob("version=*"))) == 1 for name in pipeline.TABLES)


def test_a_first_build_that_failed_is_done_again_whole(spark, tmp_path):
    class Failing(providers.HashEmbedder):
        def embed(self, texts):
            raise RuntimeError("down")

    texts = {"a": "phòng cháy", "b": "chữa cháy nhà", "c": "cháy rừng lớn"}
    with pytest.raises(Exception, match="down"):
        pipeline.index(chunk_rows(spark, texts), str(tmp_path / "i"), Failing())
    texts.pop("c")
    now = pipeline.index(chunk_rows(spark, texts), str(tmp_path / "i"))
    assert contents(now) == contents(pipeline.index(chunk_rows(spark, texts), str(tmp_path / "anew")))
    texts |= {"b": "nhà cao tầng", "d": "cửa sổ"}
    now = pipeline.index(chunk_rows(spark, texts), str(tmp_path / "i"))
    assert contents(now) == contents(pipeline.index(chunk_rows(spark, texts), str(tmp_path / "anew2")))


def test_what_an_index_writes_grows_with_what_is_new(spark, tmp_path):
    rng, at = random.Random(5), tmp_path / "i"
    texts = {f"c{k}": " ".join(f"w{rng.randint(0, 3000)}" for _ in range(60)) for k in range(2000)}
    pipeline.index(chunk_rows(spark, texts), str(at))
    size = lambda: {p: p.stat().st_size for p in at.rglob("*.parquet")}
    before = size()
    pipeline.index(chunk_rows(spark, {f"n{k}": f"new{k} w{k} w7 w8" for k in range(20)} | {k: texts[k] for k in ("c1", "c2")}), str(at))
    after = size()
    assert set(before) <= set(after)  # nothing is rewritten
    assert sum(after.values()) - sum(before.values()) < 0.08 * sum(before.values())  # some kB a file are its footer


def normal(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim)) * 3
    return [(i, [float(x) for x in centers[rng.integers(groups)] + rng.normal(size=dim)]) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(normal(3000, 16, 30, 1), "id long, embedding array<float>").cache()


def test_every_vector_is_in_a_cell_and_all_cells_are_exact_search(spark, vectors, tmp_path):
    at = cells.build(vectors, str(tmp_path / "v"))
    assert at.vectors.select("id").distinct().count() == at.vectors.count() == 3000
    asked = vectors.where("id % 20 = 0").selectExpr("id AS query_id", "embedding AS vector")
    rows = lambda df: sorted((r.query_id, r.id, r.rn, round(r.distance, 6)) for r in df.collect())
    exact = rows(dense.nearest(asked, vectors, 20, 16))
    assert rows(cells.search(asked, at, 20, len(at.centers))) == exact
    again = cells.opened(spark, str(tmp_path / "v"))
    found = rows(cells.search(asked, again, 20))
    assert again.probes == at.probes < len(at.centers) and found == rows(cells.search(asked, at, 20))
    assert len({r[:2] for r in found} & {r[:2] for r in exact}) >= 0.9 * len(exact)


def test_a_search_reads_its_cells_alone(spark, vectors, tmp_path):
    at = cells.build(vectors, str(tmp_path / "v"), cells=40)
    one = vectors.where("id = 40").selectExpr("id AS query_id", "embedding AS vector")
    plan = cells.search(one, at, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    row = indexes.ivf_report(spark, f"/root/testdata/sf{sf}").first()
    assert row.good and row.n_indexed == row.n_vectors


def test_recall_is_not_measured_by_what_the_centers_started_from(spark):
    given = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(np.random.default_rng(5).normal(size=(4000, 8)))], "id long, embedding array<float>")
    centers = cells.fitted(given, cells=200, steps=0)
    held = cells.placed(given, centers).cache()
    at = cells.Cells(centers, held, cells.enough(held, centers, 3, 0.97))
    asked = given.where("id % 20 = 0").selectExpr("id AS query_id", "embedding AS vector")
    rows = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = rows(dense.nearest(asked, given, 3, 8))
    assert len(rows(cells.search(asked, at, 3)) & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("n, nulls", [(45, (3, 20)), (15, (0,)), (0, ())])
def test_report_counts_no_null_vectors(spark, tmp_path, n, nulls):
    rows = [(i, None if i in nulls else [float(i), 1.0]) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = indexes.ivf_report(spark, str(tmp_path)).first()
    held, asked = n - len(nulls), len([i for i in range(0, n, 20) if i not in nulls])
    assert (row.n_vectors, row.n_indexed, row.n_queries, row.good) == (held, held, asked, True)


def test_equal_null_few_and_no_vectors(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(900, None)], "id long, embedding array<float>")
    at = cells.build(same, str(tmp_path / "same"))
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id long, vector array<float>")
    assert [(r.query_id, r.id, r.rn) for r in cells.search(asked, at, 3).orderBy("rn").collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    few = cells.build(same.limit(2), str(tmp_path / "few"))
    assert cells.search(asked, few, 3).count() == 2
    none = cells.build(same.where("id < 0"), str(tmp_path / "none"))
    assert none.vectors.count() == 0 and cells.search(asked, none, 3).count() == 0


def test_retrieval_may_search_cells(spark, tmp_path):
    rng = random.Random(4)
    texts = {f"c{k}": " ".join(rng.choice("phòng cháy chữa nhà tầng cao rừng kho xe điện nước cầu thang cửa sổ".split()) for _ in range(12)) for k in range(80)}
    at = pipeline.index(chunk_rows(spark, texts), str(tmp_path / "i"))
    near = cells.build(at.vectors, str(tmp_path / "cells"))
    asked = spark.createDataFrame([(1, "phòng cháy nhà cao tầng"), (2, "cửa sổ kho")], "query_id long, query string")
    vectors = providers.embedded(asked, providers.HashEmbedder(), "query_id", "query").withColumnRenamed("embedding", "vector")
    pool = lambda near: {(r.query_id, r.id, r["rank"]) for r in pipeline.retrieve(asked, vectors, at, pipeline.Settings(), near).collect()}
    every = cells.Cells(near.centers, near.vectors, len(near.centers))
    assert pool(every) == pool(None)
    assert len({x[:2] for x in pool(near)} & {x[:2] for x in pool(None)}) > 0.8 * len(pool(None))


def test_bm25_reads_a_kept_up_index(spark, tmp_path):
    at = pipeline.index(chunk_rows(spark, {"a": "phòng cháy", "b": "chữa cháy nhà"}), str(tmp_path / "i"))
    at = pipeline.index(chunk_rows(spark, {"b": "nhà cao tầng", "c": "cháy rừng lớn"}), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "cháy nhà")], "query_id long, query string")
    got = {r.id: r.bm25 for r in lexical.okapi(at.postings, at.statistics, asked, terms=at.terms).collect()}
    docs = spark.createDataFrame([("a", "phòng cháy"), ("b", "nhà cao tầng"), ("c", "cháy rừng lớn")], "id string, text string")
    assert got == pytest.approx({r.id: r.bm25 for r in lexical.okapi(lexical.postings(docs), lexical.statistics(docs), asked).collect()})
    assert Path(tmp_path / "i" / "chunks").exists() and F.lit(1) is not None
