import numpy as np
import pytest
from scipy_free import chi_square_ok

from lexquarry.llm import sharding


def test_matrix_has_exact_margins():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shards = rng.integers(0, 30, rng.integers(1, 9))
        total = shards.sum()
        rows = np.bincount(rng.integers(0, 5, total), minlength=5)
        m = sharding.matrix(rows, shards, rng)
        assert (m >= 0).all() and (m.sum(1) == rows).all() and (m.sum(0) == shards).all()


def test_matrix_follows_the_hypergeometric_law():
    rng = np.random.default_rng(1)
    seen = np.bincount([sharding.matrix(np.array([6, 14]), np.array([5, 15]), rng)[0, 0] for _ in range(4000)], minlength=6)
    from math import comb

    want = np.array([comb(6, k) * comb(14, 5 - k) / comb(20, 5) for k in range(6)]) * 4000
    assert chi_square_ok(seen[:5], want[:5])


@pytest.mark.parametrize("many", [5, 10, 10**9])
def test_draws_beyond_numpys_range_follow_the_same_law(many):
    """Places drawn themselves, in parts, until few are left."""
    from math import comb

    rng = np.random.default_rng(2)
    seen = np.bincount([sharding.drawn(np.array([5, 8, 7]), 9, rng, many, 4)[0] for _ in range(4000)], minlength=6)
    want = np.array([comb(5, k) * comb(15, 9 - k) / comb(20, 9) for k in range(6)]) * 4000
    assert chi_square_ok(seen, want)


def test_margins_of_a_huge_table():
    rows, shards = np.full(30, 100_000_000), np.full(8, 375_000_000)
    m = sharding.matrix(rows[:2], shards, np.random.default_rng(1), at_once=100_000_000 // 50)
    assert (m.sum(1) == 100_000_000).all() and abs(m / 12_500_000 - 1).max() < 1e-3


def test_more_cells_than_the_driver_holds(frame, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_CELLS", 8)
    rows = sharding.shard(frame([f"text {i}" for i in range(300)]), 4, ["doc_id"], rows_per_partition=10).collect()
    assert sorted(sum(r.shard == s for r in rows) for s in range(4)) == [75] * 4


def test_query_matches_its_contract(spark):
    import zlib

    from lexquarry.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in queries.documents(spark, folder).collect()}
    rows = queries.op3_sharding(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    per = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(p == list(range(len(p))) for p in per) and max(map(len, per)) - min(map(len, per)) <= 1


@pytest.mark.parametrize(("n", "shards"), [(0, 8), (3, 8), (1000, 8), (1001, 7)])
def test_sizes_and_slots_are_exact(frame, n, shards):
    rows = sharding.shard(frame([f"text {i % 50}" for i in range(n)]), shards, ["doc_id", "text"], rows_per_partition=60).collect()
    assert len(rows) == n and {r.doc_id for r in rows} == set(range(n))
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(shards)]
    assert all(x == list(range(len(x))) for x in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_reruns_agree_and_seeds_differ(frame):
    docs = frame([f"text {i}" for i in range(300)])
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, 4, ["doc_id"], seed, 50).collect()}
    assert place(1) == place(1) != place(2)


def test_shuffle_is_uniform(frame):
    """Where a row lands doesn't depend on where it was."""
    docs = frame([f"text {i}" for i in range(400)])
    first = np.zeros(4)
    for seed in range(6):
        for r in sharding.shard(docs, 4, ["doc_id"], seed, 60).collect():
            if r.doc_id < 100:
                first[r.shard] += 1
    assert chi_square_ok(first, np.full(4, 150.0))


def test_nulls_repeats_and_clashing_columns(frame):
    docs = frame([(None, None), (None, None), (1, "a"), (1, "a"), (2, "")])
    out = sharding.shard(docs, 2)
    assert sorted(r.shard for r in out.collect()) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])
    assert "_p" in out.columns and set(docs.columns) <= set(out.columns)


def test_copies_are_dealt_apart(frame):
    """Two copies of a row share a shard about as often as any two rows, and their slots are not neighbours."""
    docs = frame([f"text {i}" for i in range(600)])
    rows = sharding.shard(docs.unionAll(docs), 8, ["doc_id", "source"], rows_per_partition=200).collect()
    at = {}
    for r in rows:
        at.setdefault(r.doc_id, []).append((r.shard, r.slot))
    assert len(rows) == 1200 and all(len(x) == 2 for x in at.values())
    both = [abs(x[1] - y[1]) for (x, y) in at.values() if x[0] == y[0]]
    assert abs(len(both) - 600 / 8) < 4 * (600 * 7 / 64) ** 0.5
    assert sum(d == 1 for d in both) <= 8


def test_a_group_of_equal_rows_is_dealt_to_all_shards(frame):
    docs = frame([(None, "same")] * 300 + [(i, f"text {i}") for i in range(300)])
    rows = sharding.shard(docs, 4, ["doc_id"], rows_per_partition=1000).collect()
    per = np.bincount([r.shard for r in rows if r.doc_id is None], minlength=4)
    assert per.sum() == 300 and chi_square_ok(per, np.full(4, 75.0))


def test_arrival_does_not_decide_where_a_value_and_a_null_go(spark):
    rows = [(None, "v" if i % 2 else None, None if i % 2 else "v") for i in range(60)]

    def placed(order):
        docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, m string, n string").repartition(1)
        return sorted((r.m or "", r.shard, r.slot) for r in sharding.shard(docs, 8).collect())

    assert placed(range(60)) == placed(range(59, -1, -1))
