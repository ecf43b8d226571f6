"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to logical partitions by a hash. From the partitions' row counts and the shards' sizes the driver draws
how many rows each partition sends to each shard: the law of a uniform random permutation, cut into shards. Each
partition orders its rows by a keyed hash and cuts that order as the matrix says; after the exchange each shard orders
what it got by a second keyed hash. No task holds a whole shard: slots are counted per (shard, range of the second
hash) and offset by prefix sums over those counts.

All draws depend on rows and seed alone, so lost tasks are recomputed alike. Defined cases: an empty table gives an
empty result; null ids and texts are hashed like other values; rows equal in all of `keys` share a logical partition, but
each has draws of its own by its number among them, so copies are dealt as any two rows are. They may change places with
each other; if they differ outside `keys`, reruns may show it. Columns named as the added ones are replaced. A shard may be empty. Rows travel twice
and whole, so a very long text costs its own size in two exchanges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.tables import orderable, row_hash

ROWS_PER_PARTITION = 100_000
MAX_CELLS = 2_000_000
"""Of the communication matrix, which the driver holds; beyond, partitions hold more rows instead."""
MANY = 10**9
"""numpy's samplers take populations under this number."""
DRAWN = 1_000_000


def drawn(left: np.ndarray, n: int, rng: np.random.Generator, many: int = MANY, at_once: int = DRAWN) -> np.ndarray:
    """How many of n rows go to each shard, given the places left in each: exact at any size.

    Beyond `many` places, distinct places themselves are drawn, `at_once` at a time, and counted by shard.
    """
    left, out = left.copy(), np.zeros(len(left), np.int64)
    while n:
        if left.sum() < many:
            return out + rng.multivariate_hypergeometric(left, n, method="marginals")
        k = min(n, at_once)
        places = rng.choice(int(left.sum()), k, replace=False, shuffle=False)
        take = np.bincount(np.searchsorted(np.cumsum(left), places, "right"), minlength=len(left))
        out, left, n = out + take, left - take, n - k
    return out


def matrix(rows: np.ndarray, shards: np.ndarray, rng: np.random.Generator, many: int = MANY, at_once: int = DRAWN) -> np.ndarray:
    """How many of each partition's rows go to each shard. Row sums and column sums are exact."""
    left, out = shards.astype(np.int64).copy(), np.zeros((len(rows), len(shards)), np.int64)
    for p, n in enumerate(rows):
        out[p] = drawn(left, int(n), rng, many, at_once)
        left -= out[p]
    return out


def shard(docs: DataFrame, n_shards: int = 8, keys: list[str] | None = None, seed: int = 3, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """docs with `shard` (sizes at most one row apart) and `slot` (gapless from 0 in each shard).

    keys: the columns whose hash orders rows; all of them tell rows apart, and by default all but maps are used.
    """
    spark = docs.sparkSession
    given = [c for c in docs.columns if c not in ("shard", "slot")]
    keys = keys or [c for c in given if orderable(docs.schema[c].dataType)]
    of_row = lambda k: row_hash(f"{seed}:{k}", *keys)
    n = docs.count()
    parts = max(1, -(-n // rows_per_partition), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)))
    parts = min(parts, max(1, MAX_CELLS // n_shards))
    # the rows travel as one column, so that no name of theirs can clash
    base = docs.select(F.struct(*given).alias("row"), F.pmod(of_row("part"), F.lit(parts)).cast("int").alias("_p"), of_row("first").alias("_a"), of_row("second").alias("_b"), of_row("tie").alias("_t"))

    counts = np.zeros(parts, np.int64)
    for p, c in base.groupBy("_p").count().collect():
        counts[p] = c
    sizes = np.array([n // n_shards + (s < n % n_shards) for s in range(n_shards)])
    sent = matrix(counts, sizes, np.random.default_rng(seed))
    upto = np.cumsum(sent, 1)
    plan = spark.createDataFrame([(p, [int(x) for x in upto[p]]) for p in range(parts)], "_p int, _upto array<bigint>")
    cut = F.broadcast(plan) if parts * n_shards <= 1_000_000 else plan

    # a second hash in place of the columns, which would travel twice
    order = Window.partitionBy("_p").orderBy("_a", "_t")
    # equal rows are next to each other here; all but the first of them draw again. One exchange serves both orders
    copy = F.row_number().over(order) - F.rank().over(Window.partitionBy("_p").orderBy("_a"))
    again = lambda k: F.when(F.col("_c") > 0, F.xxhash64(F.lit(f"{seed}:{k}:copy"), k, "_c")).otherwise(F.col(k))
    base = base.withColumn("_c", copy).withColumns({k: again(k) for k in ("_a", "_b")})
    dealt = base.withColumn("_r", F.row_number().over(order) - 1).join(cut, "_p")
    dealt = dealt.withColumn("shard", F.size(F.filter("_upto", lambda u: u <= F.col("_r"))).cast("int"))

    ranges = max(1, -(-n // (n_shards * rows_per_partition)), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards) if n > 1000 else 1)
    # the second hash, cut to equal ranges in its own order
    dealt = dealt.withColumn("_q", F.floor((F.shiftrightunsigned(F.col("_b"), 33) * F.lit(ranges)) / F.lit(2.0**31)).cast("int"))
    within = Window.partitionBy("shard", "_q").orderBy(F.shiftrightunsigned(F.col("_b"), 33), "_b", "_t", "_c")
    placed = dealt.withColumn("_s", F.row_number().over(within) - 1)
    before = Window.partitionBy("shard").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "_q").count().withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).select("shard", "_q", "_o")
    small = F.broadcast(offsets) if ranges * n_shards <= 1_000_000 else offsets
    return placed.join(small, ["shard", "_q"]).select("row.*", "shard", (F.col("_s") + F.col("_o")).cast("long").alias("slot"))
