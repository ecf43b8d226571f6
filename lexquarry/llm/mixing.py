"""Mixing sources to target weights by entropy balancing.

Rates r of documents minimise the relative entropy sum(r ln r - r + 1) under 0 <= r <= cap and, for each source, sum(size * r)
= target. The solution is r = min(cap, exp(lambda * size / scale)): an exponential tilt per source. Newton's method on
the convex dual finds every lambda at once; each step sums first and second derivatives per source over the whole
table. Since a rate depends on source and size alone, the table is first reduced, once, to counts of (source, size).

Rates become copies by systematic rounding: within a source, documents in order of size (ties by keyed hash) fill a
running sum of rates, and a document gets one copy for each whole number plus offset that its own rate passes. Rates and
sizes both run one way along that order, so a source's taken tokens miss its target by no more than its largest document;
of OFFSETS offsets, each source uses the one that misses least.
The running sum is an offset per (source, size) plus the rank among equals times their rate; ranks are counted per
(source, size, hash bucket), so that no group of copies meets in one task. Rates are whole multiples of 1 / ONE and sums are
of integers or decimals, so neither the order in which rows arrive nor a rerun can change a copy.

Defined cases: a null source is a source, the last one; sizes of 0 get rate 1; a source without tokens has target 0 and
keeps its documents; if all targets exceed cap times their sources, every source is taken cap times; if a source has not
reached its target after all steps, an error names it. Empty table: empty. The driver holds a few numbers per source. Texts are only counted, in the
JVM and row by row, so a very long one costs a row of its own size; repeated rows are rows of their own, ties in size go by a hash of
all columns but maps, nulls included.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.tables import orderable, row_hash, written

WORD = r"[^\x20\x09-\x0D]+"
ONE = 1 << 28
"""A rate of 1; n documents with their rates fit 64 bits up to n = 1.7e10."""
BUCKET_ROWS = 500_000
BUCKETS = 32
"""Hash buckets of a (source, size), at least; more where the table has more than BUCKET_ROWS rows for each."""
OFFSETS = 64


def _whole(x):
    """Copies in a running sum."""
    return F.shiftright(x, ONE.bit_length() - 1)


def n_words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Weights in turn over the sources by code point, null last; what exceeds cap times a source goes to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def balance(counts: DataFrame, want: dict[str | None, float], size: dict[str | None, int], cap: float = 2.0, steps: int = 60, near: float = 1e-9) -> dict[str | None, tuple[float, float]]:
    """lambda and scale of each source. counts: source, size, n. Each step is one aggregation of the whole table."""
    spark = counts.sparkSession
    rows = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("size") * F.col("n")).cast("double").alias("sq"), F.max("size").alias("top"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()
    scale = {r["source"]: r["sq"] / max(size[r["source"]], 1) or 1.0 for r in rows}
    least = {r["source"]: r["least"] or 1 for r in rows}
    state = {}
    for s in want:
        if size[s] == 0:
            continue
        # at the cap every rate is the cap: the tilt that lifts the shortest document there
        full = want[s] >= cap * size[s] * (1 - near)
        # below, every rate is at most the target's share of the source: the tilt that brings the shortest document there
        low, high = (math.log(x) * scale[s] / least[s] * (1 + 1e-9) for x in (min(1.0, want[s] / size[s]), cap))
        state[s] = [high if full else 0.0, low, high, full]
    for _ in range(steps):
        if all(done for *_, done in state.values()):
            break
        now = spark.createDataFrame([(s, v[0], float(scale[s])) for s, v in state.items() if not v[3]], "source string, lam double, scale double")
        tilt = F.least(F.exp(F.col("lam") * F.col("size") / F.col("scale")), F.lit(cap))
        free = F.col("lam") * F.col("size") / F.col("scale") < math.log(cap)
        small = F.broadcast(now) if len(state) <= 100_000 else now
        sums = counts.join(small, counts["source"].eqNullSafe(now["source"])).select(now["source"], (F.col("size") * F.col("n")).alias("t"), tilt.alias("r"), F.when(free, F.col("size") / F.col("scale")).otherwise(0.0).alias("d"))
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        for s, got, slope in sums.groupBy("source").agg(exact(F.col("t") * F.col("r")), exact(F.col("t") * F.col("r") * F.col("d"))).collect():
            v = state[s]
            v[1 if got < want[s] else 2] = v[0]
            step = v[0] + (want[s] - got) / slope if slope > 0 else math.inf
            # a step out of the bracket is halved instead
            v[3] = abs(got - want[s]) <= near * max(want[s], 1)
            if not v[3]:
                v[0] = step if v[1] < step < v[2] else (v[1] + v[2]) / 2
    open_ = [s for s, v in state.items() if not v[3]]
    if open_:
        raise RuntimeError(f"after {steps} steps, the rates of {len(open_)} sources miss their targets, {open_[0]!r} among them")
    return {s: (v[0], scale[s]) for s, v in state.items()}


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 5) -> DataFrame:
    """docs with source_size, target, rate and copies added. `size` is a column of tokens per document."""
    spark = docs.sparkSession
    given = [c for c in docs.columns if c not in ("source_size", "target", "rate", "copies")]
    # rows of one id, source and size differ elsewhere: without that, arrival would decide which of them is taken
    keys = [c for c in given if orderable(docs.schema[c].dataType)]
    # the rows travel as one column, so that no name of theirs can clash
    docs = docs.select(F.struct(*given).alias("row"), F.col(source).alias("_source"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), row_hash(seed, *keys).alias("_h"))
    buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    counts = written(docs.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size"), F.pmod("_h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect()
    size_of = {r["source"]: int(r["t"]) for r in totals}
    want = targets(size_of, weights, share, cap)
    tilts = balance(by_size, want, size_of, cap)

    plan = spark.createDataFrame([(s, size_of[s], float(want[s]), *(float(x) for x in tilts.get(s, (0.0, 1.0)))) for s in size_of], "source string, source_size long, target double, lam double, scale double")
    small = F.broadcast(plan) if len(size_of) <= 100_000 else plan
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    tilted = by_size.join(small, same(by_size, plan)).select(plan["source"], "size", "n", "source_size", "target", F.round(F.least(F.exp(F.col("lam") * F.col("size") / F.col("scale")), F.lit(cap)) * ONE).cast("long").alias("rate"))
    # where each (source, size) starts in its source's running sum, and each bucket among its equals
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(tilted.withColumn("from", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(upto), F.lit(0))), "mix-starts")
    taken = lambda u: F.sum(F.col("size") * (_whole(F.col("from") + F.col("n") * F.col("rate") + u) - _whole(F.col("from") + u)))
    step = ONE // OFFSETS
    miss = starts.groupBy("source").agg(F.first("target").alias("target"), *(taken(F.lit(k * step)).alias(f"t{k}") for k in range(OFFSETS)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("miss"), F.lit(k * step).cast("long").alias("start")) for k in range(OFFSETS))))["start"]
    offset = miss.select(F.col("source").alias("o_source"), best.alias("start"))
    starts = starts.drop("n").join(F.broadcast(offset) if len(size_of) <= 100_000 else offset, F.col("source").eqNullSafe(F.col("o_source"))).drop("o_source")
    among = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("before", F.coalesce(F.sum("n").over(among), F.lit(0))).drop("n")
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    cells = ahead.withColumn("_k", key(ahead["source"])).drop("source").join(starts.withColumn("_k", key(starts["source"])).drop("source"), ["_k", "size"])
    cells = cells.select("_k", F.col("size").alias("_size"), F.col("bucket").alias("_b"), "before", "source_size", "target", "rate", "from", "start")

    ranked = docs.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("_k", "_size", "_b").orderBy("_h", F.col("row")[doc_id])) - 1)
    joined = ranked.join(cells, ["_k", "_size", "_b"])
    place = lambda more: _whole(F.col("from") + (F.col("before") + F.col("_r") + more) * F.col("rate") + F.col("start"))
    copies = place(1) - place(0)
    return joined.select("row.*", "source_size", "target", (F.col("rate") / ONE).alias("rate"), F.least(F.greatest(copies, F.lit(0)), F.lit(math.ceil(cap))).cast("int").alias("copies"))
