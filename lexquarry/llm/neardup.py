"""Near-duplicates by SuperMinHash, banding, verification and union-find grouping.

SuperMinHash: each shingle seeds a random permutation of the SIZE signature places and gives the j-th place of it the
value j + r, r uniform in [0, 1); a place keeps the smallest value it is given. Values at rank j cannot win once every
place has one below j, so a text of many shingles stops after a few ranks. Signatures of equal sets are equal, and two
signatures agree in a share of places that estimates the Jaccard similarity with less variance than MinHash.

1. Rows with the same set of shingles (equal sizes and 128-bit sums over the set) form a class, which has a number; the text
   of one of them stands for it. From here on classes are compared and joined, and at last named by their smallest id.
2. Bands of ROWS places are hashed; each band bucket has a hub, the class with the smallest hash of its number, which the
   buckets of one group mostly share. Every class is compared with the smallest of its hubs, and then with those of
   its other hubs that are not in its component yet. Links are confirmed on the full sets.
3. Where a bucket still holds documents of different components, those outside its largest one are compared with all
   others: in cells of bounded size, each pair in the first bucket it shares. All pairs are compared on the full sets,
   unless a link found before has joined them; a cell returns the links that join.
4. Components come from large-star and small-star steps, each written to the shared folder.

So a group of n copies costs n links, not n squared. Bands are as long as the threshold allows: with 20 bands of 6
places, a pair at similarity 0.85 meets in no band with probability 8e-5; with 24 bands of 5, one at 0.80 with 7e-5.

Defined cases: a set is the distinct runs of `width` words, or the whole text if shorter; texts without words, and null
ids, are linked with nothing and kept. Rows of one id are one document: if their texts differ, all their classes are linked. Words are lower-cased in A-Z only. Shingles are
told apart by 64-bit hashes, which only matters within a pair of documents. A text is read whole, in memory of about 30
times its bytes; smaller texts share blocks of 512 KB.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.tables import written
from lexquarry.llm.text import LOWER, block_of, hashed, in_blocks, mix, released, runs, words_of
from lexquarry.ship import ship

WIDTH = 5
THRESHOLD = 85
"""Percent of the union."""
SIZE = 120
MISS = 1e-4
"""At most so likely, a pair at the threshold shares no band."""
CELL = 1000
PART = 2 << 20
"""Bytes of text whose sets a cell holds at once, on either side of its pairs; a single text may be larger."""
_ONE = np.uint64(1)


def rows_of(threshold: int) -> int:
    """Places of a band, as many as MISS allows; all SIZE places are dealt to bands."""
    fit = (r for r in range(1, SIZE + 1) if SIZE % r == 0 and (1 - (threshold / 100) ** r) ** (SIZE // r) <= MISS)
    return max(fit, default=1)


def shingles(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, and their rows."""
    low = LOWER[buf]
    start, end, first = words_of(low, off)
    words = hashed(low, start, end, 3)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= width:
        at = np.flatnonzero(row[: len(words) - width + 1] == row[width - 1 :])
        h, of = runs(words, width)[at], row[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [int(runs(words[first[r] : first[r + 1]], int(counts[r]))[0]) for r in short]
        h = np.concatenate([h, mix(np.array(whole, np.uint64) + counts[short].astype(np.uint64))])
        of = np.concatenate([of, short])
    key = h + mix(of.astype(np.uint64) + _ONE)
    order = np.argsort(key, kind="stable")
    own = np.sort(order[np.r_[True, key[order][1:] != key[order][:-1]][: len(order)]])
    return h[own], of[own]


def superminhash(h: np.ndarray, row: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Signatures of n rows; rows without elements have infinite values."""
    values = np.full(n * size, np.inf)
    swaps: list[np.ndarray] = []
    for j in range(size):
        if not len(h):
            break
        u = mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        r = (u >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + ((u & np.uint64(0x7FF)) * np.uint64(size - j) >> np.uint64(11)).astype(np.int64)
        place = k
        for t in range(j - 1, -1, -1):  # what the earlier swaps of this permutation have put there
            place = np.where(place == swaps[t], t, place)
        np.minimum.at(values, row * size + place, r + j)
        swaps.append(k)
        open_ = values.reshape(n, size).max(1) >= j + 1
        go = open_[row]
        if not go.all():
            h, row, swaps = h[go], row[go], [s[go] for s in swaps]
    return values.reshape(n, size)


def text_key(text: str) -> list[Column]:
    """t1 and t2: tell the texts of one id apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, t1 and t2 (of the text), n (shingles), f1 and f2 (sums over the set), bands (hashes), sig (a byte per place)."""

    ship(docs.sparkSession)
    places = rows_of(threshold)
    n_bands = SIZE // places

    def rows(batches):
        for batch in in_blocks(batches):
            n = batch.num_rows
            h, row = shingles(*block_of(batch.column(1)), width)
            count = np.bincount(row, minlength=n)
            sums = [np.zeros(n, np.uint64) for _ in range(2)]
            for k, s in enumerate(sums):
                np.add.at(s, row, mix(h + np.uint64(1 + 7 * k)))
            v = superminhash(h, row, n)
            q = np.where(np.isfinite(v), v * 2.0**20, 0).astype(np.uint64)
            bands = np.stack([mix(runs_of(q[:, b * places : (b + 1) * places]) + np.uint64(b)) for b in range(n_bands)], 1)
            sig = (mix(q.ravel()) & np.uint64(255)).astype(np.uint8).reshape(n, SIZE)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(count, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums), pa.ListArray.from_arrays(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32), pa.array(bands.ravel().view(np.int64))), pa.array([s.tobytes() for s in sig], pa.binary())],
                ["doc_id", "t1", "t2", "n", "f1", "f2", "bands", "sig"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *text_key(text)).mapInArrow(rows, f"doc_id {kind}, t1 long, t2 long, n long, f1 long, f2 long, bands array<bigint>, sig binary")


def runs_of(q: np.ndarray) -> np.ndarray:
    out = np.zeros(len(q), np.uint64)
    for k in range(q.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + q[:, k])
    return out


def bodies_of(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, body: a compressed text of each class. wanted: id of the class, and the doc_id, t1 and t2 of one row of it."""

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = pa.array([z.compress(t.as_buffer()) for t in batch.column(3).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], body], ["doc_id", "t1", "t2", "body"])

    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), *text_key(text), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    bodies = own.mapInArrow(squeeze, f"doc_id {kind}, t1 long, t2 long, body binary")
    return bodies.join(wanted.hint("merge"), ["doc_id", "t1", "t2"]).groupBy("id").agg(F.min("body").alias("body"))


def sets_of(bodies: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted shingles of each compressed text."""
    z = zstandard.ZstdDecompressor()
    raw = [z.decompress(b) for b in bodies]
    h, row = shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), width)
    return [np.sort(part) for part in np.split(h, np.searchsorted(row, np.arange(1, len(bodies))))] if bodies else []


def alike(s: np.ndarray, t: np.ndarray, threshold: int = THRESHOLD) -> bool:
    if 100 * min(len(s), len(t)) < threshold * max(len(s), len(t)):
        return False
    both = np.concatenate([s, t])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(s) + len(t) - common)


def parts(which: np.ndarray, bodies: list[bytes], part: int = PART) -> list[np.ndarray]:
    """These rows, cut where their texts exceed so many bytes."""
    upto = np.cumsum([zstandard.frame_content_size(bodies[k]) for k in which])
    return np.split(which, np.flatnonzero(np.diff(upto // part)) + 1)


def confirmed(pairs: DataFrame, bodies: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets of shingles reach the threshold. bodies: id, body."""
    kind = bodies.schema["id"].dataType.simpleString()
    first = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("x")).hint("merge"), "a")
    both = first.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("y")).hint("merge"), "b")

    def check(batches):
        kept: dict[bytes, np.ndarray] = {}

        def sets(bodies: list[bytes]) -> list[np.ndarray]:
            """Sets of the bodies; those of the last call are known."""
            nonlocal kept
            new = list(dict.fromkeys(b for b in bodies if b not in kept))
            kept = {b: kept[b] for b in set(bodies) if b in kept} | dict(zip(new, sets_of(new, width), strict=True))
            return [kept[b] for b in bodies]

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                x, y = part.column(part.schema.get_field_index("x")).to_pylist(), part.column(part.schema.get_field_index("y")).to_pylist()
                found = sets(x + y)
                ok = []
                for s, t in zip(found[: len(x)], found[len(x) :], strict=True):
                    ok.append(alike(s, t, threshold))
                yield part.select(["a", "b"]).filter(pa.array(ok))
        released()

    return both.select("a", "b", "x", "y").mapInArrow(check, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for the ids of the edges (a, b). Rounds grow with the logarithm of the edges."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours, to the smallest of the neighbourhood
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours and itself, to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        same = new.unionAll(now).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").limit(1).count() == 0
        now = new
        if same:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def cells(bands: DataFrame, reps: DataFrame, found: DataFrame, bodies: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, cell: int = CELL, part: int = PART) -> DataFrame:
    """Links (a, b) that join documents of one bucket but different components.

    bands: key, doc_id; reps: doc_id, bands; found: id, component; bodies: id, body.
    """
    of = bands.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = of.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("component", "n").alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(float(cell))).cast("int")
    mixed = sizes.where("inside < n").select("key", "main", blocks(F.col("n") - F.col("inside")).alias("nl"), blocks(F.col("n")).alias("nr"))
    members = of.join(mixed, "key").withColumn("outside", F.col("component") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.where("outside").select("key", "doc_id", "component", "outside", F.lit(True).alias("left"), block("nl").alias("i"), every("nr").alias("j"))
    right = members.select("key", "doc_id", "component", "outside", F.lit(False).alias("left"), every("nl").alias("i"), block("nr").alias("j"))
    placed = left.unionAll(right).join(reps.select("doc_id", "bands").join(bodies.withColumnRenamed("id", "doc_id"), "doc_id"), "doc_id")
    kind = bands.schema["doc_id"].dataType

    def links(table: pa.Table) -> pa.Table:
        key, of_left = table.column("key")[0].as_py(), table.column("left").to_numpy(zero_copy_only=False)
        ids, outside = table.column("doc_id").to_pylist(), table.column("outside").to_numpy(zero_copy_only=False)
        band = np.array(table.column("bands").to_pylist())
        body = table.column("body").to_pylist()
        names, comp = np.unique(np.array(table.column("component").to_pylist()), return_inverse=True)
        root = np.arange(len(names))  # of each component, flat after each join
        here = np.flatnonzero(~of_left)
        order = {i: k for k, i in enumerate(sorted(set(ids)))}
        at = np.array([order[i] for i in ids])
        asked: dict[int, np.ndarray] = {}
        for x in np.flatnonzero(of_left):
            y = here[(comp[here] != comp[x]) & (~outside[here] | (at[here] < at[x]))]
            # the pair's first common band is this bucket
            y = y[band[x][(band[y] == band[x]).argmax(1)] == key] if len(y) else y
            if len(y):
                asked[x] = y
        a, b = [], []
        for left in parts(np.array(list(asked)), body, part) if asked else []:
            of_x = dict(zip(left, sets_of([body[k] for k in left], width), strict=True))
            for right in parts(np.unique(np.concatenate([asked[x] for x in left])), body, part):
                of_y = sets_of([body[k] for k in right], width)
                n, h = np.array([len(t) for t in of_y]), np.concatenate(of_y)
                order_h = np.argsort(h, kind="stable")
                h, owner = h[order_h], np.repeat(np.arange(len(right)), n)[order_h]
                for x in left:
                    k = np.flatnonzero(np.isin(right, asked[x]) & (root[comp[right]] != root[comp[x]]))
                    if not len(k):
                        continue
                    first, end = np.searchsorted(h, of_x[x], "left"), np.searchsorted(h, of_x[x], "right")
                    m = end - first
                    common = np.bincount(owner[np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=len(right))[k]
                    for y in right[k[100 * common >= threshold * (len(of_x[x]) + n[k] - common)]]:
                        if root[comp[y]] != root[comp[x]]:
                            root[root == root[comp[y]]] = root[comp[x]]
                            a.append(max(ids[x], ids[y]))
                            b.append(min(ids[x], ids[y]))
        if table.nbytes > part:
            released()
        arrow = table.schema.field("doc_id").type
        return pa.table({"a": pa.array(a, arrow), "b": pa.array(b, arrow)})

    return placed.groupBy("key", "i", "j").applyInArrow(links, f"a {kind.simpleString()}, b {kind.simpleString()}")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD, report: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row. Ids are numbers or strings.

    report: called with the name and the table of each kind of pairs, for tests and figures.
    """
    sigs = written(signatures(docs, doc_id, text, width, threshold).drop("sig"), "signatures")
    full = sigs.where("n > 0 AND doc_id IS NOT NULL")
    same = ["n", "f1", "f2"]
    # each class has a number of its own: an id may have several texts, and so stand for several classes
    classes = full.groupBy(*same).agg(F.min(F.struct("doc_id", "t1", "t2")).alias("rep"), F.min("bands").alias("bands"))
    classes = written(classes.select(*same, "rep", "bands", F.monotonically_increasing_id().alias("id")), "classes")
    reps = classes.select(F.col("id").alias("doc_id"), "bands")
    bands = reps.select(F.explode("bands").alias("key"), "doc_id")
    number = classes.select(*same, "id")

    hubs = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("hub"))).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "x")
    of_doc = bands.join(hubs, "key").groupBy("doc_id").agg(F.array_sort(F.collect_set("x")).alias("hubs"))  # at most one hub a band
    of_doc = written(of_doc, "hubs")
    wanted = classes.select("id", "rep.doc_id", "rep.t1", "rep.t2").join(of_doc.select(F.col("doc_id").alias("id")), "id", "left_semi")
    bodies = written(bodies_of(docs, wanted, doc_id, text), "bodies")
    edge = lambda hub: (F.greatest("doc_id", hub).alias("a"), F.least("doc_id", hub).alias("b"))

    star = of_doc.select(*edge(F.col("hubs")[0]["hub"])).where("a <> b").distinct()
    # an id with several texts links their classes: each id is one document
    key = F.struct(*same)
    several = full.groupBy("doc_id").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first <> last").select("doc_id", "first")
    own = full.select("doc_id", *same).join(several, "doc_id").where(key != F.col("first")).select(*same, *(F.col("first")[c].alias(f"first_{c}") for c in same)).distinct()
    own = own.join(number, same).select(F.col("id").alias("x"), *(F.col(f"first_{c}").alias(c) for c in same)).join(number, same)
    own = own.select(F.greatest("x", "id").alias("a"), F.least("x", "id").alias("b"))
    links = written(confirmed(star, bodies, width, threshold).unionAll(own), "links")
    found = written(components(links), "components")
    label = found.select(F.col("id").alias("hub"), F.col("component").alias("c"))

    rest = of_doc.select("doc_id", F.explode(F.slice("hubs", 2, SIZE)).alias("x")).select("doc_id", "x.hub").where("doc_id <> hub")
    rest = rest.join(label, "hub", "left").withColumn("c", F.coalesce("c", "hub"))
    rest = rest.join(label.select(F.col("hub").alias("doc_id"), F.col("c").alias("d")), "doc_id", "left").where(F.coalesce("d", "doc_id") != F.col("c"))
    rest = written(rest.select(*edge(F.col("hub"))).distinct(), "rest")

    def joined(found: DataFrame, more: DataFrame) -> DataFrame:
        if not more.limit(1).count():
            return found
        return written(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")

    if rest.limit(1).count():
        found = joined(found, written(confirmed(rest, bodies, width, threshold), "links"))
    last = written(cells(bands, reps, found, bodies, width, threshold), "links")
    found = joined(found, last)
    if report:
        for name, table in (("star", star), ("rest", rest), ("cells", last)):
            report(name, table)

    # a component's name is the smallest id of its classes
    label = classes.select("id", *same, F.col("rep.doc_id").alias("least")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    label = label.join(label.groupBy("component").agg(F.min("least").alias("name")), "component").select(*same, "name")
    out = sigs.select("doc_id", *same).join(label, same, "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull() & F.col("name").isNotNull(), F.col("name")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
