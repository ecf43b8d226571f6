"""The prefix trie of conversations, from sorted turn arrays.

A node is a distinct sequence of first turns; conversations that start with it are its members.

1. Turns become digests of role and text, are range-sorted by conversation and turn over the whole cluster, and numbered: inside a
   partition by counting, across partitions by adding what the parts before hold of the same conversation.
2. A conversation becomes an array of symbols, one per turn, mixed from digest and place; since places are mixed in, the sum
   of the first symbols (2 x 64 bits) names a prefix. Arrays are cut at every BLOCK turns, so a conversation that holds a third of
   all turns is many rows; a block is sorted under the name of the prefix it follows.
3. Blocks are range-sorted by prefix, array and conversation, whatever the number of equal ones. Each partition computes the
   common prefix lengths (LCP) of neighbours and sweeps them with a stack: a node opens at the row whose LCP with the row before is
   less than its depth, and closes at the next such row. Nodes are numbered as they open, so that a subtree is a range of numbers, and
   sums over subtrees are differences of running sums.
4. Nodes that are open at either end of a partition, and those on the way to a conversation's next block, are partial. They are few:
   at most two stacks a partition and what long conversations hold. Parts are added up by name, and sums over their
   subtrees are carried up by doubling: in round i, each node adds to its ancestor at distance 2^i. Rounds grow with the logarithm of depth.
5. The ids that end at an open node are hashed in order, as a stream of one text per partition.

Memory: a task holds one range of blocks, about PART bytes of symbols, and what is made of it (some 20 times that).

Defined cases: null role or text is empty; turns go by number, null first, then by digest where equal (repeated rows are turns of
their own); rows without conv_id belong to no conversation; a conversation without turns is a member of the root; ids are whole
numbers; further columns are not read. Empty table: no nodes. Texts of any length are hashed and measured in the JVM, row by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.tables import partitions, written
from lexquarry.llm.text import block_of, mix, ragged
from lexquarry.ship import ship

BLOCK = 1024
"""Turns of a sorted row."""
PART = 4 << 20
"""Bytes of symbols of a sorted partition, about."""
FEW = 200_000
"""Open nodes that are broadcast; more are joined by a shuffle."""
HEAD, EVERY = 6, 100
NOTHING = hashlib.sha256(b"").hexdigest()
_LOW = 0xFFFFFFFF


def keyed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, dig (of role and text), n (code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.substring(F.unhex(said), 1, 16).alias("dig"), F.length(text).cast("long").alias("n"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, rank from 0, dig, n. No conversation meets in one task: a partition's first one goes on counting from
    the parts before, whose counts (one per partition at most) are broadcast."""
    ship(turns.sparkSession)

    def counted(batches):
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            first = np.r_[True, conv[1:] != conv[:-1]]
            at = np.arange(len(conv))
            at -= np.maximum.accumulate(np.where(first, at, 0))
            if conv[0] == last:
                at[: np.argmax(first[1:]) + 1 if first[1:].any() else len(conv)] += n
            last, n = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(at), batch.column(2), batch.column(3)], ["conv_id", "part", "at", "dig", "n"])

    order = ["conv_id", "turn", "dig"]
    ranged = turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    table = written(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(counted, "conv_id long, part int, at long, dig binary, n long"), "turns")
    held = table.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("held"))
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.where("before > 0").select("conv_id", "part", "before")  # at most one per partition
    return table.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("rank"), "dig", "n")


def placed(ranks: DataFrame) -> DataFrame:
    """conv_id, p (place from 0), dig, n of conversations as they are."""
    return ranks.select("conv_id", F.col("rank").alias("p"), "dig", "n")


def regrafted(ranks: DataFrame, head: int = HEAD, every: int = EVERY) -> DataFrame:
    """The same of conversations rebuilt on the first h turns of conversation c - c % every, h = crc32(c) % head, in place of their
    own first h. A conversation that is left without turns has one row without place."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(head))
    first = ranks.where((F.col("rank") < head - 1) & (F.col("conv_id") % every == 0))
    bases = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "dig", "n"))).alias("turns"))  # fewer than head
    convs = ranks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    convs = convs.join(bases, "base", "left").withColumn("head", F.slice(F.coalesce("turns", F.array().cast(bases.schema["turns"].dataType)), F.lit(1), h.cast("int")))
    convs = written(convs.select("conv_id", "size", h.alias("h"), "head", F.size("head").alias("m")), "heads")
    own = ranks.where(F.col("rank") >= h).join(convs.select("conv_id", "h", "m"), "conv_id").select("conv_id", (F.col("m") + F.col("rank") - F.col("h")).alias("p"), "dig", "n")
    heads = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.rank").alias("p"), "x.dig", "x.n")
    none = convs.where("size <= h AND m = 0").select("conv_id", F.lit(None).cast("long").alias("p"), F.lit(None).cast("binary").alias("dig"), F.lit(None).cast("long").alias("n"))
    return own.unionAll(heads).unionAll(none)


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, k (number of the block), h1 and h2 (name of the prefix before it), path (symbols), ns (code points), more
    (whether another block follows)."""
    ship(turns.sparkSession)

    def packed(batches):
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            place, dig, n = (lists.flatten().field(c) for c in range(3))
            body, _ = block_of(dig)
            of = np.ascontiguousarray(body.reshape(-1, 16)).view("<u8").reshape(-1, 2)
            at = mix(place.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1))
            symbols = np.stack([mix(of[:, 0] ^ at), mix(of[:, 1] + at * np.uint64(0x9E3779B97F4A7C15))], 1)
            upto = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(symbols, 0)])
            cut = np.concatenate([[0], np.cumsum(size)])
            sums = upto[cut[1:]] - upto[cut[:-1]]
            raw, ns = symbols.astype(">u8").tobytes(), n.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), pa.array([raw[16 * a : 16 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([ns[8 * a : 8 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                ["conv_id", "k", "s1", "s2", "path", "ns"],
            )

    k = F.floor(F.coalesce("p", F.lit(0)) / block).cast("long").alias("k")
    rows = turns.select("conv_id", k, F.when(F.col("p").isNotNull(), F.struct("p", "dig", "n")).alias("x")).repartition("conv_id", "k")  # dealt by block, so that a long conversation may be split before
    rows = rows.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most `block`
    cut = written(rows.mapInArrow(packed, "conv_id long, k long, s1 long, s2 long, path binary, ns binary"), "blocks")
    long = (F.col("k") > 0) | (F.octet_length("path") == 16 * block)
    zero = F.lit(0).cast("long")
    short = cut.where(~long).select("conv_id", "k", zero.alias("h1"), zero.alias("h2"), "path", "ns", F.lit(False).alias("more"))
    # sums modulo 2^64, by halves; narrow rows, one per block of long conversations
    w = Window.partitionBy("conv_id").orderBy("k")
    upto = lambda half: F.coalesce(F.sum(half).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero)

    def name(s: str) -> Column:
        low, high = upto(F.col(s).bitwiseAND(_LOW)), upto(F.shiftrightunsigned(s, 32))
        return F.shiftleft((high + F.shiftrightunsigned(low, 32)).bitwiseAND(_LOW), 32).bitwiseOR(low.bitwiseAND(_LOW))

    names = cut.where(long).select("conv_id", "k", "s1", "s2").select("conv_id", "k", name("s1").alias("h1"), name("s2").alias("h2"), F.lead("k").over(w).isNotNull().alias("more"))
    return short.unionAll(cut.where(long).join(names, ["conv_id", "k"]).select(*short.columns))


SWEPT = "open boolean, depth long, conv_id long, parent_conv_id long, id1 long, id2 long, p1 long, p2 long, n_convs long, n_children long, n_leaves long, saved_tokens long, n long, ends_sha256 string, part int, piece binary"
"""What a sweep yields: whole nodes, and parts of open ones. id and p: names of the node and its parent; n: code points of the last
text; piece: the ids that end here."""


def swept(table: pa.Table, block: int = BLOCK) -> pa.Table:
    """The nodes of one sorted partition. table: k, h1, h2, path, conv_id, ns, more, part."""
    rows = table.num_rows
    k, h1, h2, conv = (table.column(c).to_numpy() for c in ("k", "h1", "h2", "conv_id"))
    more = table.column("more").to_numpy(zero_copy_only=False)
    raw, off = block_of(table.column("path"))
    ns = np.ascontiguousarray(block_of(table.column("ns"))[0]).view("<i8")
    symbols = np.ascontiguousarray(raw).view(">u8").astype(np.uint64).reshape(-1, 2)
    at, size = off // 16, np.diff(off) // 16
    same = (k[1:] == k[:-1]) & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    lcp = np.where(same, np.minimum(size[1:], size[:-1]), 0)
    pair, place = ragged(lcp)
    differ = np.flatnonzero((symbols[at[1:-1][pair] + place] != symbols[at[:-2][pair] + place]).any(1))
    np.minimum.at(lcp, pair[differ], place[differ])

    # the sweep: nodes are numbered as they open; the stack holds the open ones, below them the prefix of the block
    depth, lo, parent, last, end, stack, top = [], [], [], [], [], [], np.zeros(rows, np.int64)
    for i, (keep, length, joined) in enumerate(zip([0, *lcp.tolist()], size.tolist(), [False, *same.tolist()], strict=True)):
        new = len(depth)
        for v in stack[keep + 1 :] if joined else stack:
            last[v], end[v] = i - 1, new
        if joined:
            del stack[keep + 1 :]
        else:
            stack = [new]
            depth.append(0), lo.append(i), parent.append(-1), last.append(0), end.append(0)
            new += 1
        more_ = length - keep
        if more_ > 0:
            parent += [stack[-1], *range(new, new + more_ - 1)]
            stack += range(new, new + more_)
            depth += range(keep + 1, length + 1)
            lo += [i] * more_
            last += [0] * more_
            end += [0] * more_
        top[i] = stack[-1]
    for v in stack:
        last[v], end[v] = rows - 1, len(depth)
    depth, lo, parent, last, end = (np.array(x, np.int64) for x in (depth, lo, parent, last, end))

    bottom = parent < 0
    root = bottom & (k[lo] == 0)
    follow = np.concatenate([[0], np.cumsum(more)])
    open_ = bottom | (lo == 0) | (last == rows - 1) | (follow[last + 1] > follow[lo])
    members = np.where(bottom & ~root, 0, last - lo + 1)
    least = np.minimum.reduceat(np.append(conv, conv[-1]), np.stack([lo, last + 1], 1).ravel())[::2]
    text = np.where(bottom, 0, ns[np.maximum(at[lo] + depth - 1, 0)] if len(ns) else 0)
    whole, up = ~open_, np.maximum(parent, 0)
    kids = np.bincount(parent[whole & ~bottom], minlength=len(depth))
    sums = []
    for own in (whole & (kids == 0), np.where(whole, (members - 1) * text, 0)):
        upto = np.concatenate([[0], np.cumsum(own.astype(np.int64))])
        mine = np.where(whole, upto[end] - upto[:-1], 0)
        under = whole & open_[up]  # a whole node under an open one
        np.add.at(mine, parent[under], mine[under].copy())
        sums.append(mine)
    prefix = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(symbols, 0)])
    before = np.stack([h1[lo], h2[lo]], 1).view(np.uint64) - prefix[at[lo]]
    ids = (before + prefix[at[lo] + depth]).view(np.int64)
    above = (before + prefix[np.maximum(at[lo] + depth - 1, 0)]).view(np.int64)

    hashes, pieces = np.full(len(depth), NOTHING, object), np.full(len(depth), None, object)
    done = np.flatnonzero(~more)
    cuts = np.flatnonzero(np.r_[True, top[done][1:] != top[done][:-1]][: len(done)]).tolist() + [len(done)]
    names = conv[done].tolist()
    for a, b in zip(cuts, cuts[1:]):
        said, v = ",".join(map(str, names[a:b])).encode(), top[done[a]]
        if open_[v]:
            pieces[v] = said
        else:
            hashes[v] = hashlib.sha256(said).hexdigest()

    def of(values: np.ndarray, null: np.ndarray) -> pa.Array:
        return pa.array(values.astype(np.int64), mask=null)

    own_parent = bottom | open_[up]  # its parent's members aren't all here
    return pa.table(
        {
            "open": open_, "depth": k[lo] * block + depth, "conv_id": of(least, bottom & ~root), "parent_conv_id": of(least[up], own_parent),
            "id1": of(ids[:, 0], whole), "id2": of(ids[:, 1], whole), "p1": of(above[:, 0], bottom | ~open_[up]), "p2": of(above[:, 1], bottom | ~open_[up]),
            "n_convs": members, "n_children": kids.astype(np.int64), "n_leaves": sums[0], "saved_tokens": sums[1], "n": text.astype(np.int64),
            "ends_sha256": pa.array(np.where(open_, None, hashes), pa.string()), "part": pa.array(np.full(len(depth), table.column("part")[0].as_py()), pa.int32()), "piece": pa.array(pieces, pa.binary()),
        }
    )


def hashed_in_order(pieces: DataFrame) -> DataFrame:
    """id, ends_sha256: hash of all pieces of an id in the order of parts, joined by commas; one pass, one piece held at a time."""

    def streamed(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for node, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if node != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], batch.schema.field(0).type), pa.array([h for _, h in out])], ["id", "ends_sha256"])
            kind = batch.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    kind = pieces.schema["id"].dataType.simpleString()
    return pieces.select("id", "part", "piece").repartition("id").sortWithinPartitions("id", "part").mapInArrow(streamed, f"id {kind}, ends_sha256 string")


def summed_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """id, n_leaves and saved_tokens over each node's subtree. nodes: id, up (the parent's id), and each one's own numbers."""
    now = nodes.select("id", "up", "n_leaves", "saved_tokens")
    for _ in range(deepest.bit_length()):
        more = now.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        far = now.select(F.col("id").alias("up"), F.col("up").alias("far"))
        now = now.join(more, "id", "left").join(far, "up", "left")
        now = written(now.select("id", F.col("far").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "sums")
    return now.drop("up")


def nodes(turns: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    turns: conv_id, p, dig, n, as `placed` or `regrafted` give them.
    """
    spark = turns.sparkSession
    cut = written(blocks(turns, block), "paths")
    order = ["k", "h1", "h2", "path", "conv_id"]
    size = cut.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    sorted_ = cut.repartitionByRange(max(partitions(spark), -(-size // part)), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def sweep(batches):
        have = [b for b in batches if b.num_rows]
        if have:
            yield from swept(pa.Table.from_batches(have).combine_chunks(), block).to_batches(max_chunksize=50_000)

    found = written(sorted_.mapInArrow(sweep, SWEPT), "nodes")
    name = F.struct("depth", "id1", "id2").alias("id")
    up = F.when(F.col("p1").isNotNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("id1"), F.col("p2").alias("id2")))
    total = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = found.where("open").select(name, up.alias("up"), "conv_id", "n", *total)
    open_ = written(parts.groupBy("id").agg(F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.max("n").alias("n"), *(F.sum(c).alias(c) for c in total)), "open")
    n_open, deepest = open_.agg(F.count(F.lit(1)), F.max("id.depth")).first()
    kids = open_.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    own = open_.join(kids, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own = own.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n")})
    own = written(own.drop("kids"), "open")
    small = F.broadcast if n_open <= FEW else (lambda df: df)
    names = small(own.select(F.col("id").alias("up"), F.col("conv_id").alias("of")))
    ends = hashed_in_order(found.where("piece IS NOT NULL").select(name, "part", "piece"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    stitched = own.drop("n_leaves", "saved_tokens").join(summed_up(own, deepest or 0), "id").join(ends, "id", "left").join(names, "up", "left")
    stitched = stitched.select("conv_id", "id.depth", F.col("of").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    whole = found.where("NOT open").withColumn("up", up).join(names, "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of"))
    return whole.select(*columns).unionAll(stitched.select(*columns))


def with_texts(found: DataFrame, turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turns (root: null). turns: as given to `nodes`."""
    said = turns.select(F.col("conv_id"), (F.col("p") + 1).alias("depth"), "dig")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    of = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    texts = conversations.where("conv_id IS NOT NULL").select(of.alias("dig"), role.alias("role"), text.alias("text")).groupBy("dig").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return found.join(said, ["conv_id", "depth"], "left").join(texts, "dig", "left").drop("dig")
