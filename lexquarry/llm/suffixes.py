"""Removal of long repeated byte strings with a blockwise suffix array.

Suffixes are cut at `length` bytes: two that agree that far mark a repeat. They are dealt to suffix buckets by content:
each suffix is filed under the ANCHOR-byte string with the smallest hash inside it, so that equal suffixes meet in one
bucket, and neighbours in the text, which mostly share their anchor, travel as one stretch. A first exchange sends a
128-bit keyed BLAKE2b digest per stretch, so that equal stretches are sorted once: stretches under an anchor seen once are
dropped, and one copy of each different stretch under a repeated anchor is sent as bytes. Every suffix of a stretch that
occurs twice repeats, by definition; which of the others do, the sort says.

Buckets are then sorted one after another, in blocks of bounded size (`sort_block`): first by v bytes, then long ties by
a difference cover. The cover D holds, for any two places i and j, an offset d < v with (i + d) mod v and (j + d) mod v
in D; the suffixes at places of D (about 2 / sqrt(v) of all) are ranked beforehand by doubling, and two tied suffixes
compare by the ranks at i + d and j + d. Ties are split by a level-wise three-way quicksort over all groups at once, so
the longest common prefix never costs more than those ranks, and memory stays in proportion to the block.

Where a text repeats itself every few bytes, as in a run of one letter, all suffixes repeat by definition and those of the
first period stand for the rest.

An anchor with more than HOT different stretches would fill a task: it is split by anchors of the full `length`, which are
the suffixes themselves. Suffixes with the same anchor are then equal, so a bucket has nothing left to sort under each and
counts them; anchors are dealt by, and told apart by, two polynomials modulo 2**61 - 1 at random bases (`text.Exact`), by
which two given strings meet with probability 4e-32.

Defined cases: null is empty; texts shorter than `length` stay whole; matches never cross rows; equal rows (same id or
not) count as occurrences of each other. Ids may be null, repeated, or of any type that Arrow can sort. A text stays in one
group, in memory of about 60 times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lexquarry.llm import exchange as X
from lexquarry.llm.tables import text_bytes
from lexquarry.llm.text import Exact, Places, first_min, keyed, mix, ragged

LENGTH = 400
ANCHOR = 100
HOT = 20_000
BLOCK_BYTES = 2 << 20
PERIOD = 256
"""Bytes after which a passage may repeat itself to be filed by its first period alone."""
_LOW = np.uint64(0xFFFFFFFF)

SETTLED, SEND, ASK, SPREAD = 1, 2, 4, 8
"""A stretch: all its suffixes repeat; send its bytes; read the bucket's answer; too many under its anchor."""


def period(length: int) -> int:
    """The cover's period: a divisor of length, so that doubling stays within the cover."""
    return max(d for d in range(1, max(2, length // 4)) if length % d == 0)


def cover(v: int) -> tuple[np.ndarray, np.ndarray]:
    """Membership of residues modulo v in a difference cover, and the offset for each pair of residues."""
    s = max(1, int(np.ceil(np.sqrt(v))))
    inside = np.zeros(v, bool)
    inside[: min(s, v)] = True
    inside[::s] = True
    offset = np.full((v, v), -1, np.int32)
    i = np.arange(v)
    for d in range(v):
        both = inside[(i + d) % v][:, None] & inside[(i + d) % v][None, :]
        offset[both & (offset < 0)] = d
    if (offset < 0).any():
        raise ValueError("not a difference cover")
    return inside, offset


def refine(rank: np.ndarray, column: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """Splits the groups of equal rank by a column, in place, at the places `todo`; returns the places still tied.

    A rank is the number of smaller entries, so each group owns a range of ranks and is split within it.
    """
    if not len(todo):
        return todo
    order = np.lexsort((column, rank[todo]))
    r, c = rank[todo][order], column[order]
    at = np.arange(len(r))
    head = np.r_[True, r[1:] != r[:-1]]
    sub = head | np.r_[True, c[1:] != c[:-1]]
    of_head, of_sub = np.maximum.accumulate(np.where(head, at, 0)), np.maximum.accumulate(np.where(sub, at, 0))
    rank[todo[order]] = r + (of_sub - of_head)
    alone = sub & np.r_[sub[1:], True]
    return np.sort(todo[order[~alone]])


def _eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number that sorts like them; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf),), ">u8", padded, 0, (1,)).astype(np.uint64)


def _by_bytes(rank: np.ndarray, eights: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Refines rank by n bytes from each place; returns what is still tied."""
    todo = np.arange(len(places))
    for k in range(0, n, 8):
        x = eights[np.minimum(places[todo] + k, len(eights) - 1)]
        if n - k < 8:
            x = x >> np.uint64(8 * (8 - (n - k)))
        todo = refine(rank, x, todo)
    return todo


def sort_block(buf: np.ndarray, end_of: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length`-byte string at each start; equal strings have equal ranks.

    buf: the stretches, concatenated; end_of: where the stretch of each byte ends.
    """
    v = period(length)
    inside, offset = cover(v)
    eights = _eights(buf)
    rank = np.zeros(len(starts), np.int64)
    tied = _by_bytes(rank, eights, starts, v)
    if v == length or not len(tied):
        return rank

    # ranks of the cover sample: first by v bytes, then by doubling up to length - v
    places = np.flatnonzero(inside[np.arange(len(buf)) % v] & (np.arange(len(buf)) + v <= end_of))
    where = np.full(len(buf) + length, -1, np.int64)
    where[places] = np.arange(len(places))
    name = np.zeros(len(places), np.int64)
    todo = _by_bytes(name, eights, places, v)
    have, need = 1, length // v - 1
    while have < need:
        more = min(have, need - have)
        ahead = where[places[todo] + more * v]
        column = np.where(ahead >= 0, name[ahead], -1)
        todo = refine(name, column, todo)
        have += more

    # what the sample's string may leave uncovered: the last v bytes
    tail = np.zeros(len(tied), np.int64)
    _by_bytes(tail, eights, starts[tied] + length - v, v)
    tail_of = np.zeros(len(starts), np.int64)
    tail_of[tied] = tail
    seed = mix(np.arange(len(starts), dtype=np.uint64))
    while len(tied):
        order = tied[np.lexsort((seed[tied], rank[tied]))]
        head = np.r_[True, rank[order][1:] != rank[order][:-1]]
        pivot = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        d = offset[starts[order] % v, starts[pivot] % v]
        a, b = name[where[starts[order] + d]], name[where[starts[pivot] + d]]
        side = np.sign(a - b)
        side = np.where(side == 0, np.sign(tail_of[order] - tail_of[pivot]), side)
        at = np.argsort(order)
        order, side = order[at], side[at]
        refine(rank, side, order)
        unequal = order[side != 0]
        if not len(unequal):
            break
        n = np.bincount(rank[unequal])
        tied = unequal[n[rank[unequal]] > 1]
    return rank


def periodic(buf: np.ndarray, off: np.ndarray, length: int, most: int = PERIOD) -> list[tuple[int, int, int]]:
    """(a, b, p): where bytes a to b of a row repeat themselves every p bytes, for `length` + p bytes or more, p up to `most`.

    Such a place holds one of every length // 2 bytes: there alone, eight bytes are compared with those p further on.
    """
    n = len(buf)
    if n < length + 8:
        return []
    words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(buf), 0, (1,))
    grid = np.arange(0, n - 7, max(1, length // 2))
    row_end = off[np.searchsorted(off, grid, "right")]
    row_start = off[np.searchsorted(off, grid, "right") - 1]
    here, open_, out = words[grid], np.ones(len(grid), bool), []
    for p in range(1, min(most, length, n - 8) + 1):
        near = np.flatnonzero(open_ & (grid + p < n - 7))
        for k in near[here[near] == words[grid[near] + p]].tolist():
            if not open_[k]:
                continue
            g, lo, hi = int(grid[k]), int(row_start[k]), int(row_end[k]) - p
            a, b = g, g
            size = 64
            while b < hi:  # how far bytes equal those p further on, in steps that grow
                differ = np.flatnonzero(buf[b : min(b + size, hi)] != buf[b + p : min(b + size, hi) + p])
                if len(differ):
                    b += int(differ[0])
                    break
                b, size = min(b + size, hi), size * 2
            size = 64
            while a > lo:
                c = max(a - size, lo)
                differ = np.flatnonzero(buf[c:a] != buf[c + p : a + p])
                if len(differ):
                    a = c + int(differ[-1]) + 1
                    break
                a, size = c, size * 2
            if b - a >= length:
                out.append((a, b + p, p))
                open_[(grid >= a) & (grid < b + p)] = False
    return sorted(out)


class Stretches:
    """A group's text cut to stretches of neighbouring suffixes with the same anchor."""

    def __init__(self, table: pa.Table, length: int, anchor: int, n_buckets: int):
        self.ids, self.buf, self.off = X.opened(table)
        hasher = Places(self.buf, 2)
        n = len(self.buf)
        empty = np.zeros(0, np.int64)
        self.start = self.stop = self.anchor = empty
        self.periodic, known = periodic(self.buf, self.off, length), empty.astype(bool)
        if n >= length:
            pick = first_min(hasher.keys(anchor), length - anchor + 1)
            pick &= _LOW
            # a stretch ends where the anchor changes, and a row's last suffix starts `length` before its end
            inside = np.zeros(n - length + 2, bool)
            for a, b in zip(self.off[:-1], self.off[1:] - length + 1, strict=True):
                inside[a : max(a, b)] = True
            turn = np.r_[True, pick[1:] != pick[:-1], True]
            turn[self.off[self.off < len(turn)]] = True
            # what repeats itself: the suffixes of the first period speak for the others
            first = np.zeros(len(turn), bool)
            for a, b, p in self.periodic:
                inside[a + p : b - length + 1] = False
                twice = min(a + p, b - length - p + 1)  # from here on, a suffix of the first period doesn't fit in once more
                turn[[a, twice, a + p, b - length + 1]] = True
                first[a:twice] = True
            start = np.flatnonzero(inside[:-1] & turn[:-1])
            self.start = start
            closes = turn
            closes[1:] |= inside[:-1] & ~inside[1:]
            at = np.flatnonzero(closes)
            self.stop = at[np.searchsorted(at, start, "right")]
            self.anchor = pick[start].astype(np.int64)
            known = first[start]
        under = hasher.spans(self.anchor, self.anchor + anchor)
        self.raw, self.length = self.buf.tobytes(), length
        bucket = under % np.uint64(n_buckets)
        # by bucket, anchor, content; of equal ones the first speaks for all. Equal hashes are checked byte by byte
        lead = self.anchor - self.start
        whole = hasher.spans(self.start, self.stop + length - 1) + mix(lead.astype(np.uint64))
        self.sorted = np.lexsort((whole, under, bucket))
        u, w = under[self.sorted], whole[self.sorted]
        head = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])][: len(u)]
        again = np.flatnonzero(~head)
        if any(self._content(x) != self._content(y) for x, y in zip(self.sorted[again].tolist(), self.sorted[again - 1].tolist(), strict=True)):
            w = self.digests(np.arange(len(u)))
            self.sorted = np.lexsort((w[1], w[0], under, bucket))
            u, w = under[self.sorted], w[:, self.sorted]
            head = np.r_[True, (u[1:] != u[:-1]) | (w[:, 1:] != w[:, :-1]).any(0)][: len(u)]
        self.own = np.flatnonzero(head)
        self.under = u[self.own]
        self.many = np.diff(np.r_[self.own, len(u)]) > 1
        if len(self.own):
            self.many |= np.logical_or.reduceat(known[self.sorted], self.own)
        self.first = self.sorted[self.own]
        self.entry = np.zeros(len(u), np.int64)
        self.entry[self.sorted] = np.cumsum(head) - 1
        self.cuts = np.searchsorted(bucket[self.first], np.arange(n_buckets + 1)).tolist()

    def _content(self, k: int) -> tuple[int, bytes]:
        """What makes a stretch what it is: the place of its anchor, and its bytes."""
        return int(self.anchor[k] - self.start[k]), self.raw[self.start[k] : self.stop[k] + self.length - 1]

    def digests(self, which: np.ndarray) -> np.ndarray:
        """128 bits of each of these stretches, as two rows."""
        return np.ascontiguousarray(keyed([b"%d:" % lead + content for lead, content in map(self._content, which.tolist())], 2).T)

    def windows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and first byte of every suffix in the stretches that speak for these entries."""
        of, place = ragged(self.stop[self.first[entries]] - self.start[self.first[entries]])
        return of, self.start[self.first[entries]][of] + place


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, n_groups: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256. A byte goes if a string of `length` bytes covers it that also starts anywhere else."""
    _, size = text_bytes(docs, text)
    n_groups = n_groups or X.groups_for(size)
    n_buckets = max(1, min(n_groups, -(-size // (24 << 20)) + 15))
    groups = X.grouped(docs, n_groups, doc_id, text)

    def of(table: pa.Table) -> Stretches:
        return Stretches(table, length, anchor, n_buckets)

    def g_of(table: pa.Table) -> int:
        return table.column("g")[0].as_py()

    def first(table: pa.Table) -> pa.Table:
        s = of(table)
        whole = s.digests(s.first)
        return X.sent(0, g_of(table), [(b, X.pack(s.under[i:j], s.many[i:j].astype(np.uint8), *(w[i:j] for w in whole))) for b, (i, j) in enumerate(zip(s.cuts[:-1], s.cuts[1:], strict=True)) if i < j])

    def decide(table: pa.Table) -> pa.Table:
        # groups in order, so that a rerun picks the same copy to send
        rows = sorted(zip(table.column("g").to_pylist(), table.column("b").to_pylist(), table.column("body").to_pylist(), strict=True))
        parts = [X.unpack(r[2]) for r in rows]
        under, many, w, x = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((x, w, under))
        u, w, x = under[order], w[order], x[order]
        anchors = np.r_[True, u[1:] != u[:-1]]
        head = anchors | np.r_[True, (w[1:] != w[:-1]) | (x[1:] != x[:-1])]
        heads = np.flatnonzero(head)
        count = np.diff(np.r_[heads, len(u)])
        again = (count > 1) | (np.maximum.reduceat(many[order], heads) > 0)
        of_anchor = np.cumsum(anchors[heads]) - 1
        different = np.bincount(of_anchor)[of_anchor]
        # where every stretch under an anchor is settled, nobody asks
        asked = (np.bincount(of_anchor, ~again) > 0)[of_anchor] & (different > 1)
        state = np.where(again, SETTLED, 0) | np.where(asked & (different <= hot), SEND, 0) | np.where(asked & ~again, ASK, 0) | np.where(asked & (different > hot), SPREAD, 0)
        full = np.repeat(state, count)
        full[~head] &= ~(SEND | SPREAD)
        out = np.zeros(len(u), np.uint8)
        out[order] = full
        cut = np.split(out, np.cumsum([len(p[0]) for p in parts])[:-1])
        return pa.table({"kind": pa.array([0] * len(rows), pa.int32()), "b": pa.array([r[1] for r in rows], pa.int32()), "g": pa.array([r[0] for r in rows], pa.int32()), "body": pa.array([X.pack(c) for c in cut], pa.binary())})

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        s, g = of(left), g_of(left)
        state = X.answers(X.replies(right, 0), s.cuts)
        raw, z, out = s.raw, zstandard.ZstdCompressor(level=1), []
        for b, (i, j) in enumerate(zip(s.cuts[:-1], s.cuts[1:], strict=True)):
            e = np.flatnonzero(state[i:j] & SEND) + i
            if len(e):
                at, n = s.start[s.first[e]], (s.stop - s.start)[s.first[e]]
                data = z.compress(b"".join(raw[x : x + k + length - 1] for x, k in zip(at, n, strict=True)))
                out.append((b, X.pack(s.under[e], n, (s.anchor - s.start)[s.first[e]], np.frombuffer(data, np.uint8))))
        tables = [X.sent(1, g, out)]
        keys, _, _, place, cuts = _spread(s, state, length, n_buckets)
        if len(place):
            many = (np.bincount(place) > 1).astype(np.uint8)
            tables.append(X.sent(2, g, [(b, X.pack(keys[0][i:j], keys[1][i:j], many[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]))
        return pa.concat_tables(tables)

    def compare(table: pa.Table) -> pa.Table:
        return (_sorted if table.column("kind")[0].as_py() == 1 else _counted)(table, length)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        s = of(left)
        n = len(s.buf)
        gone = np.zeros(n + 1, np.int64)
        for a, b, _ in s.periodic:
            gone[a] += 1
            gone[b] -= 1
        if len(s.own):
            state = X.answers(X.replies(right, 0), s.cuts)
            settled = (state[s.entry] & SETTLED) > 0
            np.add.at(gone, s.start[settled], 1)
            np.add.at(gone, s.stop[settled] + length - 1, -1)
            # answers, suffix by suffix, to the stretches that were sent and not settled
            got = {b: np.unpackbits(x[0], count=int(x[1][0])).astype(bool) for b, x in X.replies(right, 1).items()}
            hits = []
            for b, (i, j) in enumerate(zip(s.cuts[:-1], s.cuts[1:], strict=True)):
                e = np.flatnonzero(state[i:j] & SEND) + i
                if len(e):
                    which, at = s.windows(e)
                    asked = (state[e] & ASK) > 0
                    hits.append(at[got[b] & asked[which]])
            _, where, asked, place, cuts = _spread(s, state, length, n_buckets)
            if len(place):
                hits.append(where[X.bits(X.replies(right, 2), cuts)[place] & asked])
            if hits:
                hits = np.concatenate(hits)
                np.add.at(gone, hits, 1)
                np.add.at(gone, hits + length, -1)
        keep = np.cumsum(gone)[:-1] == 0
        edge = np.zeros(n + 1, bool)
        edge[s.off] = True
        begins = ~keep
        begins[1:] &= keep[:-1] | edge[1:n]
        spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[s.off])
        n_kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[s.off])
        kept = [s.buf[a:b][keep[a:b]].tobytes() for a, b in zip(s.off[:-1], s.off[1:], strict=True)]
        n_bytes = np.diff(s.off)
        return pa.table({"doc_id": pa.array(s.ids, left.schema.field("doc_id").type), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_bytes - n_kept, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    one = groups.groupBy("g").applyInArrow(first, X.SENT).groupBy("b").applyInArrow(decide, X.SENT)
    two = groups.groupBy("g").cogroup(one.groupBy("g")).applyInArrow(second, X.SENT).groupBy("kind", "b").applyInArrow(compare, X.SENT)
    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return groups.groupBy("g").cogroup(one.unionAll(two).groupBy("g")).applyInArrow(last, out)


def _spread(s: Stretches, state: np.ndarray, length: int, n_buckets: int):
    """Suffixes under hot anchors: their distinct keys in order, each suffix's first byte, whether it asks, its key, and the keys' dealing."""
    e = np.flatnonzero(state & SPREAD) if len(state) else np.zeros(0, np.int64)
    if not len(e):
        return None, e, e, e, None
    of, at = s.windows(e)
    keys = Exact(s.buf).spans(at, at + length)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    head = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
    place = np.zeros(len(order), np.int64)
    place[order] = np.cumsum(head) - 1
    own = np.ascontiguousarray(keys[head].T)
    return own, at, (state[e][of] & ASK) > 0, place, X.dealt(own[0], n_buckets)


def _sorted(table: pa.Table, length: int) -> pa.Table:
    """Sorts a bucket's suffixes, anchor by anchor, in blocks; replies which repeat."""
    z = zstandard.ZstdDecompressor()
    parts = [X.unpack(x) for x in table.column("body").to_pylist()]
    under, n, lead = (np.concatenate([p[k] for p in parts]) for k in range(3))
    size = n + length - 1
    raw = np.concatenate([np.frombuffer(z.decompress(p[3].tobytes()), np.uint8) for p in parts])
    begin = np.cumsum(size) - size
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    order = np.argsort(under, kind="stable")
    heads = np.flatnonzero(np.r_[True, under[order][1:] != under[order][:-1], True])
    a = 0
    while a < len(heads) - 1:
        z_ = a + 1
        total = size[order[heads[a] : heads[z_]]].sum()
        while z_ < len(heads) - 1 and total < BLOCK_BYTES:
            total += size[order[heads[z_] : heads[z_ + 1]]].sum()
            z_ += 1
        own = order[heads[a] : heads[z_]]
        of, k = ragged(size[own])
        buf = raw[begin[own][of] + k]
        stop = np.cumsum(size[own])
        which, k = ragged(n[own])
        starts = (stop - size[own])[which] + k
        rank = sort_block(buf, stop[of], starts, length)
        out[first[own][which] + k] = np.bincount(rank)[rank] > 1
        a = z_
    return X.bits_reply(table, 1, X.split(out, [int(p[1].sum()) for p in parts]))


def _counted(table: pa.Table, length: int) -> pa.Table:
    parts = [X.unpack(x) for x in table.column("body").to_pylist()]
    k, x, many = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((x, k))
    k, x = k[order], x[order]
    same = np.r_[False, (k[1:] == k[:-1]) & (x[1:] == x[:-1]), False]
    out = many.astype(bool)
    out[order] |= same[1:] | same[:-1]
    return X.bits_reply(table, 2, X.split(out, [len(p[0]) for p in parts]))
