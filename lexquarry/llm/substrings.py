"""Removal of repeated word windows by level-wise doubling.

A window of `width` words can only repeat where shorter windows inside it do. The first level takes windows of half the
length, and of these only the ones with the smallest hash in some full window (equal full windows pick the same one);
only full windows whose pick occurs in two documents are extended to twice that length, up to `width`, and compared
there. From then on, windows that start in two documents, and those alone, are extended to twice their length: the one
from word i repeats at length 2L only if those from i and i + L repeat at length L. Levels follow until no candidate
survives; the last at which a document has a survivor is its `longest`.

Each level is one exchange of hashes (see exchange.py). The texts take part up to `width`; later levels read and write
tables of the survivors alone, so their work shrinks with them.

A window goes where the same words also start in a document with a smaller id. Words have two independent hashes of 64
bits, and windows of 7 words and more are told apart by both: 128 bits. Defined cases: null and empty texts have no
words; a null id counts as larger than every id; rows with the same id (or none) are one document and don't remove each
other's words; texts shorter than a window stay whole. Extra columns are ignored. A group holds about GROUP_BYTES of text,
or one document; a text stays in one group, in memory of about 60 times its bytes.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import exchange as X
from lexquarry.llm.tables import forget, has, text_bytes, written
from lexquarry.llm.text import first_min, hashed, joined, runs, words_of
from lexquarry.ship import ship

WIDTH = 13
GROUP_BYTES = 2 << 20
PART = 1 << 15
"""Windows in a row of the tables between levels."""
_LOW = np.uint64(0xFFFFFFFF)
_PLACE, _ONE = np.uint64(40), np.uint64(1)
"""Bits of a word's place in its text."""
PICKS, FULL = -2, -1
"""Kinds of replies up to `width`; later the kind is the length. In tables, rows that reach a length have that kind, and the
candidates of a length its negative."""


def _picks(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Full windows (their first word), and the hash each picks."""
    half = (width + 1) // 2
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = runs(words, half)
    # the upper half of the hash decides, ties by place
    key = (short & ~_LOW) | np.arange(len(short), dtype=np.uint64)
    pick = (first_min(key, width - half + 1)[:n] & _LOW).astype(np.int64)
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return at, short[pick[at]]


def _ordered(key: np.ndarray, rest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by several keys, and which places in it begin a new one."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    head = np.ones(len(order), bool)
    if len(order):
        head[1:] = sorted_[1:] != sorted_[:-1]
        for other in rest:
            o = other[order]
            if (~head[1:] & (o[1:] != o[:-1])).any():  # two keys that meet in the first hash
                order = np.lexsort((np.arange(len(key)), *rest, key))
                head[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in (key, *rest)])
                break
    return order, head


class Keys:
    """The distinct keys of some windows in order: where each window's key is, and the documents it starts in."""

    def __init__(self, keys: list[np.ndarray], number: np.ndarray, n_buckets: int):
        """keys: one or two hashes of each window; number: of its document, in order of ids, as the windows are."""
        order, head = _ordered(keys[0], keys[1:])
        heads, sorted_ = np.flatnonzero(head), number[order]
        self.keys = [k[order][heads] for k in keys]
        self.place = np.zeros(len(order), np.int64)
        self.place[order] = np.cumsum(head) - 1
        self.least = sorted_[heads]
        self.many = self.least != sorted_[np.r_[heads[1:], len(order)][: len(heads)] - 1]
        self.cuts = X.dealt(self.keys[0], n_buckets)

    def sent(self, kind: int, g: int, ids: list | None = None) -> pa.Table:
        """ids: of the documents by number, for a bucket that asks which came first."""
        out = []
        null = np.array([i is None for i in ids or []], np.uint8)
        known = np.array([0 if i is None else i for i in ids or []], np.int64)
        for b, (i, j) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            if i < j:
                first = [X.planes(self.keys[0][i:j]), self.many[i:j].astype(np.uint8)]
                rest = [k[i:j] for k in self.keys[1:]]
                out.append((b, X.pack(*first, *rest, *([known[self.least[i:j]], null[self.least[i:j]]] if ids is not None else []))))
        return X.sent(kind, g, out)


def _numbers(ids: list) -> tuple[np.ndarray, list]:
    """A number for each row's document, in order of ids (null last), and the ids by number. ids are in order."""
    new = [k == 0 or a != ids[k - 1] for k, a in enumerate(ids)]
    return np.cumsum(new, dtype=np.int64) - 1 if ids else np.zeros(0, np.int64), list(compress(ids, new))


class Level:
    """What a group knows of its text, made anew in each pass."""

    def __init__(self, table: pa.Table, width: int, n_buckets: int):
        self.ids, self.buf, self.off = X.opened(table)
        self.start, self.end, self.first = words_of(self.buf, self.off)
        self.words = list(hashed(self.buf, self.start, self.end, halves=2).T)
        self.number, self.known = _numbers(self.ids)
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.at, picked = _picks(self.words[0], self.row, width)
        self.keys = Keys([picked & ~np.uint64(0xFF)], self.number[self.row[self.at]], n_buckets)

    def extend(self, repeated: np.ndarray, width: int, n_buckets: int) -> None:
        """Keeps the full windows whose pick is repeated, and hashes all their words."""
        if len(self.at):
            self.at = self.at[repeated[self.keys.place]]
        self.full = [runs(w, width)[self.at] if len(self.at) else np.zeros(0, np.uint64) for w in self.words]
        self.keys = Keys(self.full, self.number[self.row[self.at]], n_buckets)


def _g(table: pa.Table) -> int:
    return table.column("g")[0].as_py()


def _shared(table: pa.Table) -> pa.Table:
    """A bucket's reply: which keys occur in two groups, or in two documents of one."""
    parts = [X.unpack(x) for x in table.column("body").to_pylist()]
    keys, many = (np.concatenate(x) for x in ([X.keys_of(p[0]) for p in parts], [p[1] for p in parts]))
    order = np.argsort(keys)
    same = np.r_[False, keys[order][1:] == keys[order][:-1], False]
    twice = many.astype(bool)
    twice[order] |= same[1:] | same[:-1]
    return X.bits_reply(table, table.column("kind")[0].as_py(), X.split(twice, [len(p[1]) for p in parts]))


def _earlier(table: pa.Table) -> pa.Table:
    """Which keys start in a document before the group's own first, and which start in two documents: two bits a key."""
    parts = [X.unpack(x) for x in table.column("body").to_pylist()]
    key = np.concatenate([X.keys_of(p[0]) for p in parts])
    many, other, ids, null = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
    order, head = _ordered(key, [other])
    ids, null = np.where(null > 0, np.iinfo(np.int64).max, ids)[order], null[order]
    heads = np.flatnonzero(head)
    n = np.diff(np.r_[heads, len(key)])
    after = (null > np.repeat(np.minimum.reduceat(null, heads), n)) | (ids > np.repeat(np.minimum.reduceat(ids, heads), n))
    two = np.repeat(np.logical_or.reduceat(after | (many[order] > 0), heads), n)
    out = np.zeros((len(key), 2), bool)
    out[order, 0], out[order, 1] = after, two
    return X.bits_reply(table, table.column("kind")[0].as_py(), [p.ravel() for p in X.split(out, [len(p[1]) for p in parts])])


def _two_bits(right: pa.Table, kind: int, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    got = X.replies(right, kind)
    both = X.answers({b: [np.unpackbits(x[0], count=int(x[1][0])).reshape(-1, 2)] for b, x in got.items()}, keys.cuts).astype(bool).reshape(-1, 2)
    return both[:, 0], both[:, 1]


@dataclass
class Windows:
    """A group's windows of one length that may start in two documents."""

    row: np.ndarray
    place: np.ndarray
    number: np.ndarray
    hashes: list[np.ndarray]
    known: list
    """The ids of the documents, by number."""

    def packed(self) -> list[bytes]:
        """In parts of PART windows, in order."""
        null = np.array([i is None for i in self.known], np.uint8)
        ids = np.array([0 if i is None else i for i in self.known], np.int64)
        key, number = self.row.astype(np.uint64) << _PLACE | self.place.astype(np.uint64), self.number.astype(np.uint32)
        cuts = range(0, len(key), PART)
        return [X.pack(X.planes(key[a : a + PART]), number[a : a + PART], *(h[a : a + PART] for h in self.hashes), ids, null) for a in cuts]

    @staticmethod
    def of(table: pa.Table) -> Windows:
        parts = [X.unpack(x) for _, x in sorted(zip(table.column("b").to_pylist(), table.column("body").to_pylist(), strict=True))]
        key, number, *hashes = (np.concatenate(x) for x in zip(*((X.keys_of(p[0]), *p[1:4]) for p in parts), strict=True))
        *_, ids, null = parts[0]
        return Windows((key >> _PLACE).astype(np.int64), (key & ((_ONE << _PLACE) - _ONE)).astype(np.int64), number.astype(np.int64), hashes, [None if n else i for i, n in zip(ids.tolist(), null, strict=True)])

    def kept(self, which: np.ndarray) -> Windows:
        return Windows(self.row[which], self.place[which], self.number[which], [h[which] for h in self.hashes], self.known)

    def doubled(self, length: int) -> Windows:
        """Those of twice the length whose halves are both here."""
        key = self.row << np.int64(_PLACE) | self.place
        at = np.minimum(np.searchsorted(key, key + length), max(len(key) - 1, 0))
        go = np.flatnonzero(key[at] == key + length) if len(key) else at
        out = self.kept(go)
        out.hashes = [joined(a, h[at[go]]) for a, h in zip(out.hashes, self.hashes, strict=True)]
        return out

    def reached(self, g: int, length: int) -> pa.Table:
        """The rows that have such a window, and what the next level has to look at."""
        if not len(self.row):
            return X.sent(0, g, [])
        out, more = [X.sent(length, g, [(-1, X.pack(np.unique(self.row).astype(np.uint32)))])], self.doubled(length)
        if len(more.row):
            out.append(X.sent(-2 * length, g, list(enumerate(more.packed()))))
        return pa.concat_tables(out)


def _doubling(length: int, n_buckets: int):
    """What groups send of their windows of this length, and what they keep of them."""

    def send(table: pa.Table) -> pa.Table:
        own = Windows.of(table)
        return Keys(own.hashes, own.number, n_buckets).sent(length, _g(table), own.known)

    def survive(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Windows.of(left)
        keys = Keys(own.hashes, own.number, n_buckets)
        return own.kept(_two_bits(right, length, keys)[1][keys.place]).reached(_g(left), length)

    return send, survive


def longest(level: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Doubles until no candidate survives: g, row and longest of all rows that reach a level.

    level: a written table by kind, with the rows that reach `length` and the candidates of twice that.
    """
    reached = []
    while True:
        reached.append(level.where(F.col("kind") == length).select("g", "kind", "body"))
        state = level.where(F.col("kind") == -2 * length).select("kind", "b", "g", "body")
        length *= 2
        if not has(level, f"kind={-length}"):
            break
        send, survive = _doubling(length, n_buckets)
        asked = state.groupBy("g").applyInArrow(send, X.SENT).groupBy("b").applyInArrow(_earlier, X.SENT)
        new = written(state.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(survive, X.SENT), "substrings-level", ["kind"])
        forget(level, f"kind={-length}")
        level = new

    def rows(batches):
        for batch in batches:
            for g, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = X.unpack(body)[0]
                yield pa.record_batch({"g": pa.array([g] * len(own), pa.int32()), "row": pa.array(own.astype(np.int32)), "longest": pa.array([kind] * len(own), pa.int64())})

    ship(level.sparkSession)
    return functools.reduce(DataFrame.unionAll, reached).mapInArrow(rows, "g int, row int, longest long").groupBy("g", "row").agg(F.max("longest").alias("longest"))


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, n_groups: int | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, longest, kept_sha256 and, with `texts`, kept: the words kept, joined by one space. Ids are integers.

    longest: width doubled as often as the document has a window of that length that also starts in another; 0 if none.
    """
    _, size = text_bytes(docs, text)
    n_groups = n_groups or X.groups_for(size, GROUP_BYTES)
    n_buckets = max(1, min(n_groups, 2 * -(-size // (32 << 20)) + 15))
    groups = X.grouped(docs, n_groups, doc_id, text)
    id_kind = docs.schema[doc_id].dataType.simpleString()
    result = f"{X.SENT}, row int, doc_id {id_kind}, n_words long, n_removed long, kept string, kept_sha256 string"

    def first(table: pa.Table) -> pa.Table:
        return Level(table, width, n_buckets).keys.sent(PICKS, _g(table))

    def extended(left: pa.Table, right: pa.Table) -> Level:
        level = Level(left, width, n_buckets)
        level.extend(X.bits(X.replies(right, PICKS), level.keys.cuts), width, n_buckets)
        return level

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        level = extended(left, right)
        return level.keys.sent(FULL, _g(left), level.known)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        level, g = extended(left, right), _g(left)
        goes, n = np.zeros(len(level.start) + 1, np.int64), len(level.ids)
        more = X.sent(0, g, [])
        if len(level.at):
            keys, row = level.keys, level.row[level.at]
            number = level.number[row]
            earlier, two = (x[keys.place] for x in _two_bits(right, FULL, keys))
            gone = level.at[earlier | (number > keys.least[keys.place])]
            np.add.at(goes, gone, 1)
            np.add.at(goes, gone + width, -1)
            more = Windows(row, level.at - level.first[row], number, level.full, level.known).kept(two).reached(g, width)
        keep = np.cumsum(goes)[:-1] == 0
        raw, kept = level.buf.tobytes(), []
        for r in range(n):
            i, j = level.first[r], level.first[r + 1]
            own = raw[level.off[r] : level.off[r + 1]].split()
            kept.append(b" ".join(own if keep[i:j].all() else compress(own, keep[i:j])))
        words = np.diff(level.first)
        n_kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[level.first])
        rows = X.sent(0, g, [(-1, b"")] * n)
        for name, values in (("row", pa.array(range(n), pa.int32())), ("doc_id", pa.array(level.ids, left.schema.field("doc_id").type)), ("n_words", pa.array(words, pa.int64())), ("n_removed", pa.array(words - n_kept, pa.int64())),
                             ("kept", pa.array(kept if texts else [None] * n, pa.binary()).cast(pa.string())), ("kept_sha256", pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))):
            rows = rows.append_column(name, values)
            more = more.append_column(name, pa.nulls(more.num_rows, values.type))
        return pa.concat_tables([rows, more])

    one = groups.groupBy("g").applyInArrow(first, X.SENT).groupBy("b").applyInArrow(_shared, X.SENT)
    two = groups.groupBy("g").cogroup(one.groupBy("g")).applyInArrow(second, X.SENT).groupBy("b").applyInArrow(_earlier, X.SENT)
    level = written(groups.groupBy("g").cogroup(one.unionAll(two).groupBy("g")).applyInArrow(last, result), "substrings", ["kind"])
    found = level.where("kind = 0").select("g", "row", "doc_id", "n_words", "n_removed", "kept", "kept_sha256")
    out = found.join(longest(level, width, n_buckets), ["g", "row"], "left").select("doc_id", "n_words", "n_removed", F.coalesce("longest", F.lit(0).cast("long")).alias("longest"), "kept", "kept_sha256")
    return out if texts else out.drop("kept")
