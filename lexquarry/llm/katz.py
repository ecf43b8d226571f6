"""Katz backoff language model: counts, discounts, backoff weights and scores over a whole corpus.

P_k(w | h), for a context h of k - 1 tokens, is d(c) c(hw) / c(h) where hw was counted c > 0 times, and else
alpha(h) P_{k-1}(w | h without its first token). d is the Good-Turing discount for counts up to K (1 above), from the
counts of counts of k-grams; alpha(h) = (mass that discounts left) / (1 - sum of P_{k-1}(w | h') over the counted w), so
that the probabilities of each context sum to exactly 1 over the vocabulary and one class of unknown words. At the end
of the recursion P_1(w) = d(c) c / N, and the mass that is left goes to the class of unknown words.

Counts are exchanged as hashes between groups of documents and buckets of n-grams (exchange.py). Buckets write the
n-gram table, partitioned by order and bucket, into the shared folder, and tell each group the counts of its n-grams and
which of them it owns (the first group that counted it). The sums for alpha(h) run over all n-grams under h, so owners
add theirs up per context and exchange those sums; their buckets write the table of backoff weights. Each order is one
such exchange, on top of the probabilities of the order below. `scored` trains and scores one table in this way; `fit`
returns the model, and `scored_with` asks the stored tables for the n-grams and contexts of other texts.

Words are lower-cased in A-Z; n-grams are told apart by 64-bit hashes, so that of n different ones about n * n / 2**65
pairs meet. Texts begin with start symbols, which are
never predicted, and end with an end token. Defined cases: null and empty texts are the end token alone; without
training text every token is unknown and has probability 1; where discounts leave nothing, one count is added to the
context for what was not seen; discounts that Good-Turing leaves outside (0, 1] are replaced by (r - 0.5) / r. A row
is scored for each row given, whatever its id. A text stays in one group, in memory of about 60 times its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import exchange as X
from lexquarry.llm.tables import text_bytes, written
from lexquarry.llm.text import LOWER, hashed, mix, words_of

ORDER = 2
GROUP_BYTES = 5 << 20
"""Larger than elsewhere: a group sends each of its n-grams once, and these are most of what is exchanged."""
K = 5
_END, _START = np.uint64(0x1CE1CE1CE1CE1CE1), np.uint64(0x57A127ED57A127ED)
_STEP = np.uint64(0x9E3779B97F4A7C15)
COUNTS, WEIGHTS, STATS, TABLE, ALPHA = 0, 100, 200, 300, 400
"""Kinds of rows; the order of the n-grams is added. Replies: COUNTS, WEIGHTS. Stored: TABLE, ALPHA."""
TOLD = f"{X.SENT}, stats array<bigint>"


@dataclass(frozen=True)
class Levels:
    """What the corpus says about n-grams of each order: training tokens, distinct words, discounts by count, left-over unigram mass."""

    tokens: int
    words: int
    discount: dict[int, np.ndarray]
    extra: float
    unknown: float


def discounts(of_counts: np.ndarray, k: int = K) -> np.ndarray:
    """d(0..k): Good-Turing with Katz's cut, from the numbers of n-grams counted 1 .. k + 1 times (index 0 unused)."""
    n = of_counts.astype(float)
    out = np.ones(k + 1)
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else -1.0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0) * c


def levels(stats: dict[int, np.ndarray], k: int = K) -> Levels:
    """stats: by order, the numbers of n-grams counted 1 .. k + 1 times, then the sum of counts and the number of n-grams."""
    d = {o: discounts(np.r_[0, s[: k + 1]], k) for o, s in stats.items()}
    n, words, of = int(stats[1][k + 1]), int(stats[1][k + 2]), stats[1][: k + 1]
    left = float(sum((1 - d[1][r]) * r * of[r - 1] for r in range(1, k + 1)))
    extra = 0.0 if left > 0 else 1.0
    return Levels(n, words, d, extra, (left + extra) / (n + extra))


class Grams:
    """A group's tokens and its distinct n-grams and contexts of each order."""

    def __init__(self, table: pa.Table, order: int):
        self.ids, buf, off, train = X.flagged(table)
        buf = LOWER[buf]
        start, end, first = words_of(buf, off)
        rows = len(self.ids)
        words = np.diff(first)
        self.n_tokens = words + 1
        self.first = np.concatenate([[0], np.cumsum(self.n_tokens)])
        self.row = np.repeat(np.arange(rows), self.n_tokens)
        token = np.full(len(self.row), _END)
        token[np.arange(len(start)) + np.repeat(np.arange(rows), words)] = hashed(buf, start, end, 1)
        self.train = train[self.row]
        place = np.arange(len(token)) - self.first[self.row]
        self.keys, self.at, self.count, self.context, self.context_at = {}, {}, {}, {}, {}
        behind = np.zeros(len(token), np.uint64)
        for k in range(1, order + 1):
            if k > 1:
                back = np.full(len(token), _START)
                back[k - 1 :][place[k - 1 :] >= k - 1] = token[: -(k - 1)][place[k - 1 :] >= k - 1]
                behind = mix(behind * _STEP + back + np.uint64(k))
                self.context[k], self.context_at[k] = np.unique(behind, return_inverse=True)
            self.keys[k], self.at[k] = np.unique(mix(behind + token * _STEP), return_inverse=True)
            self.count[k] = np.bincount(self.at[k][self.train], minlength=len(self.keys[k])).astype(np.int64)
        # a context is the same for all tokens that follow it, and an n-gram has one context and one shorter n-gram
        self.some = {k: self._one_of(k) for k in range(1, order + 1)}

    def _one_of(self, k: int) -> np.ndarray:
        """For each distinct n-gram, one token that ends it."""
        out = np.zeros(len(self.keys[k]), np.int64)
        out[self.at[k]] = np.arange(len(self.at[k]))
        return out


@dataclass(frozen=True)
class Model:
    """A trained model: rows (kind, b, g, body) of the stored tables, and what the corpus says."""

    table: DataFrame
    levels: Levels
    order: int
    n_buckets: int


def _rows(table: pa.Table, *columns: str) -> list[tuple]:
    """Rows in a fixed order, so that reruns add up alike."""
    return sorted(zip(*(table.column(c).to_pylist() for c in columns), strict=True))


def _out(rows: list[tuple[int, int, int, bytes, list[int] | None]]) -> pa.Table:
    kind, b, g, body, stats = zip(*rows, strict=True)
    return pa.table({"kind": pa.array(kind, pa.int32()), "b": pa.array(b, pa.int32()), "g": pa.array(g, pa.int32()), "body": pa.array(body, pa.binary()), "stats": pa.array(stats, pa.list_(pa.int64()))})


def _sender(order: int, n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        own, g, out = Grams(table, order), table.column("g")[0].as_py(), []
        for o in range(1, order + 1):
            cuts, count = X.dealt(own.keys[o], n_buckets), own.count[o].astype(np.uint32)
            out.append(X.sent(COUNTS + o, g, [(b, X.pack(X.planes(own.keys[o][i:j]), count[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]))
        return pa.concat_tables(out)

    return send


def _totaller(k: int):
    def total(table: pa.Table) -> pa.Table:
        o, b = table.column("kind")[0].as_py() - COUNTS, table.column("b")[0].as_py()
        rows = _rows(table, "g", "body")
        parts = [X.unpack(r[1]) for r in rows]
        keys = np.concatenate([X.keys_of(p[0]) for p in parts])
        count = np.concatenate([p[1] for p in parts]).astype(np.int64)
        order_ = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.r_[True, keys[order_][1:] != keys[order_][:-1]])
        n = np.diff(np.r_[heads, len(keys)])
        sums = np.add.reduceat(count[order_], heads)
        # the owner: the first group with a count
        upto = np.cumsum(count[order_]) - count[order_]
        owns = np.zeros(len(keys), bool)
        owns[order_] = (count[order_] > 0) & (upto == np.repeat(upto[heads], n))
        totals = np.zeros(len(keys), np.int64)
        totals[order_] = np.repeat(sums, n)
        sizes = [len(p[1]) for p in parts]
        counted = sums > 0
        of = np.bincount(np.minimum(sums[counted], k + 2), minlength=k + 3)[1 : k + 2]
        stats = [*of.tolist(), int(sums.sum()), int(counted.sum())]
        out = [(COUNTS + o, b, g, X.pack(t, np.packbits(w), np.array([len(w)], np.int64)), None) for (g, _), t, w in zip(rows, X.split(totals, sizes), X.split(owns, sizes), strict=True)]
        return _out([*out, (STATS + o, b, -1, b"", stats), (TABLE + o, b, -1, X.pack(X.planes(keys[order_][heads][counted]), sums[counted]), None)])

    return total


def _probability(own: Grams, right: pa.Table, upto: int, known: Levels, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token at order `upto`, and the count of its word."""
    p = words = np.zeros(0)
    for o in range(1, upto + 1):
        c = X.answers(X.replies(right, COUNTS + o), X.dealt(own.keys[o], n_buckets))
        seen = discounted(c, known.discount[o])[own.at[o]]
        if o == 1:
            words = c[own.at[1]]
            p = np.where(seen > 0, seen / max(known.tokens + known.extra, 1), known.unknown)
        else:
            cuts, got = X.dealt(own.context[o], n_buckets), X.replies(right, WEIGHTS + o)
            whole, alpha = (X.answers(got, cuts, i)[own.context_at[o]] for i in (0, 1))
            p = np.where(seen > 0, seen / np.maximum(whole, 1), alpha * p)
    return p, words


def _summer(o: int, order: int, known: Levels, n_buckets: int):
    """Per context, what the n-grams that a group owns add to its weight."""

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Grams(left, order)
        p, _ = _probability(own, right, o - 1, known, n_buckets)
        got, cuts = X.replies(right, COUNTS + o), X.dealt(own.keys[o], n_buckets)
        c = X.answers(got, cuts)
        mine = np.flatnonzero(X.bits({b: x[1:] for b, x in got.items()}, cuts))
        token = own.some[o][mine]
        context, n = own.context_at[o][token], len(own.context[o])
        whole = np.bincount(context, c[mine], n).astype(np.int64)
        left_ = np.bincount(context, c[mine] - discounted(c[mine], known.discount[o]), n)
        below = np.bincount(context, p[token], n)
        keys, cuts = own.context[o], X.dealt(own.context[o], n_buckets)
        return X.sent(WEIGHTS + o, left.column("g")[0].as_py(), [(b, X.pack(X.planes(keys[i:j]), whole[i:j], left_[i:j], below[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j])

    return sums


def _weigh(table: pa.Table) -> pa.Table:
    rows = _rows(table, "g", "kind", "b", "body")
    parts = [X.unpack(r[3]) for r in rows]
    keys, sizes = np.concatenate([X.keys_of(p[0]) for p in parts]), [len(p[1]) for p in parts]
    order_ = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.r_[True, keys[order_][1:] != keys[order_][:-1]])
    whole, left, below = (np.add.reduceat(np.concatenate([p[i] for p in parts])[order_], heads).astype(np.float64) for i in (1, 2, 3))
    extra = ((left < 1e-9) & (whole > 0)).astype(np.float64)
    whole, left = whole + extra, left + extra
    alpha = np.where(whole > 0, left / np.maximum(whole, 1) / np.maximum(1 - below, 1e-12), 1.0)
    n, out = np.diff(np.r_[heads, len(keys)]), []
    for x in (whole, alpha):
        full = np.zeros(len(keys))
        full[order_] = np.repeat(x, n)
        out.append(X.split(full, sizes))
    kind, b, counted = rows[0][1], rows[0][2], whole > 0
    replies = [(k, b, g, X.pack(w, a), None) for (g, k, b, _), w, a in zip(rows, *out, strict=True)]
    return _out([*replies, (kind - WEIGHTS + ALPHA, b, -1, X.pack(X.planes(keys[order_][heads][counted]), whole[counted], alpha[counted]), None)])


def _trained(groups: DataFrame, order: int, k: int, n_buckets: int) -> tuple[DataFrame, Model]:
    """The replies to every group, and the model: a written table for the counts, and one for the weights of each order."""
    counts = written(groups.groupBy("g").applyInArrow(_sender(order, n_buckets), X.SENT).groupBy("kind", "b").applyInArrow(_totaller(k), TOLD), "katz-counts", ["kind", "b"])
    sums = counts.where(f"kind > {STATS} AND kind < {TABLE}").groupBy("kind").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(k + 3))).collect()
    stats = {o: np.zeros(k + 3, np.int64) for o in range(1, order + 1)} | {r[0] - STATS: np.array(r[1:], np.int64) for r in sums}
    known = levels(stats, k)
    row = ("kind", "b", "g", "body")
    told, stored = counts.where(f"kind < {WEIGHTS}").select(*row), counts.where(f"kind > {TABLE}").select(*row)
    for o in range(2, order + 1):
        weights = written(groups.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_summer(o, order, known, n_buckets), X.SENT).groupBy("kind", "b").applyInArrow(_weigh, TOLD), "katz-weights", ["kind", "b"])
        told = told.unionAll(weights.where(f"kind < {STATS}").select(*row))
        stored = stored.unionAll(weights.where(f"kind > {ALPHA}").select(*row))
    return told, Model(stored, known, order, n_buckets)


def _scores(groups: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    known, order, n_buckets = model.levels, model.order, model.n_buckets

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Grams(left, order)
        p, c = _probability(own, right, order, known, n_buckets)
        n = len(own.ids)
        base = np.log10((c + 0.1) / (known.tokens + 0.1 * (known.words + 1)))
        return pa.table({
            "doc_id": pa.array(own.ids, left.schema.field("doc_id").type),
            "n_tokens": pa.array(own.n_tokens, pa.int64()),
            "n_known": pa.array(np.bincount(own.row[c > 0], minlength=n), pa.int64()),
            "train_tokens": pa.array(np.full(n, known.tokens), pa.int64()),
            "base_score": pa.array(np.bincount(own.row, base, n)),
            "score": pa.array(np.bincount(own.row, np.log10(p), n)),
        })

    out = f"doc_id {groups.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return groups.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(score, out)


def _dealing(docs: DataFrame, text: str, n_groups: int | None) -> tuple[int, int]:
    """Groups, and buckets of about 20 MB of text."""
    _, size = text_bytes(docs, text)
    n_groups = n_groups or X.groups_for(size, GROUP_BYTES)
    return n_groups, max(1, min(n_groups, -(-size // (20 << 20)) + 15))


def scored(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, k: int = K, n_groups: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row; counts come from the rows where `train` holds."""
    n_groups, n_buckets = _dealing(docs, text, n_groups)
    groups = X.grouped(docs, n_groups, doc_id, text, F.coalesce(train, F.lit(False)))
    return _scores(groups, *_trained(groups, order, k, n_buckets))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, k: int = K, n_groups: int | None = None) -> Model:
    """The model of all rows."""
    n_groups, n_buckets = _dealing(docs, text, n_groups)
    return _trained(X.grouped(docs, n_groups, doc_id, text, F.lit(True)), order, k, n_buckets)[1]


def scored_with(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", n_groups: int | None = None) -> DataFrame:
    """The columns of `scored` for other texts, from the stored tables: each group asks the buckets of its n-grams."""
    groups = X.grouped(docs, _dealing(docs, text, n_groups)[0], doc_id, text)
    order, n_buckets = model.order, model.n_buckets

    def ask(table: pa.Table) -> pa.Table:
        own, g, out = Grams(table, order), table.column("g")[0].as_py(), []
        for kind, keys in [(TABLE + o, own.keys[o]) for o in own.keys] + [(ALPHA + o, own.context[o]) for o in own.context]:
            cuts = X.dealt(keys, n_buckets)
            out.append(X.sent(kind, g, [(b, X.pack(X.planes(keys[i:j]))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]))
        return pa.concat_tables(out)

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return X.sent(0, -1, [])
        kind, b = (x.as_py() for x in key)
        parts = [X.unpack(x) for x in right.column("body").to_pylist()]
        keys = np.concatenate([X.keys_of(p[0]) for p in parts] or [np.zeros(0, np.uint64)])
        out = []
        for g, body in _rows(left, "g", "body"):
            asked = X.keys_of(X.unpack(body)[0])
            at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            found = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
            values = [np.where(found, p[at], 0 if kind < ALPHA or i == 0 else 1.0) if len(keys) else np.full(len(asked), 0.0 if i == 0 else 1.0) for i, p in enumerate(parts[0][1:])] if parts else [np.zeros(len(asked)), np.ones(len(asked))]
            out.append((kind - TABLE + COUNTS if kind < ALPHA else kind - ALPHA + WEIGHTS, b, g, X.pack(*(v.astype(np.int64 if kind < ALPHA else np.float64) for v in values))))
        kinds, bs, gs, bodies = zip(*out, strict=True)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "b": pa.array(bs, pa.int32()), "g": pa.array(gs, pa.int32()), "body": pa.array(bodies, pa.binary())})

    asked = groups.groupBy("g").applyInArrow(ask, X.SENT)
    told = asked.groupBy("kind", "b").cogroup(model.table.groupBy("kind", "b")).applyInArrow(answer, X.SENT)
    return _scores(groups, told, model)
