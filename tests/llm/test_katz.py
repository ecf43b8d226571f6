import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexquarry.llm import katz

K = 5


class Brute:
    """Katz backoff with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.count = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            w = self.tokens(t)
            for o in range(1, order + 1):
                padded = ["<s>"] * (o - 1) + w
                self.count[o].update(tuple(padded[i : i + o]) for i in range(len(w)))
        self.n = sum(self.count[1].values())
        self.d = [None]
        for o in range(1, order + 1):
            of = Counter(self.count[o].values())
            cut = (K + 1) * of[K + 1] / of[1] if of[1] else 1.0
            d = [1.0]
            for r in range(1, K + 1):
                x = ((r + 1) * of[r + 1] / (r * of[r]) - cut) / (1 - cut) if of[r] and cut < 1 else -1
                d.append(x if 0 < x <= 1 else (r - 0.5) / r)
            self.d.append(d)
        left = sum(c - self.seen(1, c) for c in self.count[1].values())
        self.extra = 0 if left > 0 else 1
        self.unknown = (left + self.extra) / (self.n + self.extra)
        self.after = [None, None] + [defaultdict(dict) for _ in range(2, order + 1)]
        for o in range(2, order + 1):
            for g, c in self.count[o].items():
                self.after[o][g[:-1]][g[-1]] = c

    @staticmethod
    def tokens(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", t) + ["</s>"]

    def seen(self, o, c):
        return (self.d[o][c] if c <= K else 1.0) * c

    def p(self, context, w):
        o = len(context) + 1
        if o == 1:
            c = self.count[1][(w,)]
            return self.seen(1, c) / (self.n + self.extra) if c else self.unknown
        after = self.after[o].get(context, {})
        if not after:
            return self.p(context[1:], w)
        total = sum(after.values())
        left = sum(c - self.seen(o, c) for c in after.values())
        extra = 1 if left < 1e-9 else 0
        if w in after:
            return self.seen(o, after[w]) / (total + extra)
        below = sum(self.p(context[1:], x) for x in after)
        return (left + extra) / (total + extra) / (1 - below) * self.p(context[1:], w)

    def score(self, t):
        w = ["<s>"] * (self.order - 1) + self.tokens(t)
        return sum(math.log10(self.p(tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


@pytest.mark.parametrize(("order", "n_groups"), [(1, 2), (2, 1), (2, 5), (3, 4)])
def test_matches_brute_force(frame, corpus, order, n_groups):
    docs = frame(corpus)
    held = F.col("doc_id") % 4 == 0
    found = {r.doc_id: r for r in katz.scored(docs, ~held, order=order, n_groups=n_groups).collect()}
    model = Brute([t for i, t in enumerate(corpus) if i % 4], order)
    v = len(model.count[1])
    assert len(found) == len(corpus)
    for i, t in enumerate(corpus):
        w = model.tokens(t)
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum((x,) in model.count[1] for x in w), model.n)
        assert r.base_score == pytest.approx(sum(math.log10((model.count[1][(x,)] + 0.1) / (model.n + 0.1 * (v + 1))) for x in w))
        if len(w) < 500:
            assert r.score == pytest.approx(model.score(t)), i


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_tables_score_as_training_does(frame, corpus, order):
    docs = frame(corpus)
    known = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False))
    model = katz.fit(docs.where(known), order=order, n_groups=3)
    want = {r.doc_id: r for r in katz.scored(docs, known, order=order, n_groups=5).collect()}
    found = {r.doc_id: r for r in katz.scored_with(docs, model, n_groups=2).collect()}
    assert len(found) == len(want)
    for i, r in found.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[i].n_tokens, want[i].n_known, want[i].train_tokens)
        assert r.score == pytest.approx(want[i].score) and r.base_score == pytest.approx(want[i].base_score)
    kinds = {r.kind for r in model.table.select("kind").distinct().collect()}
    assert kinds == {katz.TABLE + o for o in range(1, order + 1)} | {katz.ALPHA + o for o in range(2, order + 1)}


def test_stored_model_of_nothing(frame):
    model = katz.fit(frame([]))
    assert [(r.n_tokens, r.n_known, r.score) for r in katz.scored_with(frame(["a b"]), model).collect()] == [(3, 0, 0.0)]
    assert katz.scored_with(frame([]), model).collect() == []


def test_each_context_sums_to_one(corpus):
    model = Brute(corpus, 3)
    words = [g[0] for g in model.count[1]] + ["<never seen>"]
    for context in [(), ("one",), ("<s>", "<s>"), *list(model.after[3])[:5], *list(model.after[2])[:5], ("no", "such")]:
        assert sum(model.p(context, w) for w in words) == pytest.approx(1)


def test_without_training_text_and_empty_table(frame):
    rows = katz.scored(frame(["a b", None]), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in sorted(rows, key=lambda r: -r.n_tokens)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert katz.scored(frame([]), F.lit(True)).collect() == []
