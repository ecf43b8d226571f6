import re
from collections import Counter

from lexquarry.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_match_brute_force(frame, corpus):
    texts = [*corpus, "a b c a b c", "x\nx\n\n \nx \nx", "# * é$ %", "\n\n", "a b c\na b c\r\na b c", "ñandú " * 60, "one\x0btwo\x0cthree"]
    pairs = [*enumerate(texts), (None, "null id"), (3, "again"), (3, "again")]
    got = sorted(((r.doc_id, tuple(r[m] for m in quality.MEASURES)) for r in quality.ledger(frame(pairs)).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t in pairs), key=str)


def test_bits_policies_and_ablations(frame):
    good = " ".join(f"word{i}" for i in range(60))
    texts = ["short", "# " * 10 + good, " ".join(f"#{i} $%" for i in range(60)), good, "same line here\n" * 30, None]
    found = quality.ledger(frame(texts)).persist()
    bits = {r.doc_id: r.failed for r in found.collect()}
    assert bits[0] == 0b1 and bits[3] == 0 and bits[2] & 0b100 and bits[4] & 0b10 and bits[4] & 0b1000 and bits[5] & 0b1
    kept = {p: {r.doc_id for r in found.where(quality.passes(p)).collect()} for p in quality.POLICIES}
    assert kept["v1"] >= kept["v2"] >= kept["v3"] and 3 in kept["v3"]
    rules = {r.name: r for r in quality.RULES}
    for row in quality.ablations(found).collect():
        mask = quality.POLICIES[quality.CURRENT]
        without = mask & ~(1 << rules[row.rule].bit)
        assert row.n_kept == sum(b & mask == 0 for b in bits.values())
        assert row.n_kept_without == sum(b & without == 0 for b in bits.values())
        assert row.n_failed == sum(b >> rules[row.rule].bit & 1 for b in bits.values())


def test_empty_table(frame):
    assert quality.ledger(frame([])).collect() == []
    assert {r.n_kept for r in quality.ablations(quality.ledger(frame([]))).collect()} == {0}
