import random
import re

import pytest

from lexquarry.llm import decontamination as D

ITEMS = {1: "The quick brown fox jumps over the lazy dog while the band plays on through the night", 2: "Ein langer deutscher Satz, der viele Wörter enthält und gut zu finden sein sollte, auch mit Fehlern", 3: "tiny one", 4: None, 5: ""}


def edits(pattern, text):
    """Least edit distance to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance_is_exact():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abé") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abé") for _ in range(rng.randint(0, 120)))
        d, end = D.distance(D.masks(p), len(p), t)
        assert d == edits(p, t)
        if d < len(p):
            assert edits(p, t[:end]) == d


def noisy(text, n, rng):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], [t[k], "q"], ["z"]])
    return "".join(t)


def test_matches_brute_force(spark, frame):
    rng = random.Random(3)
    filler = "some other words that are not in any item at all "
    texts = [None, "", "tiny one", "Tiny   ONE", "a tiny one inside", "a tiny ones", "untiny one", "tiny one, (tiny one)", "tiny onetiny one tiny one"]
    for i in (1, 2):
        m = ITEMS[i]
        for n in range(0, 9):
            texts.append(filler * rng.randint(0, 3) + noisy(m, n, rng).upper().replace(" ", "\n " if n % 2 else " ") + " " + filler)
        texts += [m[: len(m) // 2] + filler, m, filler + m + filler + m, ITEMS[1] + " " + ITEMS[2]]
    docs = frame(texts)
    benchmark = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    got = {r.doc_id: {(x.item_id, x.distance) for x in r["items"]} for r in D.matched(docs, benchmark).collect()}
    for k, t in enumerate(texts):
        want = set()
        for i, item in ITEMS.items():
            n, text = D.normal(item), D.normal(t)
            if n and not D.edits(n):
                want |= {(i, 0)} if re.search(rf"(?<!\w){n}(?!\w)", text) else set()
            elif n and text and (d := edits(n, text)) <= int(len(n) * D.BUDGET):
                want.add((i, d))
        assert got[k] == want, (k, t)


@pytest.mark.parametrize("size", [19, 20, 23, 24, 25, 40])
def test_both_sides_of_the_first_edit(spark, frame, size):
    item = "abcdefghij klmnopqrst uvwxyz ABCDEFGHIJ KLMN"[:size].strip()
    texts = [f"say {item} twice {item}", f"say {item}", item[:5] + "#" + item[5:], "nothing"]
    found = [{(x.item_id, x.distance) for x in r["items"]} for r in D.matched(frame(texts), spark.createDataFrame([(1, item)], "item_id long, text string")).orderBy("doc_id").collect()]
    assert found == [{(1, 0)}, {(1, 0)}, {(1, 1)} if len(item) >= 20 else set(), set()]


@pytest.mark.parametrize("block", [10, 120])
def test_benchmark_in_blocks(spark, frame, monkeypatch, block):
    docs = frame([ITEMS[1], ITEMS[2], "nothing"])
    benchmark = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    whole = [r["items"] for r in D.matched(docs, benchmark).orderBy("doc_id").collect()]
    monkeypatch.setattr(D, "BLOCK", block)
    assert [r["items"] for r in D.matched(docs, benchmark).orderBy("doc_id").collect()] == whole


def test_empty_tables_and_columns(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matched(frame([]), none).collect() == []
    out = D.matched(frame([(None, "x"), (1, None)]), none)
    assert out.columns[:-1] == frame([]).columns and [r["items"] for r in out.collect()] == [[], []]
