import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, copies string, _p string"
"""The columns of documents, and some that clash with columns the operators add."""


def rows(texts, first=0):
    """(doc_id, text) pairs or texts alone, as rows of SCHEMA."""
    pairs = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return [(i, t, "en", f"src{0 if i is None else i % 3}", None, "x", "y", "z", "w") for i, t in pairs]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Texts with shared passages, exact and near copies, edge cases; deterministic."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(rng.randint(10, 60)) for _ in range(6)]
    out = [None, "", " \t\n ", "One", "one", say(3000)]
    for _ in range(60):
        parts = [say(rng.randint(0, 40)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        out.append(rng.choice([" ", "\n", " \n\t"]).join(parts))
    out += [out[10], out[10], out[11] + " more words here", out[12].replace(" ", "  ")]
    near = out[5].split()
    for k in (3, 700, 1500):
        copy = list(near)
        copy[k] = "changed"
        out.append(" ".join(copy))
    return out
