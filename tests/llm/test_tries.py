import hashlib
import random
import zlib

import pytest

from lexquarry.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, p string, n_convs long, part string, id int"
"""The columns of conversations, and some that clash with columns the operator adds."""


@pytest.fixture
def talks(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y", 7, "z", 1) for r in rows], SCHEMA)


def rebuilt(rows, graft=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    if not graft:
        return own
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(c - 100 * int(c / 100) if c < 0 else c % 100), [])[:h] + ts[h:]
    return out


def brute(rows, graft=True):
    convs = rebuilt(rows, graft)
    members, kids = {}, {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if node in kids else 1
        saved[node] = (len(members[node]) - 1) * len(node[-1][1]) * bool(node) + sum(saved[k] for k in kids.get(node, [])) if node else sum(saved[k] for k in kids.get(node, []))
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in of if len(convs[c]) == len(node))
        out.append((of[0], len(node), members[node[:-1]][0] if node else None, len(of), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def trie(docs, graft=True, **options):
    ranks = tries.numbered(tries.keyed(docs))
    return tries.nodes(tries.regrafted(ranks) if graft else tries.placed(ranks), **options)


def talk(seed, n=300, texts=6, most=9):
    rng = random.Random(seed)
    ids = [rng.randint(0, 700) for _ in range(n)] + [0, 100, 200]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([f"text {k}é" for k in range(texts)] + [None, ""])) for c in set(ids) for t in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(talks):
    rows = talk(1)
    assert found(trie(talks(rows))) == brute(rows)


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_conversations_of_many_blocks_over_many_partitions(spark, talks, block):
    rows = talk(2, n=60, texts=2, most=14)
    rows += [(900, t, "user", f"long {t // 20}") for t in range(300)] + [(901, t, "user", f"long {t // 20}") for t in range(310)] + [(902, t, "user", f"long {t // 21}") for t in range(90)]
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        assert found(trie(talks(rows), graft=False, block=block, part=500)) == brute(rows, graft=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_many_equal_conversations_are_split_over_partitions(spark, talks):
    rows = [(c, t, "user", f"t{t}") for c in range(400) for t in range(3)] + [(c, t, "user", f"t{t}") for c in range(400, 900) for t in range(2 + c % 3)]
    ranks = tries.numbered(tries.keyed(talks(rows)))
    assert ranks.count() == len(rows)
    assert found(tries.nodes(tries.placed(ranks), part=600)) == brute(rows, graft=False)


def test_ties_nulls_repeated_rows_and_lone_conversations(talks):
    rows = [(7, None, "user", "b"), (7, None, "user", "a"), (7, 1, None, None), (7, 1, None, None), (8, -3, "user", "x"), (8, -3, "user", "x"), (None, 1, "user", "gone"), (-250, 0, "user", "n"), (-250, 1, "user", "m"), (-200, 0, "user", "base")]
    rows += [(c, 0, "user", "one") for c in range(300, 400)]  # some lose their only turn; 300 is their base
    rows += [(c, 0, "user", "two") for c in range(501, 560)]  # no base: some are left without turns
    got = found(trie(talks(rows)))
    assert got == brute(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[3] == len({r[0] for r in rows} - {None}) and root[7] != tries.NOTHING


def test_empty_table_gives_no_nodes(talks):
    assert trie(talks([])).count() == 0
    assert trie(talks([(None, 1, "user", "x")])).count() == 0


def test_very_long_texts_and_roles_that_run_into_texts(talks):
    long = "é" * 3_000_000
    rows = [(1, 0, "user", long), (2, 0, "user", long), (3, 0, "use", "r" + long), (1, 1, "user", "x" * 1_000_000)]
    assert found(trie(talks(rows), graft=False)) == brute(rows, graft=False)


def test_nodes_carry_the_texts_of_their_last_turns(talks):
    rows = talk(3, n=40)
    ranks = tries.numbered(tries.keyed(talks(rows)))
    turns = tries.regrafted(ranks)
    got = tries.with_texts(tries.nodes(turns), turns, talks(rows)).collect()
    convs = rebuilt(rows)
    assert len(got) == len(brute(rows))
    assert all((r.role, r.text) == (convs[r.conv_id][r.depth - 1] if r.depth else (None, None)) for r in got)
