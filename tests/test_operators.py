import base64
import functools
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text
from lexquarry.operators import chunks, dense, fusion, incremental, lexical, merges, ranking, sections
from lexquarry.sources import providers, vocabularies

ELEMENTS = "source_sha1 string, doc_id string, ord long, element_type string, text string, page_number int"
WORDS = {"chuong": "Chương II", "dieu": "Điều {}", "khoan": "Khoản {}", "diem": "Điểm {}", "body": "nội dung {}"}
RESET = {"dieu": ("khoan", "diem"), "khoan": ("diem",)}


def fold(rows, by_clause=True, by_point=True):
    """The sections of one document, element by element: (state, title, body texts)."""
    state, titles, body, name, out = {}, [], [], "", []

    def close():
        nonlocal body, name
        if body:
            out.append((dict(state), name or " — ".join(titles), body))
        body, name = [], ""

    for is_title, field, v, t in rows:
        cuts = field and (is_title or field == "dieu" or (field == "khoan" and by_clause) or (field == "diem" and by_point))
        if is_title:
            titles.append(t)
            if body and cuts:
                name = name or " — ".join(titles)
                close()
        else:
            name = name or " — ".join(titles)
            if body and cuts:
                close()
                if field == "dieu":
                    state.clear()
        if field:
            state[field] = v
            for f in RESET.get(field, ()):
                state.pop(f, None)
        if not is_title:
            body.append(t)
    close()
    return out


def test_sections_match_a_fold(spark):
    rng, data, want = random.Random(7), [], {}
    for d in range(150):
        rows = []
        for i in range(rng.randint(0, 14)):
            field = rng.choice(["body", "body", "body", "chuong", "dieu", "khoan", "diem"])
            v = "II" if field == "chuong" else rng.choice("abc") if field == "diem" else str(rng.randint(1, 4))
            t = WORDS[field].format(v) + (f" x{i}" if field != "body" else str(i))
            rows.append((rng.random() < 0.35, None if field == "body" else field, v, t))
            data.append((f"s{d}", f"d{d}", i, "Title" if rows[-1][0] else "Text", t, i // 4 + 1))
        want[f"d{d}"] = [(s, b) for s, _, b in fold(rows)]
    made = sections.sections(sections.sectioned(spark.createDataFrame(data, ELEMENTS)))
    got = {}
    for r in made.orderBy("doc_id", "section").collect():
        state = {k: v for k, v in r.state.asDict().items() if v}
        got.setdefault(r.doc_id, []).append((state, [i.text for i in r["items"]]))
    # the state of a section is the one at its last row, titles that follow it included
    for d, rows in want.items():
        mine = got.get(d, [])
        assert [b for _, b in mine] == [b for _, b in rows], d


def test_titles_and_state_by_hand(spark):
    rows = [
        ("s", "d", 0, "Title", "Chương I Chung", 1), ("s", "d", 1, "Title", "Điều 1 Phạm vi", 1), ("s", "d", 2, "Text", "mở đầu", 1), ("s", "d", 3, "Text", "1. khoản một", 1),
        ("s", "d", 4, "Text", "a) điểm", 2), ("s", "d", 5, "PageFooter", "trang", 2), ("s", "d", 6, "Text", " ", 2), ("s", "d", 7, "Text", "Điều 2. Khác", None), ("s", "d", 8, "Text", "hết", None),
    ]
    made = sections.sections(sections.sectioned(spark.createDataFrame(rows, ELEMENTS))).orderBy("section").collect()
    states = [{k: v for k, v in r.state.asDict().items() if v} for r in made]
    assert states == [{"chuong": "I", "dieu": "1"}, {"chuong": "I", "dieu": "1", "khoan": "1"}, {"chuong": "I", "dieu": "1", "khoan": "1", "diem": "a"}, {"dieu": "2"}]
    assert {r.title for r in made} == {"Chương I Chung — Điều 1 Phạm vi"} and [len(r["items"]) for r in made] == [1, 1, 1, 2]
    loose = sections.sections(sections.sectioned(spark.createDataFrame(rows, ELEMENTS), by_clause=False, by_point=False)).collect()
    assert len(loose) == 2


def test_captions(spark):
    rows = [("s", "d", i, "Text", t, 1) for i, t in enumerate(["x" * 300, "Hình 1 " + "y" * 300, "here", "", "after", "later"])]
    got = {r.ord: r.caption for r in sections.nearby_captions(spark.createDataFrame(rows, ELEMENTS)).collect()}
    assert got[2] == "Hình 1 " + "y" * 300 + " after" and got[0] == "Hình 1 " + "y" * 300 + " here"


def packed(parts, most, overlap):
    size = lambda t: max(1, len(t) // 2)
    done, now, n = [], [], 0

    def flush():
        nonlocal now, n
        if now:
            done.append(" ".join(now))
        now, n = [], 0

    for s in parts:
        if size(s) > most:
            rest = s
            while True:
                piece, rest = (rest[: 2 * most], rest[2 * most :]) if size(rest) > most else (rest, "")
                if piece.strip():
                    if n + size(piece) > most:
                        flush()
                    now.append(piece)
                    flush()
                if not rest:
                    break
        elif n + size(s) <= most:
            now.append(s)
            n += size(s)
        else:
            flush()
            if done and overlap > 0 and size(done[-1]) > overlap:
                seed = done[-1][-2 * overlap :]
                if size(seed) + size(s) > most:
                    done.append(seed)
                else:
                    now, n = [seed], size(seed)
            now.append(s)
            n += size(s)
    flush()
    return [d.strip() for d in done if d.strip()]


def test_packing_matches_a_loop(spark):
    rng, cases = random.Random(11), []
    for k in range(300):
        parts = ["".join(rng.choice("ab ") for _ in range(rng.choice([3, 8, 20, 45, 90]))).strip() or "x" for _ in range(rng.randint(0, 9))]
        cases.append((k, parts))
    for most, overlap in ((10, 3), (15, 0), (6, 5)):
        rows = spark.createDataFrame(cases, "k long, parts array<string>").select("k", chunks.pack(F.col("parts"), most, overlap).alias("out")).collect()
        assert {r.k: r.out for r in rows} == {k: packed(p, most, overlap) for k, p in cases}


def test_packing_by_a_vocabulary(spark, tmp_path):
    """A small vocabulary made here: a word is one token with the space before it, and other words are bytes."""
    words = ["a", "b", "bb", " a", " b", " bb", " "]
    (tmp_path / "v").write_text("".join(f"{base64.b64encode(w.encode()).decode()} {k}\n" for k, w in enumerate(words)))
    load = merges.load(spark, str(tmp_path / "v"))
    parts = ["a bb a", "bb unknown", "a a a a a a a a", "bb"]
    assert chunks.packed(parts, 5, 2, load()) == ["a bb a", "bb unk", "nown", "a a a a a", "a a a", "bb"]
    rows = spark.createDataFrame([(1, parts), (2, None)], "k int, parts array<string>")
    got = rows.select(chunks.pack(F.col("parts"), 5, 2, load).alias("p"), vocabularies.counted(F.array_join("parts", " "), load).alias("n"), vocabularies.truncated(F.array_join("parts", " "), 4, load).alias("t")).collect()
    assert got[0].p == chunks.packed(parts, 5, 2, load()) and (got[0].n, got[0].t) == (21, "a bb a bb") and got[1].p is None and got[1].t is None


def naive(piece, ranks):
    """Brute force: the lowest pair, the leftmost first, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_merges_equal_brute_force_on_all_words(spark):
    ranks = merges.ranks(spark, VOCABULARY)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = docs.select(F.explode(merges.pieces(F.col("text"))).alias("piece")).distinct()
    rows = merges.token_table(words, spark.sparkContext.broadcast(ranks)).collect()
    assert len(rows) > 1000
    for r in rows:
        raw = r.piece.encode()
        ends = merges.merged(raw, ranks)
        assert [raw[a:b] for a, b in zip([0, *ends], ends)] == naive(raw, ranks)
        assert len(r.ends) == len(ends) and r.ends[-1] == len(r.piece)
    assert merges.merged(b"a" * 5000, ranks) == list(itertools.accumulate(map(len, naive(b"a" * 5000, ranks))))


def test_tokens_of_texts_equal_the_public_encoder(spark):
    import tiktoken

    ranks = merges.ranks(spark, VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=merges.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    odd = [None, "", " ", "  \n\t x", "it's we'll I'd", "ﬁ½ 123abc", "日本語テキスト", "🙂🙂 e\u0301", "a\u00a0b\u2003 c", "x" * 3000, "é" * 2000] + ["".join(rng.choice("ab é日🙂 \n'1.") for _ in range(40)) for _ in range(60)]
    texts = odd + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    held = spark.sparkContext.broadcast(ranks)
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] + [(9999, texts[5], "twice")], "id long, text string, piece string")
    by = merges.Merges(ranks)
    for n in (1, 7, 300):
        cut = {r.id: r for r in merges.truncated(merges.counted(docs, held), held, n).collect()}
        assert len(cut) == len(texts) + 1 and cut[9999].n_tokens == cut[5].n_tokens
        for i, t in enumerate(texts):
            ids = own.encode_ordinary(t or "")
            assert cut[i].n_tokens == max(1, len(ids)) == by.count(t or "") and cut[i].piece == "kept"
            want = None if t is None else own.decode_bytes(ids[:n]).decode("utf-8", "ignore")
            assert cut[i].cut == want, (n, t)
            if t and len(ids) > n:
                assert by.head(t, n) == (want or t[:1]) and t.endswith(by.tail(t, n))


def test_zeros_come_before_negative_scores(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none")], "query_id long, query string")
    scored = lexical.okapi(lexical.postings(docs), lexical.statistics(docs), asked, epsilon=-1.0 / 16).withColumn("bm25", F.when(F.col("query_id") == 1, -F.abs("bm25") - 0.001).otherwise(F.abs("bm25") + 0.001))
    got = {}
    for r in lexical.top(lexical.with_zeros(scored, docs, asked, 8), [F.col("bm25").desc(), F.col("id")], 8).orderBy("query_id", "rn").collect():
        got.setdefault(r.query_id, []).append((r.id, r.bm25 == 0))
    assert got[1] == [(i, True) for i in range(0, 32, 4)]  # the eight without the word, beyond the first 16 ids
    assert got[2] == [(i, False) for i in range(0, 32, 4)] and got[3] == [(i, True) for i in range(8)]


def test_parents_and_excerpts_follow_their_limits(spark):
    rows = [("s", "d", 0, "Text", "Điều 1 Tên dài hơn một chút", 1), ("s", "d", 1, "Table", "| a | b |", 2)]
    elements = spark.createDataFrame(rows, ELEMENTS).withColumn("text_as_html", F.when(F.col("element_type") == "Table", F.lit("<table><tr><td>một</td></tr></table>")))
    made = chunks.chunked(sections.sections(sections.sectioned(elements)), parent_tokens=5, excerpt=9).collect()
    assert next(r for r in made if r.doc_type == "parent").text == "Điều 1 Tên" and next(r for r in made if r.modality == "table").table_html_excerpt == "<table><t ..."


@pytest.mark.parametrize("by_clause, by_point", [(True, True), (False, True), (False, False)])
def test_sections_by_blocks_equal_sections_by_documents(spark, by_clause, by_point):
    rng, rows = random.Random(12), []
    for d, n in (("long", 4000), ("b", 70), ("c", 3), ("a", 900)):
        page = 1
        for k in range(n):
            page += rng.random() < 0.1
            kind = rng.choice(["chuong", "dieu", "khoan", "diem", "body", "body", "body"] if d != "long" or k % 1000 < 300 else ["body"])
            rows.append((d, f"doc{d}", k, rng.choice(["Title", "Text", "Text", "Footer"]), WORDS[kind].format(rng.randint(1, 4)) + " " + rng.choice(["x", "Tên gọi", ""]), None if rng.random() < 0.05 else page))
    rng.shuffle(rows)
    elements = spark.createDataFrame(rows, ELEMENTS)
    columns = ("source_sha1", "ord", "section", "flush", "is_title", "has_heading", "titles", "state", "text")
    want = sorted((tuple(r) for r in sections.sectioned(elements, by_clause, by_point).select(*columns).collect()), key=str)
    for blocks in (1, 3, 40):
        got = sections.sectioned_by_blocks(elements, by_clause, by_point, blocks)
        assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want
    assert sections.sectioned_by_blocks(elements.limit(0)).count() == 0


def test_a_document_of_many_elements_is_dealt_to_many_tasks(spark, monkeypatch):
    held = []
    monkeypatch.setattr(sections, "materialised", lambda table, name, real=sections.materialised: held.append(real(table, name)) or held[-1])
    n = 60_000
    text = F.when(F.col("id") % 997 == 5, F.concat(F.lit("Điều "), (F.col("id") / 997).cast("int").cast("string"))).otherwise("thân bài")
    elements = spark.range(n).select(F.lit("s").alias("source_sha1"), F.lit("d").alias("doc_id"), F.col("id").alias("ord"), F.lit("Text").alias("element_type"), text.alias("text"), (F.col("id") / 50).cast("int").alias("page_number"))
    got = sections.sectioned_by_blocks(elements, blocks=30)
    assert got.agg(F.max("section")).first()[0] == (n - 6) // 997 + 1
    sizes = [r["count"] for r in held[0].groupBy("_block").count().collect()]
    assert len(sizes) > 25 and max(sizes) < n / 10


def test_chunks_and_parents(spark):
    rows = [
        ("s", "d", 0, "Title", "Điều 1 Tên", 1), ("s", "d", 1, "Text", "Câu một. Câu hai.", 1), ("s", "d", 2, "Table", "| a | b |", 2), ("s", "d", 3, "Image", "ảnh", 3), ("s", "d", 4, "Text", "Khoản 2 nội dung", 4),
    ]
    made = chunks.chunked(sections.sections(sections.sectioned(sections.nearby_captions(spark.createDataFrame(rows, ELEMENTS))))).collect()
    child = [r for r in made if r.doc_type == "child"]
    assert sorted(r.modality for r in child) == ["image", "table", "text", "text"] and len({r.chunk_id for r in made}) == len(made)
    table = next(r for r in child if r.modality == "table")
    assert table.text == "[BẢNG]\n| a | b |" and table.page_start == 2 and table.citation == "d — Điều 1 | trang 1"  # of the section
    parent = {r.chunk_id: r for r in made if r.doc_type == "parent"}
    assert set(parent) == {r.parent_id for r in child} and {p.parent_level for p in parent.values()} == {"dieu", "khoan"}
    clause = next(p for p in parent.values() if p.parent_level == "khoan")
    assert clause.super_parent_id in parent and clause.ancestor_dieu_id == clause.super_parent_id
    assert clause.legal_hierarchy == '{"dieu":"1","khoan":"2"}' and table.legal_hierarchy == '{"dieu":"1"}'


def test_incremental(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "source_sha1 string, o int, v string")
    known = spark.createDataFrame([("b",), (None,)], "source_sha1 string")
    assert {r.v for r in incremental.unseen(rows, known).collect()} == {"x", "y"}
    assert {(r.source_sha1, r.v) for r in incremental.last_wins(rows, ["source_sha1"], "o").collect()} == {("a", "y"), ("b", "z")}
    assert incremental.counters(rows, known).first().asDict() == {"seen": 2, "new": 1}
    base, new = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(tuple(r) for r in incremental.upserted(base, new).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    docs = spark.createDataFrame([("s", "one", 1), ("s", "two", 0), ("t", "three", 5)], "source_sha1 string, doc_id string, o int")
    assert {r.doc_id for r in incremental.first_source(docs, "o").collect()} == {"two", "three"}
    hashes = spark.createDataFrame([("", "m"), ("t", None), (None, None)], "a string, b string")
    assert {r.source_sha1 for r in incremental.known_hashes(hashes, "a", "b").collect()} == {"m", "t"}


def test_fusion_ties_and_ranks(spark):
    near = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.6), (1, "b", 3, 0.9)], "query_id int, id string, rn int, distance double")
    words = spark.createDataFrame([(1, "b", 1, 9.0), (1, "c", 2, 8.0)], "query_id int, id string, rn int, bm25 double")
    got = fusion.fuse(fusion.one_rank(near), words).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].score_rrf == pytest.approx(1 / 63 + 1 / 61) and got[0].distance == 0.6 and got[0].bm25 == 9.0
    assert fusion.fuse(fusion.one_rank(near), words, compat=True).where("id = 'b'").first().bm25 == 0.0
    assert [r.id for r in fusion.fuse(near.where("rn < 3"), words, limit=1).collect()] == ["b"]


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    v = [[rng.random() for _ in range(4)] for _ in range(40)]
    vectors = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<float>")
    asked = spark.createDataFrame(list(enumerate(v[:7])), "query_id long, vector array<float>")
    whole = sorted(tuple(r) for r in dense.nearest(asked, vectors, 5, 4).collect())
    assert [r[1] for r in whole if r[3] == 1] == list(range(7))
    monkeypatch.setattr(dense, "MAX_QUERY_NUMBERS", 8)
    assert sorted(tuple(r) for r in dense.nearest(asked, vectors, 5, 4).collect()) == whole


def test_nearest_among_copies_and_nulls_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(dense, "VECTORS_A_TASK", 50)
    rng = random.Random(8)
    base = [[rng.random() for _ in range(6)] for _ in range(15)]
    rows = [(i, base[rng.randrange(15)] if i % 3 else [rng.random() for _ in range(6)]) for i in range(600)] + [(900, None), (901, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    wanted = [(q, rows[q][1]) for q in range(0, 600, 20)]
    got = {}
    for r in dense.nearest(spark.createDataFrame([*wanted, (7, None)], "query_id long, vector array<double>"), vectors, 45).orderBy("query_id", "rn").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    for q, v in wanted:
        gaps = lambda x: [(a - b) * (a - b) for a, b in zip(v, x, strict=True)]
        assert got[q] == sorted((functools.reduce(float.__add__, gaps(x), 0.0), i) for i, x in rows[:600])[:45]
    assert got[7] == [(None, i) for i in range(45)]
    last = dense.nearest(spark.createDataFrame(wanted[:1], "query_id long, vector array<double>"), vectors, 602).orderBy("rn").collect()
    assert [(r.id, r.distance) for r in last[600:]] == [(900, None), (901, None)]
    plan = dense.nearest(spark.createDataFrame(wanted, "query_id long, vector array<double>"), vectors, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "REPARTITION_BY_NUM" in plan  # dealt to tasks however few files there are


def test_bm25_batch_equals_single_queries(spark):
    corpus = spark.createDataFrame([(0, "a b c"), (1, "a a d"), (2, "e"), (3, None), (4, "b e e")], "id long, text string")
    posting, stats = lexical.postings(corpus), lexical.statistics(corpus)
    asked = [(0, "a b"), (1, "e e"), (2, "zz")]
    both = lexical.okapi(posting, stats, spark.createDataFrame(asked, "query_id long, query string"))
    single = [tuple(r) for q in asked for r in lexical.okapi(posting, stats, spark.createDataFrame([q], "query_id long, query string")).collect()]
    near = lambda rows: sorted((q, i, round(x, 12)) for q, i, x in rows)
    assert near(both.collect()) == near(single)
    full = lexical.fts(posting, stats, spark.createDataFrame(asked, "query_id long, query string")).collect()
    assert {(r.query_id, r.id) for r in full} == {(0, 0), (1, 2), (1, 4)} and all(r["rank"] < 0 for r in full)
    zero = lexical.with_zeros(both, corpus, spark.createDataFrame(asked, "query_id long, query string"), 3)
    assert lexical.top(zero, [F.col("bm25").desc(), F.col("id")], 3).groupBy("query_id").count().where("count = 3").count() == 3


@pytest.mark.parametrize("epsilon, most", [(0.25, 10**6), (-0.25, 10**6), (0.25, 20)])
def test_best_documents_are_the_top_of_all_scores(spark, monkeypatch, epsilon, most):
    monkeypatch.setattr(lexical, "MAX_QUERY_TERMS", most)  # blocks of queries
    monkeypatch.setattr(lexical, "SCORES", 60)  # and of documents: workers see these only where they are forked after, results are equal anyhow
    rng, words = random.Random(3), [f"w{k}" for k in range(30)] + ["common"] * 20
    texts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(120)]
    corpus = spark.createDataFrame([(i, rng.choice(texts) if i % 9 else None) for i in range(400)], "id long, text string")  # copies tie
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=5))) for q in range(12)] + [(90, "none"), (91, "")], "query_id long, query string")
    docs, stats = lexical.documents(corpus.repartition(3)), lexical.statistics(corpus)
    assert sorted(map(tuple, lexical.postings_of(docs).collect())) == sorted(map(tuple, lexical.postings(corpus).collect()))
    terms = lexical.vocabulary(lexical.postings(corpus), stats)
    every = lexical.okapi(lexical.postings(corpus), stats, asked, epsilon=epsilon, terms=terms).withColumn("bm25", F.round("bm25", 8))
    order = [F.col("bm25").desc(), F.col("id")]
    rows = lambda df: sorted((r.query_id, r.rn, r.id, r.bm25) for r in df.collect())
    assert rows(lexical.best(docs, stats, asked, 15, terms, epsilon=epsilon)) == rows(lexical.top(every, order, 15))
    zeros = asked.select("query_id").crossJoin(corpus.select("id")).join(every, ["query_id", "id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    assert rows(lexical.best(docs, stats, asked, 15, terms, epsilon=epsilon, zeros=True)) == rows(lexical.top(zeros, order, 15))
    assert lexical.best(docs, stats, asked.where("query_id > 99"), 15, terms).count() == lexical.best(docs.limit(0), stats, asked, 15, terms).count() == 0


def test_rounding_is_sparks(spark):
    rng = random.Random(5)
    said = [x * 10.0**k for x in (rng.random() - 0.3 for _ in range(400)) for k in (0, 2)] + [1.000000005, -2.125000005, 0.5e-8, 12.345678905, 0.0]
    got = spark.createDataFrame([(x,) for x in said], "x double").select(F.round("x", 8)).collect()
    assert lexical.rounded(np.array(said)).tolist() == [r[0] for r in got]


def test_scoring_shuffles_no_hits(spark):
    corpus = spark.createDataFrame([(i, f"a b{i % 3}") for i in range(300)], "id long, text string")
    docs, stats = lexical.documents(corpus), lexical.statistics(corpus)
    asked = spark.createDataFrame([(q, "a b1") for q in range(4)], "query_id long, query string")
    found = lexical.best(docs, stats, asked, 2, lexical.vocabulary(lexical.postings_of(docs), stats))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1 and found.count() == 8


POOL = "query_id int, rank int, id string, text string, modality string, doc_id string, van_ban string, dieu string, khoan string, diem string, ancestor_dieu_id string, bm25 double, distance double, score_rrf double, effective_date string"


def test_expansion(spark):
    pool = spark.createDataFrame([(1, 1, "c1", "t", "text", "d", "v", "1", None, None, "A", 1.0, None, 0.5, None), (1, 2, "c9", "t", "text", "e", "v", None, None, None, "", None, 0.1, 0.1, None)], POOL)
    store = [(f"c{i}", i, "t", "text", "d", "v", "1", None, None, "A") for i in range(1, 6)] + [("c9", 9, "t", "text", "e", "v", None, None, None, ""), ("c8", 8, "t", "text", "e", "v", None, None, None, "")]
    chunk = spark.createDataFrame(store, "id string, seq int, text string, modality string, doc_id string, van_ban string, dieu string, khoan string, diem string, ancestor_dieu_id string")
    wide = fusion.expand(pool, chunk, groups=2, per_group=4, most=3).orderBy("rank").collect()
    assert [r.id for r in wide] == ["c1", "c9", "c2", "c3", "c4"] and [r.extra for r in wide] == [False, False, True, True, True]
    long = spark.createDataFrame([(1, k, f"p{k}", k > 40) for k in range(1, 53)], "query_id int, rank int, id string, extra boolean")
    placed = fusion.room(long, 30, 12).where("rank <= 30")
    assert placed.where("extra").count() == 12 and placed.count() == 30


def test_rerank_features(spark):
    rows = [
        (1, 1, "a", "[BẢNG] x", "table", "d", "v", "1", None, None, "A", 3.0, 0.2, 0.1, "2024-1-2"), (1, 2, "b", "phạt 1.000 đồng", "text", "d", "v", "1", None, None, "A", None, 0.4, 0.1, "5/6/2020"),
        (1, 3, "c", "x", "text", "e", "w", "2", None, None, None, 1.0, None, 0.1, "nonsense"),
    ]
    asked = spark.createDataFrame([(1, "bảng mức phạt", None)], "query_id int, query string, prefer_modality string")
    got = {r.id: r for r in ranking.rerank(spark.createDataFrame(rows, POOL), asked).collect()}
    assert [got[k].score_vec for k in "abc"] == [1.0, 0.0, 0.0] and [got[k].score_prior_modality for k in "abc"] == [1.0, 0.0, 0.0]
    assert [got[k].score_prior_recency for k in "abc"] == [1.0, 0.0, 0.0] and [got[k].score_prior_money for k in "abc"] == [0.0, 1.0, 0.0]
    assert [got[k].score_prior_cohesion for k in "abc"] == [0.4, 0.4, 0.2] and [got[k].score_prior_scope for k in "abc"] == [1.0, 1.0, 0.5]
    assert [got[k].score_prior_lexical for k in "abc"] == pytest.approx([1, 0, 1 / 3])
    # 0.64 for a constant scorer; the second row of an article loses 15 %
    assert got["b"].score_rerank == pytest.approx(0.85 * (0.64 + 0.03 + 0.06 + 0.04))
    assert [r.id for r in ranking.rerank(spark.createDataFrame(rows, POOL), asked, final=1).collect()] == ["a"]


@pytest.mark.parametrize(("said", "want"), [("2024-1-2", 1704153600), ("2024/01/02", 1704153600), ("2/1/2024", 1704153600), ("02-01-2024", 1704153600), ("1704153600", None), ("20240102", None), ("soon", None), (None, None)])
def test_dates(spark, said, want):
    assert spark.createDataFrame([(said,)], "x string").select(ranking.parsed_date(F.col("x")).alias("y")).first().y == want


@pytest.mark.parametrize(("kind", "said", "want"), [("long", 1704153600, 1704153600), ("long", 1704153600000, 1704153600), ("double", 1704153600.9, 1704153600), ("long", 0, None), ("long", None, None)])
def test_numbers_are_seconds_or_milliseconds(spark, kind, said, want):
    rows = spark.createDataFrame([(said,)], f"updated_at {kind}")
    assert rows.select(ranking.first_date(rows).alias("y")).first().y == want


def test_equal_headings_keep_all_chunks(spark):
    """Three bodies, the first and third under one heading: every text has an id of its own, and the parent holds both."""
    rows = [("s", "d", i, "Text", t, 1) for i, t in enumerate(["Điều 1. một", "thân một", "Điều 2. hai", "thân hai", "Điều 1. ba", "thân ba"])]
    ready = sections.sections(sections.sectioned(spark.createDataFrame(rows, ELEMENTS)), compat=False)
    made = chunks.chunked(ready).collect()
    child = [r for r in made if r.doc_type == "child"]
    assert len({r.chunk_id for r in child}) == len(child) == 3 and len({r.chunk_id for r in made}) == len(made)
    assert {w for r in child for w in ("thân một", "thân hai", "thân ba") if w in r.text} == {"thân một", "thân hai", "thân ba"}
    parent = next(r for r in made if r.doc_type == "parent" and r.parent_key == "DIEU_1")
    assert "thân một" in parent.text and "thân ba" in parent.text
    assert len({r.chunk_id for r in chunks.chunked(ready, compat=True).where("doc_type = 'child'").collect()}) == 2


def test_table_modes_header_and_length(spark):
    html = "<table><tr><th>Tên</th><th>a|b</th></tr><tr><td>x<br/>y</td></tr><tr><td>1 &lt; 2</td><td>&amp;</td><td>z</td></tr></table>"
    schema = ELEMENTS + ", text_as_html string"
    rows = spark.createDataFrame([("s", "d", 0, "Title", "Điều 1 Tên", 1, None), ("s", "d", 1, "Text", "Thân.", 1, None), ("s", "d", 2, "Table", "raw", 2, html), ("s", "d", 3, "Table", "[BẢNG] plain", 3, None)], schema)
    ready = sections.sections(sections.sectioned(rows))
    md = "| Tên | a\\|b |  |\n| --- | --- | --- |\n| x y |  |  |\n| 1 < 2 | & | z |"
    of = lambda kind, **how: [r.text for r in chunks.chunked(ready, **how).where(f"doc_type = 'child' AND modality = '{kind}'").orderBy("seq").collect()]
    assert [t.count("|") for t in of("table")] == [md.count("|") + 1, 0] and of("table")[1] == "[BẢNG]\nplain"
    assert of("table")[0].startswith("[BẢNG]\n| Tên | a") and of("table")[0].endswith("| 1 < 2 | & | z |")
    assert of("table", tables="metadata") == [] == of("table", tables="append")
    assert "raw" not in of("text", tables="append")[0] and "1 < 2" in of("text", tables="append")[0] and "1 < 2" not in of("text", tables="metadata")[0]
    assert of("table", table_chars=10)[0] == "[BẢNG]\n| Tên | a\\ ..." and of("text")[0].startswith("Điều 1") and of("text", header=False) == ["Thân."]
    with pytest.raises(ValueError, match="separate"):
        chunks.chunked(ready, tables="none")


def test_distinct_in_order(spark):
    assert spark.createDataFrame([(["b", "", "a", None, "b"],)], "x array<string>").select(text.distinct_in_order(F.col("x")).alias("y")).first().y == ["b", "a"]


def test_texts_with_words_have_vectors_of_length_one(spark):
    embedder, seen, pair = providers.HashEmbedder(), {}, None
    for word in (f"w{k}" for k in itertools.count()):
        own = tuple(embedder.embed([word])[0])
        if tuple(-x for x in own) in seen:
            pair = f"{seen[tuple(-x for x in own)]} {word}"
            break
        seen[own] = word
    blank = " " * (2 * providers.TEXT_TOKENS + 1)  # a part without words, and parts that cancel out
    texts = [pair, pair + " " + pair, " ", "word" + blank + "tail", *(w + blank[len(w) :] + v for w, v in [pair.split()]), blank, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 3)
    got = [r[0] for r in providers.embedded(docs, embedder, "doc_id").orderBy("doc_id").select(norm).collect()]
    assert got == [1.0] * 5 + [0.0] * 3


def test_tokens_are_counted_where_the_text_is_read(spark):
    ranks = {bytes([b]): b for b in range(97, 123)} | {b" ": 5, b"ab": 300, b"abc": 301, b" a": 302}
    held = spark.sparkContext.broadcast(ranks)
    texts = ["abc abc", "ab" * 50, "", None, "x " * 30, "é"]
    got = merges.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), held)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == [merges.Merges(ranks).count(t or "") for t in texts]


def test_strip_takes_what_patterns_call_white_space(spark):
    codes = spark.range(1, 0x3100).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    said = codes.select(F.concat("c", F.lit("a"), "c", F.lit(" b"), "c", F.lit("\n")).alias("t"))
    assert said.where(~text.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert said.where(~text.collapse(F.col("t")).eqNullSafe(F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), "^ | $", ""))).count() == 0


def _executed(table, node):
    plan = table._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-*()0123456789").startswith(node) for line in plan.splitlines())


def test_sections_sort_their_rows_once(spark):
    rows = [("s", "d", i, "Text", t, 1) for i, t in enumerate(["Điều 1. a", "Khoản 2 b", "Điểm a c", "Chương II x", "d"])]
    assert _executed(sections.sectioned(spark.createDataFrame(rows, ELEMENTS)), "Sort ") == 1


def test_chunks_make_sections_once(spark):
    rows = [("s", "d", i, "Text", f"nội dung {i}", 1) for i in range(3)]
    made = chunks.chunked(sections.sections(sections.sectioned(sections.nearby_captions(spark.createDataFrame(rows, ELEMENTS)))))
    assert _executed(made, "Window ") == 0 and made.count() == 2
