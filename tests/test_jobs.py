import json
import math
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, index_stream, publish_chunks
from lexquarry.functions import text
from lexquarry.operators import chunks, lexical

SCHEMA = "doc_id long, text string, lang string, source string"
SAYS = [
    (1, "One sentence here. Another one there!\nA line.", "en", "web"), (2, "One sentence here. Another one there!\nA line.", "en", "news"), (3, None, "en", "web"), (4, " \n ", "en", "web"), (5, "Déjà vu. " * 200, "fr", None),
    (6, "x" * 700, "fr", ""), (7, "Short.", "de", "a/b=c d"), (7, "Short.", "de", "a/b=c d"), (7, "Another text of that id.", "de", "web"), (None, "No id.", "en", "web"), (8, "Déjà vu. " * 200, "fr", "web"), (0, "Short.", None, "wéb"),
]


def expected(rows):
    first = {}
    for i, t, _, s in rows:
        if i is not None and t and t.strip():
            first[t] = min(first.get(t, (math.inf, "")), (i, s or "unknown"))
    out = []
    for t, (i, s) in first.items():
        parts = [p.strip() for p in re.split(r"(?<=[.!?…])\s+|\n+(?=\S)", t.strip()) if p.strip()]
        out += [(i, j, c, max(1, len(c) // 2), s) for j, c in enumerate(chunks.packed(parts, 120, 20))]
    return sorted(out, key=str)


def published(spark, folder):
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/chunks").select("doc_id", "j", "text", "n_tokens", "source").collect()), key=str)


def test_each_content_is_published_once_and_reruns_change_nothing(spark, tmp_path):
    spark.createDataFrame(SAYS, SCHEMA).write.parquet(f"{tmp_path}/docs")
    done = publish_chunks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out")
    once = published(spark, f"{tmp_path}/out")
    assert once == expected(SAYS)
    assert done["documents"] == 5 and done["chunks"] == len(once)
    ids = spark.read.parquet(f"{tmp_path}/out/chunks").select("chunk_id").collect()
    assert len({r.chunk_id for r in ids}) == len(once)
    assert publish_chunks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out") == done
    assert published(spark, f"{tmp_path}/out") == once
    report = {r.source: r for r in spark.read.parquet(f"{tmp_path}/out/report").collect()}
    assert sum(r.n_chunks for r in report.values()) == len(once) and report["wéb"].n_documents == 1


def test_some_sources_replace_only_their_partitions(spark, tmp_path):
    spark.createDataFrame(SAYS, SCHEMA).write.parquet(f"{tmp_path}/docs")
    publish_chunks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out")
    before = published(spark, f"{tmp_path}/out")
    later = [(i, f"New text of {i}.", lang, s) for i, _, lang, s in SAYS[:1]] + [(20, "Other news.", "en", "news")]
    spark.createDataFrame(later, SCHEMA).write.parquet(f"{tmp_path}/later")
    publish_chunks.run(spark, f"{tmp_path}/later", f"{tmp_path}/out", {"sources": ["web"]})
    now = published(spark, f"{tmp_path}/out")
    assert [r for r in now if r[-1] != "web"] == [r for r in before if r[-1] != "web"]
    assert [r for r in now if r[-1] == "web"] == [(1, 0, "New text of 1.", 7, "web")]


def test_an_empty_table_is_published_as_one(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/docs")
    assert publish_chunks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out") == {"rows": 0, "documents": 0, "chunks": 0, "tokens": 0}


def test_config_files_are_read_and_checked(spark, tmp_path):
    for job in (publish_chunks, index_stream):
        beside = Path(job.__file__).with_suffix(".json")
        assert common.config(spark, str(beside), job.DEFAULTS) == job.DEFAULTS == json.loads(beside.read_text())
    (tmp_path / "c.json").write_text('{"chunk_tokens": 7}')
    assert common.config(spark, f"{tmp_path}/c.json", publish_chunks.DEFAULTS)["chunk_tokens"] == 7
    (tmp_path / "c.json").write_text('{"chunk_token": 7}')
    with pytest.raises(ValueError, match="chunk_token"):
        common.config(spark, f"{tmp_path}/c.json", publish_chunks.DEFAULTS)


def index_of(spark, folder):
    return sorted(tuple(r) for r in index_stream.opened(spark, folder)[0].select("term", "id", "tf", "dl").collect())


def whole(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).where("text IS NOT NULL").select(F.sha1("text").alias("id"), "text").distinct()
    return docs, sorted(tuple(r) for r in lexical.postings(docs).select("term", "id", "tf", "dl").collect())


def test_a_growing_folder_is_indexed_in_two_runs(spark, tmp_path):
    docs, out, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.createDataFrame(SAYS[:6], SCHEMA).coalesce(1).write.parquet(docs)
    first = index_stream.run(spark, docs, out, mark)
    assert (first["rows"], first["batches"], first["contents"]) == (6, 1, 4)
    assert index_of(spark, out) == whole(spark, SAYS[:6])[1]
    files = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}

    again = index_stream.run(spark, docs, out, mark)
    assert (again["rows"], again["contents"]) == (0, 4)
    later = SAYS[4:] + [(30, "Late and new: déjà vu.", "fr", "web")]
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(docs)
    last = index_stream.run(spark, docs, out, mark)
    assert last["rows"] == len(later)
    kept, postings = whole(spark, SAYS + later)
    assert index_of(spark, out) == postings and last["contents"] == kept.count()
    # what was there is as it was
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == had

    queries = spark.createDataFrame([(1, "deja vu sentence"), (2, "short"), (3, "nowhere")], "query_id long, query string")
    got = sorted((r.query_id, r.id, r.rn, round(r.bm25, 9)) for r in index_stream.search(spark, out, queries).collect())
    full = lexical.top(lexical.okapi(lexical.postings(kept), lexical.statistics(kept), queries), [F.col("bm25").desc(), F.col("id")], 10)
    assert got == sorted((r.query_id, r.id, r.rn, round(r.bm25, 9)) for r in full.collect()) and len(got) > 2


def test_a_batch_that_failed_is_done_again(spark, tmp_path, monkeypatch):
    docs, out, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    spark.createDataFrame(SAYS, SCHEMA).repartition(3).write.parquet(docs)
    done = index_stream.indexed

    def fails(batch, number, output):
        done(batch, number, output)
        if number == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(index_stream, "indexed", fails)
    with pytest.raises(Exception, match="lost"):
        index_stream.run(spark, docs, out, mark, {"max_files_per_batch": 1})
    monkeypatch.setattr(index_stream, "indexed", done)
    last = index_stream.run(spark, docs, out, mark, {"max_files_per_batch": 1})
    kept, postings = whole(spark, SAYS)
    assert index_of(spark, out) == postings and last["contents"] == kept.count()


def test_a_single_file_may_be_watched(spark, tmp_path):
    spark.createDataFrame(SAYS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/docs")
    (file,) = (tmp_path / "docs").glob("*.parquet")
    assert index_stream.run(spark, str(file), f"{tmp_path}/out", f"{tmp_path}/mark")["contents"] == whole(spark, SAYS)[0].count()


@pytest.mark.parametrize("job, folders", [("publish_chunks", 1), ("index_stream", 2)])
def test_command_lines(spark, tmp_path, job, folders):
    spark.createDataFrame(SAYS, SCHEMA).write.parquet(f"{tmp_path}/docs")
    paths = [f"{tmp_path}/o{k}" for k in range(folders)]
    root = Path(common.__file__).parent.parent
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", f"{tmp_path}/docs", *paths, "--config", f"jobs/{job}.json"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and any((tmp_path / "o0").rglob("*.parquet"))


def test_settings_are_put_back(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), common.settings(spark, spark_sql_shuffle_partitions="3", spark_lexquarry_none="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == had and spark.conf.get("spark.lexquarry.none", None) is None


def test_tokens_of_chunks_follow_the_library(spark):
    assert spark.range(1).select(text.token_len(F.lit("abcde")).alias("n")).first().n == 2
