"""Command line: files to elements, elements to chunks, chunks to an index, and searches and questions over it."""

from __future__ import annotations

import argparse
import dataclasses
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators import chunks, dense, fusion, lexical, merges, ranking
from lexquarry.plans import pipeline
from lexquarry.sources import files, jsonl, providers
from lexquarry.sources.store import Store

MODALITIES = ("table", "image", "text")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lexquarry", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)

    reading = argparse.ArgumentParser(add_help=False)
    reading.add_argument("--extractor", choices=("offline", "text", "remote"), default="offline", help="what reads files: Office files by their XML, everything as UTF-8 text, or a service")
    reading.add_argument("--service-url")
    reading.add_argument("--service-key-file", help="a file that holds the service's key alone")
    reading.add_argument("--pages-per-slice", type=int, default=files.PAGES_PER_SLICE)
    cutting = argparse.ArgumentParser(add_help=False)
    cutting.add_argument("--chunk-tokens", type=int, default=chunks.MAX_TOKENS)
    cutting.add_argument("--overlap-tokens", type=int, default=chunks.OVERLAP)
    cutting.add_argument("--vocabulary", help="a file of byte-pair ranks: a token in base64 and its rank a line")
    cutting.add_argument("--no-header", action="store_true", help="no article line above a section's text")
    cutting.add_argument("--no-clauses", action="store_true", help="sections don't end at clauses")
    cutting.add_argument("--no-points", action="store_true", help="sections don't end at points")
    cutting.add_argument("--tables", choices=chunks.TABLE_MODES, default="separate")
    cutting.add_argument("--table-chars", type=int, default=chunks.TABLE_CHARS)
    cutting.add_argument("--caption-window", type=int, default=2)
    asking = argparse.ArgumentParser(add_help=False)
    asking.add_argument("--dense-k", type=int)
    asking.add_argument("--lexical-k", type=int)
    asking.add_argument("--final-k", type=int)

    step = steps.add_parser("elements", parents=[reading], help="files to JSON lines of elements; files that are known are skipped")
    step.add_argument("folder")
    step.add_argument("out")
    step = steps.add_parser("chunk", parents=[cutting], help="JSON lines of elements to chunks; sources that are known are skipped")
    step.add_argument("elements")
    step.add_argument("chunks")
    step = steps.add_parser("ingest", parents=[reading, cutting], help="files to chunks in one step")
    step.add_argument("folder")
    step.add_argument("chunks")
    step = steps.add_parser("index", help="chunks to an index; only new chunks are embedded")
    step.add_argument("chunks")
    step.add_argument("index")
    step = steps.add_parser("search", parents=[asking], help="hybrid search without an answer")
    step.add_argument("index")
    step.add_argument("query", nargs="+")
    step = steps.add_parser("ask", parents=[asking], help="answer questions")
    step.add_argument("chunks")
    step.add_argument("question", nargs="+")
    step.add_argument("--index", help="an index made before; by default one beside the chunks")
    step.add_argument("--prefer", choices=MODALITIES, help="by default what the question asks for")
    step.add_argument("--only", action="store_true", help="retrieve nothing but what is preferred")
    step.add_argument("--no-expand", action="store_true")
    step.add_argument("--dense-only", action="store_true")
    return parser


def _extractor(args: argparse.Namespace) -> files.Extractor:
    if args.extractor == "text":
        return files.PlainText()
    if args.extractor == "offline":
        return files.OFFLINE
    if not args.service_url or not args.service_key_file:
        raise SystemExit("a remote extractor needs --service-url and --service-key-file")
    return files.with_remote(files.Remote(args.service_url, Path(args.service_key_file).read_text().strip()))


def _settings(spark: SparkSession, args: argparse.Namespace) -> pipeline.Settings:
    return pipeline.Settings(
        chunk_tokens=args.chunk_tokens, overlap_tokens=args.overlap_tokens, header=not args.no_header, by_clause=not args.no_clauses, by_point=not args.no_points,
        vocabulary=merges.load(spark, args.vocabulary) if args.vocabulary else None, tables=args.tables, table_chars=args.table_chars, caption_window=args.caption_window,
    )


def _chunked(elements: DataFrame, store: Store, settings: pipeline.Settings) -> None:
    have = store.read()
    made = pipeline.chunk(elements, have, settings).persist()
    print(f"{made.select('source_sha1').distinct().count()} new sources, {made.count()} chunks")
    if made.limit(1).count():
        store.upsert(made, "chunk_id")
    made.unpersist()


def _new(spark: SparkSession, args: argparse.Namespace, known: DataFrame | None) -> DataFrame:
    none = spark.createDataFrame([], "source_sha1 string")
    return files.extracted(files.new_files(files.scan(spark, args.folder), none if known is None else known), _extractor(args), args.pages_per_slice)


def _search(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scores of both retrievers, added with reciprocal ranks."""
    at = pipeline.opened(spark, args.index)
    asked = spark.createDataFrame(list(enumerate(args.query)), "query_id long, query string")
    vectors = providers.embedded(asked, providers.HashEmbedder(), "query_id", "query").withColumnRenamed("embedding", "vector")
    near = dense.nearest(vectors, at.vectors, args.dense_k or 30)
    best = lexical.top(lexical.okapi(at.postings, at.statistics, asked, terms=at.terms), [F.col("bm25").desc(), F.col("id")], args.lexical_k or 50)
    found = fusion.hybrid(best.select("query_id", "id", "rn", ranking.minmax(F.col("bm25")).alias("score_lex")), near.select("query_id", "id", "rn", dense.similarity(F.col("distance")).alias("score_vec")), final=args.final_k or 12)
    for row in fusion.looked_up(found, at.chunks).join(at.chunks.select("id", "citation"), "id", "left").orderBy("query_id", "rank").toLocalIterator():
        print(f"{row['rank']:>2}. {row.citation or row.id} | hybrid={row.score_hybrid:.4f} (lex={row.score_lex:.3f}, vec={row.score_vec:.3f})\n    {' '.join(row.text.split())[:240]}")


def _ask(spark: SparkSession, args: argparse.Namespace) -> None:
    chosen = {k: getattr(args, k) for k in ("dense_k", "lexical_k", "final_k") if getattr(args, k)}
    settings = dataclasses.replace(pipeline.Settings(prefer=args.prefer or "auto", only=args.only, expand=not args.no_expand, hybrid=not args.dense_only), **chosen)
    index = pipeline.opened(spark, args.index) if args.index else pipeline.index(Store(spark, args.chunks).read(), f"{args.chunks.rstrip('/')}-index")
    questions = spark.createDataFrame(list(enumerate(args.question)), "query_id long, query string")
    kept: list[DataFrame] = []
    for row in pipeline.answer(questions, index, settings, kept=kept).orderBy("query_id").collect():
        print(row["answer"], *(f"[{i}] {s}" for i, s in enumerate(row["sources"], 1)), *(f"- {s}" for s in row["suggestions"] or []), sep="\n")
    for table in kept:
        table.unpersist()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexquarry").getOrCreate()
    if args.step == "elements":
        known = jsonl.known(spark, args.out)
        made = _new(spark, args, known).persist()
        print(f"{made.select('source_sha1').distinct().count()} new files, {made.count()} elements")
        if made.limit(1).count():
            jsonl.append(jsonl.flat(made), args.out)
        made.unpersist()
    elif args.step == "chunk":
        _chunked(jsonl.elements(jsonl.ordered(spark, args.elements), order="ord"), Store(spark, args.chunks), _settings(spark, args))
    elif args.step == "ingest":
        store = Store(spark, args.chunks)
        _chunked(_new(spark, args, store.read()), store, _settings(spark, args))
    elif args.step == "index":
        pipeline.index(Store(spark, args.chunks).read(), args.index)
        print(f"{pipeline.opened(spark, args.index).chunks.count()} chunks")
    elif args.step == "search":
        _search(spark, args)
    else:
        _ask(spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
