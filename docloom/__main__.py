"""Command line: ``python -m docloom COMMAND``; results go to standard output.

    profile PATH                 report of a table of documents
    build PATH OUT               ingest, clean, chunk, check and embed into OUT
    chunks OUT                   numbers and sections of the chunk table
    sample OUT N                 chunks to read through
    search OUT QUERY...          hits of each query
    benchmark OUT QUERIES        report over a list of ``query | keyword, keyword`` lines
    serve OUT                    the HTTP service
    settings                     the settings in force
"""

from __future__ import annotations

import argparse
import sys

from .config import EngineConfig


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--env", help="an env file with settings", default=".env")
    top.add_argument("--kind", help="format of the raw decisions", default="parquet")
    sub = top.add_subparsers(dest="command", required=True)
    for name, args in (
        ("profile", ["path"]), ("build", ["path", "out"]), ("chunks", ["out"]), ("sample", ["out", "n"]), ("search", ["out", "query+"]),
        ("benchmark", ["out", "queries"]), ("serve", ["out"]), ("settings", []),
    ):
        command = sub.add_parser(name)
        for arg in args:
            command.add_argument(arg.rstrip("+"), nargs="+" if arg.endswith("+") else None)
    return top


def run(spark, args: argparse.Namespace, config: EngineConfig) -> list[str]:
    """Lines that a command prints."""
    from . import console
    from .operators.embedding import HashingEmbedder
    from .operators.evaluate import timed_benchmark
    from .operators.search import SearchEngine
    from .plans.batch import build
    from .sources import io

    embedder = HashingEmbedder(config.embedding_dim)
    if args.command == "profile":
        return console.profile_report(io.read_decisions(spark, args.path, args.kind), config)
    if args.command == "build":
        stats = build(spark, args.path, args.out, embedder, config, args.kind).get_stats()
        return [f"{k}: {v}" for k, v in stats.items()]
    io.require(spark, f"{args.out}/chunks")
    chunks = spark.read.parquet(f"{args.out}/chunks")
    if args.command == "chunks":
        return console.chunk_report(chunks, chunks.select("original_doc_id").distinct().count())
    if args.command == "sample":
        return console.sample_lines(chunks, int(args.n))
    io.require(spark, f"{args.out}/vectors")
    engine = SearchEngine(io.join_vectors(chunks, spark.read.parquet(f"{args.out}/vectors")), embedder, config)
    if args.command == "search":
        return [line for q in args.query for line in console.hit_lines(q, engine.search(q), config.top_k)]
    if args.command == "benchmark":
        return console.table_lines(timed_benchmark(engine, io.read_queries(spark, args.queries)), "Benchmark")
    from .service import serve

    serve(engine).serve_forever()
    return []


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = EngineConfig.from_env(path=args.env)
    if args.command == "settings":
        print(config.summary())
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("docloom").getOrCreate()
    try:
        print("\n".join(run(spark, args, config)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
