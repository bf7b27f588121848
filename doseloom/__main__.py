"""python -m doseloom list | run QUERY FOLDER [--out PATH] | index FOLDER PATH | search PATH WORDS...: the queries and the index from a shell."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="doseloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="folder for the result as parquet; without it the first rows are shown")
    build = commands.add_parser("index", help="build the keyword index of a folder's documents")
    build.add_argument("folder")
    build.add_argument("path")
    ask = commands.add_parser("search", help="search an index")
    ask.add_argument("path")
    ask.add_argument("words", nargs="+")
    ask.add_argument("--limit", type=int, default=10)
    args = parser.parse_args(arguments)

    from . import catalogue, catalogue_rules, queries  # noqa: F401
    from .operators import index

    known = catalogue.QUERIES | queries.QUERIES
    if args.command == "list":
        print("\n".join(sorted(known)))
        return 0
    if args.command == "run" and args.query not in known:
        print(f"no query {args.query}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("doseloom").getOrCreate()
    if args.command == "run":
        found = known[args.query](spark, args.folder)
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        else:
            found.show(50, truncate=80)
    elif args.command == "index":
        index.build_index(spark.read.parquet(f"{args.folder}/documents.parquet"), args.path)
    else:
        asked = spark.createDataFrame([(1, " ".join(args.words))], "query_id int, query string")
        index.with_snippets(spark, args.path, index.search_index(spark, args.path, asked, args.limit), asked).orderBy("rank").show(args.limit, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main())
