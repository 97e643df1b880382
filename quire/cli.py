"""Command line: process a table of pages into books and chunks, list the books.

    python -m quire.cli process PAGES.parquet --root LOGS --batch 1
    python -m quire.cli list-books --root LOGS
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire import settings
from quire.errors import QuireError
from quire.operators import runs


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    found = settings.load()
    logging.basicConfig(level=found.log_level)
    top = argparse.ArgumentParser(prog="quire")
    commands = top.add_subparsers(dest="command", required=True)
    process = commands.add_parser("process", help="pages (book, page, text) into books and chunks")
    process.add_argument("pages")
    process.add_argument("--batch", default="1")
    process.add_argument("--source-lang", default="ur")
    listing = commands.add_parser("list-books", help="title, status, chunks and pages of each book")
    for c in (process, listing):
        c.add_argument("--root", required=True)
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    try:
        if args.command == "process":
            done = runs.ingest(spark.read.parquet(args.pages), found.chunk_target_chars, args.source_lang)
            runs.commit_ingest(done, args.root, args.batch)
        for b in runs.books_now(spark, args.root).orderBy(F.desc("batch"), "id").toLocalIterator():
            print(f"{b.id}\t{b.status}\t{b.total_chunks}\t{b.page_count}")
    except QuireError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
