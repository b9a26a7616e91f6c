"""python -m pageloom.plans.cli join|analyze|epub INPUT OUTPUT: the plans over folders of page files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import chapters, quality
from ..sources import readers, writers
from . import book


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("plan", choices=["join", "analyze", "epub"])
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--no-markers", action="store_true")
    parser.add_argument("--dictionary")
    parser.add_argument("--author", default="Unknown")
    parser.add_argument("--language", default="en")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pageloom").getOrCreate()
    if args.plan == "epub":
        found = chapters.chapters(readers.markdown(spark, args.input)).withColumnsRenamed({"content": "text"})
        rows = found.withColumns({"block": F.lit(0).cast("bigint"), "part": F.lit(0)})
        return int(not writers.epub_files(rows, args.output, args.author, args.language).count())
    tiers = readers.TIERS["join" if args.plan == "join" else "analyze"]
    pages = readers.page_texts(spark, args.input, tiers)
    if args.plan == "analyze":
        writers.text_files(quality.report_text(pages), args.output, (), "report", "_error_report.txt").count()
        return int(not quality.report(pages).where("has_critical_errors").isEmpty())
    words = readers.dictionary(spark, args.dictionary)
    kind = (pages.select("kind").first() or ["markdown"])[0]
    books = book.join_only(pages, kind, words, not args.no_markers)
    return int(not writers.text_files(books, args.output).count())


if __name__ == "__main__":
    sys.exit(main())
