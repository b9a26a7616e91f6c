"""The plans from pages to books: full run, join, analysis, EPUB.

Pages that several steps read are written to the shared checkpoint folder once they are
cleaned. Small sets (dictionary, repeated phrases) are counted
when a plan is made, to see whether they may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chapters, clean, headers, joiner, quality, running
from ..operators.ordered import packed, stored


@dataclass
class Result:
    """What a run made, or why it failed. ``books``: rows (book_id, block, n_pages, text, ...) for ``writers.text_files``; ``chapters``: rows for ``writers.epub_files``."""

    success: bool
    message: str = ""
    books: DataFrame | None = None
    chapters: DataFrame | None = None
    reports: DataFrame | None = None
    boundaries: DataFrame | None = None


def cleaned_pages(results: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(book_id, page_no, text) from OCR results (raw layout JSON and text without headers), page by page."""
    return clean.clean_raw(results, dictionary, raw="raw", text="text_nohf").select("book_id", "page_no", F.col("cleaned").alias("text"))


def joined_books(pages: DataFrame, markers: bool = True, running_headers: bool = True, min_occurrences: int = 10) -> DataFrame:
    """Books as rows (``joiner.blocks``): headers and footers that repeat dropped, pages joined, running headers dropped."""
    whole = joiner.blocks(headers.clean_book_pages(packed(pages), min_occurrences), markers=markers)
    return running.drop_running_headers(whole) if running_headers else whole


def run(results: DataFrame, dictionary: DataFrame | None = None, markers: bool = True, formats: tuple[str, ...] = ("md", "epub"), **limits) -> Result:
    """The full plan over OCR results: reports on the raw texts, then cleaned and joined books. No pages, or an error of Spark, is a failed result."""
    try:
        if results.limit(1).isEmpty():
            return Result(False, "No pages found")
        reports = quality.report(results, "text_nohf", "success", **limits)
        pages = headers.clean_book_pages(packed(cleaned_pages(results, dictionary)))
        books = running.drop_running_headers(joiner.blocks(pages, markers=markers))
        made = chapters.of_blocks(stored(books)) if "epub" in formats else None
        return Result(True, "", books, made, reports, joiner.boundaries(pages))
    except PySparkException as e:  # what Spark says of the data; errors of this program are raised
        return Result(False, str(e))


def join_only(pages: DataFrame, kind: str = "markdown", dictionary: DataFrame | None = None, markers: bool = True, running_headers: bool = True) -> DataFrame:
    """Books, as rows, from page files: JSON by its blocks (unreadable ones are empty), markdown without the search for repetition."""
    if kind == "json":
        listed = pages.withColumn("_raw", F.when(F.ltrim("text").startswith("["), F.col("text")))
        done = clean.clean_raw(listed.withColumn("_none", F.lit("")), dictionary, raw="_raw", text="_none")
    else:
        done = clean.clean_markdown(pages, dictionary)
    return joined_books(done.select("book_id", "page_no", F.col("cleaned").alias("text")), markers, running_headers)
