"""Pages as a stream: files are taken up once, each batch is replayable.

Cleaning and findings need a page alone. What repeats in a book is known only from all its pages, so a header that
reaches its count later is withdrawn from pages that came before: each batch's pages are kept by its number, and the
books that it adds to are made anew from all batches, whichever order these came in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean, headers, quality
from ..operators.ordered import run_of, stored

PAGES = "book_id string, page_no int, raw string, text_nohf string, success boolean"


def stream(spark: SparkSession, folder: str, schema: str = PAGES, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def processed(batch: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """A batch's pages cleaned, with the number of findings on each by severity."""
    found = F.transform(quality.page_findings(F.coalesce("text_nohf", F.lit(""))), lambda x: x["severity"])
    rows = clean.clean_raw(batch, dictionary, raw="raw", text="text_nohf")
    counts = [F.size(F.array_remove(found, k)) for k in ("error", "warning", "info")]
    counts = [(F.size(found) - c).alias(f"n_{k}s") for c, k in zip(counts, ("error", "warning", "info"), strict=True)]
    return rows.select("book_id", "page_no", F.col("cleaned").alias("text"), "success", *counts)


def run(pages: DataFrame, output: str, checkpoint: str, dictionary: DataFrame | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Clean what is new and end. A batch that is tried again overwrites its own folder, so each page is there once."""

    def write(batch: DataFrame, number: int) -> None:
        done = processed(batch, dictionary)
        done.write.mode("overwrite").parquet(f"{output}/batch={number}")
        if after is not None:
            after(done, number)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TEXTS = "book_id string, page_no int, text string"


def keep_books(batch: DataFrame, number: int, folder: str, min_occurrences: int = 10) -> None:
    """Add a batch of pages (book_id, page_no, text) to ``folder``: to its pages, and to the books without repeated headers and footers that ``books`` reads.

    Of a page that comes in several batches that of the last number counts; of one that comes twice in a batch the
    greater text. Only the folders of the batch's books are read and written; a batch that is tried again writes what
    it wrote before. Pages without a book or a number are left out.
    """
    spark = batch.sparkSession
    own = batch.where("book_id is not null and page_no is not null").groupBy("book_id", "page_no").agg(F.max("text").alias("text"))
    own.write.mode("overwrite").partitionBy("book_id").parquet(f"{folder}/pages/batch={number}")
    held = spark.read.schema("page_no int, text string, batch int, book_id string").parquet(f"{folder}/pages")
    added = held.where(F.col("batch") == number).select("book_id").distinct()
    rows = held.join(added, "book_id", "left_semi").groupBy("book_id", "page_no").agg(F.max_by("text", "batch").alias("text"))
    done = headers.clean_book_pages(stored(rows), min_occurrences).select("page_no", "text", "book_id")
    done.repartition("book_id", run_of()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(f"{folder}/books")


def books(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, page_no, text): the pages that ``keep_books`` has made so far."""
    return spark.read.schema("page_no int, text string, book_id string").parquet(f"{folder}/books").select("book_id", "page_no", "text")


def run_books(pages: DataFrame, folder: str, checkpoint: str, min_occurrences: int = 10) -> StreamingQuery:
    """Take up the pages (book_id, page_no, text) that are new, and end."""
    add = lambda batch, number: keep_books(batch, number, folder, min_occurrences)
    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
