"""Incremental runs: what is still to process, and results with their gaps filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_output(outputs: DataFrame) -> DataFrame:
    """Outputs with a JSON file that can be read and a text without headers."""
    return outputs.where(F.col("has_json") & F.col("has_nohf") & F.coalesce("json_valid", F.lit(True)))


def fresh(outputs: DataFrame, images: DataFrame, key: list[str]) -> Column:
    return (outputs["modified"] >= images["modified"]) & _same(outputs, images, key)


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    same = F.lit(True)
    for k in key:
        same &= a[k] == b[k]
    return same


def to_process(images: DataFrame, outputs: DataFrame, key: tuple[str, ...] = ("book_id", "page_no")) -> DataFrame:
    """Images without an output at least as new (both have ``modified``)."""
    i, o = images.alias("i"), outputs.alias("o")
    return i.join(o, fresh(o, i, list(key)), "left_anti")


def cached(images: DataFrame, outputs: DataFrame, key: tuple[str, ...] = ("book_id", "page_no")) -> DataFrame:
    """Images whose output is at least as new."""
    i, o = images.alias("i"), outputs.alias("o")
    return i.join(o, fresh(o, i, list(key)), "left_semi")


def filled(images: DataFrame, results: DataFrame, key: tuple[str, ...] = ("book_id", "page_no")) -> DataFrame:
    """A result for every image; a missing one is a failure with a message."""
    rows = images.select(*key).join(results, list(key), "left")
    missing = F.col("success").isNull()
    return rows.withColumn("error_message", F.when(missing, "Processing failed or was interrupted").otherwise(F.col("error_message"))).withColumn("success", F.coalesce("success", F.lit(False)))


def outcome(results: DataFrame) -> DataFrame:
    """(book_id, n_pages, n_success, n_failed, ready) of each book."""
    good = F.count_if(F.coalesce("success", F.lit(False)))
    return results.groupBy("book_id").agg(F.count("*").alias("n_pages"), good.alias("n_success"), (F.count("*") - good).alias("n_failed"), (F.count("*") > 0).alias("ready"))
