"""Headers and footers that repeat across the pages of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pystr import SPACE, given, strip
from ..functions.scalar import normal_header
from .ordered import run_of, stored

HEADER = f"\\A#+{SPACE}+([^\\n]+)\\z"
#: Sets of phrases of at most so many characters in all are broadcast to the pages; more are joined by a shuffle.
MOST_BROADCAST = 16_000_000
#: Characters that a book and a phrase count for beside their own.
EACH = 64


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def kept_small(sets: DataFrame, phrases: Column) -> DataFrame:
    """A table of a row for each book, computed once, and broadcast if its phrases are few enough."""
    sets = stored(sets)
    size = F.aggregate(phrases, F.lit(EACH).cast("bigint"), lambda n, x: n + F.length(x) + EACH)
    return F.broadcast(sets) if (sets.agg(F.sum(size)).first()[0] or 0) <= MOST_BROADCAST else sets


def may_have_headers(text: Column) -> Column:
    return text.startswith("#") | F.contains(text, F.lit("\n#"))


def header_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """(book_id, page_no, line_no, header): the markdown headers, normalised. Only header lines become rows."""
    numbered = F.transform(lines(F.col(text)), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    own = F.filter(numbered, lambda x: x["line"].startswith("#") & x["line"].rlike(HEADER))
    rows = pages.where(may_have_headers(F.col(text))).select("book_id", "page_no", F.explode(own).alias("h"))
    return rows.select("book_id", "page_no", "h.line_no", normal_header(F.regexp_extract("h.line", HEADER, 1)).alias("header"))


def repeated_section_headers(pages: DataFrame, min_occurrences: int = 3, window_pages: int = 20, max_length: int = 50, text: str = "text") -> DataFrame:
    """(book_id, header): headers that occur so often within so many consecutive pages.

    A header's occurrences may be a third of all rows: they are counted by page first, and windowed in overlapping
    runs of pages, each run with the pages of the next one that its windows reach.
    """
    counts = header_lines(pages, text).where(F.length("header") < max_length).groupBy("book_id", "header", "page_no").agg(F.count("*").alias("n"))
    run = 64 * window_pages
    dealt = counts.withColumn("_run", F.explode(F.array_distinct(F.array(run_of(run=run), F.floor((F.col("page_no") - (window_pages - 1)) / run)))))
    ahead = Window.partitionBy("book_id", "header", "_run").orderBy("page_no").rangeBetween(0, window_pages - 1)
    return dealt.withColumn("_within", F.sum("n").over(ahead)).where(F.col("_within") >= min_occurrences).select("book_id", "header").distinct()


def drop_repeated_section_headers(pages: DataFrame, repeated: DataFrame, text: str = "text") -> DataFrame:
    """The pages with all but the first occurrence in the book of each repeated header dropped."""
    found = header_lines(pages, text).join(repeated, ["book_id", "header"], "left_semi")
    first = found.groupBy("book_id", "header").agg(F.min(F.struct("page_no", "line_no")).alias("first"))
    sets = kept_small(first.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("header", "first"))).alias("_first")), F.map_keys("_first"))

    def stays(line: Column, i: Column) -> Column:
        first = F.col("_first")[normal_header(F.regexp_extract(line, HEADER, 1))]
        return ~line.rlike(HEADER) | first.isNull() | (F.struct(F.col("page_no").alias("page_no"), i.alias("line_no")) <= first)

    kept = F.array_join(F.filter(lines(F.col(text)), stays), "\n")
    some = F.col("_first").isNotNull() & may_have_headers(F.col(text))
    return pages.join(sets, "book_id", "left").withColumn(text, F.when(some, kept).otherwise(F.col(text))).drop("_first")


def edge_lines(text: Column) -> tuple[Column, Column]:
    """The first and last line that isn't blank, stripped; null if all are. The other lines are not looked at."""
    return edge_line(text, 1), edge_line(text, -1)


def edge_line(text: Column, side: int) -> Column:
    return given(strip(text), lambda t: F.when(t != "", strip(F.substring_index(t, "\n", side))))


def repeated_edges(pages: DataFrame, min_occurrences: int = 10, max_length: int = 80, text: str = "text") -> DataFrame:
    """(book_id, side, phrase, n): short first lines (header) and last lines (footer) that repeat in a book."""
    first, last = edge_lines(F.col(text))
    sides = pages.where(strip(F.col(text)) != "").select("book_id", F.explode(F.array(F.struct(F.lit("header").alias("side"), first.alias("phrase")), F.struct(F.lit("footer").alias("side"), last.alias("phrase")))).alias("s"))
    counted = sides.select("book_id", "s.side", "s.phrase").where(F.length("phrase") < max_length).groupBy("book_id", "side", "phrase").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_occurrences)


def without_edges(text: Column, headers: Column, footers: Column) -> Column:
    """The text without leading lines among the headers and then trailing ones among the footers. Only a text whose first (last) line is among them is cut into lines."""

    def cut(rows: Column, phrases: Column) -> Column:
        at = F.array_position(F.transform(rows, lambda x: F.array_contains(phrases, strip(x))), F.lit(False))
        return F.when(at == 0, F.slice(rows, 1, 0)).otherwise(F.slice(rows, at.cast("int"), F.size(rows)))

    def top(t: Column) -> Column:
        found = F.array_contains(headers, strip(F.substring_index(t, "\n", 1)))
        return F.when(found, F.array_join(cut(lines(t), headers), "\n")).otherwise(t)

    def bottom(t: Column) -> Column:
        found = F.array_contains(footers, strip(F.substring_index(t, "\n", -1)))
        return F.when(found, F.array_join(F.reverse(cut(F.reverse(lines(t)), footers)), "\n")).otherwise(t)

    return strip(given(given(strip(text), top), bottom))


def drop_edges(pages: DataFrame, repeated: DataFrame, text: str = "text") -> DataFrame:
    """The pages without the repeated phrases at their top and bottom; books without any, and blank pages, stay as they are."""
    none = F.array().cast("array<string>")
    sets = repeated.groupBy("book_id").agg(F.collect_set(F.when(F.col("side") == "header", F.col("phrase"))).alias("_headers"), F.collect_set(F.when(F.col("side") == "footer", F.col("phrase"))).alias("_footers"))
    rows = pages.join(kept_small(sets, F.concat("_headers", "_footers")), "book_id", "left")
    clean = without_edges(F.col(text), F.coalesce("_headers", none), F.coalesce("_footers", none))
    return rows.withColumn(text, F.when(F.col("_headers").isNull() | (strip(F.col(text)) == ""), F.col(text)).otherwise(clean)).drop("_headers", "_footers")


def clean_book_pages(pages: DataFrame, min_occurrences: int = 10, text: str = "text") -> DataFrame:
    """Running section headers first, then headers and footers of what is left."""
    once = drop_repeated_section_headers(pages, repeated_section_headers(pages, text=text), text)
    return drop_edges(once, repeated_edges(once, min_occurrences, text=text), text)
