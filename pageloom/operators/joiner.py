"""Decisions at page boundaries, and books put together from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pystr import NOT_SPACE, SPACE, SPACE_SET, WORD, lstrip, rstrip, strip
from .ordered import RUN, in_runs, last_before, previous

# What ends a sentence, begins a section or goes on with one; abbreviations whose dot ends nothing.
SENTENCE_END = "[.!?;:][\"')\\]]*\\z|[。！？；：」』）】]\\z"
SECTION = rf"(?i)\A(?:chapter|part|section|#{{1,6}}{SPACE}+|\d+\.{SPACE}+[A-Z]|[IVXLCDM]+\.{SPACE}*[A-Z])"
CONTINUATION = r"\A[a-z,;:\-–—]"
ABBREVIATIONS = "mr mrs ms dr prof sr jr vs etc al inc ltd corp eg ie viz cf fig no vol pp ed eds trans rev st ave blvd".split()
# Decisions on a boundary and their reasons.
DIRECT, PARAGRAPH, NEW_SECTION = "direct", "paragraph", "section"
REASONS = {
    "empty": "Empty page",
    "section": "New section/chapter detected",
    "goes_on_after": "Lowercase continuation after sentence",
    "complete": "Complete sentence at page boundary",
    "goes_on": "Sentence continues across page",
    "hyphen": "Hyphenated word across page",
    "unclear": "Ambiguous boundary, defaulting to paragraph",
}


def ends_sentence(text: Column) -> Column:
    """The text ends with closing punctuation that isn't an abbreviation's; so does an empty one."""
    text = rstrip(text)
    last = F.lower(F.rtrim(F.regexp_extract(text, f"({NOT_SPACE}+)\\z", 1), F.lit(".\"')]")))
    return (text == "") | (text.rlike(SENTENCE_END) & ~last.isin(ABBREVIATIONS))


def continues(text: Column) -> Column:
    return lstrip(text).rlike(CONTINUATION)


def hyphenated(text: Column) -> Column:
    return rstrip(text).rlike(f"{WORD}-\\z")


def ends_in_text(stripped: Column) -> Column:
    """The last line of a stripped text is no header and no part of one: the line before it says something too."""
    last = F.substring_index(stripped, "\n", -1)
    before = F.substring_index(F.rtrim(F.left(stripped, F.length(stripped) - F.length(last)), F.lit("\n")), "\n", -1)
    return ~last.startswith("#") & before.rlike(f"[^#{SPACE_SET}]")


def edge_facts(stripped: Column) -> Column:
    """All that boundaries depend on, of one stripped text: a few flags."""
    tail, head = F.right(stripped, F.lit(200)), F.left(stripped, F.lit(100))
    return F.struct((stripped == "").alias("empty"), stripped.rlike(SECTION).alias("section"), continues(head).alias("goes_on"), ends_sentence(tail).alias("complete"), hyphenated(tail).alias("hyphen"), ends_in_text(stripped).alias("closed"))


def judged(before: Column, after: Column) -> Column:
    """struct(decision, reason) of the boundary between two pages, from their facts."""

    def result(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(REASONS[reason]).alias("reason"))

    return (
        F.when(before["empty"] | after["empty"], result(PARAGRAPH, "empty"))
        .when(after["section"], result(NEW_SECTION, "section"))
        .when(before["complete"] & after["goes_on"], result(DIRECT, "goes_on_after"))
        .when(before["complete"], result(PARAGRAPH, "complete"))
        .when(after["goes_on"], result(DIRECT, "goes_on"))
        .when(before["hyphen"], result(DIRECT, "hyphen"))
        .otherwise(result(PARAGRAPH, "unclear"))
    )


def decided(rows: DataFrame, run: int = RUN) -> DataFrame:
    """Rows (book_id, page_no, facts, ...) with ``before_page``, ``before_closed``, ``decision`` and ``reason``, null on a book's first page, and ``last``."""
    rows = previous(rows, F.col("facts"), "before", run=run).withColumnRenamed("before_last", "last")
    found = F.when(F.col("before_page").isNotNull(), judged(F.col("before"), F.col("facts")))
    return rows.withColumn("_judged", found).withColumn("decision", F.col("_judged.decision")).withColumn("reason", F.col("_judged.reason")).withColumn("before_closed", F.col("before.closed")).drop("_judged", "before", "facts")


def boundaries(pages: DataFrame, text: str = "text", run: int = RUN) -> DataFrame:
    """(book_id, page_before, page_after, decision, reason): a row for each two pages that follow one another. Only flags of the texts are shuffled."""
    stripped = strip(F.coalesce(F.col(text), F.lit("")))
    rows = decided(pages.select("book_id", "page_no", edge_facts(stripped).alias("facts")), run)
    return rows.where("before_page is not null").select("book_id", F.col("before_page").alias("page_before"), F.col("page_no").alias("page_after"), "decision", "reason")


def decision_counts(found: DataFrame) -> DataFrame:
    """Boundaries of each book by decision."""
    return found.groupBy("book_id").agg(F.count("*").alias("n_boundaries"), *[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in (DIRECT, PARAGRAPH, NEW_SECTION)])


def separator(page: Column, decision: Column, markers: bool = True) -> Column:
    """What stands between two pages; with markers, a comment that names the second."""
    mark = F.format_string("<!-- page %d -->", page) if markers else F.lit("")
    section = F.concat(F.lit("\n\n"), mark, F.lit("\n\n")) if markers else F.lit("\n\n---\n\n")
    paragraph = F.concat(F.lit("\n\n"), mark, F.lit("\n")) if markers else F.lit("\n\n")
    return F.when(decision == DIRECT, F.concat(F.lit(" "), mark)).when(decision == PARAGRAPH, paragraph).otherwise(section)


def joined_pages(pages: DataFrame, text: str = "text", markers: bool = True, run: int = RUN) -> DataFrame:
    """(book_id, page_no, piece): what each page adds to its book; concatenated in page order the pieces are the book."""
    return _pieces(pages, text, markers, run).select("book_id", "page_no", "piece")


def _pieces(pages: DataFrame, text: str, markers: bool, run: int) -> DataFrame:
    stripped = strip(F.coalesce(F.col(text), F.lit("")))
    rows = in_runs(pages.select("book_id", "page_no", text), run=run)
    rows = decided(rows.withColumn("facts", edge_facts(stripped)), run).withColumn("stripped", stripped)  # a text is shuffled once
    piece = F.when(F.col("before_page").isNull(), F.col("stripped")).when(F.col("stripped") == "", "").otherwise(F.concat(separator(F.col("page_no"), F.col("decision"), markers), F.col("stripped")))
    return rows.withColumn("piece", piece)


#: What a block may begin behind: a line with more than white space that is no header, and the line ends after it, where the next line is no header and isn't indented.
CUT = rf"\n(?!#)[{SPACE_SET}&&[^\n]]*+{NOT_SPACE}[^\n]*+\n++(?=[^#{SPACE_SET}])"
#: The block that a book begins with.
FIRST = -(1 << 40)


def blocks(pages: DataFrame, text: str = "text", markers: bool = True, run: int = RUN) -> DataFrame:
    """(book_id, block, first, last, n_pages, text): books as rows of whole lines; concatenated in order of ``block`` they are the book.

    A block begins with what a page adds, if that begins with a line end and the page before ended in plain text, or else
    behind the page's first ``CUT``; a page without either belongs to the block before. So no line, no header and no run
    of line ends lies in two blocks, even where headers between are dropped. The text of a book of one page isn't
    stripped; pages of no book (null) are left out.
    """
    rows = _pieces(pages.where("book_id is not null"), text, markers, run)
    piece = F.when(F.col("last") & F.col("before_page").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.col("piece"))
    begins = F.coalesce("before_closed", F.lit(False)) & F.startswith(F.col("piece"), F.lit("\n"))
    rows = rows.select("book_id", "_run", F.col("page_no").cast("bigint").alias("page_no"), "last", piece.alias("piece"), begins.alias("_begins"))
    rows = rows.withColumn("_cut", F.when(F.col("_begins"), "").otherwise(F.regexp_substr("piece", F.lit(CUT))))
    rows = last_before(rows, F.when(F.col("_cut").isNotNull(), F.col("page_no")), "_of", run=run)
    at = F.expr("locate(_cut, piece) + length(_cut)")
    cut = F.col("_cut").isNotNull()
    own = F.struct(F.col("page_no").alias("block"), (2 * F.col("page_no") + 1).alias("at"), F.substring("piece", at, F.length("piece")).alias("text"), F.col("last").alias("last"), F.lit(0).alias("page"))
    before = F.struct(F.coalesce("_of", F.lit(FIRST)).alias("block"), (2 * F.col("page_no")).alias("at"), F.when(cut, F.substring("piece", F.lit(1), at - 1)).otherwise(F.col("piece")).alias("text"), (F.col("last") & ~cut).alias("last"), F.lit(1).alias("page"))
    parts = rows.select("book_id", F.explode(F.when(cut, F.array(before, own)).otherwise(F.array(before))).alias("x")).select("book_id", "x.*")
    made = parts.groupBy("book_id", "block").agg(F.expr("listagg(text, '') within group (order by at)").alias("text"), F.bool_or("last").alias("last"), F.sum("page").alias("n_pages"))
    return made.select("book_id", "block", (F.col("block") == FIRST).alias("first"), "last", "n_pages", F.coalesce("text", F.lit("")).alias("text"))


def books(pages: DataFrame, text: str = "text", markers: bool = True, run: int = RUN) -> DataFrame:
    """(book_id, n_pages, content), a row per book; the text of a book of one page isn't stripped."""
    pieces = _pieces(pages, text, markers, run).withColumn("_whole", F.coalesce(F.col(text), F.lit("")))
    made = pieces.groupBy("book_id").agg(F.count("*").alias("n_pages"), F.expr("listagg(piece, '') within group (order by page_no)").alias("content"), F.first("_whole").alias("_whole"))
    return made.select("book_id", "n_pages", F.when(F.col("n_pages") == 1, F.col("_whole")).otherwise(F.coalesce("content", F.lit(""))).alias("content"))
