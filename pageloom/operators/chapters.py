"""Chapters of joined books: of texts held as one string, by array expressions, or of books as rows of whole lines.

Over rows a chapter's number is the count of marker lines before it, and what it holds is known from
positions in the book: sums over the blocks before, kept within runs of blocks and carried from run
to run. So no book, and no chapter, is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pystr import SPACE, given, lstrip, rstrip, strip
from .ordered import RUN, stored, totals_before

#: A line that begins a chapter: a header of the first two levels, or "Chapter 1", "Part 2".
MARKER = rf"\A(?:#{{1,2}}{SPACE}+[^\n]+|(?i:chapter|part){SPACE}+\d+[^\n]*)\z"
LEAST, PREAMBLE = 100, 100


def chapters(books: DataFrame, content: str = "content", split: bool = True) -> DataFrame:
    """(book_id, chapter_no, title, content): from each marker line to the next. Chapters of 100 characters or fewer
    are dropped; so is a text before the first marker, unless it is longer (then it is an introduction). A book
    without chapters is one named Content. Markers are told line by line."""
    text = F.coalesce(F.col(content), F.lit(""))
    if not split:
        return books.select("book_id", F.lit(0).alias("chapter_no"), F.lit("Content").alias("title"), text.alias("content"))
    rows = books.select("book_id", text.alias("_text"), F.split(text, "\n").alias("_lines"))
    starts = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(MARKER), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("_starts", starts)
    n = F.size("_lines")

    def chapter(start, k):
        end = F.coalesce(F.get("_starts", k + 1), n + 1)
        title = strip(F.ltrim(strip(F.element_at("_lines", start)), F.lit("#")))
        return F.struct(title.alias("title"), strip(F.array_join(F.slice("_lines", start, end - start), "\n")).alias("content"))

    found = F.filter(F.transform("_starts", chapter), lambda c: F.length(c["content"]) > LEAST)
    head = F.array_join(F.slice("_lines", 1, F.get("_starts", F.lit(0)) - 1), "\n")
    intro = F.struct(F.lit("Introduction").alias("title"), strip(head).alias("content"))
    led = F.when((F.length(head) + 1 > PREAMBLE) & (strip(head) != ""), F.concat(F.array(intro), found)).otherwise(found)
    whole = F.array(F.struct(F.lit("Content").alias("title"), F.col("_text").alias("content")))
    out = F.when((F.size("_starts") == 0) | (F.size(found) == 0), whole).otherwise(led)
    return rows.select("book_id", F.posexplode(out).alias("chapter_no", "c")).select("book_id", "chapter_no", "c.title", "c.content")


def parts(blocks: DataFrame) -> DataFrame:
    """(book_id, block, part, at, title, text) of blocks of whole lines: cut at marker lines; ``part`` counts them within the block (0: what stands before the first), ``at`` is the place in the block."""
    lines = F.split("text", "\n")

    def cut(x):
        n = F.size(x)
        starts = F.filter(F.transform(x, lambda line, i: F.when(line.rlike(MARKER), i + 1)), lambda i: i.isNotNull())

        def part(a, k, starts):
            end = F.coalesce(F.get(starts, k + 1), n + 1)
            own = F.concat(F.array_join(F.slice(x, a, end - a), "\n"), F.when(end <= n, "\n").otherwise(""))
            ahead = F.length(F.array_join(F.slice(x, 1, a - 1), "\n")) + F.when(a > 1, 1).otherwise(0)
            title = F.when(k > 0, strip(F.ltrim(strip(F.element_at(x, a)), F.lit("#"))))
            return F.struct(k.alias("part"), ahead.cast("bigint").alias("at"), title.alias("title"), own.alias("text"))

        # the part before the first marker begins at line 1, and is empty if that is one
        every = given(F.concat(F.array(F.lit(1)), starts), lambda s: F.transform(s, lambda a, k: F.when((k == 0) & (F.get(s, F.lit(1)) == 1), F.struct(k.alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("string").alias("title"), F.lit("").alias("text"))).otherwise(part(a, k, s))))
        return every

    return blocks.select("book_id", "block", F.explode(given(lines, cut)).alias("x")).select("book_id", "block", "x.*")


def of_blocks(blocks: DataFrame, split: bool = True, run: int = RUN) -> DataFrame:
    """(book_id, chapter_no, title, block, part, text): the chapters of books as rows of whole lines, as ``chapters`` makes them of whole texts; a chapter's texts in order of block and part are its content."""
    if not split:
        return blocks.select("book_id", F.lit(0).cast("bigint").alias("chapter_no"), F.lit("Content").alias("title"), "block", F.lit(0).alias("part"), "text")
    cut = stored(parts(blocks))
    own = cut.groupBy("book_id", "block").agg(F.max("part").alias("_markers"), F.sum(F.length("text")).alias("_length"))
    placed = totals_before(own, {"part0": F.col("_markers"), "at0": F.col("_length")}, "book_id", "block", run).select("book_id", "block", "part0", "at0")
    rows = stored(cut.join(placed, ["book_id", "block"]).withColumn("_chapter", F.col("part0") + F.col("part")).withColumn("at", F.col("at0") + F.col("at")))
    text, n = F.col("text"), F.length("text")
    filled = F.when(strip(text) != "", F.struct((F.col("at") + n - F.length(lstrip(text))).alias("a"), (F.col("at") + F.length(rstrip(text))).alias("z")))
    facts = rows.select("book_id", "_chapter", "title", "at", filled.alias("f"))
    found = facts.groupBy("book_id", "_chapter").agg(F.max("title").alias("title"), F.min("at").alias("at"), F.min("f.a").alias("low"), F.max("f.z").alias("high"))
    good = (F.col("_chapter") > 0) & (F.coalesce(F.col("high") - F.col("low"), F.lit(0)) > LEAST)
    found = stored(found.withColumn("good", good))
    books = found.groupBy("book_id").agg(F.bool_or("good").alias("any"), F.min(F.when(F.col("_chapter") > 0, F.col("at"))).alias("head"))
    led = (F.col("_chapter") == 0) & F.col("any") & (F.col("head") > PREAMBLE) & F.col("low").isNotNull()
    told = found.join(books, "book_id").withColumn("stays", ~F.col("any") | F.col("good") | led)
    numbered = totals_before(told, {"chapter_no": F.when(F.col("stays") & F.col("any"), 1).otherwise(0)}, "book_id", "_chapter", run).where("stays")
    title = F.when(~F.col("any"), "Content").when(F.col("_chapter") == 0, "Introduction").otherwise(F.col("title"))
    named = numbered.select("book_id", "_chapter", "chapter_no", title.alias("title"), F.when(F.col("any"), F.col("low")).alias("low"), F.when(F.col("any"), F.col("high")).alias("high"))
    met = rows.drop("title").join(named, ["book_id", "_chapter"])
    begin = F.greatest(F.coalesce(F.col("low") - F.col("at"), F.lit(0)), F.lit(0))
    end = F.least(F.coalesce(F.col("high") - F.col("at"), n), n)
    kept = F.when(end > begin, F.substring("text", (begin + 1).cast("int"), (end - begin).cast("int"))).otherwise("")
    out = met.select("book_id", "chapter_no", "title", "block", "part", kept.alias("text"))
    return out.where("text <> '' or (title = 'Content' and part = 0)")
