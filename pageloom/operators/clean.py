"""Cleaning of pages: layout blocks, raw page JSON, markdown, with a dictionary for broken words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pystr import lstrip
from .ordered import stored

# Layout categories that aren't body text.
EXCLUDED = ("Page-header", "Page-footer", "Page-number")
BLOCKS = "array<struct<bbox:array<double>,category:string,text:string>>"
#: A dictionary of at most so many words and characters is broadcast to the workers; a larger one is joined.
MOST_WORDS, MOST_CHARACTERS = 500_000, 8_000_000


def known_words(pages: DataFrame, dictionary: DataFrame, texts: Column, key: list[str]) -> DataFrame:
    """(key, known): for each row the words of its broken pairs that are in the dictionary, by a join."""
    whole = T.JAVA_BREAK.replace("(", "").replace(")", "")
    joined = lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"({whole})"), F.lit(1)), lambda x: F.lower(F.replace(x, F.lit("-\n"), F.lit(""))))
    pair = F.explode(F.array_distinct(F.flatten(F.transform(texts, joined))))
    broken = pages.where(F.exists(texts, lambda t: t.rlike(T.JAVA_BREAK)))
    return broken.select(*key, pair.alias("word")).join(dictionary, "word", "left_semi").groupBy(*key).agg(F.collect_set("word").alias("known"))


@dataclass
class Words:
    """A dictionary that is ready for use: its words, and a broadcast set of them if they are few enough."""

    words: DataFrame
    shared: Broadcast | None

    @staticmethod
    def of(dictionary: DataFrame | Words | None) -> Words | None:
        if dictionary is None or isinstance(dictionary, Words):
            return dictionary
        words = stored(dictionary.select(F.lower("word").alias("word")).where("word is not null").distinct())
        n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
        if n > MOST_WORDS or size > MOST_CHARACTERS:
            return Words(words, None)
        return Words(words, dictionary.sparkSession.sparkContext.broadcast(frozenset(words.toArrow()["word"].to_pylist())))


def dehyphenator(pages: DataFrame, dictionary: DataFrame | Words | None, texts: Column, key: list[str]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """How broken words are mended: with a broadcast set if the dictionary is small enough, else with each row's known words joined to it."""
    ready = Words.of(dictionary)
    if ready is None:
        return pages, T.keep_hyphens
    if ready.shared is not None:
        return pages, T.mender(ready.shared)
    return pages.join(known_words(pages, ready.words, texts, key), key, "left"), lambda t: T.mend_with(t, F.col("known"))


def clean_texts(pages: DataFrame, dictionary: DataFrame | Words | None = None, key: tuple[str, ...] = ("book_id", "page_no"), text: str = "text", name: str = "cleaned") -> DataFrame:
    """Adds each text as one cleaned block."""
    rows, mend = dehyphenator(pages, dictionary, F.array(text), list(key))
    return rows.withColumn(name, T.clean_block(F.col(text), mend)).drop("known")


def clean_markdown(pages: DataFrame, dictionary: DataFrame | Words | None = None, key: tuple[str, ...] = ("book_id", "page_no"), text: str = "text", name: str = "cleaned") -> DataFrame:
    """Adds each text cleaned as markdown, salvaged first where it looks like JSON."""
    rows, mend = dehyphenator(pages, dictionary, F.array(text), list(key))
    return rows.withColumn(name, T.clean_markdown(F.col(text), mend)).drop("known")


def body_texts(blocks: Column) -> Column:
    """The texts of the blocks that aren't headers, footers or numbers; a null category is text."""
    body = F.filter(blocks, lambda b: ~F.coalesce(b["category"], F.lit("Text")).isin(*EXCLUDED))
    return F.filter(F.transform(body, lambda b: F.coalesce(b["text"], F.lit(""))), lambda t: t != "")


def clean_blocks(pages: DataFrame, dictionary: DataFrame | Words | None = None, repetition: bool = True, key: tuple[str, ...] = ("book_id", "page_no"), blocks: str = "blocks", name: str = "cleaned") -> DataFrame:
    """Adds the page's text from its layout blocks: body texts, repetition cut, cleaned, empty ones dropped, as paragraphs. No blocks give an empty text."""
    rows = pages.withColumn("_texts", body_texts(F.col(blocks)))
    if repetition:
        rows = rows.withColumn("_texts", T.blocks_without_repetition(F.col("_texts")))
    if dictionary is not None:
        # the texts meet the mender as one string; its gap is no word character, so no break spans it
        gap = "\x1d\x01\x1d"
        rows, mend = dehyphenator(rows, dictionary, F.col("_texts"), list(key))
        rows = rows.withColumn("_texts", F.when(F.size("_texts") > 0, F.split(mend(F.array_join("_texts", gap)), gap)).otherwise(F.col("_texts")))
    else:
        rows = rows.withColumn("_texts", F.transform("_texts", T.keep_hyphens))
    cleaned = F.array_join(F.filter(F.transform("_texts", T.unwrap), lambda t: t != ""), "\n\n")
    return rows.withColumn(name, F.coalesce(cleaned, F.lit(""))).drop("_texts", "known")


def clean_raw(pages: DataFrame, dictionary: DataFrame | Words | None = None, repetition: bool = True, key: tuple[str, ...] = ("book_id", "page_no"), raw: str = "raw", text: str = "text", name: str = "cleaned") -> DataFrame:
    """Adds the page's text from its raw layout JSON: a non-empty list by its blocks, anything else from the markdown ``text``."""
    dictionary = Words.of(dictionary)
    parsed = F.when(lstrip(F.col(raw)).startswith("["), F.from_json(raw, BLOCKS))
    rows = pages.withColumn("_blocks", parsed).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    listed = F.col("_blocks").isNotNull() & (F.size("_blocks") > 0)
    rows = clean_blocks(rows, dictionary, repetition, key, "_blocks", "_by_blocks")
    if repetition:
        rows = rows.withColumn("_text", T.without_repetition(F.col("_text"))["text"])
    rows = clean_markdown(rows, dictionary, key, "_text", "_by_text")
    return rows.withColumn(name, F.when(listed, F.col("_by_blocks")).otherwise(F.col("_by_text"))).drop("_blocks", "_text", "_by_blocks", "_by_text")


def repetitions(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``phrase``, the repeated phrase (null if there is none), and ``cleaned``, the text with its runs cut."""
    found = pages.withColumn("_found", T.without_repetition(F.col(text)))
    return found.withColumn("phrase", F.col("_found.phrase")).withColumn("cleaned", F.col("_found.text")).drop("_found")
