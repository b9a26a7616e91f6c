"""Studies of OCR accuracy: runs compared with their baseline, averages, speed-ups."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(a: Sequence, b: Sequence) -> float:
    """``SequenceMatcher(None, a, b).ratio()``, exactly, by its rules for what matches first.

    Of ``a`` only the places of elements that the matcher indexes are visited; in texts of 200 characters and more it
    passes over those that make up over a hundredth, nearly all letters.
    """
    if a == b:
        return 1.0
    places = SequenceMatcher(None, (), b).b2j
    at = [i for i, x in enumerate(a) if x in places]
    found, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size = longest(a, b, places, at, alo, ahi, blo, bhi)
        found += size
        if size and alo < i and blo < j:
            todo.append((alo, i, blo, j))
        if size and i + size < ahi and j + size < bhi:
            todo.append((i + size, ahi, j + size, bhi))
    return 2.0 * found / (len(a) + len(b))


def longest(a: Sequence, b: Sequence, places: dict, at: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest match within a[alo:ahi] and b[blo:bhi] as ``SequenceMatcher`` chooses it: of indexed elements, made longer at both ends by any."""
    first, second, size, ends = alo, blo, 0, {}
    begin, stop = bisect_left(at, alo), bisect_left(at, ahi)
    for k in range(begin, stop):
        i = at[k]
        goes_on = k + 1 < stop and at[k + 1] == i + 1
        before = ends if k > begin and at[k - 1] == i - 1 else {}
        if not before and not goes_on and size:  # a single element is no longer match
            ends = before
            continue
        own = places[a[i]]
        own = own[bisect_left(own, blo) : bisect_left(own, bhi)]
        if not before:
            ends = dict.fromkeys(own, 1) if goes_on else {}
            if own and not size:
                first, second, size = i, own[0], 1
            continue
        ends = {}
        for j in own:
            n = ends[j] = before.get(j - 1, 0) + 1
            if n > size:
                first, second, size = i - n + 1, j - n + 1, n
    while first > alo and second > blo and a[first - 1] == b[second - 1]:
        first, second, size = first - 1, second - 1, size + 1
    while first + size < ahi and second + size < bhi and a[first + size] == b[second + size]:
        size += 1
    return first, second, size


def similarity(a: str, b: str) -> tuple[float, float, int, int, int]:
    """Similarity of two texts by characters and by words, their difference in length, and the words of each."""
    a, b = a or "", b or ""
    x, y = a.split(), b.split()
    return ratio(a, b), ratio(x, y), len(b) - len(a), len(x), len(y)


MEASURES = "struct<char_similarity: double, word_similarity: double, length_difference: int, base_words: int, words: int>"


def _compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([similarity(x, y) for x, y in zip(a, b, strict=True)], columns=["char_similarity", "word_similarity", "length_difference", "base_words", "words"])


def with_baseline(runs: DataFrame, setting: str = "rotation", baseline: float = 0) -> DataFrame:
    """Runs (image, setting, text, ocr_time) with ``base_text`` and ``base_time`` of the image's baseline run."""
    base = runs.where(F.col(setting) == baseline).select("image", F.col("text").alias("base_text"), F.col("ocr_time").alias("base_time"))
    return runs.join(base, "image")


def with_similarity(runs: DataFrame, setting: str = "rotation", baseline: float = 0) -> DataFrame:
    joined = with_baseline(runs, setting, baseline)
    return joined.withColumn("_c", F.pandas_udf(_compared, MEASURES)("base_text", "text")).select("*", "_c.*").drop("_c")


def averages(compared_runs: DataFrame, setting: str = "rotation") -> DataFrame:
    return compared_runs.groupBy(setting).agg(F.count("*").alias("n_runs"), F.avg("ocr_time").alias("avg_time"), F.avg("char_similarity").alias("avg_char_similarity"), F.avg("word_similarity").alias("avg_word_similarity"))


def speedups(runs: DataFrame, setting: str = "scale", baseline: float = 1.0) -> DataFrame:
    """(setting, avg_time, speedup): the baseline's average time over each setting's; 0 where that is 0, null without a baseline."""
    mean = runs.groupBy(setting).agg(F.avg("ocr_time").alias("avg_time"))
    base = mean.where(F.col(setting) == baseline).select(F.col("avg_time").alias("_base"))
    return mean.join(F.broadcast(base), F.lit(True), "left").select(setting, "avg_time", F.when(F.col("avg_time") > 0, F.col("_base") / F.col("avg_time")).otherwise(0.0).alias("speedup"))


def first_images(images: DataFrame, n: int, name: str = "image") -> DataFrame:
    """The first n images by name, which a study runs on."""
    return images.orderBy(name).limit(n)
