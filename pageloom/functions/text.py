"""Cleaning of OCR text: line breaks, hyphenation, salvage of broken JSON, repetition artefacts."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pystr import WORD, given, replace, strip

#: A word broken over two lines; the second part starts with an ASCII lower-case letter.
BREAK = re.compile(r"(\w+)-\n([a-z]\w*)")
JAVA_BREAK = f"({WORD}+)-\\n([a-z]{WORD}*)"
#: The same, tried at the beginnings of words only.
WHOLE_BREAK = f"(?<!{WORD})({WORD}++)-\\n([a-z]{WORD}*+)"
#: Texts of a batch that are Python objects at a time.
SLICE = 64
#: Places in a run that are compared before all of it.
PROBES = (0, 1, 2, 5)
#: A quoted string after "text":, possessive, so that a very long one can't overflow the matcher's stack.
FRAGMENT = r'"text"\s*+:\s*+"((?:[^"\\]++|\\.)*+)(?:"|(?=\n?\z))'


def slices(batch: pa.Array) -> Iterator[list]:
    """A batch's values, few at a time: Spark hands over thousands of texts at once, of any length."""
    for k in range(0, len(batch), SLICE):
        yield batch.slice(k, SLICE).to_pylist()


def joined(parts: Iterator[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([pa.array([], kind), *parts])


def mend(text: str, known: Collection[str]) -> str:
    """Join broken words that are in the dictionary, and give the others their hyphen back."""
    return BREAK.sub(lambda m: m[1] + m[2] if (m[1] + m[2]).lower() in known else f"{m[1]}-{m[2]}", text)


def mender(words: Broadcast) -> Callable[[Column], Column]:
    """``mend`` with a broadcast word set; only texts with a broken word go to Python."""

    def run(text: pa.Array) -> pa.Array:
        return joined((pa.array([mend(t, words.value) if t and "-\n" in t else t for t in own], pa.string()) for own in slices(text)), pa.string())

    return lambda text: F.coalesce(F.arrow_udf(run, "string")(F.when(text.contains("-\n"), text)), text)


def mend_with(text: Column, known: Column) -> Column:
    """``mend`` with the words that are known for each row: the text is cut around its broken words, by noncharacters."""
    part, gap = "\ufdd0", "\ufdd1"
    cut = F.split(F.regexp_replace(text, JAVA_BREAK, f"{part}$1{gap}$2{part}"), part)
    whole = lambda x: F.coalesce(F.array_contains(known, F.lower(F.replace(x, F.lit(gap), F.lit("")))), F.lit(False))
    mended = F.transform(cut, lambda x: F.when(~F.contains(x, F.lit(gap)), x).otherwise(F.replace(x, F.lit(gap), F.when(whole(x), "").otherwise("-"))))
    return F.when(F.contains(text, F.lit("-\n")), F.array_join(mended, "")).otherwise(text)


def keep_hyphens(text: Column) -> Column:
    """``mend`` with an empty dictionary; to look for a hyphen at a line end is cheaper than to try the words."""
    return given(text, lambda t: F.when(F.contains(t, F.lit("-\n")), F.regexp_replace(t, WHOLE_BREAK, "$1-$2")).otherwise(t))


def unwrap(text: Column) -> Column:
    """Single line ends become spaces, runs of spaces one; both ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " "), "  +", " "))


def clean_block(text: Column, dehyphenate: Callable[[Column], Column] = keep_hyphens) -> Column:
    """A block of text with words mended and lines joined; null stays null, and empty empty."""
    return unwrap(dehyphenate(text))


def fragments(text: Column) -> Column:
    """The texts of broken JSON: values of "text" over 50 characters, unescaped, as paragraphs; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(FRAGMENT), F.lit(1))
    plain = F.transform(found, lambda x: replace(replace(replace(x, '\\"', '"'), "\\n", "\n"), "\\\\", "\\"))
    long = F.filter(plain, lambda x: F.length(x) > 50)
    return F.when(F.contains(text, F.lit('"text":')) & (F.size(long) > 0), F.array_join(long, "\n\n"))


def looks_like_json(text: Column) -> Column:
    return strip(text).startswith("[{") | F.contains(text, F.lit('"text":'))


def clean_markdown(text: Column, dehyphenate: Callable[[Column], Column] = keep_hyphens) -> Column:
    """Page text that isn't valid JSON: fragments salvaged where it looks like JSON, then each paragraph cleaned.

    Paragraphs are told apart before words are mended, for a word never breaks over an empty line.
    """
    salvaged = F.when(looks_like_json(text), F.coalesce(fragments(text), text)).otherwise(text)
    parts = F.split(dehyphenate(salvaged), r"\n\n+")
    return F.array_join(F.filter(F.transform(parts, unwrap), lambda x: x != ""), "\n\n")


def find_repetition(text: str | None, min_repeats: int = 10, min_phrase: int = 15) -> str | None:
    """The phrase that follows itself at least so many times, the shortest length first, at sampled starts."""
    if not text or len(text) < min_phrase * min_repeats:
        return None
    n = len(text)
    samples = min(50, n // min_phrase)
    sizes = np.arange(min_phrase, min(100, n // min_repeats))
    room = n - sizes * min_repeats
    starts = np.maximum(1, room // samples)[:, None] * np.arange(samples)
    of, at = np.nonzero(starts <= room[:, None])
    starts, moved = starts[of, at], sizes[of]
    # a run repeats with this period exactly if it equals itself moved on by it: a few of its characters tell most others apart
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for k in PROBES:
        if k >= min_phrase * (min_repeats - 1):
            break
        same = np.flatnonzero(codes[starts + k] == codes[starts + moved + k])
        starts, moved = starts[same], moved[same]
    for start, size in zip(starts.tolist(), moved.tolist(), strict=True):
        run = size * (min_repeats - 1)
        if text.startswith(text[start : start + run], start + size) and len(text[start : start + size].strip()) >= min_phrase // 2:
            return text[start : start + size]
    return None


def drop_repetition(text: str | None, min_repeats: int = 10) -> tuple[str | None, str | None]:
    """The text with each run of its repeated phrase cut to one, and the phrase."""
    phrase = find_repetition(text, min_repeats)
    if phrase is None:
        return text, None
    return re.sub(f"(?:{re.escape(phrase)}){{2,}}", lambda _: phrase, text), phrase


def without_repetition(text: Column) -> Column:
    """struct(text, phrase) of ``drop_repetition``; from Python come only texts that change."""
    found = F.arrow_udf(_changed_rows, "struct<text: string, phrase: string>")(text)
    return F.struct(F.when(found["phrase"].isNull(), text).otherwise(found["text"]).alias("text"), found["phrase"].alias("phrase"))


def _drop_rows(text: pa.Array) -> pa.Array:
    return _dropped(text, True)


def _changed_rows(text: pa.Array) -> pa.Array:
    return _dropped(text, False)


def _dropped(text: pa.Array, every: bool) -> pa.Array:
    """``drop_repetition`` of each text; unless ``every``, a text that stays as it is is null."""
    kind = pa.struct([("text", pa.string()), ("phrase", pa.string())])

    def dropped(own: list[str | None]) -> pa.Array:
        texts, phrases = zip(*map(drop_repetition, own), strict=True)
        texts = [t if every or p is not None else None for t, p in zip(texts, phrases, strict=True)]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(phrases, pa.string())], fields=list(kind))

    return joined(map(dropped, slices(text)), kind)


def blocks_without_repetition(blocks: Column) -> Column:
    """``drop_repetition`` on each text of an array."""
    return F.arrow_udf(_drop_blocks, "array<string>")(blocks)


def _drop_blocks(blocks: pa.Array) -> pa.Array:
    kind = pa.list_(pa.string())
    return joined((pa.array([None if b is None else [drop_repetition(t)[0] for t in b] for b in own], kind) for own in slices(blocks)), kind)
