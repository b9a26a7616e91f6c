"""Token counts and ids of whole texts under a public vocabulary.

``token_counts`` uses the whole-token shortcut: it is proved once, on the driver, which
vocabulary strings the merge rules leave alone as a single token. A pre-token in that set
counts one without any merging; only the others are merged, each distinct one once per
cache generation. That holds for any text: where it has characters beyond U+017F, the
library's own normaliser and splitter give the pre-tokens.

Cases: a null text is empty (0 bytes, 0 tokens); the strings of special tokens inside a
text are what the library makes of them; any Unicode is counted by the library's own
normaliser and splitter; repeated and tied rows are kept as they are; an empty table gives
an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import column, steps, texts

#: Bytes of pre-tokens that a worker remembers (beyond that it starts anew), those that an entry counts for besides its text, and characters of the longest remembered.
CACHE_BYTES, ENTRY, LONGEST = 32 << 20, 120, 256
# The letters, digits and white space up to U+017F, as Unicode has them.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGIT = "0-9²³¹¼-¾"
SPACE = "\t-\r \u0085 "
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: Beyond these characters the library itself normalises and splits a text. (U+0130 grows when it is lower-cased.)
UNUSUAL = re.compile("[^\x00-įı-ſ]")
WORD_SPLIT = re.compile(f"{SUFFIXES}|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
BYTE_SPLIT = re.compile(f"{SUFFIXES}| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


# What the vocabularies' files say of normalising and splitting.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
WORD_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SUFFIXES + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, BYTE_LEVEL]},
}
BYTE_FORM = {"normalizer": None, "pre_tokenizer": BYTE_LEVEL | {"use_regex": True}}


@lru_cache
def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def byte_level(text: str) -> str:
    chars = byte_chars()
    return "".join(chars[b] for b in text.encode())


@lru_cache(maxsize=4)
def library(path: str):
    """A worker loads a vocabulary once."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> dict[str, int]:
    """The texts whose single token is proved: each vocabulary string that ends a word, decoded, and encoded anew alone."""
    tok = library(path)
    suffix = json.loads(tok.to_str())["model"].get("end_of_word_suffix") or ""
    back = {c: b for b, c in enumerate(byte_chars())}
    proved = {}
    for piece in tok.get_vocab(with_added_tokens=False):
        if suffix and not piece.endswith(suffix):
            continue
        core = piece[: len(piece) - len(suffix)] if suffix else piece
        try:
            text = bytes(back[c] for c in core).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and len(tok.model.tokenize(core)) == 1:
            proved[text] = 1
    return proved


class PieceCounts(dict):
    """Tokens of a pre-token. What isn't proved whole is merged (``merges`` counts how often), and remembered up to a bound in bytes. ``raw``: the pre-tokens are given as byte-level strings."""

    def __init__(self, whole: dict[str, int], path: str, raw: bool = False):
        self.whole = {byte_level(x): 1 for x in whole} if raw else whole
        super().__init__(self.whole)
        self.path, self.raw, self.held, self.merges = path, raw, 0, 0

    def __missing__(self, piece: str) -> int:
        n = len(library(self.path).model.tokenize(piece if self.raw else byte_level(piece)))
        self.merges += 1
        if len(piece) <= LONGEST:
            self.held += ENTRY + 4 * len(piece)
            if self.held > CACHE_BYTES:
                self.clear()
                self.update(self.whole)
                self.held = 0
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts; a worker's."""

    def __init__(self, whole: dict[str, int], path: str):
        self.tok = library(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.plain, self.raw = PieceCounts(whole, path), PieceCounts(whole, path, True)

    def __call__(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if UNUSUAL.search(text):  # the library normalises and splits; its pre-tokens are counted like the others
            split = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
            return sum(self.raw[piece] for piece, _ in split)
        return sum(map(self.plain.__getitem__, WORD_SPLIT.findall(text.lower())))


def check_form(path: str, form: dict) -> None:
    """A vocabulary whose normaliser or splitter isn't the one that is copied here would be counted wrongly."""
    given = json.loads(library(path).to_str())
    if {k: given[k] for k in form} != form:
        raise ValueError(f"{path} normalises or splits texts in another way than {form}")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every text, for a lower-casing word vocabulary whose pre-tokens end in a suffix (ValueError for others)."""
    check_form(path, WORD_FORM)
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(whole.value, path)
        for b in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "n_bytes"), pa.array(map(count, texts(b, "text")), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")


@lru_cache(maxsize=4)
def merger(path: str):
    """The merges of a byte-level vocabulary whose ids are the ranks of its merges (checked here): pre-token to ids."""
    import tiktoken

    model = json.loads(library(path).to_str())["model"]
    back = {c: b for b, c in enumerate(byte_chars())}
    ranks = {bytes(back[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in back for c in piece)}
    firsts = len(ranks) - len(model["merges"])
    for i, pair in enumerate(model["merges"], firsts):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        if model["vocab"].get(left + right) != i:
            return lambda piece: [t.id for t in library(path).model.tokenize(byte_level(piece))]
    made = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks={k: i for k, i in ranks.items() if i < firsts + len(model["merges"])}, special_tokens={})
    return made.encode_ordinary


class PieceIds(dict):
    """The ids of a pre-token as little-endian unsigned 32-bit numbers, remembered up to a bound in bytes."""

    def __init__(self, path: str):
        check_form(path, BYTE_FORM)
        super().__init__()
        self.merge, self.path, self.held = merger(path), path, 0

    def __missing__(self, piece: str) -> bytes:
        got = self.merge(piece)
        ids = struct.pack(f"<{len(got)}I", *got)
        if len(piece) <= LONGEST:
            self.held += ENTRY + 4 * len(piece) + len(ids)
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[piece] = ids
        return ids


def ids_of(text: str, cache: PieceIds, special: list[str]) -> bytes:
    """The ids of a text under a byte-level vocabulary, as the library gives them."""
    if any(s in text for s in special) or UNUSUAL.search(text):
        return np.array(library(cache.path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    return b"".join(map(cache.__getitem__, BYTE_SPLIT.findall(text)))
