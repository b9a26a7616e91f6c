"""String semantics of Python as Spark expressions: what counts as space, word, letter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that str.strip() removes and str.split() splits at.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: Character classes for Java's regular expressions (and RE2): a Unicode word character, and white space.
WORD = r"[\p{L}\p{N}_]"
SPACE_SET = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACE_SET}]"
NOT_SPACE = f"[^{SPACE_SET}]"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def lstrip(x: Column) -> Column:
    return F.ltrim(x, F.lit(SPACES))


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def given(value: Column, made: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def quoted(x: str) -> str:
    """As a literal in SQL text."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
