"""Native expressions against plain Python on random texts."""

import random
import re

from pyspark.sql import functions as F

from pageloom.functions import text
from pageloom.operators import headers, joiner, quality

ALPHABET = ["a", "b", "rn", "vv", "0", "O", "1", "I", "l", " ", " ", "\n", "(", "[", "}", '"', "'", "■", "é", "漢", "²", ".", ",", " ", "\t", "aaaaa"]


def texts(seed, n=300, most=60):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, most))) for _ in range(n)]


def runs_of_five(t):
    return [m for m in re.finditer(r"([^\n])\1{4,}", t)]


def expected(t):
    """(error_type, n) of a text, from counts of characters."""
    out = []
    if len(t.strip()) < 50:
        out.append(("SHORT_PAGE", len(t.strip())))
    if not t:
        return out
    bad = sum(c in quality.GARBAGE for c in t)
    if bad > 0.01 * len(t):
        out.append(("GARBAGE_CHARS", bad))
    if runs_of_five(t):
        out.append(("REPEATED_CHARS", len(runs_of_five(t))))
    for p in ("[0O]{3}", "[1Il]{3}", r"rn(?=\w)", r"\bvv(?=\w)"):
        n = len(re.findall(p, t))
        if n > 3:
            out.append(("OCR_CONFUSION", n))
    tokens = t.split()
    if tokens and sum(map(len, tokens)) < 2 * len(tokens):
        out.append(("SHORT_WORDS", len(tokens)))
    for a, b in ("()", "[]", "{}"):
        if abs(t.count(a) - t.count(b)) > 2:
            out.append(("UNBALANCED_BRACKETS", abs(t.count(a) - t.count(b))))
    for q in "\"'":
        if t.count(q) > 2 and t.count(q) % 2:
            out.append(("UNBALANCED_QUOTES", t.count(q)))
    odd = sum(not c.isalnum() and not c.isspace() for c in t)
    if odd / len(t) > 0.15:
        out.append(("HIGH_SPECIAL_CHAR_RATIO", odd))
    return out


def test_findings(spark):
    given = texts(1) + texts(2, 60, 400)
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(given)], "book_id string, page_no int, text string")
    got = [[] for _ in given]
    for r in quality.findings(df).orderBy("page_no", "seq").collect():
        got[r.page_no].append((r.error_type, r.n))
    assert got == [expected(t) for t in given]


def test_unwrapping(spark):
    given = texts(3)
    df = spark.createDataFrame(list(enumerate(given)), "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(text.unwrap(F.col("text"))).collect()]
    want = []
    for t in given:
        joined = "".join(" " if c == "\n" and t[max(i - 1, 0) : i] != "\n" and t[i + 1 : i + 2] != "\n" else c for i, c in enumerate(t))
        while "  " in joined:
            joined = joined.replace("  ", " ")
        want.append(joined.strip())
    assert got == want


def test_edges(spark):
    r = random.Random(4)
    given = ["\n".join(r.choices(["H", "F", " ", "x y", ""], k=r.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(given)], "book_id string, page_no int, text string")
    rep = spark.createDataFrame([("b", "header", "H", 10), ("b", "footer", "F", 10)], "book_id string, side string, phrase string, n bigint")
    got = [x.text for x in headers.drop_edges(df, rep).orderBy("page_no").collect()]
    want = []
    for t in given:
        rows = t.strip().split("\n")
        while rows and rows[0].strip() == "H":
            del rows[0]
        while rows and rows[-1].strip() == "F":
            rows.pop()
        want.append("\n".join(rows).strip() if t.strip() else t)
    assert got == want


def test_sentence_ends(spark):
    r = random.Random(5)
    pieces = ["word", "etc", "Mr", "no", ".", "!", "?", ";", ":", '"', "'", ")", "]", " ", "。", "」", "x-", "\n"]
    given = ["".join(r.choices(pieces, k=r.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(given)), "i int, text string")
    got = [x[0] for x in df.orderBy("i").select(joiner.ends_sentence(F.col("text"))).collect()]
    want = []
    for t in given:
        t = t.rstrip()
        core = t.rstrip("\"')]")
        closed = bool(t) and (core[-1:] in tuple(".!?;:") and core != "" or t[-1] in "。！？；：」』）】")
        last = (t.split() or [""])[-1].rstrip(".\"')]").lower()
        want.append(not t or closed and last not in joiner.ABBREVIATIONS)
    assert got == want
