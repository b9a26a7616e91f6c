"""Fill-in-the-middle against a version in plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pageloom.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "a", "a b", "\x01\x02 \x02e\x01m \x01", "\x02\x02m\x01\x01e x", "x <P> y", "x <S", "< P><P", "<M>", "漢字 😀😀  x y \x0b\x1c z ", "word " * 60_000, "w" * 300_000, " " * 300_000, "\0a \0"]


def plainly(id_, text):
    text, digest = text or "", hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()
    units = UNITS.findall(text)
    assert "".join(units) == text
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, None, text
    if h4 % 100 < 80:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = fim.transformed(df, keep=("text",)).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    got = made.collect()
    assert sorted((str(r.doc_id), r.text or "", r.n, r.form, r.prefix or "", r.middle or "", r.suffix or "", r.output) for r in got) == sorted((str(i), t or "", n, f, p or "", m or "", s or "", o) for i, t in rows for n, f, p, m, s, o in [plainly(i, t)])
    assert all(r.again == (r.text or "") and (r.prefix is None) == (r.form == "plain") for r in got)
    return {r.form for r in got}


def test_odd_texts_under_many_ids(spark):
    assert check(spark, [(100 * k + i, t) for k in range(12) for i, t in enumerate(ODD)]) == {"plain", "spm", "psm"}
    check(spark, [(None, "a b c"), (None, "a b c"), (7, None), (7, "x y")])
    assert fim.transformed(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_random_texts(spark):
    r = random.Random(2)
    letters = list("ab <>PSM\x01\x02em\n\t") + ["é", "😀"]
    check(spark, [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for i in range(1500)])


def test_shares_and_other_columns(spark):
    df = spark.createDataFrame([(i, f"a{i} b c", "x", 1) for i in range(2000)], "doc_id bigint, text string, output string, _n int")
    every = fim.transformed(df, share=100, suffix_first=0)
    assert {r.form for r in every.collect()} == {"psm"}
    assert {r.form for r in fim.transformed(df, share=0).collect()} == {"plain"}
    forms = [r.form for r in fim.transformed(df, keep=("_n",)).collect()]
    assert 900 < sum(f != "plain" for f in forms) < 1100 and 730 < forms.count("spm") < 870
