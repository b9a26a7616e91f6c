"""Pages to books: boundaries, headers, chapters, running headers, quality."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import chapters, headers, joiner, ordered, quality, running


def book(spark, texts, name="b"):
    return spark.createDataFrame([(name, i, t) for i, t in enumerate(texts)], "book_id string, page_no int, text string")


def decisions(spark, texts, run=4096):
    return [(r.page_before, r.page_after, r.decision, r.reason) for r in joiner.boundaries(book(spark, texts), run=run).orderBy("page_after").collect()]


CASES = [
    ("the quick brown", "fox jumps", "direct"),
    ("A complete sentence.", "Another one.", "paragraph"),
    ("A complete sentence.", "and it goes on", "direct"),
    ("some text", "Chapter 2", "section"),
    ("mid sentence", "# New Section", "section"),
    ("mid", "1. Introduction", "section"),
    ("mid", "IV. The end", "section"),
    ("mid", "particular things", "section"),
    ("a broken hyph-", "Enated", "direct"),
    ("", "text", "paragraph"),
    ("   ", "text", "paragraph"),
    ("text", "", "paragraph"),
    ("said Mr.", "Smith went", "paragraph"),
    ("said Mr.", "smith went", "direct"),
    ("he said no.", "Next", "paragraph"),
    ('He left."', "Next", "paragraph"),
    ("结束。", "Next", "paragraph"),
    ("and so", "– she said", "direct"),
    ("and so", "Something else", "paragraph"),
    (None, "x", "paragraph"),
]


def test_decisions(spark):
    rows = [(f"b{i:02}", k, t) for i, (a, b, _) in enumerate(CASES) for k, t in enumerate((a, b))]
    got = {r.book_id: r.decision for r in joiner.boundaries(spark.createDataFrame(rows, "book_id string, page_no int, text string")).collect()}
    assert [got[f"b{i:02}"] for i in range(len(CASES))] == [d for _, _, d in CASES]


@pytest.mark.parametrize("run", [1, 2, 3, 4096])
def test_runs_of_pages_change_nothing(spark, run):
    r = random.Random(2)
    texts = [r.choice(["Ends here.", "goes on", "Chapter 3", "", "hyph-", "etc."]) for _ in range(23)]
    assert decisions(spark, texts, run) == decisions(spark, texts) and len(decisions(spark, texts)) == 22


def test_previous_skips_missing_pages(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 7, "y"), ("a", 100, "z"), ("b", 3, "w")], "book_id string, page_no int, text string")
    got = {(r.book_id, r.page_no): (r.p, r.p_page) for r in ordered.previous(df, F.col("text"), "p", run=4).collect()}
    assert got == {("a", 0): (None, None), ("a", 7): ("x", 0), ("a", 100): ("y", 7), ("b", 3): (None, None)}


def test_rows_are_numbered_over_tasks(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), r.randrange(10**9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "book_id string, k bigint").repartition(7)
    got = ordered.numbered(df, [F.col("k")], "place").collect()
    for name in ("hot", "a", "b", None):
        own = sorted(k for n, k in rows if n == name)
        assert [x.k for x in sorted((x for x in got if x.book_id == name), key=lambda x: x.place)] == own
        assert sorted(x.place for x in got if x.book_id == name) == list(range(len(own)))


def test_books_are_joined(spark):
    whole = lambda texts, markers: joiner.books(book(spark, texts), markers=markers).first().content
    assert whole(["one two", "three.", "Four", "# Five"], True) == "one two <!-- page 1 -->three.\n\n<!-- page 2 -->\nFour\n\n<!-- page 3 -->\n\n# Five"
    assert whole(["one two", "three.", "Four", "# Five"], False) == "one two three.\n\nFour\n\n---\n\n# Five"
    assert whole(["a", " ", "b"], False) == "a\n\nb" and whole(["  alone  "], True) == "  alone  " and whole([None], True) == ""
    assert joiner.books(book(spark, [])).count() == 0
    assert joiner.decision_counts(joiner.boundaries(book(spark, ["a", "b", "Chapter 1"]))).first()["n_section"] == 1


# headers and footers
def edges(spark, texts, **k):
    return {(r.side, r.phrase) for r in headers.repeated_edges(book(spark, texts), **k).collect()}


def test_edges_repeat_ten_times(spark):
    body = [f"\n  TOP \n\nBody {i} is here\nBOTTOM\n" for i in range(10)]
    assert edges(spark, body) == {("header", "TOP"), ("footer", "BOTTOM")}
    assert edges(spark, body[:9]) == set() and edges(spark, body[:9], min_occurrences=9)
    for n, found in ((79, True), (80, False)):
        assert bool(edges(spark, ["x" * n + f"\nbody {i}\nlast {i}" for i in range(10)])) is found
    assert edges(spark, ["only"] * 10) == {("header", "only"), ("footer", "only")}


def test_edges_are_stripped_while_they_follow_one_another(spark):
    rows = book(spark, ["TOP\nTOP\nbody\nEND", "TOP\n\nTOP\nbody", " ", "TOP\nEND", "body\nTOP", None])
    rep = spark.createDataFrame([("b", "header", "TOP", 10), ("b", "footer", "END", 10)], "book_id string, side string, phrase string, n bigint")
    got = [r.text for r in headers.drop_edges(rows, rep).orderBy("page_no").collect()]
    assert got == ["body", "TOP\nbody", " ", "", "body\nTOP", None]
    assert [r.text for r in headers.drop_edges(book(spark, [" x "]), rep.limit(0)).collect()] == [" x "]


def flagged(spark, at, n=60):
    return {r.header for r in headers.repeated_section_headers(book(spark, [("## Intro \n" if i in at else "") + f"text {i}" for i in range(n)])).collect()}


def test_section_headers_need_three_in_twenty_pages(spark):
    assert flagged(spark, {0, 5, 19}) == {"INTRO"} and flagged(spark, {0, 10, 20}) == set() and flagged(spark, {3, 4}) == set()
    for n, found in ((49, True), (50, False)):
        assert bool(headers.repeated_section_headers(book(spark, ["# " + "x" * n] * 3)).count()) is found


def test_section_windows_over_runs(spark):
    r = random.Random(6)
    at = sorted({r.randrange(6000) for _ in range(500)})
    df = spark.createDataFrame([("b", p, f"# h{p % 7}") for p in at], "book_id string, page_no int, text string")
    want = {f"H{k}" for k in range(7) for own in [[p for p in at if p % 7 == k]] for a, c in zip(own, own[2:], strict=False) if c - a < 20}
    assert {x.header for x in headers.repeated_section_headers(df).collect()} == want


def test_the_first_section_header_stays(spark):
    rows = book(spark, ["a\n# Run\nb", "# RUN \nc\n## run", "# Else", "d\n#  Run"])
    got = [r.text for r in headers.drop_repeated_section_headers(rows, headers.repeated_section_headers(rows)).orderBy("page_no").collect()]
    assert got == ["a\n# Run\nb", "c", "# Else", "d"]


def test_clean_book_pages(spark):
    texts = [f"BOOK TITLE\n\n# Part\nPage {i} text." for i in range(15)]
    got = [r.text for r in headers.clean_book_pages(book(spark, texts)).orderBy("page_no").collect()]
    assert got == ["# Part\nPage 0 text."] + [f"Page {i} text." for i in range(1, 15)] and "BOOK" not in "".join(got)
    assert [r.text for r in headers.clean_book_pages(book(spark, ["Unique one", "Unique two"])).orderBy("page_no").collect()] == ["Unique one", "Unique two"]


# running headers
def test_running_headers(spark):
    given = {
        "# Title\n\nIt was a\n\n# TITLE\n\ndark night.": "# Title\n\nIt was a\n\ndark night.",
        "Some end.\n\n# Next\n\nText here.\n\n# next\n\nMore.": "Some end.\n\n# Next\n\nText here.\n\nMore.",
        "it goes\n\n# Run\n\non and ends.\n\n# Run\n\nNew text.": "it goes\n\non and ends.\n\n# Run\n\nNew text.",
        "ends here¹²\n\n# A\n\n* bullet": "ends here¹²\n\n# A\n\n* bullet",
        "He said.³\n\n# A\n\nlower case": "He said.³\n\n# A\n\nlower case",
        "the old <!-- page 3 -->\n\n# HEAD\n\n<!-- page 4 -->\nman went": "the old <!-- page 3 -->\n\n<!-- page 4 -->\nman went",
        "x" * 400 + "\n# A\n" + "y" * 2000 + "\n# a\nlast": "x" * 400 + "\n\n" + "y" * 2000 + "\n\nlast",
        "it was Mr.\n# A\nSmith who came along that day. Then": "it was Mr.\n# A\nSmith who came along that day. Then",
        "it was the old\n# A\nSmith who came along that day. Then": "it was the old\n\nSmith who came along that day. Then",
        "it was the old\n# A\nSMITH WHO CAME ALONG THAT DAY": "it was the old\n# A\nSMITH WHO CAME ALONG THAT DAY",
        "no headers\n\n\n\nhere ": "no headers\n\nhere", "": "", "# only": "# only",
    }
    df = spark.createDataFrame([(t, w) for t, w in given.items()] + [(None, None)], "t string, w string")
    for r in df.select("t", "w", running.without_running_headers(F.col("t")).alias("got")).collect():
        assert r.got == r.w, r.t


def test_sentences(spark):
    df = spark.createDataFrame([("Mr. Smith left. He ran!  Then (Bob) stopped",), ("",)], "t string")
    assert [r[0] for r in df.select(running.sentences(F.col("t"))).collect()] == [["Mr. Smith left.", "He ran!", "Then (Bob) stopped"], [""]]


# chapters
def split(spark, content, **k):
    df = spark.createDataFrame([("b", content)], "book_id string, content string")
    return [(r.title, r.content) for r in chapters.chapters(df, **k).orderBy("chapter_no").collect()]


def test_chapters(spark):
    x, y = "x" * 120, "y" * 120
    assert split(spark, f"# One\n{x}\n## Two \n{y}\n### Three\nz") == [("One", f"# One\n{x}"), ("Two", f"## Two \n{y}\n### Three\nz")]
    assert split(spark, f"chapter 1 Start\n{x}\nPART 2\n{y}") == [("chapter 1 Start", f"chapter 1 Start\n{x}"), ("PART 2", f"PART 2\n{y}")]
    assert split(spark, "no markers") == [("Content", "no markers")] and split(spark, "") == [("Content", "")] and split(spark, None) == [("Content", "")]
    assert split(spark, "# A\nshort\n# B\nshort") == [("Content", "# A\nshort\n# B\nshort")]
    assert split(spark, f"# One\n{x}", split=False) == [("Content", f"# One\n{x}")]
    for n, kept in ((100, False), (101, True)):
        assert (split(spark, f"{'p' * (n - 1)}\n# One\n{x}")[0][0] == "Introduction") is kept
        assert (len(split(spark, f"# A\n{'q' * (n - 4)}\n# One\n{x}")) == 2) is kept


# quality
def kinds(spark, text, **k):
    return [r.error_type for r in quality.findings(book(spark, [text]), **k).orderBy("seq").collect()]


LONG = "Plain words stand here to make the page long enough for all rules. "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ["SHORT_PAGE"]), (None, ["SHORT_PAGE"]), ("   ", ["SHORT_PAGE"]), ("a" * 3 + "bc" * 23, ["SHORT_PAGE"]), ("ab " * 17, []),
        ("■" + "ab c" * 24 + "abc", []), ("■■" + "ab c" * 24 + "ab", ["GARBAGE_CHARS"]),
        (LONG + "aaaa", []), (LONG + "aaaaa", ["REPEATED_CHARS"]), (LONG + "\n" * 6, []),
        (LONG + " 000 OOO 0O0", []), (LONG + " 000 OOO 0O0 O0O", ["OCR_CONFUSION"]), (LONG + "lIl 1I1 III lll", ["OCR_CONFUSION"]),
        (LONG + "rna rnb rnc", []), (LONG + "rna rnb rncrnd", ["OCR_CONFUSION"]), (LONG + "vva vvb vvc vvd", ["OCR_CONFUSION"]), (LONG + "avva bvvb cvvc dvvd", []),
        ("a b c d e f g h i j " * 4, ["SHORT_WORDS"]),
        (LONG + "((", []), (LONG + "(((", ["UNBALANCED_BRACKETS"]), (LONG + "((( [[[ {{{", ["UNBALANCED_BRACKETS"] * 3),
        (LONG + '"', []), (LONG + '"""', ["UNBALANCED_QUOTES"]), (LONG + "''''", []), (LONG + "'''\"\"\"", ["UNBALANCED_QUOTES"] * 2),
        ("abcdefghij klmno qrs" * 4 + "." * 0 + "abcde" + ".,;:!?-.,;:!?-.,", ["HIGH_SPECIAL_CHAR_RATIO"]), (("abcdefghijklmnopq" + ".,;") * 5, []),
    ],
)
def test_detectors(spark, text, want):
    assert kinds(spark, text) == want


def test_severity_and_messages(spark):
    rows = {r.page_no: r for r in quality.findings(book(spark, ["", "  xyz", LONG + "■" * 9 + "□□"]), max_ratio=0.9).where("error_type <> 'REPEATED_CHARS'").collect()}
    assert (rows[0].severity, rows[0].message) == ("error", "Page has only 0 characters")
    assert (rows[1].severity, rows[1].message, rows[1].context) == ("warning", "Page has only 3 characters", "  xyz")
    assert rows[2].context == "■□" and rows[2].message.startswith("Found 11 suspicious characters (14.1%)")


def test_reports(spark):
    df = book(spark, [LONG, "", LONG]).withColumn("ok", F.col("page_no") != 2)
    r = quality.report(df, success="ok").first()
    assert (r.total_pages, r.successful_pages, r.n_errors, r.has_critical_errors) == (3, 2, 2, True)
    text = quality.report_text(df, success="ok").first().report
    assert "Total pages: 3\nSuccessful: 2\nErrors: 2\nWarnings: 0" in text and "Page    1 [ERROR] SHORT_PAGE" in text and "Page    2 [ERROR] OCR_FAILED" in text
    assert text.index("Page    1") < text.index("Page    2")
    clean = quality.report(book(spark, [LONG])).first()
    assert (clean.n_errors, clean.n_warnings, clean.has_critical_errors) == (0, 0, False)
