"""Books as rows of whole lines against the same books as one string; files written as rows arrive."""

import collections
import hashlib
import io
import random
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from pageloom import registry
from pageloom.operators import chapters, headers, joiner, ordered, running
from pageloom.sources import epub, readers, writers
from pageloom.streaming import incremental

PAGES = "book_id string, page_no int, text string"
TOKENS = ["# Run", "## Head two", "# RUN", "#", "##  ", "# #", "text goes", "on and on", "Ends here.", "\n", "\n\n", "\n\n\n", "  indented", "> quote", "* item", "Chapter 3", "1. x", " ", "\t", "\x0b#", "###### deep", "word " * 30 + ".", "lower " * 80, "<!-- c -->"]


def odd_pages(seed, books=40, most=25):
    r = random.Random(seed)
    make = lambda: "".join(r.choice(TOKENS) + r.choice(["\n", "\n", " ", "\n\n", ""]) for _ in range(r.randint(0, 12)))
    rows = [(f"b{b}", 3 * p, make() if r.random() > 0.03 else None) for b in range(books) for p in range(r.randint(1, most))]
    rows += [("none", 0, ""), ("null", 0, None), (None, 0, "# A\n\nof no book"), (None, 1, "# A\n\nmore")]
    rows += [("edge", 0, "p" * 98 + "\n# A\n" + "y" * 97 + "\n"), ("edge2", 0, "p" * 100 + "\n# A\n" + "y" * 98 + "  \n\n# B\nq"), ("spaces", 0, "  \n\n" + "p" * 120 + "\n# A\n" + "x" * 200 + "  \n ")]
    # a book longer than a run of pages, with the same header on each and headers that interrupt
    return rows + [("long", p, f"# Long\n\nIt was page {p} of\n\n## long\n\nmany that follow." + ("\n\n# Chapter\n\n" + "z" * 150) * (p % 7 == 0)) for p in range(60)]


@pytest.mark.parametrize("run", [4, 4096])
def test_rows_are_the_whole_books(spark, run):
    df = spark.createDataFrame(odd_pages(run), PAGES)
    for markers in (True, False):
        want = {r.book_id: r for r in joiner.books(df.where("book_id is not null"), markers=markers).withColumn("bare", running.without_running_headers(F.col("content"))).collect()}
        blocks = ordered.stored(joiner.blocks(df, markers=markers, run=run))
        got, bare = collections.defaultdict(list), collections.defaultdict(list)
        for r in blocks.orderBy("block").collect():
            got[r.book_id].append(r)
        for r in running.drop_running_headers(blocks, run).orderBy("block").collect():
            bare[r.book_id].append(r.text)
        assert set(got) == set(bare) == set(want)
        for b, r in want.items():
            assert "".join(x.text for x in got[b]) == r.content and sum(x.n_pages for x in got[b]) == r.n_pages
            assert [x.first for x in got[b]] == [True] + [False] * (len(got[b]) - 1) and [x.last for x in got[b]] == [False] * (len(got[b]) - 1) + [True]
            assert "".join(bare[b]) == r.bare
        assert len(got["long"]) > 50


@pytest.mark.parametrize("run", [4, 4096])
def test_chapters_over_rows(spark, run):
    df = spark.createDataFrame(odd_pages(7), PAGES)
    want = {(r.book_id, r.chapter_no): (r.title, r.content) for r in chapters.chapters(joiner.books(df.where("book_id is not null"), markers=False)).collect()}
    got = {}
    blocks = ordered.stored(joiner.blocks(df, markers=False, run=run))
    for r in chapters.of_blocks(blocks, run=run).orderBy("book_id", "chapter_no", "block", "part").collect():
        title, text = got.get((r.book_id, r.chapter_no), (r.title, ""))
        assert title == r.title
        got[r.book_id, r.chapter_no] = (title, text + r.text)
    assert got == want
    assert {r.title for r in chapters.of_blocks(blocks, split=False).collect()} == {"Content"}
    assert chapters.of_blocks(blocks.limit(0)).collect() == [] and running.drop_running_headers(blocks.limit(0)).collect() == []


def test_totals_and_last_values_over_runs(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), p, r.randint(0, 9) if r.random() < 0.3 else None) for p in range(300)]
    df = spark.createDataFrame(rows, "book_id string, page_no int, v int")
    for x in ordered.last_before(ordered.totals_before(df, {"s": F.col("v")}, run=7), F.col("v"), "l", run=7).collect():
        own = [v for b, p, v in rows if b == x.book_id and p < x.page_no and v is not None]
        assert (x.s, x.l) == (sum(own), own[-1] if own else None)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_numbers_meet_their_rows(spark, most):
    r = random.Random(2)
    ids = [*range(-5000, 5000, 3), *range(20_000, 24_100), *(r.randrange(-(1 << 62), 1 << 62) for _ in range(200))]
    numbers = {i: r.randint(0, 1 << 30) for i in ids if i % 7}
    rows = spark.createDataFrame([(i, f"t{i}") for i in [*ids, *ids[:50], None]], "id bigint, text string")
    found = ordered.with_numbers(rows, spark.createDataFrame([*numbers.items(), (None, 3)], "id bigint, n int"), "id", "n", most)
    assert sorted(tuple(x) for x in found.select("id", "text", "n").collect()) == sorted((i, f"t{i}", numbers[i]) for i in [*ids, *ids[:50]] if i in numbers)
    again = ordered.with_numbers(rows, spark.createDataFrame([(0, 1), (0, 2)], "id bigint, n int"), "id", "n", most)
    assert sorted(x.n for x in again.where("id = 0").collect()) == ([1, 2] if 0 in ids else [])


def test_texts_of_many_pages_are_not_shuffled(spark, tmp_path):
    n = 500_001
    docs = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("book "), F.col("id") % 3).alias("source"), F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.pages(spark, str(tmp_path))
    assert "SortMergeJoin" not in rows._jdf.queryExecution().toString()
    assert rows.where("page_no = doc_id div 3 and text = concat('text ', doc_id) and book_id = concat('book ', doc_id % 3)").count() == n


# files
def test_files_of_books(spark, tmp_path):
    df = spark.createDataFrame(odd_pages(3), PAGES).where("book_id is not null")
    blocks = ordered.stored(joiner.blocks(df))
    want = {r.book_id: r.content for r in joiner.books(df).collect()}
    for r in writers.text_files(blocks, str(tmp_path / "md")).collect():
        data = (tmp_path / "md" / f"{r.book_id}.md").read_bytes()
        assert (data.decode(), r.n_chars, r.digest) == (want[r.book_id], len(want[r.book_id]), hashlib.md5(data).hexdigest())
    assert {(r.book_id, r.content) for r in readers.markdown(spark, str(tmp_path / "md")).collect()} == set(want.items())
    whole = collections.defaultdict(list)
    for r in chapters.chapters(joiner.books(df)).orderBy("chapter_no").collect():
        whole[r.book_id].append((r.title, r.content))
    for r in writers.epub_files(chapters.of_blocks(blocks), str(tmp_path / "epub"), "Me").collect():
        meta = epub.Metadata(r.book_id, "Me", "en", f"urn:book:{r.book_id}", "1970-01-01", "1970-01-01T00:00:00Z")
        assert (tmp_path / "epub" / f"{r.book_id}.epub").read_bytes() == epub.build(meta, whole[r.book_id]) and r.n_chapters == len(whole[r.book_id])


def test_ids_that_look_alike_are_files_of_their_own(spark, tmp_path):
    ids = ["a/b", "a_b", "a%2Fb", "a\\b", ".a", "%2Ea", "..", "ä b-c.d", "", None, "%", "%00", "a\nb"]
    assert len({writers.safe(x) for x in ids}) == len(ids) and not any("/" in writers.safe(x) or writers.safe(x).startswith(".") for x in ids)
    rows = spark.createDataFrame([(x, 0, f"text of {x}") for x in ids], "book_id string, block int, text string")
    assert writers.text_files(rows, str(tmp_path)).count() == len(ids)
    assert {p.read_text() for p in tmp_path.iterdir()} == {f"text of {x}" for x in ids}


def test_a_failed_attempt_leaves_nothing(tmp_path):
    with pytest.raises(ValueError, match="stop"), writers.stream(str(tmp_path), "x") as f:
        f.write(b"half")
        raise ValueError("stop")
    assert list(tmp_path.iterdir()) == []


def test_a_large_book_streams_into_its_files(tmp_path):
    """As a task does, without Spark: 60 MB of text, converted and packed in little memory."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    line = "Some words of a page that stand there, line after line, for a while.\n\n" * 200
    with writers.stream(str(tmp_path), "b.epub") as f:
        epub.write(f, epub.Metadata("b"), [f"C{k}" for k in range(10)], ((line for _ in range(420)) for _ in range(10)))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 30_000
    with zipfile.ZipFile(tmp_path / "b.epub") as z:
        assert z.testzip() is None and sum(x.file_size for x in z.infolist()) > 58_000_000


def test_markdown_in_pieces_is_converted_alike():
    r = random.Random(2)
    parts = ["# A", "## A", "text", "more text", "", "- x", "    - y", "1. z", "> q", "> - in", "| a | b |", "|---|:-:|", "| 1 | 2", "```py", "```", "~~~", "```not a fence", "***", "<div>", "[TOC]", "  ", "&amp & <b> 3 < 4"]
    for _ in range(400):
        text = "\n".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        cuts = sorted(r.randint(0, len(text)) for _ in range(4))
        assert "".join(epub.body_of([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])) == epub.to_html(text)
    assert epub.to_html("```a b\nc\n\nd") == "<p>```a b\nc</p>\n<p>d</p>"
    out = io.BytesIO()
    epub.write(out, epub.Metadata("x"), [], [])
    assert zipfile.ZipFile(io.BytesIO(out.getvalue())).infolist()[0].filename == "mimetype"


# pages with edits, saved
COLUMNS = "page_no int, text string"


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_saved_edits_touch_only_their_books(spark, tmp_path):
    rows = [(b, p, f"{b}{p}") for b in ("01", "1", "x y", "a=b") for p in range(5)]
    writers.pages(spark.createDataFrame(rows, PAGES), str(tmp_path))
    first = files_of(tmp_path)
    edits = spark.createDataFrame([("01", 2, "new"), ("01", 3, None), ("x y", 99, "unknown page"), ("none", 0, "unknown book"), (None, 0, "n"), ("a=b", 0, "b"), ("a=b", 0, "a")], PAGES)
    read = lambda: {(r.book_id, r.page_no): r.text for r in writers.read_pages(spark, str(tmp_path), COLUMNS).collect()}
    for _ in range(2):
        writers.save_edits(spark, str(tmp_path), edits, COLUMNS)
        want = {(b, p): t for b, p, t in rows} | {("01", 2): "new", ("01", 3): None, ("a=b", 0): "b"}
        assert read() == want and writers.read_pages(spark, str(tmp_path), COLUMNS).count() == len(rows)
    left = files_of(tmp_path)
    kept = {f for f in first if left.get(f) == first[f]}
    assert {f.partition("/")[0] for f in kept} == {"book_id=1", "book_id=x y"} and {f for f in left if f.partition("/")[0] in {"book_id=1", "book_id=x y"}} == kept


def test_a_failed_save_changes_nothing(spark, tmp_path):
    writers.pages(spark.createDataFrame([("a", p, f"t{p}") for p in range(9)], PAGES), str(tmp_path))
    before = files_of(tmp_path)
    broken = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y")], PAGES).withColumn("text", F.when(F.col("text") == "y", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        writers.save_edits(spark, str(tmp_path), broken, COLUMNS)
    assert files_of(tmp_path) == before and [r.text for r in writers.read_pages(spark, str(tmp_path), COLUMNS).orderBy("page_no").collect()] == [f"t{p}" for p in range(9)]


# books from batches of pages
def test_any_split_of_pages_into_batches_gives_the_same_books(spark, tmp_path):
    r = random.Random(4)
    texts = [("b", p, f"BOOK TITLE\n\n# Part {p // 15}\n# Running\nPage {p} text.\nEnd of it") for p in range(45)] + [("c", p, f"Body {p}\n# Once\nmore") for p in range(4)]
    rows = spark.createDataFrame(texts, PAGES)
    want = {(x.book_id, x.page_no): x.text for x in headers.clean_book_pages(rows).collect()}
    for turn in range(2):
        folder, go = str(tmp_path / str(turn)), {k: r.randrange(3) for k in range(len(texts))}
        batches = [spark.createDataFrame([t for k, t in enumerate(texts) if go[k] == n] or [(None, 1, "of no book")], PAGES) for n in range(3)]
        old = spark.createDataFrame([("b", 3, "replaced later"), ("b", None, "x")], PAGES)
        incremental.keep_books(old, 0, folder)
        for n, batch in enumerate(batches):
            incremental.keep_books(batch, n + 1, folder)
        incremental.keep_books(batches[2], 3, folder)  # tried again
        assert {(x.book_id, x.page_no): x.text for x in incremental.books(spark, folder).collect()} == want and incremental.books(spark, folder).count() == len(want)


def test_a_header_is_withdrawn_once_it_repeats(spark, tmp_path):
    page = lambda p: ("b", p, f"TOP LINE\nText {p} stands here.")
    first = lambda: incremental.books(spark, str(tmp_path)).where("page_no = 0").first().text
    incremental.keep_books(spark.createDataFrame([page(p) for p in range(9)], PAGES), 0, str(tmp_path))
    assert first() == "TOP LINE\nText 0 stands here."
    incremental.keep_books(spark.createDataFrame([page(9)], PAGES), 1, str(tmp_path))
    assert first() == "Text 0 stands here."
