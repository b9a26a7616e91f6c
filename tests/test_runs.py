"""Review, resume, studies, files, streams, plans and the driver's entry."""

import io
import json
import os
import random
import subprocess
import sys
import zipfile
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from pageloom.operators import accuracy, ocr, ordered, resume, review, running
from pageloom.plans import book, cli
from pageloom.plans.config import Config
from pageloom.sources import epub, readers, writers
from pageloom.streaming import incremental, progress

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def call(name="suggest_fix", arguments="{}"):
    return {"function": {"name": name, "arguments": arguments}}


def test_review_issues(spark):
    good = json.dumps({"issue_type": "hyphen", "description": "d", "suggested_text": "s", "start_offset": 3, "end_offset": 5, "confidence": 0.81})
    raw = json.dumps({"choices": [{"message": {"tool_calls": [call(arguments=good), call("other"), call(arguments="{bad"), call()]}}]})
    df = spark.createDataFrame([("b", 1, raw), ("b", 2, "not json"), ("b", 3, None), ("b", 4, '{"choices": []}')], "book_id string, page_no int, response string")
    rows = review.issues(df).orderBy("start_offset").collect()
    assert [(r.type, r.severity, r.start_offset, r.end_offset, r.suggestion, r.status) for r in rows] == [("unknown", "low", 0, 0, "", "pending"), ("hyphen", "high", 3, 5, "s", "pending")]
    assert len({r.id for r in rows}) == 2 and {r.id for r in rows} == {r.id for r in review.issues(df).collect()}
    done = review.with_status(review.issues(df), spark.createDataFrame([(rows[1].id, "accepted")], "id string, status string"))
    assert review.pending(done).count() == 1


def test_upsert(spark):
    pages = spark.createDataFrame([("b", 0, "x"), ("b", 1, "y")], "book_id string, page_no int, text string")
    edits = spark.createDataFrame([("b", 1, "new"), ("b", 9, "lost")], "book_id string, page_no int, text string")
    assert [r.text for r in review.upsert(pages, edits).orderBy("page_no").collect()] == ["x", "new"]


def test_resume(spark):
    ts = "2024-01-0{} 00:00:00"
    images = spark.createDataFrame([("b", i, ts.format(2)) for i in range(5)], "book_id string, page_no int, m string").withColumn("modified", F.col("m").cast("timestamp"))
    outs = spark.createDataFrame([("b", 0, ts.format(2), True, True, True), ("b", 1, ts.format(1), True, True, True), ("b", 2, ts.format(3), True, False, True), ("b", 3, ts.format(3), True, True, False)], "book_id string, page_no int, m string, has_json boolean, has_nohf boolean, json_valid boolean").withColumn("modified", F.col("m").cast("timestamp"))
    good = resume.valid_output(outs)
    assert sorted(r.page_no for r in resume.to_process(images, good).collect()) == [1, 2, 3, 4]
    assert [r.page_no for r in resume.cached(images, good).collect()] == [0]
    results = spark.createDataFrame([("b", 0, "t", True, None), ("b", 1, "", False, "bad")], "book_id string, page_no int, text string, success boolean, error_message string")
    rows = resume.filled(images, results).orderBy("page_no").collect()
    assert [r.success for r in rows] == [True, False, False, False, False] and rows[1].error_message == "bad" and "interrupted" in rows[4].error_message
    out = resume.outcome(resume.filled(images, results)).first()
    assert (out.n_pages, out.n_success, out.n_failed) == (5, 1, 4)


def test_similarity_and_speedups(spark):
    assert accuracy.similarity("a b c", "a b c")[:3] == (1.0, 1.0, 0) and accuracy.similarity("", "")[0] == 1.0
    runs = spark.createDataFrame([("i", 1.0, "a b", 4.0), ("i", 0.5, "a c d", 2.0), ("i", 0.25, "", 0.0)], "image string, scale double, text string, ocr_time double")
    got = {r.scale: r.speedup for r in accuracy.speedups(runs).collect()}
    assert got == {1.0: 1.0, 0.5: 2.0, 0.25: 0.0}
    mean = {r.scale: r.avg_word_similarity for r in accuracy.averages(accuracy.with_similarity(runs, "scale", 1.0), "scale").collect()}
    assert mean[1.0] == 1.0 and mean[0.5] == pytest.approx(0.4)


def test_recognition_retries_and_goes_on(spark):
    images = spark.createDataFrame([("b", 0, "good", b"x"), ("b", 1, "bad", b"y"), ("b", 2, "none", b"z")], "book_id string, page_no int, path string, content binary")

    def make():
        def model(path, content):
            if path == "bad":
                raise ValueError("broken")
            return None if path == "none" else {"text": "t", "text_nohf": "n", "layout": [{"text": "é"}]}

        return model

    rows = ocr.recognised(images, make, pause=0.0).orderBy("page_no").collect()
    assert [(r.success, r.error_message) for r in rows] == [(True, None), (False, "broken"), (False, "No result")] and "é" in rows[0].raw
    assert ocr.recognised(images, make, pause=0.0, none_fails=False).where("success").count() == 2
    pages = spark.createDataFrame([("b", 0, "x"), ("b", 1, "y")], "book_id string, page_no int, text string")
    assert [r.success for r in ocr.reviewed(pages, lambda: lambda t: {"x": "{}"}[t]).orderBy("page_no").collect()] == [True, False]


def test_attempts():
    tries = []

    def third(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError("no")
        return x

    assert ocr.attempted(third, 5, pause=0) == 5 and len(tries) == 3
    assert ocr.attempted(lambda: None, pause=0, none_fails=False) is None


# files
@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "mybook" / "ocr_pages"
    d.mkdir(parents=True)
    for i, t in enumerate(["First page goes\non", "and ends. " * 12, "# Chapter Two\n" + "Body text. " * 15]):
        (d / f"page_{i:04d}.md").write_text("HEADER\n" + t)
        (d / f"page_{i:04d}_nohf.md").write_text(t)
        (d / f"page_{i:04d}.json").write_text(json.dumps([{"category": "Page-header", "text": "HEADER"}, {"category": "Text", "text": t}]) if i < 2 else "{broken")
    for n in ("IMG_20240102_030405.jpg", "b.PNG", "c.Jpg", "d.txt"):
        (tmp_path / "mybook" / n).write_bytes(b"x")
    return tmp_path / "mybook"


def test_readers(spark, folder):
    assert sorted(r.name for r in readers.images(spark, str(folder)).collect()) == ["IMG_20240102_030405.jpg", "b.PNG"]
    times = {r.name: str(r.captured) for r in readers.captured_images(spark, str(folder)).collect()}
    assert times["IMG_20240102_030405.jpg"] == "2024-01-02 03:04:05" and times["b.PNG"] > "2025"
    pages = readers.page_texts(spark, str(folder))
    assert [(r.page_no, r.kind) for r in pages.orderBy("page_no").collect()] == [(0, "json"), (1, "json"), (2, "json")]
    assert readers.page_texts(spark, str(folder), readers.TIERS["analyze"]).first().kind == "markdown"
    assert readers.page_texts(spark, str(folder), ("*.nothing",)).count() == 0
    assert readers.pages_folder(spark, str(folder)) == str(folder / "ocr_pages")
    outs = {r.page_no: (r.has_json, r.has_nohf, r.json_valid) for r in readers.outputs(spark, str(folder / "ocr_pages")).collect()}
    assert outs == {0: (True, True, True), 1: (True, True, True), 2: (True, True, False)}
    (folder / "words").write_text("Hello\n\n world \nhello\n")
    assert sorted(r.word for r in readers.dictionary(spark, str(folder / "words")).collect()) == ["hello", "world"]
    assert readers.dictionary(spark, "/no/such/file").count() == 0
    assert [r.page_no for r in readers.processed_images(spark, str(folder)).collect()] == [0]


def test_naming(spark):
    made = lambda *names: readers.naming(spark.createDataFrame([(n,) for n in names], "name string")).first().pattern
    assert made("page_0001.md") == "page_N" and made("scan_page_1.md") == "scan_page_N" and made("other.md") == "page_N"
    numbers = spark.createDataFrame([("page_0012.md",), ("x_page_3.md",), ("page_1_nohf.md",), ("a.md",)], "name string").select(review.page_number(F.col("name"))).collect()
    assert [r[0] for r in numbers] == [12, 3, None, None]


def test_cli(spark, folder, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    assert cli.main(["join", str(folder), out]) == 0
    text = open(f"{out}/ocr_pages.md").read()
    assert "First page goes on <!-- page 1 -->and ends." in text and "HEADER" not in text
    assert cli.main(["analyze", str(folder), out]) in (0, 1) and "OCR Error Report" in open(f"{out}/ocr_pages_error_report.txt").read()
    assert cli.main(["epub", f"{out}/ocr_pages.md", out]) == 0
    with zipfile.ZipFile(f"{out}/ocr_pages.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.read("mimetype") == b"application/epub+zip"


def test_lists_tables_and_contents():
    made = epub.to_html("[TOC]\n\n# A\n\n## B & c\n\n- x\n- y\n    - z\n- v\n\n3. a\n\n| a | b |\n|:-|-:|\n| 1 |")
    assert '<div class="toc"><ul><li><a href="#a">A</a><ul><li><a href="#b-c">B &amp; c</a></li></ul></li></ul></div>' in made
    assert "<ul><li>x</li><li>y<ul><li>z</li></ul></li><li>v</li></ul>" in made and "<ol><li>a</li></ol>" in made
    assert '<td style="text-align: left;">1</td><td style="text-align: right;"></td>' in made
    assert writers.indented('{"a":["é"]}') == '{\n  "a": [\n    "é"\n  ]\n}' and writers.indented("no json") == "no json" and writers.indented(None) is None


def test_epub():
    md = "# T & <x>\n\nA *b* **c** `d` [e](f) & g<br>\n\n- one\n- two\n\n1. x\n2. y\n\n> quote\n> more\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nif a < b:\n```\n\n---\n\n<!-- page 1 -->\n\n# T & <x>"
    data = epub.build(epub.Metadata("Title & more"), [("One & two", md), ("Two", "plain\x07 text")])
    assert data == epub.build(epub.Metadata("Title & more"), [("One & two", md), ("Two", "plain\x07 text")])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        html = z.read("OEBPS/chapter0.xhtml").decode()
        for name in z.namelist():
            if name.endswith((".opf", ".ncx", ".xml")) or name.endswith("nav.xhtml"):
                minidom.parseString(z.read(name))
    for part in ("<em>b</em>", "<strong>c</strong>", "<code>d</code>", '<a href="f">e</a>', "<li>one</li>", "<ol><li>x</li>", "<blockquote>", "<td>1</td>", 'class="language-py"', "a &lt; b", "<hr/>", "<br/>"):
        assert part in html, part


def test_chapters_of_files_are_rows_as_they_are_read(spark, tmp_path):
    texts = {"a": [f"**{k}** " + "x" * (200_000 * (k % 3)) for k in range(60)], "b": [], "c": ["é"]}
    for name, own in texts.items():
        (tmp_path / f"{name}.epub").write_bytes(epub.build(epub.Metadata(name), [(f"t{k}", x) for k, x in enumerate(own)]))
    (tmp_path / "d.txt").write_text("no book")
    found = readers.epub_bodies(spark, str(tmp_path))
    got = {(os.path.basename(r.path).removesuffix(".epub"), r.chapter_no): r.body for r in found.collect()}
    assert got == {(name, k): epub.to_html(x) for name, own in texts.items() for k, x in enumerate(own)}

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            data = super().read(n)
            Counted.read_bytes += len(data)
            return data

    data = epub.build(epub.Metadata("r"), [("t", random.Random(k).randbytes(40_000).hex()) for k in range(50)])
    first = next(epub.bodies(Counted(data)))
    assert len(first) > 80_000 and Counted.read_bytes < len(data) / 10


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0, "t", "n", "[]"), ("b", 1, "é", None, None)], "book_id string, page_no int, text string, text_nohf string, raw string")
    assert [r.written for r in writers.page_files(rows, str(tmp_path / "p")).orderBy("page_no").collect()] == [3, 1]
    assert sorted(os.listdir(tmp_path / "p" / "b")) == ["page_0000.json", "page_0000.md", "page_0000_nohf.md", "page_0001.md"]
    writers.pages(rows, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    writers.study(rows, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    assert writers.resized_images(spark.createDataFrame([("a", b"no image")], "path string, content binary")).first().jpeg is None


def test_plan(spark):
    rows = spark.createDataFrame([("b", 0, '[{"category":"Text","text":"One cur-\\nrently"}]', "x", True), ("b", 1, None, "goes on.", True), ("b", 2, None, "", False)], "book_id string, page_no int, raw string, text_nohf string, success boolean")
    done = book.run(rows, spark.createDataFrame([("currently",)], "word string"))
    assert done.success and done.books.first().text == "One currently <!-- page 1 -->goes on."
    assert done.reports.first().n_errors == 2 and [r.title for r in done.chapters.collect()] == ["Content"] and done.boundaries.count() == 2
    assert not book.run(rows.limit(0)).success
    assert not book.run(rows.drop("raw")).success


def test_stream(spark, tmp_path):
    schema = incremental.PAGES
    spark.createDataFrame([("b", 0, None, "a\nb", True)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    args = (str(tmp_path / "out"), str(tmp_path / "cp"))
    incremental.run(incremental.stream(spark, str(tmp_path / "in")), *args).awaitTermination(60)
    spark.createDataFrame([("b", 1, None, "c", True)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.run(incremental.stream(spark, str(tmp_path / "in")), *args).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("page_no").collect()
    assert [(r.page_no, r.text, r.n_warnings) for r in rows] == [(0, "a b", 2), (1, "c", 2)]  # short, and of short words


def test_a_listener_counts_what_a_stream_reads(spark, tmp_path):
    pages_ = spark.createDataFrame([("b", p, None, f"text {p}", True) for p in range(40)], incremental.PAGES).repartition(3)
    pages_.write.parquet(str(tmp_path / "in"))
    shown = progress.Progress(40)
    start = lambda: incremental.run(incremental.stream(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    progress.followed(spark, shown, start)
    assert shown.current == 40 == spark.read.parquet(str(tmp_path / "out")).count() and shown.item.startswith("batch ")
    progress.followed(spark, shown, start)  # nothing new
    assert shown.current == 40
    # a batch that fails isn't counted; the one that takes its place is
    pages_.limit(5).write.mode("append").parquet(str(tmp_path / "in"))

    def fail(done, number):
        raise ValueError("stop")

    again = lambda after: incremental.run(incremental.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), after=after)
    with pytest.raises(Exception, match="stop"):
        progress.followed(spark, shown, lambda: again(fail), wait=2)
    assert shown.current == 40
    progress.followed(spark, shown, lambda: again(None))
    assert shown.current == 45 and shown.percent == 112.5


def test_progress(spark):
    p = progress.Progress(10, "Pages", out=io.StringIO())
    p.update(4, item="x" * 40)
    p.update(1, success=False)
    p.started -= 5
    assert (p.percent, p.successful, p.failed, progress.Progress(0).percent, progress.Progress(5).eta) == (50.0, 4, 1, 100.0, None)
    assert "5/10 (50%)" in p.line() and "..." + "x" * 22 in p.line() and "5/10" in p.finish() and round(p.eta) == 5
    assert list(progress.progress_iter((i for i in range(3)), out=None)) == [0, 1, 2]
    log = spark.createDataFrame([("r", 10, 3, True, 2.0), ("r", 10, 2, False, 5.0)], "run_id string, total int, n int, success boolean, elapsed double")
    r = progress.log_summary(log).first()
    assert (r.current, r.successful, r.failed, r.rate, r.eta, r.percent, r.elapsed_text) == (5, 3, 2, 1.0, 5.0, 50.0, "5s")


@pytest.mark.parametrize("wrong", [{"book_title": " "}, {"resize_target": -1}, {"ocr_threads": 0}, {"max_error_ratio": 0}, {"max_error_ratio": 1.1}, {"min_text_length": -1}, {"output_formats": ("pdf",)}])
def test_config(wrong):
    assert Config("i", "o/", "A: Book", max_error_ratio=1).path("epub") == "o/A__Book.epub"
    with pytest.raises(ValueError):
        Config(**({"input_dir": "i", "output_dir": "o", "book_title": "t"} | wrong))


# the driver's entry
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 180
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 55


def test_entry_without_the_training_data_part(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/pageloom", tmp_path / "pageloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout.split()[0]) > 50, said.stderr


def test_nothing_else_imports_the_training_data_part():
    for top, _, names in os.walk(f"{ROOT}/pageloom"):
        for n in names:
            if n.endswith(".py") and "/llm" not in top:
                assert "llm" not in [w for line in open(f"{top}/{n}") if "import" in line for w in line.replace(".", " ").split()], n


@pytest.mark.parametrize("name", ["page_boundaries", "page_findings", "clean_text_blocks", "clean_book_pages", "repeated_phrases", "book_chapters", "pages_to_process", "review_issues", "salvaged_fragments", "clean_raw_layouts"])
def test_queries_against_sql(spark, name):
    import duckdb

    from pageloom import registry

    con = duckdb.connect()
    for t in ("documents", "events", "orders", "lineitem", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(map(str, con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({registry.ORACLE_SQL[name]})").fetchall()))
    assert got == want and got


def test_page_files_are_read_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 0, "one\n\ntwo\n", "x\ny", '[1]'), ("a/b", 1, "three\r\nfour", "", None)], "book_id string, page_no int, text string, text_nohf string, raw string")
    writers.page_files(rows, f"file:{tmp_path}").collect()
    got = readers.page_texts(spark, str(tmp_path), ("*_nohf.md",)).orderBy("page_no").collect()
    assert [(r.book_id, r.text) for r in got] == [("a%2Fb", "x\ny"), ("a%2Fb", "")]
    assert [r.text for r in readers.page_texts(spark, str(tmp_path), ("page_????.md",)).orderBy("page_no").collect()] == ["one\n\ntwo\n", "three\r\nfour"]
    assert [r.content for r in readers.markdown(spark, f"{tmp_path}/a%2Fb/page_0000.md").collect()] == ["one\n\ntwo\n"]
    assert [(r.page_no, r.has_json, r.json_valid) for r in readers.outputs(spark, f"{tmp_path}/a%2Fb").orderBy("page_no").collect()] == [(0, True, True), (1, False, None)]


@pytest.mark.parametrize(("tiers", "of"), [(readers.TIERS["analyze"], ("text", "text_nohf")), (readers.TIERS["join"], ("text", "raw"))])
def test_pages_of_more_than_four_digits_come_behind_those_of_four(spark, tmp_path, tiers, of):
    numbers = [7, 1000, 1001, 9999, 10000, 10001, 99999, 100000]
    rows = spark.createDataFrame([(b, n, *(str(n) if x in of else None for x in ("text", "text_nohf", "raw"))) for b in "ab" for n in numbers], "book_id string, page_no int, text string, text_nohf string, raw string")
    writers.page_files(rows, str(tmp_path)).collect()
    got = readers.page_texts(spark, str(tmp_path), tiers).orderBy("book_id", "page_no").collect()
    assert [(r.book_id, r.page_no, int(r.text)) for r in got] == [(b, k, n) for b in "ab" for k, n in enumerate(numbers)]


@pytest.mark.parametrize(("name", "most"), [("page_file_tiers", 300), ("captured_files", 600)])
def test_files_are_written_some_at_a_time_and_deleted(spark, monkeypatch, name, most):
    import duckdb

    from pageloom import registry

    folders, counts = [], []
    own, written = registry.own_folder, registry.written

    def count():
        return sum(len([x for x in names if x.endswith((".md", ".json", ".jpg"))]) for folder in folders for _, _, names in os.walk(folder.removeprefix("file:")))

    monkeypatch.setattr(registry, "STANDING", 500, raising=False)
    monkeypatch.setattr(registry, "own_folder", lambda spark: folders.append(own(spark)) or folders[-1])
    monkeypatch.setattr(registry, "written", lambda files: (written(files), counts.append(count())))
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(map(str, con.execute(f"select {', '.join(cols)} from ({registry.ORACLE_SQL[name]})").fetchall()))
    assert got == want and len(got) > 500
    assert 100 < max(counts) <= most and count() == 0
    # nor does what was stored on the way stay
    with ordered.fleeting(spark):
        path = ordered.stored(spark.range(3))._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_running_headers_leave_one_packed_copy_of_the_texts(spark):
    letters = random.Random(3)
    texts = [f"# Head {k % 3}\n" + letters.randbytes(10_000).hex() + f"\n## Own {k}\nend\n" for k in range(100)]
    rows = spark.createDataFrame([("b", k, k == 0, k == 99, 1, x) for k, x in enumerate(texts)], "book_id string, block bigint, first boolean, last boolean, n_pages bigint, text string")
    folder = ordered.shared_folder(spark).removeprefix("file:")

    def held():
        return sum(os.path.getsize(f"{top}/{x}") for top, _, names in os.walk(folder) for x in names)

    stood = held()
    found = running.drop_running_headers(rows, run=8)
    assert held() - stood < sum(map(len, texts))
    got = "".join(r.text for r in found.orderBy("block").collect())
    want = spark.createDataFrame([("".join(texts),)], "text string").select(running.without_running_headers(F.col("text"))).first()[0]
    assert got == want and len(got) > 2_000_000


def test_review_requests_go_over_http(spark):
    import http.server
    import threading

    class Model(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            good = asked["max_tokens"] == 4096 and asked["tools"][0]["function"]["name"] == "suggest_fix" and asked["messages"][1]["content"] != "bad"
            call = {"function": {"name": "suggest_fix", "arguments": json.dumps({"issue_type": "spelling", "start_offset": 1, "end_offset": 2, "confidence": 0.9})}}
            data = json.dumps({"choices": [{"message": {"tool_calls": [call]}}]}).encode()
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(data if good else b"")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    pages = spark.createDataFrame([("b", 0, "texxt"), ("b", 1, "bad")], "book_id string, page_no int, text string")
    got = ocr.reviewed(pages, ocr.http_client(f"http://127.0.0.1:{server.server_port}/")).persist()
    assert [(r.page_no, r.success) for r in got.orderBy("page_no").collect()] == [(0, True), (1, False)]
    assert [(r.page_no, r.type, r.severity) for r in review.issues(got).collect()] == [(0, "spelling", "high")]
    server.shutdown()


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no list of files, and empty files are told like others."""
    (tmp_path / "a").mkdir()
    for name, said in (("page_0000.md", "one"), ("page_0001.md", ""), ("page_0002.svg", "x"), (".page_0003.md", "hidden")):
        (tmp_path / "a" / name).write_text(said)
    for name in ("a.jpg", "b.JPG", "c.txt"):
        (tmp_path / name).write_bytes(b"\xff\xd8" + b"x" * 300_000)
    found = readers.whole_files(spark, str(tmp_path), "page_*.md", True)
    assert sorted((r.path, r.text, r.modified is not None) for r in found.collect()) == [(f"file:{tmp_path}/a/page_0000.md", "one", True), (f"file:{tmp_path}/a/page_0001.md", "", True)]
    pages = readers.page_texts(spark, str(tmp_path), ("*.nothing", "page_*.md"))
    assert sorted((r.book_id, r.page_no, r.text) for r in pages.collect()) == [("a", 0, "one"), ("a", 1, "")]
    images = readers.images(spark, str(tmp_path), content=True)
    assert sorted((r.name, len(r.content)) for r in images.collect()) == [("a.jpg", 300_002), ("b.JPG", 300_002)]
    assert [x.inputFiles() for x in (found, pages, images)] == [[], [], []]


def test_similarity_is_the_matchers_and_visits_no_common_letters():
    from difflib import SequenceMatcher

    r = random.Random(5)
    for _ in range(400):
        letters = r.choice(["ab", "abc ", "abcdefghijklmnop .,XYZ", "aé😀", "a" * 30 + "bcdefgh"])
        a, b = ("".join(r.choices(letters, k=r.choice([0, 1, 5, 60, 199, 200, 201, 450]))) for _ in range(2))
        if r.random() < 0.5:
            b = "".join(c for c in a if r.random() < 0.95) + r.choice(["", "x", "abab"])
        for x, y in ((a, b), (a.split(), b.split()), (a, a)):
            assert accuracy.ratio(x, y) == SequenceMatcher(None, x, y).ratio()

    class Counted(str):
        seen = 0

        def __getitem__(self, k):
            Counted.seen += 1
            return str.__getitem__(self, k)

    # letters of which each makes up a seventh are not indexed, so but for both ends of a match none is looked at
    a, b = ("".join(r.choices("abcdefg", k=20_000)) for _ in range(2))
    assert accuracy.ratio(Counted(a), b) == SequenceMatcher(None, a, b).ratio() and Counted.seen < 100
