"""Registered queries take whole texts and all rows."""

import pytest

from pageloom import registry
from pageloom.operators.accuracy import similarity

SMALL = "/root/testdata/sf0.001"


def in_sql(sql: str, *tables: str) -> list:
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con.execute(sql).fetchall()


def test_xhtml_of_whole_pages(spark):
    got = [(r.page_id, r.xhtml) for r in registry.sanitised_xhtml(spark, SMALL).collect()]
    assert sorted(got) == sorted(in_sql(registry.ORACLE_SQL["sanitised_xhtml"], "pages")) and max(len(x) for _, x in got) > 13_000


def test_every_run_is_compared_in_full(spark):
    docs = {i: (t, n) for i, t, n in in_sql("select doc_id, text, n_chars from documents", "documents")}
    want: dict[int, list] = {0: [], 90: [], 180: [], 270: []}
    for i, (t, n) in docs.items():
        quarter = i // 20 % 4
        want[quarter * 90].append((n / 100, *similarity(docs[i - 20 * quarter][0], t)[:2]))
    got = {r.rotation: r for r in registry.accuracy_averages(spark, SMALL).collect()}
    assert sum(r.n_runs for r in got.values()) == len(docs) == 200 and set(got) == set(want)
    for k, rows in want.items():
        means = [sum(x) / len(rows) for x in zip(*rows, strict=True)]
        assert [got[k].n_runs, got[k].avg_time, got[k].avg_char_similarity, got[k].avg_word_similarity] == pytest.approx([len(rows), *means])


@pytest.fixture
def events(spark, tmp_path):
    """Ids beyond 3,000 and beyond four digits, and the rest of 1,234's neighbours."""
    ids = [*range(5), *range(1230, 1240), *range(2995, 3005), *range(5000, 5005), *range(9990, 10010), 10300, 99999, 100000, 123456]
    spark.createDataFrame([(i, "ab"[i % 2]) for i in ids], "event_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path), ids


def test_pages_of_all_events_are_listed(spark, events):
    at, ids = events
    want = {(f"/b/{'ab'[i % 2]}/ocr_pages", i, f"page_{i:04d}.md", f"page_{i:04d}.json" if i % 2 == 0 else None, f"page_{i}.jpg" if i % 3 == 2 else f"page_{i:04d}.jpg") for i in ids}
    got = [(r.folder, r.page_no, r.markdown, r.json, r.image) for r in registry.page_listing(spark, at).collect()]
    assert len(got) == len(ids) and set(got) == want
    names = {f"page_{i:04d}{x}" for i in ids for x in (".md", "_nohf.md")}
    assert names <= {r.name for r in registry.page_names(spark, at).collect()}
    assert registry.page_naming(spark, at).first().pattern == "page_N"
    assert [tuple(r) for r in registry.page_image(spark, at).collect()] == [("/b/a/ocr_pages", 1234, "page_1234.jpg")]


def test_all_events_are_ordered(spark, events):
    at, ids = events
    by_path = {i: k for k, i in enumerate(sorted(ids, key=lambda i: f"page_{i:04d}.md"), 1)}
    want = [(i, f"page_{i:04d}.md", by_path[i], k) for k, i in enumerate(sorted(ids), 1)]
    assert sorted((r.page_no, r.name, r.by_path, r.by_number) for r in registry.page_orders(spark, at).collect()) == want


def test_results_keep_whole_texts(spark):
    cols = "book_id, page_no, text, success, error_message"
    whole = registry.ORACLE_SQL["results_with_gaps_filled"]
    got = [tuple(r) for r in registry.results_with_gaps_filled(spark, SMALL).select(*cols.split(", ")).collect()]
    assert sorted(got) == sorted(in_sql(f"select {cols} from ({whole})", "documents")) and max(len(r[2] or "") for r in got) > 10_000
