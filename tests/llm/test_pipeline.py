"""The pipeline's stages over a small table, each against what it must keep."""

import collections
import itertools
import random

import corpus_pipeline
from pageloom.llm import simhash

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    every = {r.doc_id for r in docs.collect()}
    good = corpus_pipeline.keep_quality(spark, docs, SF)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == corpus_pipeline.COLUMNS
    assert sum(labels[i] == 1 for i in labels if i in every - kept) <= 2 and sum(labels[i] == 0 for i in labels if i in kept) <= 2
    known = corpus_pipeline.keep_language(spark, good, SF)
    # what goes here is of two languages: a benchmark passage in another one was put into it
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    mixed = [r.text for r in good.join(known.select("doc_id"), "doc_id", "left_anti").collect()]
    assert known.columns == corpus_pipeline.COLUMNS and len(mixed) <= 12 and sum(not any(i[:60] in t or i[-60:] in t for i in items) for t in mixed) <= 2
    one = corpus_pipeline.drop_near_duplicates(spark, known, SF)
    texts = {r.doc_id: r.text for r in one.collect()}
    assert len(set(texts.values())) == len(texts)
    sets, holders = {i: set(simhash.shingle_hashes(t, 5)) for i, t in texts.items()}, collections.defaultdict(list)
    for i, own in sets.items():
        for x in own:
            holders[x].append(i)
    shared = collections.Counter(p for ids in holders.values() for p in itertools.combinations(ids, 2))
    assert not any(n >= 0.8 * len(sets[a] | sets[b]) for (a, b), n in shared.items())
    # each document that is gone was near one that is here, directly or by way of others that are gone
    gone = {r.doc_id: set(simhash.shingle_hashes(r.text, 5)) for r in known.collect() if r.doc_id not in texts}
    near = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    reached = list(sets.values())
    while gone and (found := [i for i, x in gone.items() if any(near(x, y) for y in reached)]):
        reached = [gone.pop(i) for i in found]
    assert not gone
    clean = corpus_pipeline.drop_leaks(spark, one, SF)
    leaked = {i for i, t in texts.items() if any(x in t for x in items)}
    assert {r.doc_id for r in clean.collect()} == set(texts) - leaked and leaked
    packed = corpus_pipeline.pack(spark, clean, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts) - leaked


def test_stages_take_odd_and_empty_tables(spark):
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id bigint"
    r = random.Random(1)
    rows = [(i, t, None, None, None, 1.0, 2) for i, t in enumerate([None, "", "12", "a b c d e f g", "a b c d e f g", " ".join(r.choice("abc") for _ in range(20_000))])] + [(None, None, None, None, None, None, None)]
    for df in (spark.createDataFrame(rows, shape), spark.createDataFrame([], shape)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).collect()


def test_language_takes_texts_with_a_long_stretch_without_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    text = (docs.where("lang = 'en' and doc_id % 7 = 0").orderBy("doc_id").first().text * 20)[:2000]
    more = [(10**9 + i, text[:1000] + gap + text[1000:], "en", "s", 2600) for i, gap in enumerate(["\n" + "-" * 600 + "\n", " 12 34" * 100])]
    kept = corpus_pipeline.keep_language(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), SF)
    assert {r.doc_id for r in kept.where(f"doc_id >= {10**9}").collect()} == {10**9, 10**9 + 1}
