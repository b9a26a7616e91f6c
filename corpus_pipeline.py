"""A corpus pipeline: quality, language, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontam, langid, neardup, packing, quality
from pageloom.llm.batches import delete, read, use_checkpoint_dir
from pageloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if the model gives it at least this probability of good quality, and its language this margin and fit (nats an n-gram).
LEAST_QUALITY, LEAST_MARGIN, LEAST_FIT = 0.5, 0.2, -2.5
CAPACITY = 1024


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on labelled documents, takes for good ones. An empty text is rejected."""
    model = quality.scorer(docs, read(spark, sf_dir, "labels"), F.lit(True))
    scored = quality.score(docs.where("trim(text) <> ''"), model, COLUMNS)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear: an n-gram is on average as likely as this in a language that was learned, and by so much likelier than in the next one, and little of the text stands in another one, window by window. Those without letters, of unlearned languages, of several and of none go; each half of the documents is judged by a model of the other."""
    return langid.clear(docs, COLUMNS, LEAST_MARGIN, LEAST_FIT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the document with the smallest id."""
    return neardup.representatives(docs, COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of CAPACITY tokens."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), CAPACITY)


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack)]

#: The stages fit models and tokenise, which SQL can't express; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written to the shared folder and read again; what the next stage has read is deleted, the last result stays."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            delete(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
