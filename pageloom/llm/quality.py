"""Quality classifier: a generalised additive model over surface features of whole texts.

The model is fitted on at most ``FIT_ROWS`` labelled documents, those first by a hash of
their id; every text is scored. Cases: null and empty texts get the features of an empty
text and a score like any other; labels that are null or not 0 or 1, and labels of unknown
documents, don't train; one label repeated counts once, two different ones both count, and
so does a document whose id is repeated (once, by the smallest of its rows' features); with
no usable label every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gam
from .batches import column, steps, texts
from .features import DIGIT, LETTER, MARK, SPACE, UPPER, classes_of, code_points, sums

#: Labelled documents that a fit uses at most.
FIT_ROWS = 20_000
FEATURES = ("size", "upper", "digits", "marks", "exclaims", "signs", "bars", "brackets", "lines", "word_size", "long_words", "distinct", "repeats", "same_lines", "top_word", "mark_ends", "capital_words")
# Signs that prose seldom has.
SIGNS = "#$%&*+<=>@\\^_`~"


def features(batch: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    if not batch:
        return np.zeros((0, len(FEATURES)))
    codes, starts = code_points(batch)
    kinds = classes_of(codes)
    n = np.diff(starts) - 1.0
    size = np.maximum(n, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return sums(flags.astype(np.int64), starts) / size

    small = np.minimum(codes, 127)
    signs, brackets = np.zeros(128, dtype=bool), np.zeros(128, dtype=bool)
    signs[[ord(c) for c in SIGNS]] = True
    brackets[[ord(c) for c in "()[]{}"]] = True
    kinds[starts[1:] - 1] = 0
    letters = share(kinds & LETTER > 0)
    out = [np.log1p(n), share(kinds & UPPER > 0) / np.maximum(letters, 1e-9), share(kinds & DIGIT > 0), share(kinds & MARK > 0), share(small == 33), share(signs[small]), share(small == 124), share(brackets[small]), share(small == 10)]
    words = np.zeros((len(batch), 8))
    after_mark = np.concatenate([(kinds[:-1] & MARK > 0) & (kinds[1:] & SPACE > 0), [False]])
    capital = np.concatenate([(kinds[:-1] & SPACE > 0) & (kinds[1:] & UPPER > 0), [False]])
    ends, capitals = sums(after_mark.astype(np.int64), starts), sums(capital.astype(np.int64), starts)
    for i, text in enumerate(batch):
        w = text.split()
        if not w:
            continue
        count, lines = len(w), [x for x in text.split("\n") if x]
        often = Counter(w)
        words[i] = (sum(map(len, w)) / count, len(max(often, key=len)), np.log(len(often)) / np.log(count) if count > 1 else 1.0, sum(map(eq, w, w[1:])) / count, 1 - len(set(lines)) / max(len(lines), 1), max(often.values()) / count, ends[i] / count, capitals[i] / count)
    return np.column_stack([*out, words])


def scorer(docs: DataFrame, labels: DataFrame, trains: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> gam.Model:
    """Fit on labelled documents for which ``trains`` (over the id column ``id``) holds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & trains)
    chosen = known.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            x = features(texts(b, "text"))
            yield pa.RecordBatch.from_arrays([column(b, "id").cast(pa.string()), column(b, "y").cast(pa.float64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "y", "x"])

    # rows that repeat an id count once, so there are no more than the labels chosen
    once = rows.mapInArrow(run, "id string, y double, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x"))
    table = once.toArrow()
    x = np.array(table["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, table["y"].to_numpy()]) if len(x) else np.zeros(0, dtype=int)
    return gam.fit(x[order], table["y"].to_numpy()[order] if len(x) else np.zeros(0))


def score(docs: DataFrame, model: gam.Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of docs (but for one of this name) with ``score``, the probability of label 1."""
    keep = [c for c in keep if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col(text_col).alias("judged"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "judged"):
            p = shared.value.score(features(texts(b, "judged")))
            yield pa.RecordBatch.from_arrays([*(column(b, k) for k in names), pa.array(p)], names=[*names, "score"])

    return rows.mapInArrow(run, rows.drop("judged").schema.add("score", "double")).withColumnsRenamed(dict(zip(names, keep, strict=True)))
