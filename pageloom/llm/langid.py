"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are gathered from every training document and summed by
Spark; the smoothed log-probability matrix (languages x buckets, the buckets a parameter)
is broadcast, and numpy scores each batch as a sparse product. More than ``MOST_LABELS``
languages are scored in blocks of so many, one after another over each batch.

The posterior probability is near 1 for nearly every text, right or wrong, since it sums
over all n-grams. Two measures that don't saturate stand beside it: ``margin``, by how much
an n-gram of the text is likelier in its language than in the second one on average, and
``fit``, by how much it is likelier than an average n-gram of the language's training
texts. A text in a language that wasn't learned has a low fit. Means over a whole text can't
tell a mixture of languages: ``clear`` also judges windows of a bounded number of characters.

Cases: a null text, or one without a letter (by Unicode's categories, all planes), gets
``und``, score 0, and null margin and fit; a document with a null label doesn't train; ties
go to the label that sorts first; no training document at all leaves every prediction
``und``; with one label only, margin is null. Repeated rows count as often as they occur,
and each is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .batches import column, steps, texts
from .features import LETTER, classes_of, code_points, sums

BITS, SIZES, SMOOTHING, MOST_LABELS = 16, (1, 2, 3), 0.5, 200
STEP = 1 << 20
UNKNOWN = "und"
#: Columns of the result; columns of the input with these names give way to them.
RESULTS = ("lang_pred", "score", "margin", "fit")
#: What is known of a text under a model.
EACH = ("label", "best", "second", "every", "usual", "n")


@dataclass
class Model:
    """The labels, sorted; for each the log probabilities of the buckets, the log prior, and the mean log probability of its training n-grams."""

    labels: list[str]
    matrix: np.ndarray
    prior: np.ndarray
    usual: np.ndarray
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES

    def blocks(self, most: int) -> list[Model]:
        return [Model(self.labels[a : a + most], self.matrix[a : a + most], self.prior[a : a + most], self.usual[a : a + most], self.bits, self.sizes) for a in range(0, max(len(self.labels), 1), most)]


def grams(batch: list[str], bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the bucket of each n-gram of the lower-cased texts (what isn't a letter counts as one same character), which of them count, the starts of the texts, and each text's letters."""
    codes, starts = code_points([t.lower() for t in batch])
    letter = (classes_of(codes) & LETTER) > 0
    plain = np.where(letter, codes, 32).astype(np.uint64)
    letters = sums(letter.astype(np.int64), starts)
    for n in sizes:
        h = np.zeros(len(plain), dtype=np.uint64)
        counts = np.zeros(len(plain), dtype=bool)
        for k in range(n):
            m = len(plain) - k
            h[:m] = h[:m] * np.uint64(0x100000001B3) + plain[k:] + np.uint64(n)
            counts[:m] |= letter[k:]
        for k in range(1, n):  # none spans the gap between two texts
            counts[np.maximum(starts[1:] - 1 - k, 0)] = False
        counts[starts[1:] - 1] = False
        h *= np.uint64(0x9E3779B97F4A7C15)
        yield (h >> np.uint64(64 - bits)).astype(np.int64), counts, starts, letters


def train(docs: DataFrame, label: str = "lang", text: str = "text", bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> Model:
    """Fit to all documents with a label; the driver gets one row for each label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in steps(batches, "text", STEP):
            labels = column(b, "label").to_pylist()
            names = sorted(set(labels))
            for x in names:
                found.setdefault(x, np.zeros((1 << bits) + 1, dtype=np.int64))[-1] += labels.count(x)
            own = np.array([names.index(x) for x in labels])
            for h, counts, starts, _ in grams(texts(b, "text"), bits, sizes):
                key = np.repeat(own, np.diff(starts)) << bits | h
                n = np.bincount(key[counts], minlength=len(names) << bits).reshape(len(names), -1)
                for i, x in enumerate(names):
                    found[x][:-1] += n[i]
            if len(found) > MOST_LABELS:  # what a task holds is bounded
                yield from counted(found)
                found = {}
        yield from counted(found)

    def counted(found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], names=["label", "bucket", "n"])

    def dense(key: tuple, table: pa.Table) -> pa.Table:
        n = np.zeros((1 << bits) + 1)
        n[table["bucket"].to_numpy()] = table["n"].to_numpy()
        smooth = n[:-1] + SMOOTHING
        logs = (np.log(smooth) - np.log(smooth.sum())).astype("<f4")
        usual = float((n[:-1] * logs).sum() / max(n[:-1].sum(), 1))
        return pa.table({"label": [key[0].as_py()], "docs": [int(n[-1])], "usual": [usual], "logs": pa.array([logs.tobytes()], pa.binary())})

    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    total = rows.mapInArrow(count, "label string, bucket bigint, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = total.groupBy("label").applyInArrow(dense, "label string, docs bigint, usual double, logs binary").toArrow().sort_by("label")
    labels, n = table["label"].to_pylist(), table["docs"].to_numpy().astype(float)
    matrix = np.frombuffer(b"".join(table["logs"].to_pylist()), "<f4").reshape(len(labels), 1 << bits)
    return Model(labels, matrix, np.log((n + 1) / (n.sum() + len(labels))) if labels else np.zeros(0), table["usual"].to_numpy(), bits, sizes)


def judge(batch: list[str], model: Model, held: tuple | None = None) -> tuple:
    """For each text: the likeliest label (None without a letter), its log probability with the text, the second one's, the logarithm of the sum of all, the label's ``usual``, and the n-grams; ``held``: the same from other labels, which sort before."""
    total = np.repeat(model.prior[:, None], len(batch), axis=1)
    letters, n = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
    for h, counts, starts, letters in grams(batch, model.bits, model.sizes):  # noqa: B020
        h[~counts] = 1 << model.bits
        n += sums(counts.astype(np.int64), starts)
        for i in range(len(model.labels)):
            row = np.append(model.matrix[i], np.float32(0))
            total[i] += np.add.reduceat(row[h], starts[:-1], dtype=np.float64) if len(batch) else 0
    label, best, second, usual = np.full(len(batch), None, dtype=object), *np.full((2, len(batch)), -np.inf), np.zeros(len(batch))
    every = best.copy()
    if held is not None:
        label, best, second, every, usual = (np.array(x) for x in held)
    for i, name in enumerate(model.labels):
        better = total[i] > best
        second = np.where(better, best, np.maximum(second, total[i]))
        label[better], usual[better] = name, model.usual[i]
        best = np.maximum(best, total[i])
        every = np.logaddexp(every, total[i])
    label[letters == 0] = None
    return label, best, second, every, usual, n


def scored(rows: DataFrame, model: Model, window: int = 0, most: int = MOST_LABELS) -> DataFrame:
    """Rows (..., judged) with the figures of ``judge`` in place of the text, as arrays: of the whole text, and then of its windows of about so many characters, if any."""
    given, state = rows.columns, list(EACH)
    for turn, block in enumerate(model.blocks(most)):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        schema = rows.select(*given).schema
        for x in state:
            schema = schema.add(x, ArrayType(StringType() if x == "label" else DoubleType()))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in steps(batches, "judged", STEP):
                cut = [[t, *windows(t, window)] for t in texts(b, "judged")]
                ends = pa.array(np.cumsum([0, *map(len, cut)]), pa.int32())
                held = tuple(column(b, x).flatten().to_numpy(zero_copy_only=False) for x in state[:5]) if turn else None
                found = judge([t for own in cut for t in own], shared.value, held)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.string() if k == 0 else pa.float64())) for k, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*(column(b, k) for k in given), *lists], names=[*given, *state])

        rows = rows.mapInArrow(run, schema)
    return rows.drop("judged")


def windows(text: str, size: int) -> list[str]:
    """A text cut in equal parts of about so many characters; none of a text that would be one."""
    n = round(len(text) / size) if size else 0
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)] if n > 1 else []


def renamed(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, dict[str, str]]:
    """The ``keep`` columns under other names with the text as ``judged``, and the way back."""
    back = {f"k{i}": c for i, c in enumerate(keep)}
    return docs.select(*[F.col(f"`{c}`").alias(k) for k, c in back.items()], F.col(f"`{text}`").alias("judged")), back


def figures(x: Column) -> tuple[Column, Column, Column, Column]:
    """lang_pred, score, margin and fit of one struct of ``judge``'s figures."""
    known, finite = x["label"].isNotNull(), x["second"] > float("-inf")
    score = F.when(known, F.exp(x["best"] - x["every"])).otherwise(0.0)
    return F.coalesce(x["label"], F.lit(UNKNOWN)), score, F.when(known & finite, (x["best"] - x["second"]) / x["n"]), F.when(known, x["best"] / x["n"] - x["usual"])


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text", most: int = MOST_LABELS) -> DataFrame:
    """The ``keep`` columns of docs (but for those of these names) with lang_pred, score, margin and fit."""
    rows, back = renamed(docs, [c for c in keep if c not in RESULTS], text)
    whole = figures(F.get(F.arrays_zip(*EACH), F.lit(0)))
    return scored(rows, model, 0, most).select(*back, *(x.alias(c) for x, c in zip(whole, RESULTS, strict=True))).withColumnsRenamed(back)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """The crc32 of the id as text falls in this fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def clear(docs: DataFrame, keep: list[str], margin: float, fit: float, window: int = 100, foreign: float = 0.15, line_fit: float = -2.0, window_fit: float = -1.5, unfit: float = 0.5, id_col: str = "doc_id", label: str = "lang", text: str = "text") -> DataFrame:
    """The ``keep`` columns of the documents whose language is clear: the whole text has at least this margin and fit, and, if it is two windows of about ``window`` characters or more, at most a share ``foreign`` of its n-grams lies in windows that this margin gives to another language, and at most ``unfit`` in windows below ``window_fit``. A text of ``1.5 * window`` n-grams, about a line, has ``line_fit`` at least: a longer text fits better than a short one may by chance. Each half of the documents, by the hash of the id (a null one is in the first half), is judged by a model of the other half."""
    second = in_fold(id_col, 2, 1)
    halves = docs.where(~second), docs.where(second)
    out = []
    for own, other in (halves, halves[::-1]):
        rows, back = renamed(own, keep, text)
        judged = scored(rows, train(other, label, text), window).withColumn("_every", F.arrays_zip(*EACH))
        lang, _, margin_of, fit_of = figures(F.get("_every", F.lit(0)))
        # a window without a letter has no n-grams, and is neither
        parts = F.slice("_every", F.lit(2), F.greatest(F.size("_every") - 1, F.lit(0)))
        grams_in = lambda x: F.aggregate(x, F.lit(0.0), lambda a, w: a + w["n"])
        told = lambda w: (w["label"] != F.get("label", F.lit(0))) & (F.try_divide(w["best"] - w["second"], w["n"]) >= margin)
        unlike = lambda w: w["label"].isNotNull() & (w["best"] / w["n"] - w["usual"] < window_fit)
        all_ = grams_in(parts)
        one = (grams_in(F.filter(parts, told)) <= foreign * all_) & (grams_in(F.filter(parts, unlike)) <= unfit * all_)
        good = (lang != UNKNOWN) & (F.coalesce(margin_of, F.lit(margin)) >= margin) & (fit_of >= F.when(F.get("n", F.lit(0)) >= 1.5 * window, max(fit, line_fit)).otherwise(fit)) & one
        out.append(judged.where(good).select(*back).withColumnsRenamed(back))
    return out[0].unionByName(out[1])
