"""Sum-of-squares packing of tokenised documents into sequences of a fixed capacity.

Each text is tokenised whole and closed with an end id. Documents longer than a sequence are
cut into full pieces, the first piece taking the remainder; full pieces are sequences of
their own. The other pieces are dealt evenly to groups of a bounded number of pieces, and
each group is packed, largest piece first: a piece goes where the squared counts of open
bins per residual gap become smallest, ties to the tightest bin. A new bin is opened only for
what fits none: to weigh it as one more place, as the rule has it for pieces that come one
by one, takes 1.3 % more sequences here (7,443 against 7,346 for 15,996 pieces that fill
7,332).

Cases: a null text is empty, and so is its end id alone; repeated rows are packed each;
equal lengths keep the order of the hash that dealt them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import checkpoint, column, steps, texts
from .tokens import PieceIds, ids_of, library

#: Pieces that one task packs.
GROUP = 20_000


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text."""
    special = [t.content for t in library(path).get_added_tokens_decoder().values()]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceIds(path)
        for b in steps(batches, "text"):
            at, start, length, crc, number = [], [], [], [], []
            for i, t in enumerate(texts(b, "text")):
                ids = ids_of(t, cache, special) + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    number.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays([column(b, "id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def place(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each piece, by sum of squares; a bin is opened only for what fits none."""
    open_ = np.zeros(capacity + 1)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = [], 0
    for s in sizes:
        before = open_[s:]
        change = np.where(before > 0, open_[: capacity - s + 1] - before, np.inf)
        if before[0] > 0:
            change[0] -= 0.5  # a full bin counts no more, an open one would
        k = int(change.argmin())
        if change[k] < np.inf:
            b = held[s + k].pop()
            open_[s + k] -= 1
        else:
            b, k = bins, capacity - s
            bins += 1
        if k:
            open_[k] += 1
            held[k].append(b)
        out.append(b)
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, placed largest first."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    bins[order] = place(sizes[order].tolist(), capacity)
    return bins


def packed(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cut = checkpoint(pieces(docs, path, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    full = cut.where(F.col("length") == capacity).select("id", "piece", "start", "length", "ids_crc32", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("deal", F.xxhash64("row")).withColumn("g", F.pmod("deal", F.lit(groups)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("deal", "ascending")])
        sizes = table["length"].to_numpy().astype(np.int64)
        bins = pack(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        firsts = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        begins = ends - sizes[order]
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[order] = begins - np.repeat(begins[firsts], np.diff(np.append(np.flatnonzero(firsts), len(order))))
        sequence = ((key[0].as_py() << 32) + bins) * 2 + 1
        return table.select(["id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return full.unionByName(dealt.groupBy("g").applyInArrow(run, full.schema)).withColumnRenamed("id", id_col)
