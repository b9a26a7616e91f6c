"""Hard negatives by inner product: an exact top-k search over one-dimensional distance keys.

Vectors are augmented by one component so that all have the length of the longest: then the
larger an inner product with a query, the nearer the augmented vector. Each row goes to the
nearest of a bounded number of pivots, and its key is (pivot, distance to it). Rows are stored
sorted by key in chunks, several chunks a segment; the directory of segments (at most ``MOST``
besides one for each pivot and partition) is all that is broadcast. A vector at distance r of a
query has a key within r of the query's own distance to the same pivot, so a search scans, for
each pivot, the key interval of a radius, and in the next round the annulus up to a larger one:
first the radius that some ``FIRST`` segments need, then those that ``GROWTH`` times as many need.
A query is done when the distance of its k-th hit, or of the least score that may count, is within
the radius: no row that wasn't scanned can be better then. Equal vectors of a label keep only the
ids that an answer can hold; queries of equal vectors and labels are searched once.

Vectors hold whole numbers; scores are exact (one beyond 64 bits is the nearest 64-bit number).
Evenly spread vectors of many dimensions leave no interval out; then each query meets all rows, in
blocks.

Cases: rows with a null id, label, vector or component take no part; of rows that repeat an id the
one with the smallest label and vector stands; a shorter vector counts as filled up with zeros;
empty vectors score 0; ties go to the smaller id; an anchor without another row of its label,
or whose positives score under 0, gives no row; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import checkpoint, column

#: Rows in a chunk, segments of the whole table, pivots, queries that meet a chunk at a time.
CHUNK, MOST, PIVOTS, GROUP = 2048, 65_536, 256, 256
#: Segments that the first round's radius reaches, and how many times as many each further one does.
FIRST, GROWTH = 8, 32
#: Numbers that planning holds at a time.
CELLS = 1 << 22
#: Distances are taken for known up to this share of the longest.
SLACK = 1e-6
LEAST, LARGEST = -(1 << 63), (1 << 63) - 1


def usable(table: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, vec): one row of each id."""
    rows = table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), F.col(f"`{vec_col}`").cast("array<bigint>").alias("vec"))
    whole = rows.where("id is not null and label is not null and vec is not null and not exists(vec, x -> x is null)")
    return whole.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """Inner products of all rows of a and b, whose components are at most ``top``: exact, cut at 64 bits."""
    bound = a.shape[1] * top * top
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, LARGEST).astype(np.int64)


class Space:
    """What every task needs to know of the vectors: their length, the longest's square, the pivots, the segments."""

    def __init__(self, dim: int, top: int, square: float):
        self.dim, self.top, self.square = dim, top, square
        self.kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
        self.pivots = np.zeros((0, dim), np.int64)
        self.segment, self.pivot, self.low, self.high = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def opened(self, blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, self.kind).reshape(-1, self.dim) if self.dim else np.zeros((len(blob), 0), np.int64)

    def packed(self, x: np.ndarray) -> bytes:
        return x.astype(self.kind).tobytes() if self.dim else bytes(len(x))  # a vector without components still counts

    def apart(self, x: np.ndarray, rows: bool) -> np.ndarray:
        """Distances of rows, or of queries (whose further component is 0), to all pivots."""
        x, p = x.astype(np.float64), self.pivots.astype(np.float64)
        xx, pp = (x * x).sum(1), (p * p).sum(1)
        more = lambda s: np.sqrt(np.maximum(self.square - s, 0))
        gap = (more(xx)[:, None] - more(pp)) ** 2 if rows else (more(pp) ** 2)[None, :]
        return np.sqrt(np.maximum(xx[:, None] + pp - 2 * x @ p.T, 0) + gap)

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from each query a row with this score lies, or a little more."""
        x = x.astype(np.float64)
        most = (x * x).sum(1) + self.square
        return np.sqrt(np.maximum(most - 2 * score.astype(np.float64), 0)) + SLACK * np.sqrt(most)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and segment how far the segment's keys are from the query's at least, and at most."""
        at = self.apart(x, False)[:, self.pivot]
        return np.maximum(np.maximum(self.low - at, at - self.high), 0), np.maximum(np.abs(at - self.low), np.abs(at - self.high))


class Index:
    """The rows (id, label, vec) of ``usable`` for searches of at most k hits."""

    def __init__(self, rows: DataFrame, k: int):
        self.spark, self.k = rows.sparkSession, k
        # equal vectors of a label score alike: only the smallest ids of them can be among the first k
        place = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
        kept = checkpoint(rows.withColumn("_n", place).where(F.col("_n") <= k).drop("_n"))
        square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        top = F.greatest(F.abs(F.array_max("vec").cast("decimal(20,0)")), F.abs(F.array_min("vec").cast("decimal(20,0)")))
        n, dim, most, longest = kept.agg(F.count("*"), F.max(F.size("vec")), F.max(top), F.max(square)).first()
        self.space = space = Space(dim or 0, int(most or 0), longest or 0.0)
        pivots = kept.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, int(n**0.5 / 8)))).select("vec").toArrow()["vec"]
        space.pivots = matrix(pivots.combine_chunks(), space.dim) if n else space.pivots
        per = max(CHUNK, -(-n // MOST))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(column(b, "vec"), space.dim)
                    far = space.apart(x, True)
                    at = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(far[np.arange(len(at)), at]), column(b, "id"), column(b, "label"), pa.array([space.packed(v[None, :]) for v in x], pa.binary())], names=["pivot", "key", "id", "label", "vec"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segment, held, last = TaskContext.get().partitionId() << 32, 0, None
            for b in batches:
                pivot = column(b, "pivot").to_numpy()
                begins = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]])) if b.num_rows else []
                for x, y in zip(begins, [*begins[1:], b.num_rows], strict=True):
                    for a in range(x, y, CHUNK):
                        part = b.slice(a, min(CHUNK, y - a))
                        if held >= per or last not in (None, pivot[a]):
                            segment, held = segment + 1, 0
                        held, last = held + part.num_rows, pivot[a]
                        key = column(part, "key").to_numpy()
                        blobs = [key.tobytes(), *(column(part, c).to_numpy().tobytes() for c in ("id", "label")), b"".join(column(part, "vec").to_pylist())]
                        yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([int(last)], pa.int32()), pa.array([key[0]]), pa.array([key[-1]]), *(pa.array([x], pa.binary()) for x in blobs)], names=["segment", "pivot", "low", "high", "keys", "ids", "labels", "vecs"])

        ordered = kept.mapInArrow(keyed, "pivot int, key double, id bigint, label bigint, vec binary").repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id")
        self.chunks = checkpoint(ordered.mapInArrow(cut, "segment bigint, pivot int, low double, high double, keys binary, ids binary, labels binary, vecs binary"))
        found = self.chunks.groupBy("segment").agg(F.min("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        space.segment, space.pivot, space.low, space.high = (found[c].to_numpy() for c in ("segment", "pivot", "low", "high"))
        self.shared = self.spark.sparkContext.broadcast(space)

    def search(self, queries: DataFrame, same: bool) -> DataFrame:
        """(slot, rank, id, score): for each of ``queries`` (slot, label, vec array, low, high) its first k rows, of its own label or of others, with scores from low to high (null: any)."""
        shared, k = self.shared, self.k

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    space = shared.value
                    x = matrix(column(b, "vec"), space.dim)
                    far = space.apart(x, False)
                    # queries that look for the same segments stand together
                    b = b.set_column(b.schema.get_field_index("place"), "place", pa.array(far.argmin(1) + far.min(1) / (1 + far.min(1))))
                    yield b.set_column(b.schema.get_field_index("vec"), "vec", pa.array([space.packed(v[None, :]) for v in x], pa.binary()))

        def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space = shared.value
            for x in parts(batches, space):
                score = np.maximum(column(x, "low").to_numpy(), column(x, "kth").to_numpy())
                vec = space.opened(b"".join(column(x, "vec").to_pylist()))
                radius = np.where(score == LEAST, np.inf, space.radius(vec, score))
                if reach < len(space.segment):
                    radius = np.minimum(radius, np.partition(space.bounds(vec)[0], reach, axis=1)[:, reach])
                yield x.set_column(x.schema.get_field_index("radius"), "radius", pa.array(np.maximum(radius, column(x, "done").to_numpy())))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space = shared.value
            for x in parts(batches, space):
                vecs, at = np.unique(np.array(column(x, "vec").to_pylist(), dtype=object), return_inverse=True)
                every = space.opened(b"".join(vecs))
                least, most = (y[at] for y in space.bounds(every))
                radius, done = column(x, "radius").to_numpy(), column(x, "done").to_numpy()
                wanted = (least <= radius[:, None]) & (most > done[:, None])
                low = np.maximum(column(x, "low").to_numpy(), column(x, "kth").to_numpy())
                for s in np.flatnonzero(wanted.any(0)):
                    own = np.flatnonzero(wanted[:, s])
                    some, place = np.unique(at[own], return_inverse=True)
                    blobs = [*(column(x, c).to_numpy()[own] for c in ("slot", "label")), low[own], column(x, "high").to_numpy()[own], done[own], radius[own], place.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([space.segment[s]]), *(pa.array([y.tobytes()], pa.binary()) for y in blobs), pa.array([space.packed(every[some])], pa.binary())], names=["segment", *QUERY])

        def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space = shared.value
            for b in batches:
                for r in b.to_pylist():
                    slot, label, low, high, done, radius, at = (np.frombuffer(r[c], kind) for c, kind in QUERY.items() if kind)
                    x, q = space.opened(r["vecs"]), space.opened(r["asking"])
                    key, ids, labels = np.frombuffer(r["keys"], "<f8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
                    gap = np.abs(space.apart(q, False)[at, r["pivot"]][:, None] - key)
                    score = products(q, x, space.top)[at]
                    alike = labels == label[:, None]
                    may = (gap <= radius[:, None]) & (gap > done[:, None]) & (alike if same else ~alike) & (score >= low[:, None]) & (score <= high[:, None])
                    if may.shape[1] > k:
                        of = np.where(may, score, LEAST)
                        may &= score >= np.partition(of, -k, axis=1)[:, -k][:, None]
                    i, j = np.nonzero(may)
                    order = np.lexsort([ids[j], ~score[i, j], i])
                    i, j = i[order], j[order]
                    firsts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
                    keep = np.arange(len(i)) - np.repeat(firsts, np.diff(np.append(firsts, len(i)))) < k
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(slot[i]), pa.array(ids[j]), pa.array(score[i, j])], names=["slot", "id", "score"])

        schema = "slot bigint, label bigint, vec binary, low bigint, high bigint, done double, radius double, kth bigint, place double"
        begun = queries.select("slot", "label", "vec", F.coalesce("low", F.lit(LEAST)).alias("low"), F.coalesce("high", F.lit(LARGEST)).alias("high"), F.lit(-1.0).alias("done"), F.lit(-1.0).alias("radius"), F.lit(LEAST).alias("kth"), F.lit(0.0).alias("place"))
        slots = begun.mapInArrow(packed, schema).sort("place", "vec", "slot")
        found, reach = None, FIRST
        place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
        while True:
            plan = checkpoint(slots.mapInArrow(planned, schema).where("radius > done"))
            if plan.isEmpty():
                break
            met = plan.mapInArrow(asked, "segment bigint, " + ", ".join(f"{c} binary" for c in QUERY)).join(self.chunks.select("segment", "pivot", "keys", "ids", "labels", "vecs"), "segment")
            hits = met.mapInArrow(looked, "slot bigint, id bigint, score bigint")
            hits = hits if found is None else hits.unionByName(found.drop("rank"))
            found = checkpoint(hits.withColumn("rank", place).where(F.col("rank") <= k))
            if reach >= len(self.space.segment):
                break
            kth = found.where(F.col("rank") == k).select("slot", F.col("score").alias("_kth"))
            slots = plan.join(kth, "slot", "left").withColumns({"done": F.col("radius"), "kth": F.coalesce("_kth", "kth")}).select(*slots.columns).sort("place", "vec", "slot")
            reach *= GROWTH
        if found is None:
            found = self.spark.createDataFrame([], "slot bigint, id bigint, score bigint, rank int")
        return found


#: What a group of queries carries to a segment, and as what numbers.
QUERY = {"slot": "<i8", "label_": "<i8", "low": "<i8", "high": "<i8", "done": "<f8", "radius": "<f8", "at": "<i8", "asking": ""}


def parts(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """Batches of so many queries that their bounds to all segments fit."""
    most = max(1, min(GROUP, CELLS // max(1, len(space.segment))))
    for b in batches:
        for start in range(0, b.num_rows, most):
            yield b.slice(start, most)


def mined(table: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "vec") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row with ``anchors`` (SQL over id, label, vec) and each of its first positives, other rows of its label, the first negatives, rows of other labels that score from ``least`` to ``most`` percent of the positive."""
    rows = checkpoint(usable(table, id_col, label_col, vec_col))
    chosen = rows.where(anchors)
    distinct = checkpoint(chosen.groupBy("label", "vec").agg(F.min("id").alias("slot")))
    index = Index(rows, max(positives + 1, negatives))
    own = index.search(distinct.withColumns({"low": F.lit(None).cast("bigint"), "high": F.lit(None).cast("bigint")}), True).where(F.col("rank") <= positives + 1)
    asking = chosen.join(distinct, ["label", "vec"]).select(F.col("id").alias("anchor_id"), "slot")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    pairs = asking.join(own.select("slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "slot").where("positive_id <> anchor_id")
    pairs = checkpoint(pairs.withColumn("_n", place).where(F.col("_n") <= positives).drop("_n"))
    # positives of one score share their negatives
    scores = pairs.where("positive_score >= 0").select("slot", "positive_score").distinct()
    p = F.col("positive_score").cast("decimal(20,0)")
    bounds = scores.withColumns({"low": F.ceil(p * least / 100).cast("bigint"), "high": F.floor(p * most / 100).cast("bigint")}).where("low <= high")
    wanted = checkpoint(bounds.withColumnRenamed("slot", "first").join(distinct.withColumnRenamed("slot", "first"), "first").withColumn("slot", F.monotonically_increasing_id()))
    other = index.search(wanted.select("slot", "label", "vec", "low", "high"), False).where(F.col("rank") <= negatives)
    told = wanted.select("slot", "first", "positive_score").join(other, "slot").select(F.col("first").alias("slot"), "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(told, ["slot", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
