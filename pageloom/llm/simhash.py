"""SimHash fingerprints of whole texts, and the exact search for near ones in tiles.

Fingerprints are compared with numpy: exclusive-or, then bit counts, tile against tile.
Rows are dealt to cells by bounded keys (the bit counts of both halves of a fingerprint, or
the logarithm of a shingle set's size); cells farther apart than the radius (or the size
ratio) allow never meet. A cell is cut into tiles of a bounded number of rows, each pair of
tiles is one task's work, and within it blocks whose bit counts differ beyond the radius are
skipped. A task reports a spanning forest of the links it finds, never all pairs; the
components over these forests are those over all links.

Cases: equal fingerprints meet as one row with the smallest id; null and empty texts have
no words, and fingerprint zero; ids that are null take no part in links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import checkpoint, column, steps, texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints in a tile: one in so many of all, within these bounds (fewer, larger tiles for more rows: each is sent to each it must meet).
TILE_SHARE, TILE_LEAST, TILE_MOST = 128, 4096, 65536
#: Rows of a block within a tile, and columns that are compared with it at a time.
BLOCK, COLUMNS = 64, 8192
STEP = 1 << 20


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of so many words, joined by spaces; of the whole sequence where there are fewer."""
    found = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return []
    hashed = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [hashed(b" ".join(found), seed)]
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [hashed(joined[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def mix(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash made from a hash; the 0-th is itself."""
    if not k:
        return x
    x = (x ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits that are set in over half of it; zero for an empty run."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    pieces = -(-sizes // 255)  # so many hashes can be counted in a byte
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(firsts, pieces) + 255 * within
    begins = np.cumsum(pieces) - pieces
    bits = np.zeros((len(full), 64), dtype=bool)
    for k in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(k) & np.uint64(0x0101010101010101), cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begins, axis=0)
        bits[:, k::8] = counts * 2 > sizes[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, shingles): ``lanes`` numbers of 64 bits as bytes, and how many shingles they are of. ``distinct``: each shingle once, and ``digest``, 128 bits that tell the set of shingles."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP):
            each = [np.array(shingle_hashes(t, words), dtype=np.uint64) for t in texts(b, "text")]
            if distinct:
                each = [np.unique(x) for x in each]
            sizes = np.array([len(x) for x in each])
            joined = np.concatenate(each)
            fp = np.column_stack([majorities(mix(joined, k), sizes) for k in range(lanes)])
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(sizes, pa.int64()), *([pa.array([set_digest(x) for x in each], pa.binary())] if distinct else [])], names=["id", "fp", "shingles", *(["digest"] if distinct else [])])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, fp binary, shingles bigint" + (", digest binary" if distinct else "")
    return rows.mapInArrow(run, schema)


def set_digest(hashes: np.ndarray) -> bytes:
    """Of a set of shingles, sorted."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The component, as its smallest member, of each of n nodes linked by a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def bit_counts(fp: np.ndarray) -> np.ndarray:
    """Of each 16 bits of fingerprints."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16)).astype(np.int16)


def near(x: np.ndarray, y: np.ndarray, radius: int, first: int, same: bool, sx: np.ndarray | None = None, sy: np.ndarray | None = None, ratio: float = 0.0, wide: tuple[int, int] | None = None) -> np.ndarray:
    """Component of each row of tile x, then tile y (if it isn't x), over links of at most ``radius`` differing bits and a shingle-set size ratio of at least ``ratio``. ``first``: bits that the first half of the lanes may differ by. ``wide``: (n, bits), another radius, no smaller, for pairs with a set under n shingles."""
    n, off = len(x) + (0 if same else len(y)), 0 if same else len(x)
    cx, cy = bit_counts(x), bit_counts(y)
    bx, by = np.arange(0, len(x), BLOCK), np.arange(0, len(y), BLOCK)
    low_x, high_x = np.minimum.reduceat(cx, bx), np.maximum.reduceat(cx, bx)
    low_y, high_y = np.minimum.reduceat(cy, by), np.maximum.reduceat(cy, by)
    root = np.arange(n)
    for i, start in enumerate(bx):
        gap = np.maximum(np.maximum(low_x[i] - high_y, low_y - high_x[i]), 0).sum(1)
        met = np.flatnonzero(gap <= (wide[1] if wide else radius))
        if same:
            met = met[met >= i]
        if not len(met):
            continue
        cols = (by[met][:, None] + np.arange(BLOCK)).ravel()
        cols = cols[cols < len(y)]
        part = x[start : start + BLOCK]
        for k in range(0, len(cols), COLUMNS):
            some = cols[k : k + COLUMNS]
            own = root[start : start + len(part)]
            if (own == own[0]).all():  # what is one with the whole block already needs no look
                some = some[root[some + off] != own[0]]
            apart = np.bitwise_count(part[:, :1] ^ y[some, 0][None, :])
            for lane in range(1, x.shape[1] // 2):
                apart += np.bitwise_count(part[:, lane : lane + 1] ^ y[some, lane][None, :])
            r, c = np.nonzero(apart <= first)
            r, c = r + start, some[c]
            keep = r < c if same else np.ones(len(r), dtype=bool)
            if x.shape[1] > 1:
                most = np.where(np.minimum(sx[r], sy[c]) < wide[0], wide[1], radius) if wide else radius
                keep &= np.bitwise_count(x[r] ^ y[c]).sum(1, dtype=np.int64) <= most
            if ratio:
                keep &= np.minimum(sx[r], sy[c]) >= ratio * np.maximum(sx[r], sy[c]) - 1e-9
            r, c = r[keep], c[keep]
            if len(r):
                root = forest(n, np.concatenate([np.arange(n), r]), np.concatenate([root, c + off]))
    return root


def links(fps: DataFrame, radius: int, lanes: int = 1, first: int | None = None, ratio: float = 0.0, tile: int | None = None, wide: tuple[int, int] | None = None) -> DataFrame:
    """(a, b): a spanning forest over the distinct fingerprints (id, fp, shingles) of the links between them, as ids."""
    first = radius if first is None else min(first, radius)
    spark = fps.sparkSession
    if ratio:  # cells of sizes; only a cell and the next can hold the ratio
        cell = F.floor(F.log(F.greatest("shingles", F.lit(1))) / float(-np.log(ratio)) + 1e-9).cast("int")
        steps_to: list[int] = [0, 1]
    else:
        if lanes != 1 or radius > 15:
            raise ValueError("wider fingerprints and radii need a size ratio")
        high = F.bit_count(F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("bigint"))
        low = F.bit_count(F.conv(F.hex(F.substring("fp", 5, 4)), 16, 10).cast("bigint"))
        base = 64
        cell = (high * base + low).cast("int")
        steps_to = [a * base + b for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius and (a, b) >= (0, 0)]
    rows = fps.where(F.col("id").isNotNull()).withColumn("cell", cell)
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most 65 x 65 cells, or as many as sizes have logarithms
    tile = tile or min(max(sum(sizes.values()) // TILE_SHARE, TILE_LEAST), TILE_MOST)
    tiles_of = {c: -(-n // tile) for c, n in sizes.items()}
    shared = spark.sparkContext.broadcast(tiles_of)
    count = F.create_map(*[F.lit(x) for kv in tiles_of.items() for x in kv]) if tiles_of else F.create_map(F.lit(0), F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce(count[F.col("cell")], F.lit(1))).cast("int"))

    def tiles(key: tuple, table: pa.Table) -> pa.Table:
        c, p = key[0].as_py(), key[1].as_py()
        fp = np.frombuffer(b"".join(table["fp"].to_pylist()), dtype="<u8").reshape(-1, lanes)
        counts = bit_counts(fp)
        order = np.lexsort([*counts.T[::-1], counts.sum(1) // 4]) if not ratio else np.argsort(counts.sum(1), kind="stable")
        blob = fp[order].tobytes() + table["id"].to_numpy()[order].astype("<i8").tobytes() + table["shingles"].to_numpy()[order].astype("<i8").tobytes()
        out = [(c, p, c, p)]
        out += [(c, p, c, q) for q in range(p + 1, shared.value[c])] + [(c, q, c, p) for q in range(p)]
        for s in steps_to:
            if s:
                out += [(c, p, c + s, q) for q in range(shared.value.get(c + s, 0))]
                out += [(c - s, q, c, p) for q in range(shared.value.get(c - s, 0))]
        met = [{"c1": k[0], "p1": k[1], "c2": k[2], "p2": k[3], "left": (c, p) == k[:2]} for k in out]
        return pa.table({"met": [met], "blob": [blob]}, schema=tile_schema)

    key_type = pa.struct([("c1", pa.int32()), ("p1", pa.int32()), ("c2", pa.int32()), ("p2", pa.int32()), ("left", pa.bool_())])
    tile_schema = pa.schema([("met", pa.list_(key_type)), ("blob", pa.binary())])

    def open_(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(blob) // (8 * lanes + 16)
        return np.frombuffer(blob, "<u8", n * lanes).reshape(n, lanes), np.frombuffer(blob, "<i8", n, 8 * lanes * n), np.frombuffer(blob, "<i8", n, 8 * lanes * n + 8 * n)

    def pair(key: tuple, table: pa.Table) -> pa.Table:
        side = dict(zip(table["left"].to_pylist(), table["blob"].to_pylist(), strict=True))
        if len(side) < 2 and (key[0], key[1]) != (key[2], key[3]):  # a tile that got no row
            return link_schema.empty_table()
        x, ix, sx = open_(side[True])
        same = len(side) == 1
        y, iy, sy = (x, ix, sx) if same else open_(side[False])
        root = near(x, y, radius, first, same, sx, sy, ratio, wide)
        ids = ix if same else np.concatenate([ix, iy])
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": ids[root[at]], "b": ids[at]}, schema=link_schema)

    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    whole = rows.select("cell", "part", "id", "fp", "shingles").groupBy("cell", "part").applyInArrow(tiles, "met array<struct<c1:int,p1:int,c2:int,p2:int,left:boolean>>, blob binary")
    met = whole.select(F.explode("met").alias("m"), "blob").select("m.*", "blob")
    return met.groupBy("c1", "p1", "c2", "p2").applyInArrow(pair, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id that has a link; by rounds of large and small stars until nothing changes."""
    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())

    stars = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        stars = checkpoint(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        last, before = before, state(stars)
        if before == last:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every document: components over fingerprints that differ in at most ``radius`` of 64 bits."""
    fps = checkpoint(fingerprints(docs, words, 1, False, id_col, text_col))
    alone = fps.groupBy("fp").agg(F.min("id").alias("id"), F.lit(0).cast("bigint").alias("shingles"))
    found = components(links(alone, radius))
    named = alone.select("fp", F.col("id").alias("first")).join(found.withColumnRenamed("id", "first"), "first", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return fps.join(named, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.concat(*[F.substring(F.hex("fp"), 15 - 2 * i, 2) for i in range(8)])).alias("fingerprint"), "component_id")
