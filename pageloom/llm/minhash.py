"""Near-duplicate groups by one-permutation MinHash: banded buckets, star-shaped candidate edges, exact confirmation.

A document's set is its distinct runs of five words. One hash of each shingle fills a signature:
its value falls into one of ``BINS`` bins, and a bin keeps its least. An empty bin takes the value
of another one that isn't empty, drawn by a hash of the bin and the attempt alone, the same for
every document (optimal densification), so bins stay independent and two bins agree with the
chance of the sets' Jaccard similarity. ``BANDS`` runs of ``ROWS`` bins are the buckets' keys. In
a bucket each set is linked with the smallest one only, so a bucket of n sets makes n - 1 edges,
not n squared. A star may hang two like sets on a hub that is like neither; therefore the edges
say only who shares a component, and ``neardup.verified`` confirms on the full sets what is alike
within it: no link is lost that any bucket holds. At a similarity of 0.85 a pair shares no bucket
with a chance of 3 in 10^7, less above.

Cases: rows with equal sets meet as one node; a text without words (null or empty too) has no
shingle and is linked with nothing; fewer than five words are one shingle; long texts are hashed
whole, one at a time; of rows that repeat an id each is a node of its own, and a group's name is
its smallest id; a row with a null id takes no part (null component, kept); other columns are
not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import checkpoint, column, steps, texts
from .neardup import verified
from .simhash import STEP, components, mix, set_digest, shingle_hashes

WORDS, SIMILARITY = 5, 0.85
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Attempts that a densified bin draws at once.
DRAWS = 64
NO = np.uint64(0xFFFFFFFFFFFFFFFF)


def drawn(turn: int, bins: int) -> np.ndarray:
    """For each bin the bins that it asks, one after another, in the ``turn``-th lot."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(turn * DRAWS, (turn + 1) * DRAWS, dtype=np.uint64)
    return (mix(at, 5) >> np.uint64(17)) % np.uint64(bins)


def signatures(hashes: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` values for each run of hashes; a row of NO for an empty one."""
    out = np.full((len(sizes), bins), NO)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix(hashes, 3)
    place = owner * bins + (mixed >> np.uint64(40)).astype(np.int64) % bins
    order = np.lexsort([mixed, place])
    firsts = order[np.concatenate([[True], np.diff(place[order]) > 0])] if len(order) else order
    out.ravel()[place[firsts]] = mixed[firsts]
    full = out != NO
    open_ = ~full & (np.asarray(sizes) > 0)[:, None]
    turn = 0
    while open_.any():
        ask = drawn(turn, bins).astype(np.int64)
        row, bin_ = np.nonzero(open_)
        for k in range(0, len(row), 1 << 16):
            r, b = row[k : k + (1 << 16)], bin_[k : k + (1 << 16)]
            hit = full[r[:, None], ask[b]]
            first = hit.argmax(1)
            found = hit[np.arange(len(r)), first]
            r, b, first = r[found], b[found], first[found]
            out[r, b] = out[r, ask[b, first]]
            open_[r, b] = False
        turn += 1
    return out


def bucket_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Of each signature the key of each band."""
    key = np.zeros((len(signature), bands), dtype=np.uint64)
    own = signature.reshape(len(signature), bands, rows)
    for k in range(rows):
        key = mix(key ^ own[:, :, k], 7) + np.uint64(k)
    return mix(key + np.arange(bands, dtype=np.uint64), 11)


def sketched(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shingles, digest, keys): the size of the set, 128 bits that tell it, and its buckets (none for an empty set)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP):
            sets = [np.unique(np.array(shingle_hashes(t, words), dtype=np.uint64)) for t in texts(b, "text")]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            keys = bucket_keys(signatures(np.concatenate(sets), sizes))
            own = [k.view(np.int64) if n else [] for k, n in zip(keys, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(sizes), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["id", "shingles", "digest", "keys"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, shingles bigint, digest binary, keys array<bigint>")


def stars(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (node, keys): the smallest node of each bucket with each other one of it."""
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("key", "a")
    return buckets.join(hubs, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def near_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document: the smallest id that links of at least this similarity reach, and whether it is the document's own."""
    sketches = checkpoint(sketched(docs, words, id_col, text_col))
    taking = sketches.where("id is not null and shingles > 0")
    sets = taking.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    nodes = checkpoint(sets.withColumn("node", F.monotonically_increasing_id()))
    found = components(stars(nodes))
    both = found.unionByName(found.select(F.col("component").alias("id"), "component")).distinct().withColumnRenamed("id", "node")
    candidates = checkpoint(both.join(nodes.select("node", "id", "digest"), "node"))
    made = components(verified(docs, candidates, words, similarity, id_col, text_col)).select(F.col("id").alias("node"), "component")
    # a node's id is the smallest of its rows, so a group's smallest id is that of its nodes
    named = nodes.select("node", "digest", "id").join(made, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = named.groupBy("group").agg(F.min("id").alias("least"))
    groups = named.join(least, "group").select("digest", "least")
    out = taking.join(groups, "digest").select("id", "shingles", F.col("least").alias("component"))
    rest = sketches.where("id is null or shingles = 0").select("id", "shingles", F.col("id").alias("component"))
    all_ = out.unionByName(rest)
    return all_.select(F.col("id").alias(id_col), F.col("shingles").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
