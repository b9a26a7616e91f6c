"""Near-duplicate groups: SimHash candidates in tiles, then exact Jaccard similarity of shingle sets.

Documents of equal shingle sets (by a 128-bit digest of the set) meet as one node. Fingerprints
of 256 bits over distinct five-word shingles find candidates: at a Jaccard similarity of 0.8
two fingerprints differ in at most 38 bits on average (48 for sets of 4 and 5 shingles;
standard deviation 6), unrelated ones in 128 (8). Pairs within ``RADIUS`` bits (``WIDE`` for
sets under so many shingles), of which ``FIRST`` may lie in the first half, and whose set sizes
allow the similarity are candidates; a pair at 0.8 lies beyond with a chance below 1 in 10^6
(``tests/llm`` counts none missed among all pairs of 10,000 documents).

Only texts that share a candidate component are compared again, exactly: all pairs within
chunks of a bounded number of texts, small components many to a task; then one text of each
group that a chunk has made, with those of the component's other chunks; and last, only for
components that are still in several groups, what these two steps have left open between the
texts outside the largest group and all others. So a large family of copies is read a few
times, not once for each of its chunks, and no link between texts is lost. A task reports a spanning
forest of the pairs it confirms. Groups are the components over confirmed pairs.

Cases: texts without words are equal to each other; null texts are empty; of rows with the
same smallest id in a group one stays, whatever else they hold; rows that repeat an id with
texts of different groups are judged each; rows with a null id are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import checkpoint, column, reclaim, steps, texts
from .simhash import STEP, components, fingerprints, forest, links, set_digest, shingle_hashes

WORDS, SIMILARITY, LANES, RADIUS, WIDE, FIRST = 5, 0.8, 4, 66, (8, 84), 46
#: Texts in a chunk of a large component, and in a task of small ones.
CHUNK, TASK = 192, 384
#: Ids of so few candidates are broadcast to the documents; more are joined by a shuffle.
MOST_BROADCAST = 500_000
FOREST = "a bigint, b bigint"


def confirmed(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row of a and a row of b (positions in sets) whose Jaccard similarity is reached."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(inverse, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    owner, inverse = owner[often[inverse]], number[inverse[often[inverse]]]
    shared = np.zeros((len(a), len(b)), dtype=np.float32)
    total = int(often.sum())
    place = np.argsort(inverse, kind="stable")
    owner, inverse = owner[place], inverse[place]
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[a], col[b] = np.arange(len(a)), np.arange(len(b))
    for start in range(0, total, 8192):
        x, y = np.searchsorted(inverse, start), np.searchsorted(inverse, start + 8192)
        o, v = owner[x:y], inverse[x:y] - start
        left, right = np.zeros((len(a), 8192), dtype=np.float32), np.zeros((len(b), 8192), dtype=np.float32)
        left[row[o[row[o] >= 0]], v[row[o] >= 0]] = 1
        right[col[o[col[o] >= 0]], v[col[o] >= 0]] = 1
        shared += left @ right.T
    either = sizes[a][:, None] + sizes[b][None, :] - shared
    i, j = np.nonzero(shared >= similarity * either - 1e-6)
    i, j = a[i], b[j]
    return i[i != j], j[i != j]


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, group) of every document with an id: the digest of its shingle set, and a number that the sets of a group share."""
    fps = checkpoint(fingerprints(docs.where(F.col(f"`{id_col}`").isNotNull()), words, LANES, True, id_col, text_col))
    sets = fps.groupBy("digest").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    nodes = checkpoint(sets.withColumn("node", F.monotonically_increasing_id()))
    found = components(links(nodes.select(F.col("node").alias("id"), "fp", "shingles"), RADIUS, LANES, FIRST, similarity, wide=WIDE))
    both = found.unionByName(found.select(F.col("component").alias("id"), "component")).distinct().withColumnRenamed("id", "node")
    candidates = checkpoint(both.join(nodes.select("node", "id", "digest"), "node"))
    del found, both
    reclaim(docs.sparkSession)
    pairs = checkpoint(verified(docs, candidates, words, similarity, id_col, text_col))
    reclaim(docs.sparkSession)
    made = components(pairs).select(F.col("id").alias("node"), "component")
    named = nodes.select("digest", "node").join(made, "node", "left").select("digest", F.coalesce("component", "node").alias("group"))
    return fps.select("id", "digest").join(named, "digest").select("id", "digest", "group")


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of every document with an id: the smallest id of its group."""
    rows = checkpoint(classes(docs, words, similarity, id_col, text_col))
    least = rows.groupBy("group").agg(F.min("id").alias("component"))
    return rows.join(least, "group").select("id", "component")


def shingle_sets(docs: DataFrame, candidates: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component, chunks, chunk, shingles): the set of each candidate (node, id, digest, component), from its text."""
    sized = candidates.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    named = checkpoint(candidates.join(sized, "component"))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    met = rows.join(F.broadcast(named) if named.count() <= MOST_BROADCAST else named, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP):
            sets = [np.unique(np.array(shingle_hashes(t, words), dtype=np.uint64)) for t in texts(b, "text")]
            # of rows that repeat an id only those with this very set
            own = pa.array([set_digest(s) == d for s, d in zip(sets, column(b, "digest").to_pylist(), strict=True)], pa.bool_())
            raw = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("node", "component", "chunks")), raw], names=["node", "component", "chunks", "shingles"]).filter(own)

    sets = met.mapInArrow(run, "node bigint, component bigint, chunks int, shingles binary").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    return checkpoint(sets)


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """A forest of the confirmed pairs between the sides of each task: rows (task, job, left, right, node, shingles), where each left row of a job meets each right one. A node that stands in a job twice counts once."""

    def check(table: pa.Table) -> pa.Table:
        nodes, job = table["node"].to_numpy(), table["job"].to_numpy()
        order = np.lexsort([nodes, job])
        order = order[np.concatenate([[True], (nodes[order][1:] != nodes[order][:-1]) | (job[order][1:] != job[order][:-1])])]
        table = table.take(pa.array(order))
        nodes, job = nodes[order], job[order]
        left, right = (table[c].to_numpy(zero_copy_only=False) for c in ("left", "right"))
        sets = [np.frombuffer(x, "<u8") for x in table["shingles"].to_pylist()]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(job)) + 1):
            i, j = confirmed([sets[k] for k in own], np.flatnonzero(left[own]), np.flatnonzero(right[own]), similarity)
            a.append(own[i])
            b.append(own[j])
        root = forest(len(nodes), np.concatenate(a), np.concatenate(b))
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": nodes[root[at]], "b": nodes[at]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.groupBy("task").applyInArrow(check, FOREST)


def meeting(rows: DataFrame, chunk: Column, chunks: Column, left: Column, right: Column) -> DataFrame:
    """Rows for ``compared``: within a component every two chunks meet in a task, the rows that are ``left`` with those that are ``right``."""
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    dealt = rows.withColumn("_chunk", chunk).withColumn("_left", left).withColumn("_right", right).withColumn("_other", other)
    low, high = F.least("_chunk", "_other"), F.greatest("_chunk", "_other")
    task = F.struct(F.col("component").alias("c"), low.alias("i"), high.alias("j"))
    return dealt.select(task.alias("task"), F.lit(0).cast("bigint").alias("job"), F.col("_left").alias("left"), F.col("_right").alias("right"), "node", "shingles")


def verified(docs: DataFrame, candidates: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b): a spanning forest of the confirmed pairs of nodes within the components of (node, id, digest, component)."""
    sets = shingle_sets(docs, candidates, words, id_col, text_col)
    tasks = max(1, -(-candidates.count() // TASK))
    yes = F.lit(True)
    small = F.struct(F.lit(-1).cast("bigint").alias("c"), F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("int").alias("i"), F.lit(0).alias("j"))
    large = F.struct(F.col("component").alias("c"), F.col("chunk").alias("i"), F.col("chunk").alias("j"))
    own = sets.select(F.when(F.col("chunks") > 1, large).otherwise(small).alias("task"), F.col("component").alias("job"), yes.alias("left"), yes.alias("right"), "node", "shingles")
    within = checkpoint(compared(own, similarity))
    spread = sets.where("chunks > 1")
    if spread.isEmpty():
        return within
    # one text of each group of a chunk, with those of the other chunks
    first = checkpoint(grouped(spread, within).groupBy("component", "chunk", "root").agg(F.min("node").alias("node")))
    counted = first.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    chosen = checkpoint(spread.select("node", "shingles").join(first.select("node", "component"), "node").join(counted, "component"))
    met = meeting(chosen, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("parts"), yes, yes)
    across = checkpoint(within.unionByName(compared(met, similarity)))
    # between what is outside a component's largest group and the rest, all but pairs of those that have met already
    named = checkpoint(grouped(spread, across).join(first.select("node", F.lit(True).alias("met")), "node", "left").withColumn("met", F.coalesce("met", F.lit(False))))
    sizes = named.groupBy("component", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("component").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    open_ = checkpoint(named.join(most, "component").select("node", "component", "chunk", "met", (F.col("root") != F.col("most")).alias("outside")))
    if open_.where("not met").isEmpty():
        return across
    chunks_with = lambda c: F.collect_set(F.when(c, F.col("chunk")))
    new, out = ~F.col("met"), F.col("outside")
    held = open_.groupBy("component").agg(chunks_with(new).alias("_new"), chunks_with(out).alias("_out"), chunks_with(new & out).alias("_both"))
    partners = F.when(new & out, F.sequence(F.lit(0), F.col("chunks") - 1)).when(out, F.col("_new")).when(new, F.col("_out")).otherwise(F.col("_both"))
    rest = spread.select("node", "chunks", "shingles").join(open_, "node").join(held, "component").withColumn("_other", F.explode(partners))
    task = F.struct(F.col("component").alias("c"), F.least("chunk", "_other").alias("i"), F.greatest("chunk", "_other").alias("j"))
    pairs = rest.where("chunk <> _other").select(task.alias("task"), F.lit(0).cast("bigint").alias("job"), out.alias("left"), yes.alias("right"), "node", "shingles")
    return across.unionByName(compared(pairs, similarity))


def grouped(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, component, chunk, root): the group that each node has come to over the pairs."""
    found = components(pairs).select(F.col("id").alias("node"), F.col("component").alias("root"))
    return sets.select("node", "component", "chunk").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def representatives(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each group: that of its smallest id. The texts themselves are shuffled only if too many ids go to be broadcast."""
    rows = checkpoint(classes(docs, id_col=id_col, text_col=text_col, words=words))
    least = rows.groupBy("group").agg(F.min(F.struct("id", "digest")).alias("least"))
    judged = rows.join(least, "group").withColumn("stays", F.struct("id", "digest") == F.col("least"))
    ids = checkpoint(judged.groupBy("id").agg(F.count_if("stays").alias("stay"), F.count("*").alias("n")))
    gone, again = ids.where("stay = 0").select("id"), ids.where("stay > 0 and n > 1").select("id")
    n_gone, n_again = ids.agg(F.count_if(F.col("stay") == 0), F.count_if((F.col("stay") > 0) & (F.col("n") > 1))).first()
    small = lambda x, n: F.broadcast(x) if n <= MOST_BROADCAST else x
    key = F.col(f"`{id_col}`")
    columns = [F.col(f"`{c}`") for c in keep]
    one = docs.join(small(gone.withColumnRenamed("id", "_gone"), n_gone), key == F.col("_gone"), "left_anti")
    if not n_again:
        return one.select(*columns)
    # rows that repeat an id: those of the chosen set, one of equal ones
    again = small(again.withColumnRenamed("id", "_again"), n_again)
    marked = checkpoint(one.join(again, key == F.col("_again"), "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    told = fingerprints(marked, words, 1, True, "_row", text_col).select(F.col("id").alias("_row"), "digest")
    stay = judged.where("stays").select(F.col("id").alias("_id"), "digest").distinct()
    first = marked.select("_row", key.alias("_id")).join(told, "_row").join(stay, ["_id", "digest"]).groupBy("_id", "digest").agg(F.min("_row").alias("_row"))
    return one.join(again, key == F.col("_again"), "left_anti").select(*columns).unionByName(marked.join(first.select("_row"), "_row", "left_semi").select(*columns))
