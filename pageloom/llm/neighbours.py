"""Approximate nearest neighbours by largest cosine: NN-descent and greedy graph search.

Index: equal vectors become one node, named by a hash of the vector; its few smallest ids are
kept for answers. A tree over a bounded sample deals nodes to parts of about ``PART`` rows, so
that near ones mostly share a part; each node is also a guest of the next part. Blocks within
a part give first neighbours. Then each round is two joins on the part: a part asks the others
for the neighbours of its nodes' neighbours, both ways, and every node keeps the closest of
all it meets (``nngraph.merge``); only steps that are new since the last round are taken.
Replies name nodes without their vectors; what a part doesn't hold of these it fetches from their
parts, in single precision and once, however many replies name it. Parts and replies are kept in
tables bucketed by part, in the shared checkpoint folder, so parts are never shuffled themselves.

Search: a query goes to the two parts that the tree names, and there to the leaves of a finer
tree; from these it follows the graph greedily, within a part until its beam holds nothing to
expand, then on to the parts where the rest of the beam lives. All nodes of the beam are
scored on the original vectors in double precision. A query needn't be a row of the table. More
answers than ``answers``, of which each node keeps ids, are refused.

Every row is indexed and every query answered; sizes of lists, beams and rounds are
parameters. Vectors of different lengths have no cosine: each length has a graph of its own.
Cases: vectors that are null, empty, zero, or hold null or non-finite numbers take no part,
neither as query nor as candidate; null ids neither; rows that repeat an id and vector count
once; an id with several vectors is a query with each, and an answer once, by its closest;
a query's own id is no answer; ties go to the smaller id, and vectors that differ by as little
as single precision can tell in their difference are told apart; other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import nngraph as G
from .batches import checkpoint, column, delete, use_checkpoint_dir

#: Neighbours of a node, those that list it and join a round, rounds at most, and the share of changed neighbours below which they end.
DEGREE, LISTERS, ROUNDS, STILL = 16, 8, 4, 0.1
#: Nodes of a part, about, and vectors that its tree is fitted on at most.
PART, SAMPLE = 32_768, 65_536
#: Nodes that a query keeps, expands at a time, and times that it moves on to other parts.
BEAM, WIDTH, HOPS = 200, 8, 8
#: Queries of a group, and shares that the answers of equal queries are dealt in.
GROUP, SALTS = 512, 8

PART_COLUMNS = {"ids": "<i8", "vec": "<f4", "near": "<i8", "nearp": "<i4", "sims": "<f4", "fresh": "?", "hid": "<i8", "hpart": "<i4", "hvec": "<f4"}
ASK = {"vids": "<i8", "vvec": "<f4", "v": "<i4", "m": "<i8", "watch": "<i8"}
ASK_IDS = {c: t for c, t in ASK.items() if c != "vvec"}
REPLY = {"m": "<i8", "count": "<i4", "e": "<i4", "uids": "<i8", "upart": "<i4"}
FETCHED = {"vids": "<i8", "vvec": "<f4"}
INDEX = {"ids": "<i8", "vec": "<f4", "links": "<i4", "hid": "<i8", "hpart": "<i4", "hvec": "<f4", "directions": "<f4", "cuts": "<f4", "leaf": "<i4"}
FOUND = {"ids": "<i8", "parts": "<i4", "sims": "<f4", "done": "?"}
#: What of a part its replies are made of.
REPLIES = ("ids", "near", "nearp", "fresh")


def shape(columns: dict[str, str], *first: str) -> str:
    return ", ".join([*first, *(f"{c} binary" for c in columns)])


def packed(kind: dict[str, str], arrays: G.Part) -> dict[str, bytes]:
    return {c: np.ascontiguousarray(arrays[c], dtype=t).tobytes() for c, t in kind.items()}


def rows_in(table: pa.Table) -> list[dict]:
    """The rows, their bytes as views of the table's."""
    columns = {c: table[c] for c in table.column_names}
    return [{c: x[i].as_buffer() if pa.types.is_binary(x.type) else x[i].as_py() for c, x in columns.items()} for i in range(table.num_rows)]


def opened(kind: dict[str, str], row: dict, widths: dict[str, int]) -> G.Part:
    """The arrays of a row; a column with a width is a matrix."""
    return {c: (x.reshape(-1, widths[c]) if c in widths else x) for c, t in kind.items() for x in [np.frombuffer(row[c], dtype=t)]}


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    rows = table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit_of(raw: np.ndarray) -> np.ndarray:
    """Scaled first, so that no square overflows or vanishes."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).astype(np.float32)


def hashes(raw: np.ndarray) -> np.ndarray:
    """A name for each vector, not negative; -0.0 and 0.0 are equal."""
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in raw + 0.0], dtype=np.int64)


class Index:
    """The neighbour graphs of a table's vectors, one for each length."""

    def __init__(self, table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", answers: int = 5, degree: int = DEGREE, rounds: int = ROUNDS, part: int = PART):
        rows = usable(table, id_col, vec_col)
        self.spark, self.answers, self.graphs = table.sparkSession, answers, {}
        found = rows.groupBy(F.size("v").alias("dim")).count().collect()  # one row for each length of vectors
        try:
            for r in sorted(found):
                self.graphs[r["dim"]] = graph = Graph(table.sparkSession, r["dim"], answers, degree, part)
                graph.build(rows.where(F.size("v") == r["dim"]), r["count"], rounds)
        except BaseException:
            self.close()
            raise

    def search(self, queries: DataFrame, k: int = 5, beam: int = BEAM, width: int = WIDTH, hops: int = HOPS, id_col: str = "id", vec_col: str = "v") -> DataFrame:
        """(query_id, rank, vec_id, score) for queries of any table; a query whose length no row has finds nothing."""
        if k > min(self.answers, beam):
            raise ValueError(f"an index of answers={self.answers}, searched with beam={beam}, has no {k} answers for every query")
        rows = usable(queries, id_col, vec_col)
        out = self.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        for dim, graph in self.graphs.items():
            out = out.unionByName(graph.search(rows.where(F.size("v") == dim), k, beam, width, hops))
        return out

    def close(self) -> None:
        """Drops the tables; results that aren't written yet are lost."""
        for graph in self.graphs.values():
            graph.close()


class Graph:
    def __init__(self, spark: SparkSession, dim: int, answers: int, degree: int, part: int):
        self.spark, self.dim, self.answers, self.degree, self.part = spark, dim, answers, degree, part
        self.name, self.tables, self.scored = f"neighbours_{uuid.uuid4().hex}", [], None
        use_checkpoint_dir(spark)
        self.folder = spark.sparkContext.getCheckpointDir()
        self.widths = {"vec": dim, "hvec": dim, "vvec": dim, "uvec": dim, "near": degree, "nearp": degree, "sims": degree, "fresh": degree, "links": degree + LISTERS, "directions": dim}

    def build(self, rows: DataFrame, n: int, rounds: int) -> None:
        """The graph of n rows, by rounds until little changes."""
        depth = max(0, int(np.ceil(np.log2(n / self.part)))) if n else 0
        self.buckets = 1 << depth
        self.keys = part_keys(self.spark, self.buckets)
        self.tree = G.grow(self.sample(rows, n, min(SAMPLE, max(4096, 64 << depth))), depth)
        begun = self.deal(rows, self.answers).groupBy("pid").applyInArrow(self.starter(self.answers), shape(PART_COLUMNS | {"raw": "", "counts": "", "members": ""}, "pid int", "changed bigint", "held bigint"))
        self.raw = state = self.saved(begun)
        for turn in range(rounds):
            told = self.saved(self.joined(state, self.asked(state, False), self.replier(turn), shape(REPLY, "pid int"), REPLIES).repartition(self.buckets, "pid"))
            wanted = self.joined(state, told, self.wanting, "pid int, frm int, vids binary", ["hid"])
            fetched = self.joined(state, wanted, self.fetching, shape(FETCHED, "pid int"), ["ids", "vec"])
            # parts and replies are bucketed alike, so only the vectors are shuffled
            whole = state.select("pid", *PART_COLUMNS).unionByName(told, allowMissingColumns=True)
            new = self.saved(whole.groupBy("pid").cogroup(fetched.groupBy("pid")).applyInArrow(self.merger(turn), shape(PART_COLUMNS, "pid int", "changed bigint", "held bigint")))
            self.drop(self.tables[-2])
            if turn:  # the first one has the original vectors
                self.drop(self.tables[-3])
            state = new
            changed, held = state.agg(F.sum("changed"), F.sum("held")).first()
            if not held or changed < STILL * held:
                break
        self.index = self.saved(self.joined(state, self.asked(state, True), self.finisher(), shape(INDEX, "pid int"), PART_COLUMNS))

    def sample(self, rows: DataFrame, n: int, most: int) -> np.ndarray:
        """A sample by hash, of at most twice so many rows."""
        share = min(1.0, most / max(n, 1)) * (1 << 30)
        got = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share).select("v").limit(2 * most).toArrow()["v"]
        return unit_of(matrix(got.combine_chunks(), self.dim)) if len(got) else np.zeros((0, self.dim), np.float32)

    def saved(self, df: DataFrame) -> DataFrame:
        """As a table bucketed by part: reading it needs no shuffle to meet messages to the parts."""
        name = f"{self.name}_{len(self.tables)}"
        df.write.bucketBy(self.buckets, "pid").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        delete(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        for name in self.tables:
            self.drop(name)

    def deal(self, rows: DataFrame, answers: int) -> DataFrame:
        """Each distinct vector of a batch to its part with its smallest ids, and without them to the next one as a guest."""
        dim, tree, keys = self.dim, self.tree, self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                raw, ids = matrix(column(b, "v"), dim) + 0.0, column(b, "id").to_numpy()
                named = hashes(raw)
                order = np.lexsort([ids, named])
                fresh = np.concatenate([[True], (named[order][1:] != named[order][:-1]) | (raw[order][1:] != raw[order][:-1]).any(axis=1)])
                first, end = np.flatnonzero(fresh), np.append(np.flatnonzero(fresh)[1:], len(order))
                members = [np.unique(ids[order[x:y]])[: answers + 1].astype("<i8").tobytes() for x, y in zip(first, end, strict=True)]
                raw, named = raw[order[first]], named[order[first]]
                unit = unit_of(raw)
                own, beside = (keys[x] for x in G.leaves(unit, tree))
                guest = np.flatnonzero(own != beside)
                none = [None] * len(guest)
                columns = [
                    np.concatenate([own, beside[guest]]).astype(np.int32), np.concatenate([own, own[guest]]).astype(np.int32), np.concatenate([named, named[guest]]),
                    pa.array([*(x.tobytes() for x in raw), *none], pa.binary()), pa.array([*([None] * len(own)), *(x.tobytes() for x in unit[guest])], pa.binary()), pa.array([*members, *none], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["pid", "home", "node", "raw", "vec", "members"])

        return rows.mapInArrow(run, "pid int, home int, node bigint, raw binary, vec binary, members binary")

    def starter(self, answers: int) -> Callable:
        dim, degree = self.dim, self.degree

        def run(key: tuple, table: pa.Table) -> pa.Table:
            pid = key[0].as_py()
            held = {"raw": [], "ids": [], "members": []}
            own = table.filter(pa.compute.is_valid(table["raw"])).sort_by([("node", "ascending"), ("raw", "ascending")])
            nodes, raws, lists = own["node"].to_numpy(), own["raw"].to_pylist(), own["members"].to_pylist()
            for node, raw, some in zip(nodes, raws, lists, strict=True):
                if held["raw"] and held["raw"][-1] == raw:
                    held["members"][-1].append(some)
                else:  # another vector of the same name takes the next free one
                    held["ids"].append(max(int(node), held["ids"][-1] + 1 if held["ids"] else 0))
                    held["raw"].append(raw)
                    held["members"].append([some])
            members = [np.unique(np.frombuffer(b"".join(x), "<i8"))[: answers + 1] for x in held["members"]]
            raw = np.frombuffer(b"".join(held["raw"]), "<f8").reshape(-1, dim)
            guests = table.filter(pa.compute.is_valid(table["vec"])).sort_by("node")
            gids, gpart, gvec = G.once(guests["node"].to_numpy(), guests["home"].to_numpy(), np.frombuffer(b"".join(guests["vec"].to_pylist()), "<f4").reshape(-1, dim))
            vec = unit_of(raw) if len(raw) else np.zeros((0, dim), np.float32)
            part = G.begin(np.array(held["ids"], np.int64), vec, pid, gids, gpart, gvec, degree)
            row = packed(PART_COLUMNS, part) | {"raw": raw.tobytes(), "counts": np.array([len(x) for x in members], "<i4").tobytes(), "members": np.concatenate([np.zeros(0, "<i8"), *members]).astype("<i8").tobytes()}
            return rows_of([{"pid": pid, "changed": 0, "held": 0} | row], ["pid", "changed", "held"])

        return run

    def asked(self, state: DataFrame, every: bool) -> DataFrame:
        """(pid, frm, ...): the messages of each part to the others; with vectors for the last ones, of ``every`` edge."""
        kind, left_out = (ASK, ()) if every else (ASK_IDS, ("vec",))
        widths, need = self.widths, [c for c in PART_COLUMNS if c not in ("sims", "hid", "hpart", "hvec", *left_out)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in rows_in(pa.Table.from_batches([b])):
                    part = opened({c: PART_COLUMNS[c] for c in need}, r, widths)
                    out = [{"pid": q, "frm": r["pid"]} | packed(kind, x) for q, x in G.asks(part, r["pid"], every, every).items()]
                    yield from rows_of(out, ["pid", "frm"], kind).to_batches()

        return state.select("pid", *need).mapInArrow(run, shape(kind, "pid int", "frm int"))

    def joined(self, state: DataFrame, messages: DataFrame, run: Callable, result: str, need: Iterable[str]) -> DataFrame:
        """Each part, these columns of it, with the messages to it; only the messages are shuffled."""
        names = [c.split()[0] for c in result.split(", ")]

        def one(own: pa.Table, sent: pa.Table) -> pa.Table:
            out = [x for r in rows_in(own) for x in run(r, rows_in(sent))]
            return rows_of(out, [n for n, c in zip(names, result.split(", "), strict=True) if not c.endswith("binary")], [n for n, c in zip(names, result.split(", "), strict=True) if c.endswith("binary")])

        return state.select("pid", *need).groupBy("pid").cogroup(messages.groupBy("pid")).applyInArrow(one, result)

    def replier(self, turn: int) -> Callable:
        widths = self.widths

        def run(r: dict, sent: list[dict]) -> list[dict]:
            letters = [(x["frm"], opened(ASK_IDS, x, widths)) for x in sorted(sent, key=lambda x: x["frm"])]
            part = opened({c: PART_COLUMNS[c] for c in REPLIES}, r, widths)
            return [{"pid": q} | packed(REPLY, x) for q, x in G.replies(part, r["pid"], letters, LISTERS, turn, False).items()]

        return run

    @staticmethod
    def wanting(r: dict, sent: list[dict]) -> list[dict]:
        letters = [opened({c: REPLY[c] for c in ("uids", "upart")}, x, {}) for x in sent]
        return [{"pid": q, "frm": r["pid"], "vids": ids.tobytes()} for q, ids in G.wants(np.frombuffer(r["hid"], "<i8"), r["pid"], letters).items()]

    @property
    def fetching(self) -> Callable:
        dim = self.dim

        def run(r: dict, sent: list[dict]) -> list[dict]:
            ids, vec = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vec"], "<f4").reshape(-1, dim)
            return [{"pid": x["frm"], "vids": bytes(x["vids"]), "vvec": vec[G.place_of(ids, np.frombuffer(x["vids"], "<i8"))].tobytes()} for x in sent]

        return run

    def merger(self, turn: int) -> Callable:
        widths = self.widths

        def run(own: pa.Table, sent: pa.Table) -> pa.Table:
            rows = rows_in(own)
            fetched = [(x["vids"], x["vvec"]) for x in (opened(FETCHED, y, widths) for y in rows_in(sent))]
            letters = [opened(REPLY, x, widths) for x in rows if x["ids"] is None]
            out = []
            for r in rows:
                if r["ids"] is not None:  # a part, once
                    part = G.merge(opened(PART_COLUMNS, r, widths), r["pid"], letters, LISTERS, turn, fetched)
                    out.append({"pid": r["pid"], "changed": int(part["fresh"].sum()), "held": int((part["near"] >= 0).sum())} | packed(PART_COLUMNS, part))
            return rows_of(out, ["pid", "changed", "held"], PART_COLUMNS)

        return run

    def finisher(self) -> Callable:
        widths = self.widths

        def run(r: dict, sent: list[dict]) -> list[dict]:
            letters = [(x["frm"], opened(ASK, x, widths)) for x in sorted(sent, key=lambda x: x["frm"])]
            return [{"pid": r["pid"]} | packed(INDEX, G.finished(opened(PART_COLUMNS, r, widths), r["pid"], letters, LISTERS))]

        return run

    def search(self, queries: DataFrame, k: int, beam: int, width: int, hops: int) -> DataFrame:
        """(query_id, rank, vec_id, score) for queries (id, v). ``scored`` is then a table of (q, scored): how many nodes each query was compared with."""
        dim, tree, keys, widths = self.dim, self.tree, self.keys, self.widths

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    raw = matrix(column(b, "v"), dim) + 0.0
                    own, beside = (keys[x].astype(np.int32) for x in G.leaves(unit_of(raw), tree))
                    yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(hashes(raw)), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array([np.unique(x).tolist() for x in np.stack([own, beside], axis=1)], pa.list_(pa.int32()))], names=["id", "q", "raw", "pids"])

        asked = checkpoint(queries.mapInArrow(name, "id bigint, q bigint, raw binary, pids array<int>"))
        one = asked.groupBy("q").agg(F.min(F.struct("raw", "pids")).alias("x")).select("q", "x.*")
        groups = max(1, -(-asked.select("q").distinct().count() // GROUP))
        empty = {c: F.lit(b"").alias(c) for c in FOUND}
        state = checkpoint(one.select(F.pmod("q", F.lit(groups)).cast("int").alias("g"), "q", "raw", F.lit(0).cast("bigint").alias("scored"), *empty.values()))
        asks = one.select(F.explode("pids").alias("pid"), "q", "raw", F.lit(b"").alias("ids"), F.lit(b"").alias("done"))

        def look(own: pa.Table, sent: pa.Table) -> pa.Table:
            out, letters = [], sent.to_pylist()
            for r in own.to_pylist():
                if letters:
                    unit = unit_of(np.frombuffer(b"".join(x["raw"] for x in letters), "<f8").reshape(-1, dim))
                    seeds = [(np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["done"], "?")) for x in letters]
                    for x, (ids, parts, sims, done, scored) in zip(letters, G.explore(opened(INDEX, r, widths), r["pid"], unit, seeds, beam, width), strict=True):
                        out.append({"g": x["q"] % groups, "q": x["q"], "scored": scored} | packed(FOUND, {"ids": ids, "parts": parts, "sims": sims, "done": done}))
            return rows_of(out, ["g", "q", "scored"], FOUND, ("q", "scored"))

        def gather(own: pa.Table, sent: pa.Table) -> pa.Table:
            out, told = [], {}
            for x in sent.to_pylist():
                told.setdefault(x["q"], []).append(x)
            for r in own.to_pylist():
                found = [opened(FOUND, x, {}) for x in [r, *told.get(r["q"], ())]]
                ids, parts, sims, done = (np.concatenate([x[c] for x in found]) for c in FOUND)
                order = np.lexsort([~done, ids])  # what has been expanded anywhere is
                ids, parts, sims, done = ids[order], parts[order], sims[order], done[order]
                ids, parts, sims, done = G.once(ids, parts, sims, done)
                order = np.lexsort([ids, -sims])[:beam]
                out.append({"g": r["g"], "q": r["q"], "raw": r["raw"], "scored": r["scored"] + sum(x["scored"] for x in told.get(r["q"], ()))} | packed(FOUND, {"ids": ids[order], "parts": parts[order], "sims": sims[order], "done": done[order]}))
            return rows_of(out, ["g", "q", "scored"], ["raw", *FOUND], ("q", "scored"))

        def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    x = opened(FOUND, r, {})
                    for p in np.unique(x["parts"][~x["done"]]):
                        mine = x["parts"] == p
                        out.append({"pid": int(p), "q": r["q"], "raw": r["raw"], "ids": x["ids"][mine].tobytes(), "done": x["done"][mine].tobytes()})
                yield from rows_of(out, ["pid", "q"], ["raw", "ids", "done"], ("q",)).to_batches()

        index = self.index.groupBy("pid")
        for hop in range(hops):
            found = index.cogroup(asks.groupBy("pid")).applyInArrow(look, shape(FOUND, "g int", "q bigint", "scored bigint"))
            state = checkpoint(state.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(gather, "g int, q bigint, scored bigint, raw binary, " + shape(FOUND)))
            if hop + 1 < hops:
                asks = checkpoint(state.mapInArrow(onward, "pid int, q bigint, raw binary, ids binary, done binary"))
                if asks.isEmpty():
                    break
        self.scored = state.select("q", "scored")

        def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    x = opened(FOUND, r, {})
                    ids, parts = x["ids"], x["parts"]
                    out += [{"pid": int(p), "q": r["q"], "raw": r["raw"], "ids": ids[parts == p].tobytes()} for p in np.unique(parts)]
                yield from rows_of(out, ["pid", "q"], ["raw", "ids"], ("q",)).to_batches()

        def measure(own: pa.Table, sent: pa.Table) -> pa.Table:
            q, vec_id, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for r in own.to_pylist():
                ids, counts, members = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["counts"], "<i4").astype(np.int64), np.frombuffer(r["members"], "<i8")
                raw, begins = np.frombuffer(r["raw"], "<f8").reshape(-1, dim), np.cumsum(counts) - counts
                for x in sent.to_pylist():
                    at = G.place_of(ids, np.frombuffer(x["ids"], "<i8"))
                    at = at[at >= 0]
                    n = counts[at]
                    vec_id.append(members[G.ranges(begins[at], n)])
                    score.append(np.repeat(cosines(np.frombuffer(x["raw"], "<f8"), raw[at]), n))
                    q.append(np.full(n.sum(), x["q"]))
            return pa.table({"q": np.concatenate(q), "vec_id": np.concatenate(vec_id), "score": np.concatenate(score)})

        last = state.mapInArrow(closest, "pid int, q bigint, raw binary, ids binary")
        hits = self.raw.select("pid", "ids", "raw", "counts", "members").groupBy("pid").cogroup(last.groupBy("pid")).applyInArrow(measure, "q bigint, vec_id bigint, score double")
        # many queries may share a vector: its answers go out in several shares
        dealt = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = asked.select(F.col("id").alias("query_id"), "q", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).distinct()
        met = mine.join(dealt, ["q", "salt"]).where("vec_id <> query_id").groupBy("query_id", "q", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
        return checkpoint(met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def cosines(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """In double precision; scaled by powers of two first where squares would overflow or vanish."""
    scale = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])
    u, w = scale(u), scale(w)
    return (w * u).sum(axis=1) / (np.sqrt((w * w).sum(axis=1)) * np.sqrt((u * u).sum()))


def part_keys(spark: SparkSession, buckets: int) -> np.ndarray:
    """A number for each part, such that every bucket of a table holds one of them."""
    tries = spark.range(buckets * 24 + 64).select(F.col("id").cast("int").alias("key")).select("key", F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket"))
    found = tries.groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").toArrow()["key"].to_numpy()
    return found if len(found) == buckets else np.arange(buckets)


def rows_of(rows: list[dict], numbers: list[str], blobs: dict | list = (), wide: tuple[str, ...] = ("changed", "held")) -> pa.Table:
    """A table of rows with 32-bit numbers (64 for ``wide``) and bytes."""
    names = [*numbers, *(blobs if blobs else [c for c in (rows[0] if rows else ()) if c not in numbers])]
    kinds = [(pa.int64() if c in wide else pa.int32()) if c in numbers else pa.binary() for c in names]
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)], schema=pa.schema(list(zip(names, kinds, strict=True))))
