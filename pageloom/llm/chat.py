"""Quotation linking: conversations in reply order, without the quotes.

Each message's lines are split by their quote level (leading ``>``). Runs of lines of one
level are passages; passages are hashed in normalised form (lower case, single spaces).
A message's own text, each of its own paragraphs and each of its own lines are the places
where a quotation of it may come from. Quoted passages of every level are joined by hash,
first within their conversation, then, if they have ``FAR`` characters or more, anywhere, to
the earliest message that holds them and comes before. Both sides are reduced to one row per
hash before they meet. A message answers the hit of its shallowest level, there the one
within its conversation, there that of its first passage; all hits are returned.

A message without any hit answers the turn before it in its conversation, whatever numbers
lie between, if there is one. Threads are followed to their first message by pointer
doubling, and numbered in reply order: by depth, then conversation and turn.

Cases: null and empty texts quote nothing and stay empty; a quotation of no known message
is cut like any other, and the message answers the turn before it; passages without a letter
or digit link nothing; rows with a null conversation or turn are threads of their own, at
position 0; repeated (conv, turn) rows are kept, answer the same message and share a
position; a passage in several messages counts as its earliest one's (smallest turn within
the conversation; else smallest conversation, then turn); other columns are left out,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered, previous
from .batches import checkpoint, column, steps, texts

#: Characters that a passage must have to be looked for in other conversations.
FAR = 24
MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
INTRO = re.compile(r"(?:^|\n)[^\n]*\b(?:wrote|schrieb|escribió|a écrit)[ \t]*:[ \t]*$")


def levels(text: str) -> list[tuple[int, str]]:
    """The runs of lines of one quote level, marks removed; a blank line goes on with its level."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        level = m[1].count(">") if m else 0
        rest = line[m.end() :] if m else line
        if not m and not line.strip() and runs and runs[-1][0] == 0:
            level = 0
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    return [(level, "\n".join(x)) for level, x in runs]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def parts(text: str) -> dict[int, bool]:
    """The hashes of a text, of its paragraphs and of its lines, the whole first; whether each is long enough to be told anywhere."""
    found: dict[int, bool] = {}
    for x in [text, *re.split(r"\n\s*\n", text), *text.split("\n")]:
        plain = normal(x)
        if any(map(str.isalnum, plain)):
            found.setdefault(xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63), len(plain) >= FAR)
    return found


def parse(text: str) -> tuple[str, list[tuple[int, str]], dict[int, bool]]:
    """The text without quotes; its passages (level, text); the hashes of its own parts."""
    own: list[str] = []
    quoted = []
    for level, passage in levels(text):
        if not level:
            own.append(passage)
            continue
        if own:
            own[-1] = INTRO.sub("", own[-1])
        quoted.append((level, passage))
    plain = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if quoted else text
    return plain, quoted, parts(plain)


LOOKED, OWN = "array<struct<hash:bigint,level:int,pos:int>>", "array<struct<hash:bigint,far:boolean>>"


def parsed_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text without quotes, n_quotes, looked, own)."""
    rows = turns.select(F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    looked_type = pa.list_(pa.struct([("hash", pa.int64()), ("level", pa.int32()), ("pos", pa.int32())]))
    own_type = pa.list_(pa.struct([("hash", pa.int64()), ("far", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            found = [parse(t) for t in texts(b, "text")]
            given = column(b, "text").to_pylist()
            looked = [[{"hash": h, "level": level, "pos": k} for k, (level, passage) in enumerate(quoted) for h in parts(passage)] for _, quoted, _ in found]
            own = [[{"hash": h, "far": far} for h, far in x.items()] for _, _, x in found]
            plain = [None if g is None else f[0] for f, g in zip(found, given, strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "conv"), column(b, "turn"), column(b, "role"), pa.array(plain, pa.string()), pa.array([len(f[1]) for f in found], pa.int32()), pa.array(looked, looked_type), pa.array(own, own_type)], names=["conv", "turn", "role", "text", "n_quotes", "looked", "own"])

    return rows.mapInArrow(run, f"conv bigint, turn bigint, role string, text string, n_quotes int, looked {LOOKED}, own {OWN}")


def hits(placed: DataFrame) -> DataFrame:
    """(conv, turn, level, far, pos, c, t): for each quoted passage the earliest message before that holds it."""
    quotes = placed.where("size(looked) > 0").select("conv", "turn", F.explode("looked").alias("q")).select("conv", "turn", "q.*").distinct()
    wanted = quotes.select("hash").distinct()
    sources = placed.select("conv", "turn", F.explode("own").alias("o")).select("conv", "turn", "o.*").join(wanted, "hash", "left_semi")
    within = sources.groupBy("conv", "hash").agg(F.min("turn").alias("first"))
    anywhere = sources.where("far").groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("any"))
    met = quotes.join(within, ["conv", "hash"], "left").join(anywhere, "hash", "left")
    inside = F.when(F.col("first") < F.col("turn"), F.struct(F.lit(0).alias("far"), F.col("conv").alias("c"), F.col("first").alias("t")))
    outside = F.when(F.col("any") < F.struct("conv", "turn"), F.struct(F.lit(1).alias("far"), F.col("any.conv").alias("c"), F.col("any.turn").alias("t")))
    return met.select("conv", "turn", "level", "pos", F.coalesce(inside, outside).alias("hit")).where("hit is not null").select("conv", "turn", "level", "hit.far", "pos", "hit.c", "hit.t")


def roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, rc, rt, depth): each message's thread and the steps to its first message, from (conv, turn, pc, pt). What has come to a first message stands aside; the others double their steps."""
    up = parents.select("conv", "turn", F.coalesce("pc", "conv").alias("rc"), F.coalesce("pt", "turn").alias("rt"), F.when(F.col("pc").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    done, going = up.where("depth = 0"), up.where("depth > 0")
    every = going
    while not going.isEmpty():
        far = every.select(F.col("conv").alias("rc"), F.col("turn").alias("rt"), F.col("rc").alias("rc2"), F.col("rt").alias("rt2"), F.col("depth").alias("more"))
        stepped = going.join(far, ["rc", "rt"], "left")
        stepped = checkpoint(stepped.select("conv", "turn", F.coalesce("rc2", "rc").alias("rc"), F.coalesce("rt2", "rt").alias("rt"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")))
        finished = stepped.where("not moved").drop("moved")
        done, going = done.unionByName(finished), stepped.where("moved").drop("moved")
        every = going.unionByName(done.where("depth > 0"))
    return done


def linked(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, reply_conv, reply_turn, by_quote, quoted, thread_conv, thread_turn, depth, position): ``quoted`` are all messages that are quoted, as (level, conv_id, turn); in the order of ``position`` a thread is in reply order."""
    parsed = checkpoint(parsed_turns(turns, conv, turn, role, text))
    placed = parsed.where("conv is not null and turn is not null")
    link = F.struct("level", F.col("c").alias("conv_id"), F.col("t").alias("turn"))
    chosen = hits(placed).groupBy("conv", "turn").agg(F.min(F.struct("level", "far", "pos", "c", "t")).alias("hit"), F.array_sort(F.collect_set(link)).alias("quoted"))
    nodes = previous(placed.select("conv", "turn").distinct(), F.col("turn"), "before", "conv", "turn").select("conv", "turn", "before")
    parents = checkpoint(nodes.join(chosen, ["conv", "turn"], "left").select(
        "conv", "turn", F.coalesce("hit.c", F.when(F.col("before").isNotNull(), F.col("conv"))).alias("pc"), F.coalesce("hit.t", "before").alias("pt"), F.col("hit").isNotNull().alias("by_quote"), "quoted"
    ))
    reply = parents.join(roots(parents).select("conv", "turn", "rc", "rt", "depth"), ["conv", "turn"])
    order = numbered(reply.select("conv", "turn", "depth", F.struct("rc", "rt").alias("thread")), [F.col("depth"), F.col("conv"), F.col("turn")], "position", "thread").select("conv", "turn", "position")
    none = F.array().cast("array<struct<level:int,conv_id:bigint,turn:bigint>>")
    return parsed.join(reply.join(order, ["conv", "turn"]), ["conv", "turn"], "left").select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", "n_quotes", F.col("pc").alias("reply_conv"), F.col("pt").alias("reply_turn"), F.coalesce("by_quote", F.lit(False)).alias("by_quote"), F.coalesce("quoted", none).alias("quoted"),
        F.col("rc").alias("thread_conv"), F.col("rt").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("position", F.lit(0)).cast("bigint").alias("position"),
    )
