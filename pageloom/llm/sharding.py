"""Extendible hashing into shards of a bounded number of bytes, with DataFrame functions only.

A row's key is hashed to 60 bits. The directory is indexed by a prefix of these bits; a
bucket is the shortest prefix whose rows fit the byte limit, so only buckets over the limit
are split on another bit. Sizes are summed at a depth that follows from the total, and once
more, deeper, for the prefixes that still don't fit there.

Rows whose 60 bits are the same can't be split by hashing. If they exceed the limit, they
fill shards one after another in the order of ``row``'s sums; a single row over the limit is
a shard alone.

Cases: a null text has 0 bytes; a null key hashes as an empty one; an empty table gives an
empty result; extra columns are kept in a struct until the end, so that their names clash
with none of ours, but for those in ``RESULTS``, which give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import checkpoint

BITS = 60
#: Bits beyond those that evenly filled shards would need, and bits added for each further round.
SLACK, DEEPER = 4, 12
#: A directory of at most so many entries is broadcast; a larger one is joined by its prefix.
MOST_BROADCAST = 200_000
#: Columns of the result; columns of the input with these names give way to them.
RESULTS = ("n_bytes", "shard", "depth")


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def leaves(sizes: DataFrame, depth: int, base: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """From (prefix, bytes) at ``depth``: (prefix, shard depth) of those that fit a bucket between the depths ``base`` and ``depth``, and (prefix) of those that don't."""
    levels = sizes.select("prefix", "bytes", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftright(prefix, {depth} - d)"))
    sums = checkpoint(levels.groupBy("d", "p").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("d", "p"))
    # the shallow prefixes that fit nowhere would bring all rows to a few keys
    least = sums.agg(F.min("d")).first()[0]
    fits = levels.where(F.col("d") >= (depth if least is None else least)).select("prefix", "d", "p").join(sums, ["d", "p"]).groupBy("prefix").agg(F.min("d").alias("d"))
    return fits, sizes.select("prefix").join(fits, "prefix", "left_anti")


def directory(keyed: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], int]:
    """(depth, its (prefix, d)) of each round over rows (h, bytes), and the depth of the last."""
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    depth, base = min(BITS, max(0, (int(total) // limit).bit_length()) + SLACK), 0
    rounds: list[tuple[int, DataFrame]] = []
    rest = keyed
    while True:
        sizes = checkpoint(rest.groupBy(F.shiftright("h", BITS - depth).alias("prefix")).agg(F.sum("bytes").alias("bytes")))
        fits, over = leaves(sizes, depth, base, limit)
        fits = checkpoint(fits)
        rounds.append((depth, fits))
        over = checkpoint(over)
        n = over.count()
        if not n or depth == BITS:
            return rounds, depth
        hint = F.broadcast(over) if n <= MOST_BROADCAST else over
        rest = rest.withColumn("prefix", F.shiftright("h", BITS - depth)).join(hint, "prefix", "left_semi").select("h", "bytes")
        depth, base = min(BITS, depth + DEEPER), depth + 1


def sharded(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all, if None) with n_bytes, shard (the bucket's hash prefix as bits; ``-`` and a number follow where equal hashes fill several shards) and depth."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in RESULTS]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), hash60(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"))
    rounds, last = directory(rows.select("h", "bytes"), limit)
    out = rows
    found = F.lit(None).cast("int")
    for i, (depth, fits) in enumerate(rounds):
        named = fits.select(F.col("prefix").alias(f"p{i}"), F.col("d").alias(f"d{i}"))
        hint = F.broadcast(named) if fits.count() <= MOST_BROADCAST else named
        out = out.withColumn(f"p{i}", F.shiftright("h", BITS - depth)).join(hint, f"p{i}", "left").drop(f"p{i}")
        found = F.coalesce(found, F.col(f"d{i}"))
    out = out.withColumn("depth", found)
    prefix = F.expr(f"substring(lpad(bin(h), {BITS}, '0'), 1, depth)")
    done = out.where("depth is not null").select("kept", "bytes", prefix.alias("shard"), "depth")
    if last == BITS:  # equal hashes over the limit: fill by running sums within slices of the rows, a slice at a time
        same = checkpoint(out.where("depth is null")).withColumn("row", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("row", 33))
        alone = F.col("bytes") > limit // 2
        part = Window.partitionBy("h", "slice", F.pmod(F.xxhash64("row"), F.lit(16))).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        room = limit - limit // 2
        number = F.floor(F.coalesce(F.sum("bytes").over(part), F.lit(0)) / room)
        small = same.where(~alone).withColumn("fill", F.concat(F.col("slice"), F.lit("."), F.pmod(F.xxhash64("row"), F.lit(16)), F.lit("."), number))
        large = same.where(alone).withColumn("fill", F.concat(F.lit("r"), F.col("row")))
        rest = small.unionByName(large).select("kept", "bytes", F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lit("-"), F.col("fill")).alias("shard"), F.lit(BITS).alias("depth"))
        done = done.unionByName(rest)
    return done.select("kept.*", F.col("bytes").alias("n_bytes"), "shard", "depth")
