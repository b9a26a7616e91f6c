"""Order-dependent steps over the pages of books, without one task for a whole book.

Pages of a book are windowed in runs of a bounded number of page numbers; what crosses from
one run to the next is one row per run.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Page numbers in a run.
RUN = 4096
#: Ids of a block, as a power of two, and bytes of blocks that are broadcast at most.
BLOCK_BITS, MOST_BYTES = 12, 64 << 20


#: The folders of what is stored within ``fleeting``, a list for each that is open.
_fleeting: ContextVar[tuple[list[str], ...]] = ContextVar("fleeting", default=())


def stored(df: DataFrame, kept: bool = False) -> DataFrame:
    """The rows written to the shared folder of ``spark.checkpoint.dir``, so that a lost executor's share is read again and not made anew. ``kept``: beyond the ``fleeting`` around."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    noted(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get(), kept)
    return out


def packed(df: DataFrame, kept: bool = False) -> DataFrame:
    """As ``stored``, but as compressed Parquet, which takes less disk; how the rows are dealt is not kept."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    noted(path, kept)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def noted(path: str, kept: bool = False) -> None:
    if over := _fleeting.get()[: -1 if kept else None]:
        over[-1].append(path)


@contextmanager
def fleeting(spark: SparkSession) -> Iterator[None]:
    """What is ``stored`` meanwhile is deleted in the end, but what is ``kept``, so nothing may read it any more by then."""
    token = _fleeting.set((*_fleeting.get(), []))
    try:
        yield
    finally:
        made = _fleeting.get()[-1]
        _fleeting.reset(token)
        for path in made:
            delete(spark, path)


def reclaim(spark: SparkSession) -> None:
    """Have Spark free the shuffles of steps that are over and no longer referred to; it does so only when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where there is none, and only for a local master, as in tests."""
    context, given = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not given and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(given or f"{tempfile.gettempdir()}/checkpoints/{os.getpid()}")
    return context.getCheckpointDir()


def run_of(page: str = "page_no", run: int = RUN) -> Column:
    return F.floor(F.col(page) / run)


def in_runs(df: DataFrame, page: str = "page_no", run: int = RUN) -> DataFrame:
    """Rows with their run; the one that they have stays, so that steps one after another shuffle them once."""
    return df if "_run" in df.columns else df.withColumn("_run", run_of(page, run))


def previous(df: DataFrame, column: Column, name: str, book: str = "book_id", page: str = "page_no", run: int = RUN) -> DataFrame:
    """Adds the value of the page before in the book's order, null on the first, its page number as ``<name>_page``, and ``<name>_last``: no page follows."""
    rows = in_runs(df, page, run).withColumn("_own", F.struct(F.col(page).alias("p"), column.alias("v")))
    within = rows.withColumn("_before", F.lag("_own").over(Window.partitionBy(book, "_run").orderBy(page)))
    ends = rows.groupBy(book, "_run").agg(F.max_by("_own", page).alias("_last"))
    by_run = Window.partitionBy(book).orderBy("_run")
    over = ends.select(book, "_run", F.lag("_last").over(by_run).alias("_carried"), F.when(F.lead("_run").over(by_run).isNull(), F.col("_last.p")).alias("_end"))
    out = within.join(over, [book, "_run"], "left").withColumn("_before", F.coalesce("_before", "_carried"))
    out = out.withColumn(name, F.col("_before.v")).withColumn(f"{name}_page", F.col("_before.p")).withColumn(f"{name}_last", F.coalesce(F.col("_end") == F.col(page), F.lit(False)))
    return out.drop("_own", "_before", "_carried", "_end", *({"_run"} - set(df.columns)))


def totals_before(df: DataFrame, columns: dict[str, Column], group: str = "book_id", order: str = "page_no", run: int = RUN) -> DataFrame:
    """Adds, by name, the sum of each column over the rows before in a group's order: within runs, plus one row per run of what came before it."""
    rows = df.withColumn("_run", run_of(order, run))
    within = Window.partitionBy(group, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(group, "_run").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in columns.items()))
    carried = runs.select(group, "_run", *(F.sum(f"_sum_{n}").over(across).alias(f"_carried_{n}") for n in columns))
    out = rows.withColumns({n: F.sum(c).over(within) for n, c in columns.items()}).join(carried, [group, "_run"])
    zero = F.lit(0).cast("bigint")
    return out.withColumns({n: F.coalesce(n, zero) + F.coalesce(f"_carried_{n}", zero) for n in columns}).drop("_run", *(f"_carried_{n}" for n in columns))


def last_before(df: DataFrame, column: Column, name: str, group: str = "book_id", order: str = "page_no", run: int = RUN) -> DataFrame:
    """Adds the last value that isn't null of the rows before in a group's order; null if there is none."""
    rows = in_runs(df, order, run).withColumn("_value", column)
    within = Window.partitionBy(group, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.where("_value is not null").groupBy(group, "_run").agg(F.max_by("_value", order).alias("_of_run"))
    every = rows.select(group, "_run").distinct().join(runs, [group, "_run"], "left")
    carried = every.select(group, "_run", F.last("_of_run", ignorenulls=True).over(across).alias("_carried"))
    out = rows.withColumn(name, F.last("_value", ignorenulls=True).over(within)).join(carried, [group, "_run"])
    return out.withColumn(name, F.coalesce(name, "_carried")).drop("_value", "_carried", *({"_run"} - set(df.columns)))


def numbered(df: DataFrame, order: list[Column], name: str, group: str = "book_id") -> DataFrame:
    """Adds each row's place from 0 within its group in this order, without one task for a whole group.

    Rows are dealt to tasks by ranges of (group, order) and numbered there; what came before a task's first row of a
    group is one count per group and task. The ranges are drawn once: the dealt rows are written to the shared folder, so they should be narrow.
    Rows that are equal in the order are numbered as they come, so the order should be a total one.
    """
    keys = [F.col(group), *order]
    marked = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(marked)
    counts = dealt.groupBy(group, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_group"), F.col("_task").alias("_of"), (before - F.col("_first")).alias("_shift"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_of"))
    return dealt.join(starts, same).withColumn(name, (F.col("_at") + F.col("_shift")).cast("int")).drop("_task", "_at", "_group", "_of", "_shift")


def with_numbers(rows: DataFrame, numbers: DataFrame, key: str, name: str, most: int = MOST_BYTES) -> DataFrame:
    """Rows with the number that ``numbers`` (key bigint, name int) has for their key; rows without one are left out.

    Numbers are broadcast as blocks: of each 4,096 ids those from the least to the greatest that occurs, 4 bytes each, so the
    rows meet them in no shuffle. Where these blocks exceed ``most`` bytes, or a key repeats, rows and numbers are joined as they are.
    """
    id_, place = F.col(key), F.col(key).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    each = numbers.where(id_.isNotNull()).select(F.shiftright(id_, BLOCK_BITS).alias("_block"), F.struct(place.alias("p"), F.col(name).alias("n")).alias("_x"))
    listed = each.groupBy("_block").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    gap = lambda x, i: F.coalesce(F.get("_xs", i + 1)["p"] - x["p"] - 1, F.lit(0))
    held = F.flatten(F.transform("_xs", lambda x, i: F.concat(F.array(x["n"]), F.array_repeat(F.lit(None).cast("int"), gap(x, i)))))
    blocks = stored(listed.select("_block", F.get("_xs", F.lit(0))["p"].alias("_least"), (F.element_at("_xs", -1)["p"] - F.get("_xs", F.lit(0))["p"] + 1).alias("_span"), held.alias("_held")))
    size, repeated = blocks.agg(F.coalesce(F.sum(F.size("_held") * 4 + 64), F.lit(0)), F.coalesce(F.bool_or(F.size("_held") != F.col("_span")), F.lit(False))).first()
    if repeated or size > most:
        return rows.join(numbers.select(key, name), key)
    met = rows.join(F.broadcast(blocks.drop("_span")), F.shiftright(id_, BLOCK_BITS) == F.col("_block"))
    at = place - F.col("_least")
    return met.withColumn(name, F.when(at >= 0, F.get("_held", at))).where(F.col(name).isNotNull()).drop("_block", "_least", "_held")
