"""Arrow batches in and out of numpy, with bounded memory."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes that one step of a Python operator holds at a time (a longer text stands alone).
STEP_BYTES = 1 << 20


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut the batches at about ``most`` bytes of the text column."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(start, end - start)
            start = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Null counts as the empty text."""
    return [x or "" for x in column(batch, name).to_pylist()]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def reclaim(spark: SparkSession) -> None:
    """Have Spark free the shuffles and checkpoints of steps that are over and no longer referred to; it does so only when the driver's JVM collects garbage, which many small rounds don't make it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's checkpoint folder; set one only where there is none, and only for a local master, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(given or f"{tempfile.gettempdir()}/checkpoints/{os.getpid()}")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
