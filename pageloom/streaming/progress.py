"""Progress of long runs: a counter, its line, and the same figures from a log table."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.scalar import DURATIONS, duration, percent, rate, remaining

CELLS, NAME = 20, 25


def format_time(seconds: float | None) -> str:
    """``duration`` of one number."""
    if seconds is None:
        return DURATIONS[3]
    minutes = seconds // 60
    parts = (round(seconds),) if seconds < 60 else (minutes, seconds % 60) if seconds < 3600 else (minutes // 60, minutes % 60)
    return DURATIONS[(seconds >= 60) + (seconds >= 3600)] % parts


@dataclass
class Progress:
    total: int
    desc: str = ""
    unit: str = "items"
    out: TextIO | None = None
    current: int = 0
    successful: int = 0
    failed: int = 0
    item: str = ""
    started: float = field(default_factory=time.monotonic)

    @property
    def elapsed(self) -> float:
        return time.monotonic() - self.started

    @property
    def rate(self) -> float:
        return self.current / self.elapsed if self.elapsed > 0 else 0.0

    @property
    def eta(self) -> float | None:
        return (self.total - self.current) / self.rate if self.rate else None

    @property
    def percent(self) -> float:
        return 100.0 * self.current / self.total if self.total else 100.0

    def update(self, n: int = 1, success: bool = True, item: str = "") -> None:
        self.current += n
        self.successful += n * success
        self.failed += n * (not success)
        self.set_item(item or self.item)

    def set_item(self, name: str) -> None:
        self.item = name
        self._show("\r")

    def line(self) -> str:
        full = int(CELLS * min(self.percent, 100) / 100)
        speed = f"{self.rate:.1f} {self.unit}/s" if self.rate >= 1 else f"{1 / self.rate:.1f}s/{self.unit}" if self.rate else ""
        name = self.item if len(self.item) <= NAME else f"...{self.item[-(NAME - 3) :]}"
        parts = [f"{self.desc}: [{'█' * full}{'░' * (CELLS - full)}]", f"{self.current}/{self.total}", f"({self.percent:.0f}%)", speed, f"ETA {format_time(self.eta)}", name]
        return " ".join(p for p in parts if p)

    def finish(self) -> str:
        said = f"{self.desc}: {self.current}/{self.total} in {format_time(self.elapsed)}, {self.failed} failed"
        self._show("\n")
        return said

    def _show(self, end: str) -> None:
        if self.out is not None:
            print(self.line(), end=end, file=self.out, flush=True)


class BatchListener(StreamingQueryListener):
    """Feeds a counter with the rows that each batch of a stream has read, as Spark reports them. A task that is tried
    again doesn't count again; a batch that is tried again after a restart has the same number and counts once."""

    def __init__(self, shown: Progress, name: str | None = None):
        self.shown, self.name, self.seen = shown, name, set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if (self.name is None or p.name == self.name) and p.numInputRows and (p.id, p.batchId) not in self.seen:
            self.seen.add((p.id, p.batchId))
            self.shown.update(p.numInputRows, item=f"batch {p.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.shown.update(0, item=event.exception.splitlines()[0])


def followed(spark: SparkSession, shown: Progress, start: Callable[[], StreamingQuery], wait: float = 30.0) -> StreamingQuery:
    """Start a stream that ends by itself, wait for its end, and have its batches counted."""
    listener = BatchListener(shown)
    spark.streams.addListener(listener)
    try:
        query = start()
        query.awaitTermination()
        told = {(p.id, p.batchId) for p in query.recentProgress if p.numInputRows}
        until = time.monotonic() + wait  # reports come a little later than the end
        while not told <= listener.seen and time.monotonic() < until:
            time.sleep(0.05)
        return query
    finally:
        spark.streams.removeListener(listener)


def progress_iter(items: Iterable, desc: str = "", unit: str = "items", out: TextIO | None = sys.stderr) -> Iterator:
    held = items if hasattr(items, "__len__") else list(items)
    shown = Progress(len(held), desc, unit, out)
    for item in held:
        yield item
        shown.update()
    shown.finish()


def log_summary(log: DataFrame) -> DataFrame:
    """(run_id, total, current, successful, failed, rate, eta, percent, elapsed_text) from a run's log (run_id, total, n, success, elapsed)."""
    summed = log.groupBy("run_id").agg(F.max("total").alias("total"), F.sum("n").alias("current"), F.sum(F.when(F.col("success"), F.col("n")).otherwise(0)).alias("successful"), F.sum(F.when(F.col("success"), 0).otherwise(F.col("n"))).alias("failed"), F.max("elapsed").alias("elapsed"))
    total, done, elapsed = F.col("total"), F.col("current"), F.col("elapsed")
    return summed.select("run_id", "total", "current", "successful", "failed", rate(done, elapsed).alias("rate"), remaining(total, done, elapsed).alias("eta"), percent(total, done).alias("percent"), duration(elapsed).alias("elapsed_text"))
