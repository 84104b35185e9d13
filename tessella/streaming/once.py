"""Structured Streaming forms of the process-once pipeline, and event-time extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handles what has arrived since the last run, in batches, and ends; the checkpoint makes each batch
    count once. handle must be idempotent by batch id."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first row of each key within the lateness; older state is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, late: str, size: str, slide: str | None, by: list[str], value: str) -> DataFrame:
    """Extension: tumbling or sliding window counts and sums with a watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, at: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Extension: session windows that end after a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))


def interval_pairs(left: DataFrame, right: DataFrame, source: str, at: str, key: str, seconds: int, late: str) -> DataFrame:
    """a, b, source: pairs of rows of two streams with one source whose times are at most so many seconds apart. Both
    sides have watermarks and the range bounds how long a row can find partners, so state behind both is
    dropped: rows later than `late` behind the latest time seen are left out, all others give the pairs that a
    join of the whole tables gives, each once."""
    a = left.select(F.col(key).alias("a"), F.col(source).alias("sa"), F.col(at).alias("ta")).withWatermark("ta", late)
    b = right.select(F.col(key).alias("b"), F.col(source).alias("sb"), F.col(at).alias("tb")).withWatermark("tb", late)
    width = F.expr(f"interval {int(seconds)} seconds")
    near = (F.col("sa") == F.col("sb")) & (F.col("tb") >= F.col("ta") - width) & (F.col("tb") <= F.col("ta") + width)
    return a.join(b, near).select("a", "b", F.col("sa").alias(source))
