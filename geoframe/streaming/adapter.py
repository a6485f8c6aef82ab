"""Row-local operators on unbounded streams.

Extraction, envelopes, quadkeys, reprojection and joins with a static boundary table keep no state, so they run on
readStream tables unchanged.  Operators that need the whole table run on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def row_local(stream: DataFrame, *operations: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for f in operations:
        stream = stream.transform(f)
    return stream


def per_batch(stream: DataFrame, operation: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """operation (a sort, kd-tree cells, statistics) and write on each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, i: write(operation(batch), i)).option("checkpointLocation", checkpoint)


def windowed_bounds(stream: DataFrame, time_column: str, window: str, late: str) -> DataFrame:
    """Bounds and rows of each time window; rows later than `late` are dropped and state ends there."""
    from ..operators.aggregate import _envelope

    e = stream.withWatermark(time_column, late).select(F.window(time_column, window).alias("w"), _envelope(stream).alias("e"))
    return e.groupBy("w").agg(F.count("*").alias("n"), F.min("e.xmin").alias("xmin"), F.min("e.ymin").alias("ymin"), F.max("e.xmax").alias("xmax"), F.max("e.ymax").alias("ymax"))
