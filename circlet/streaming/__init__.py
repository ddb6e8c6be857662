"""Streams of points into a partitioned table.

Curve index and leaf are projections without state, so that a stream gets them
by the same expressions as a table does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_stream(points: DataFrame, layout, path: str, checkpoint: str) -> StreamingQuery:
    """points: a stream with id, x, y.  layout: one of operators.layouts, for its assign and partition columns."""
    placed = layout.assign(points)
    writer = placed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.partitionBy(*layout.partition_by) if layout.partition_by else writer).trigger(availableNow=True).start()
