"""Contacts that arrive as a stream: pixel counts kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_stream(pairs: DataFrame) -> DataFrame:
    """A streaming frame of single contacts (bin1_id, bin2_id) as running counts of upper-triangle pixels."""
    ordered = pairs.select(F.least("bin1_id", "bin2_id").alias("bin1_id"), F.greatest("bin1_id", "bin2_id").alias("bin2_id"))
    return ordered.groupBy("bin1_id", "bin2_id").agg(F.count(F.lit(1)).cast("double").alias("count"))


def start(pairs: DataFrame, checkpoint: str, save: Callable[[DataFrame, int], None]):
    """Start the stream; ``save`` gets the changed pixels of each batch (a batch run again comes with its number)."""
    return pixel_stream(pairs).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).start()
