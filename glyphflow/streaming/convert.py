"""Conversion of streams: the same Columns, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..functions.arrow import bounded_batches


def convert_stream(stream: DataFrame, engine: Engine, code: str, column: str = "text", to: str = "converted") -> DataFrame:
    """A streaming DataFrame with a converted column."""
    bounded_batches(stream.sparkSession)
    return stream.withColumn(to, engine.transliterate(column, code))


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What is there now, then the end: exactly once, by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
