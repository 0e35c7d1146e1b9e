"""Files that arrive over time, each taken once, and a gate for bad values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def each_arrival(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``act`` with each batch that is there, then ends."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finite_only(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NaN or infinite values in these columns; null is neither."""
    for c in columns:
        stream = stream.where(F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(True)))
    return stream
