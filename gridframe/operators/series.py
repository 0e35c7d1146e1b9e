"""Time-ordered data: positions, concatenation, ranges, bin centres and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.operators import quantile
from gridframe.sources import folders


def with_positions(df: DataFrame, order: list[str], name: str = "i", partitions: int | None = None) -> DataFrame:
    """Consecutive positions from 0 in a total order, without bringing all rows to one task.

    Rows are range-partitioned by the order and written as a table of the session's shared folder, as the
    bounds of ranges are sampled and would differ if a lost part were made again; each partition's first
    position is the number of rows in those before it (one small row a partition)."""
    ranged = df.repartitionByRange(*order) if partitions is None else df.repartitionByRange(partitions, *order)
    held = folders.scratch(df.sparkSession)
    ranged.withColumn("_p", F.spark_partition_id()).write.parquet(held)
    ranged = df.sparkSession.read.schema(ranged.withColumn("_p", F.lit(0)).schema).parquet(held)
    sizes = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    first = df.sparkSession.createDataFrame(list(starts.items()), "_p int, _first long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_k", place).join(F.broadcast(first), "_p").withColumn(name, F.col("_first") + F.col("_k")).drop("_p", "_k", "_first")


def concatenate(parts: list[DataFrame], axis: str, lengths: list[int], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Joins parts end to end along an axis and keeps positions from start to stop, numbered from 0.

    Negative bounds count from the end.  A part outside the range isn't read."""
    n = sum(lengths)
    begin = 0 if start is None else start + n if start < 0 else start
    end = n if stop is None else stop + n if stop < 0 else min(stop, n)
    out, offset = [], 0
    for part, length in zip(parts, lengths, strict=True):
        if offset < end and offset + length > begin:
            place = F.col(axis) + offset
            out.append(part.where((place >= begin) & (place < end)).withColumn(axis, place - begin))
        offset += length
    return reduce(DataFrame.unionByName, out) if out else parts[0].where(F.lit(False))


def bin_centres(df: DataFrame, time: str, order: list[str], alignment: float, name: str = "centre") -> DataFrame:
    """time + alignment * half the median spacing (found by dividing buckets, so no task orders all spacings)."""
    gaps = with_positions(df.select(time, *[c for c in order if c != time]), order).select("i", time)
    before = gaps.select((F.col("i") + 1).alias("i"), F.col(time).alias("_before"))
    steps = gaps.join(before, "i").select((F.col(time) - F.col("_before")).cast("double").alias("_d"), F.lit(1.0).alias("_w"))
    spacing = quantile.weighted_quantile(steps, [], "_d", "_w", 0.5, "split", "_gap").select(F.abs("_gap").alias("_gap"))
    return df.join(F.broadcast(spacing)).withColumn(name, F.col(time) + F.lit(alignment) * F.col("_gap") / 2).drop("_gap")


def batches(df: DataFrame, position: str, size: int, value: str) -> DataFrame:
    """Full batches of ``size`` consecutive positions; an incomplete last one is left out."""
    rows = df.groupBy(F.floor(F.col(position) / size).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(position, value))).alias("_rows"))
    return rows.where(F.col("n") == size).select("batch", "n", F.transform("_rows", lambda r: r[value]).alias("members"))
