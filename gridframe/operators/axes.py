"""Selections, joins and reductions over axes in cell layout: a position column for each axis, and values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class AxisException(ValueError):
    """An operation isn't defined over this axis."""


def slice_axis(df: DataFrame, axis: str, start: int = 0, stop: int | None = None, step: int = 1, length: int | None = None) -> DataFrame:
    """Positions start, start + step ... before stop, numbered anew from 0.

    Negative bounds count from the end of an axis of ``length`` positions."""
    if step < 1:
        raise IndexError("the step of a slice is at least 1")
    if start < 0 or stop is not None and stop < 0:
        if length is None:
            raise IndexError("negative bounds need the length of the axis")
        start, stop, step = slice(start, stop, step).indices(length)
    i = F.col(axis)
    kept = df.where(i >= start) if stop is None else df.where((i >= start) & (i < stop))
    return kept.where((i - start) % step == 0).withColumn(axis, ((i - start) / step).cast("long"))


def put_slice(df: DataFrame, axis: str, start: int, stop: int, value: str, new: Column) -> DataFrame:
    """Sets a value at the positions from start to before stop."""
    return df.withColumn(value, F.when((F.col(axis) >= start) & (F.col(axis) < stop), new).otherwise(F.col(value)))


def index_axes(df: DataFrame, axes: list[str], key: tuple, lengths: dict[str, int] | None = None) -> DataFrame:
    """Cells under an index as of arrays: integers drop their axis, slices cut theirs, one Ellipsis
    stands for the axes between, None adds an axis of one position (``new_0`` and so on)."""
    if sum(k is Ellipsis for k in key) > 1:
        raise IndexError("an index can only have a single ellipsis")
    used = sum(k is not None and k is not Ellipsis for k in key)
    if used > len(axes):
        raise IndexError(f"too many indices: {used} for {len(axes)} axes")
    left, added, lengths = list(axes), 0, lengths or {}
    for k in key:
        if k is None:
            df, added = df.withColumn(f"new_{added}", F.lit(0).cast("long")), added + 1
        elif k is Ellipsis:
            left = left[len(axes) - used :]
        else:
            axis = left.pop(0)
            if isinstance(k, slice):
                df = slice_axis(df, axis, k.start or 0, k.stop, k.step or 1, lengths.get(axis))
            else:
                k = int(k)
                if k < 0 and axis not in lengths:
                    raise IndexError("negative positions need the length of the axis")
                df = df.where(F.col(axis) == (k + lengths[axis] if k < 0 else k)).drop(axis)
    return df


def select_axis(df: DataFrame, axis: str, within: tuple[int, ...] | None = None, index: Iterable[int] | None = None, labels: tuple[DataFrame, list] | None = None) -> DataFrame:
    """One selection of an axis: a range (start, stop, step) before listed positions, these before labels."""
    if within is not None:
        return slice_axis(df, axis, *within)
    if index is not None:
        return take_axis(df, axis, index)
    return df if labels is None else select_labels(df, axis, *labels)


def partition_of(position: Column, parts: int, method: str = "con", count: Column | None = None, seed: int = 0) -> Column:
    """The part that a position of a list goes to: contiguous runs (the first ones longer by one), in turn, or at random."""
    if parts < 1:
        raise ValueError("a list has one part at least")
    if method == "alt":
        return F.pmod(position, F.lit(parts))
    if method == "rand":
        return F.pmod(F.xxhash64(position, F.lit(seed)), F.lit(parts))
    if method != "con" or count is None:
        raise ValueError("parts are con (with the count), alt or rand")
    size, more = F.floor(count / parts), count % parts
    return F.when(position < more * (size + 1), F.floor(position / (size + 1))).otherwise(more + F.floor((position - more * (size + 1)) / F.greatest(size, F.lit(1))))


def sign_changes(df: DataFrame, keep: list[str], order: str, value: str) -> DataFrame:
    """Neighbours along an order between which a value changes its sign or is zero: (low, high, f_low, f_high)."""
    along = Window.partitionBy(*keep).orderBy(order)
    pairs = df.select(*keep, F.col(order).alias("low"), F.lead(order).over(along).alias("high"), F.col(value).alias("f_low"), F.lead(value).over(along).alias("f_high"))
    return pairs.where("f_low * f_high <= 0")


def take_axis(df: DataFrame, axis: str, positions: Iterable[int]) -> DataFrame:
    """The listed positions in the listed order, with repeats; the list is short by nature."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(positions)), "_to long, _from long")
    return df.join(F.broadcast(wanted), F.col(axis) == F.col("_from")).drop("_from", axis).withColumnRenamed("_to", axis)


def select_labels(df: DataFrame, axis: str, labels: DataFrame, wanted: list) -> DataFrame:
    """Cells whose label on the axis table (idx, label) is wanted."""
    return df.join(labels.where(F.col("label").isin(wanted)), F.col(axis) == F.col("idx"), "left_semi")


def with_labels(df: DataFrame, axis: str, labels: DataFrame, name: str) -> DataFrame:
    """Adds the label of each position; Spark broadcasts an axis table that is small."""
    return df.join(labels.select(F.col("idx").alias(axis), F.col("label").alias(name)), axis)


def align(a: DataFrame, b: DataFrame, axes: list[str], how: str = "inner") -> DataFrame:
    """Cells of two arrays on the axes they share; the one without an axis is repeated along it."""
    if not axes:
        raise AxisException("the arrays share no axis")
    return a.join(b, axes, how)


def reduce_axes(df: DataFrame, keep: list[str], **reductions: Column) -> DataFrame:
    """Aggregates over all axes but those kept (none kept: one row over everything)."""
    return df.groupBy(*keep).agg(*[c.alias(n) for n, c in reductions.items()])


def accumulate(df: DataFrame, keep: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum along an order within each combination of the axes kept."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keep).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def nan_min(value: Column) -> Column:
    """Minimum that is NaN if any value is."""
    return F.when(F.bool_or(F.isnan(value)), F.lit(float("nan"))).otherwise(F.min(value))


def nan_census(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the numbers of NaN and of infinite values."""
    sums = [F.count_if(F.isnan(c)).alias(f"{c}_nan") for c in columns] + [F.count_if(F.abs(c) == float("inf")).alias(f"{c}_inf") for c in columns]
    return df.agg(*sums)


def reshape_flat(df: DataFrame, outer: str, inner: str, size: int, name: str) -> DataFrame:
    """Two axes become one, the inner one (of this size) running fastest."""
    return df.withColumn(name, F.col(outer) * size + F.col(inner)).drop(outer, inner)


def pack(df: DataFrame, axis: str, value: str, keep: list[str]) -> DataFrame:
    """Packed layout: the values along an axis as one array for each combination of the axes kept."""
    return df.groupBy(*keep).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, value))), lambda x: x[value]).alias(value))


def unpack(df: DataFrame, array: str, axis: str, value: str) -> DataFrame:
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias(axis, value))


def block_of(i: Column, n: int, blocks: int) -> Column:
    """The block of position i when n positions are split evenly, the first blocks taking the rest."""
    base, rest = divmod(n, blocks)
    edge = rest * (base + 1)
    return F.when(i < edge, F.floor(i / (base + 1))).otherwise(rest + F.floor((i - edge) / max(base, 1))).cast("long")


def unique_ordered(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place at which each is seen first."""
    return df.groupBy(value).agg(F.min(order).alias("first_seen"))


def redistribute(df: DataFrame, axis: str, partitions: int | None = None) -> DataFrame:
    """Partitions by ranges of an axis."""
    return df.repartitionByRange(axis) if partitions is None else df.repartitionByRange(partitions, axis)
