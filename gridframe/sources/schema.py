"""What a container holds: axes that come and go, typed tables, datasets that must fit, ranges of labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.sources import folders
from gridframe.sources.store import Container, load


@dataclass(frozen=True)
class TableSpec:
    """The columns of a table of records along one axis, by Spark's names of types."""

    columns: dict[str, str]
    axis: str

    @property
    def schema(self) -> T.StructType:
        return T.DataType.fromDDL(", ".join(f"`{n}` {t}" for n, t in self.columns.items()))

    def of(self, df: DataFrame) -> DataFrame:
        """A table's columns in the types of the spec; values that don't fit into them stop the job."""
        place = f"i_{self.axis}"
        if missing := {place, *self.columns} - set(df.columns):
            raise ValueError(f"no columns {sorted(missing)}")
        fits = []
        for n, t in self.columns.items():
            new = F.col(n).try_cast(t)
            lost = F.col(n).isNotNull() & new.isNull()
            fits.append(F.when(lost, F.raise_error(F.concat(F.lit(f"{n} doesn't hold "), F.col(n).cast("string"))).cast(t)).otherwise(new).alias(n))
        return df.select(F.col(place).cast("long").alias(place), *fits)


def add_axis(held: Container, axis: str, labels: DataFrame | list | int, spark: SparkSession | None = None) -> Container:
    """An axis given by its table (idx, label), its labels, or its length."""
    if axis in held.axes:
        raise ValueError(f"{axis} exists")
    if isinstance(labels, DataFrame):
        if set(labels.columns) != {"idx", "label"}:
            raise ValueError("an axis table has the columns idx and label")
        held.axes[axis] = labels
    else:
        spark = spark or SparkSession.active()
        held.axes[axis] = spark.range(labels).select(F.col("id").alias("idx"), F.col("id").alias("label")) if isinstance(labels, int) else spark.createDataFrame(list(enumerate(labels)), ["idx", "label"])
    return held


def drop_axis(held: Container, axis: str) -> Container:
    """Takes an axis out that no dataset lies on."""
    if axis not in held.axes:
        raise KeyError(axis)
    if used := sorted(n for n, dims in held.dims.items() if axis in dims):
        raise ValueError(f"{axis} is an axis of {used}")
    del held.axes[axis]
    return held


def require_dataset(held: Container, name: str, df: DataFrame, dims: list[str]) -> DataFrame:
    """The dataset of this name if its axes and types are those given, else a new one with these cells."""
    if name not in held.datasets:
        held.add(name, df, dims)
    elif held.dims[name] != list(dims):
        raise ValueError(f"{name} has the axes {held.dims[name]}, not {list(dims)}")
    elif dict(held.datasets[name].dtypes) != dict(df.dtypes):
        raise TypeError(f"{name} has the columns {dict(held.datasets[name].dtypes)}, not {dict(df.dtypes)}")
    return held.datasets[name]


def described(held: Container) -> list[dict[str, Any]]:
    """Name, axes and columns of each dataset, from plans alone."""
    return [{"name": n, "axes": list(held.dims[n]), "columns": {c: t for c, t in df.dtypes if c not in {f"i_{a}" for a in held.dims[n]}}} for n, df in sorted(held.datasets.items())]


def misfits(held: Container) -> DataFrame | None:
    """(dataset, axis, cells): how many cells of each dataset lie at positions that its axis doesn't have.

    Nothing for a container whose datasets have no axis with a table."""
    out = None
    for name, dims in held.dims.items():
        for axis in dims:
            if axis in held.axes:
                known = held.axes[axis].select(F.col("idx").alias(f"i_{axis}")).distinct()
                one = held.datasets[name].join(known, f"i_{axis}", "left_anti").agg(F.count(F.lit(1)).alias("cells")).select(F.lit(name).alias("dataset"), F.lit(axis).alias("axis"), "cells")
                out = one if out is None else out.unionByName(one)
    return out


def select_range(held: Container, axis: str, start: Any = None, stop: Any = None, convert: Callable[[Column], Column] = lambda label: label) -> Container:
    """Positions with labels from ``start`` to before ``stop``, on an axis whose labels grow.

    ``convert`` is applied to the axis table's labels first (times of another kind, say).  Only the axis
    table is read to find the positions; the datasets are cut by their numbers, so Parquet skips the rest."""
    label = convert(F.col("label"))
    before = [F.count_if(F.coalesce(label < F.lit(x), F.lit(False))) if x is not None else None for x in (start, stop)]
    low, high = held.axes[axis].agg(*[(b if b is not None else F.lit(0) if i == 0 else F.count(F.lit(1))).alias(f"b{i}") for i, b in enumerate(before)]).first()
    return held.select(**{axis: slice(low, max(low, high))})


def moved_to_disk(held: Container, path: str, rows_per_file: int | None = None, **options: Any) -> Container:
    """The container saved and opened again, so what follows reads it; files of at most so many rows."""
    spark = next(iter([*held.datasets.values(), *held.axes.values()])).sparkSession
    key = "spark.sql.files.maxRecordsPerFile"
    known = spark.conf.get(key)
    try:
        if rows_per_file is not None:
            spark.conf.set(key, rows_per_file)
        held.save(path, **options)
    finally:
        spark.conf.set(key, known)
    return load(spark, path)


def moved_to_memory(held: Container) -> Container:
    """The container with its datasets kept by Spark, in memory as far as it goes; ``unpersist`` lets one go."""
    return Container({n: df.persist() for n, df in held.datasets.items()}, dict(held.axes), dict(held.dims), dict(held.attrs), list(held.history))


def sizes_on_disk(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each dataset of a saved container, as the file system tells them."""
    fs, at = folders.hadoop(spark, f"{path}/data")
    found = fs.listStatus(at) if fs.exists(at) else []
    return {x.getPath().getName(): fs.getContentSummary(x.getPath()).getLength() for x in found}
