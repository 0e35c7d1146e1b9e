"""A container: datasets, axis tables, attributes and history under one folder.

Datasets are Parquet tables in cell layout; attributes are (path, key, JSON) rows and
history (seq, name, JSON) rows.  A container is written aside and renamed when it is complete.
What is appended later lies in folders of the same kind under ``more``; only complete ones count.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.operators.axes import slice_axis, take_axis
from gridframe.sources import folders


def encode(value: Any) -> str:
    def other(x: Any) -> Any:
        if isinstance(x, datetime):
            return x.isoformat()
        if isinstance(x, bytes):
            return x.decode()
        if hasattr(x, "tolist"):
            return x.tolist()
        raise TypeError(f"{type(x).__name__} can't be an attribute")

    return json.dumps(value, default=other)


@dataclass
class Container:
    """Datasets and axes by name, with the axes of each dataset."""

    datasets: dict[str, DataFrame] = field(default_factory=dict)
    axes: dict[str, DataFrame] = field(default_factory=dict)
    dims: dict[str, list[str]] = field(default_factory=dict)
    attrs: dict[str, dict[str, Any]] = field(default_factory=dict)
    history: list[tuple[str, Any]] = field(default_factory=list)

    def add(self, name: str, df: DataFrame, dims: list[str]) -> Container:
        if name in self.datasets:
            raise ValueError(f"{name} exists")
        self.datasets[name], self.dims[name] = df, list(dims)
        return self

    @classmethod
    def of_axes(cls, spark: SparkSession, specs: dict[str, dict], axes_from: Container | None = None, copy_from: Container | None = None, skip: tuple[str, ...] = (), **axes: int | list) -> Container:
        """A container with the axes that its dataset specs name: given as a length or labels, or those of another
        container.  ``specs`` has for each dataset its axes, the type and start value of its cells, and ``initialise``.
        ``copy_from`` gives axes too, and the datasets none of whose axes was given anew."""
        source = axes_from or copy_from
        out = cls(attrs=dict(source.attrs) if source else {}, history=list(source.history) if source else [])
        for axis in dict.fromkeys(a for spec in specs.values() for a in spec["axes"]):
            if axis in axes:
                given = axes[axis]
                rows = spark.range(given).select(F.col("id").alias("idx"), F.col("id").alias("label")) if isinstance(given, int) else spark.createDataFrame(list(enumerate(given)), ["idx", "label"])
                out.axes[axis] = rows
            elif source and axis in source.axes:
                out.axes[axis] = source.axes[axis]
            else:
                raise RuntimeError(f"no labels for the axis {axis}")
        for name, spec in specs.items():
            if spec.get("initialise"):
                out.add_dataset(name, spec["axes"], spec.get("type", "double"), spec.get("start", 0))
        for name in copy_from.datasets if copy_from else ():
            if name not in skip and name not in out.datasets and not set(copy_from.dims[name]) & set(axes):
                out.add(name, copy_from.datasets[name], copy_from.dims[name])
        return out

    def add_dataset(self, name: str, dims: list[str], kind: str = "double", start: float = 0) -> Container:
        """A dense dataset with the start value in every cell."""
        if missing := set(dims) - set(self.axes):
            raise RuntimeError(f"no such axes: {sorted(missing)}")
        cells = None
        for axis in dims:
            own = self.axes[axis].select(F.col("idx").alias(f"i_{axis}"))
            cells = own if cells is None else cells.join(own, F.lit(True))
        return self.add(name, cells.withColumn("value", F.lit(start).cast(kind)), dims)

    def copy_filtered(self, axis: str, selection: slice | list[int], exclude_axes: tuple[str, ...] = (), copy_without_selection: bool = False) -> Container:
        """Datasets under a selection of one axis: those with an excluded axis stay out, those without the axis
        too unless ``copy_without_selection`` is set."""
        out = self.select(**{axis: selection})
        keep = [n for n, dims in self.dims.items() if not set(dims) & set(exclude_axes) and (axis in dims or copy_without_selection)]
        out.datasets, out.dims = {n: out.datasets[n] for n in keep}, {n: out.dims[n] for n in keep}
        return out

    def project(self, *names: str) -> Container:
        """The named datasets alone."""
        if missing := set(names) - set(self.datasets):
            raise ValueError(f"no such datasets: {sorted(missing)}")
        return Container({n: self.datasets[n] for n in names}, dict(self.axes), {n: self.dims[n] for n in names}, dict(self.attrs), list(self.history))

    def add_history(self, name: str, entry: Any) -> None:
        if name == "order":
            raise ValueError("this name is reserved")
        self.history.append((name, entry))

    def select(self, **selections: slice | list[int]) -> Container:
        """Selects positions of axes, in every dataset that has them and in the axis tables."""
        unknown = set(selections) - set(self.axes)
        if unknown:
            raise RuntimeError(f"no such axes: {sorted(unknown)}")

        def cut(df: DataFrame, column: str, by: slice | list[int], n: int | None) -> DataFrame:
            return slice_axis(df, column, by.start or 0, by.stop, by.step or 1, n) if isinstance(by, slice) else take_axis(df, column, by)

        out = Container(dict(self.datasets), dict(self.axes), dict(self.dims), dict(self.attrs), list(self.history))
        for axis, by in selections.items():
            from_end = isinstance(by, slice) and any(x is not None and x < 0 for x in (by.start, by.stop, by.step))
            n = self.axes[axis].count() if from_end else None
            out.axes[axis] = cut(self.axes[axis], "idx", by, n)
            for name, dims in self.dims.items():
                if axis in dims:
                    out.datasets[name] = cut(out.datasets[name], f"i_{axis}", by, n)
        return out

    def save(self, path: str, mode: str = "errorifexists", compression: str = "zstd", preserve: bool = False) -> None:
        """Writes all tables aside and renames the folder last; a write that fails leaves nothing that loads.

        ``mode`` is "errorifexists" or "overwrite"; ``preserve`` keeps what a failed write has left aside."""
        if mode not in ("errorifexists", "overwrite"):
            raise ValueError(f"{mode} is no mode of saving")
        spark = next(iter([*self.datasets.values(), *self.axes.values()])).sparkSession
        with folders.committed(spark, path, mode == "overwrite", preserve) as aside:
            for kind, tables in (("data", self.datasets), ("axes", self.axes)):
                for name, df in tables.items():
                    df.write.option("compression", compression).parquet(f"{aside}/{kind}/{name}")
            rows = [(p, k, encode(v)) for p, own in self.attrs.items() for k, v in sorted(own.items())]
            spark.createDataFrame(rows, "path string, key string, json string").coalesce(1).write.parquet(f"{aside}/_attrs")
            rows = [(i, n, encode(e)) for i, (n, e) in enumerate(self.history)]
            spark.createDataFrame(rows, "seq int, name string, json string").coalesce(1).write.parquet(f"{aside}/_history")
            spec = json.dumps({"dims": self.dims, "axes": sorted(self.axes)})
            spark.createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{aside}/_spec")

    def append(self, path: str, axis: str = "time") -> None:
        """Adds this container to a saved one along an axis, wholly or not at all.

        Both have the same datasets, with the same axes and types of cells.  A writer that meets another one's
        rename fails, and may try again."""
        spark = next(iter([*self.datasets.values(), *self.axes.values()])).sparkSession
        held = load(spark, path)
        for name in sorted(set(held.datasets) | set(self.datasets)):
            mine, kept = self.datasets.get(name), held.datasets.get(name)
            if mine is None or kept is None or self.dims[name] != held.dims[name] or dict(mine.dtypes) != dict(kept.dtypes):
                raise ValueError(f"{name} doesn't fit what is in {path}")
        if axis not in held.axes or axis not in self.axes:
            raise ValueError(f"no axis {axis}")
        n, k = held.axes[axis].count(), len(appended(spark, path))
        more = Container(attrs=dict(self.attrs), history=list(self.history))
        more.axes[axis] = self.axes[axis].withColumn("idx", (F.col("idx") + n).cast(held.axes[axis].schema["idx"].dataType))
        for name, df in self.datasets.items():
            if axis in self.dims[name]:
                more.add(name, df.withColumn(f"i_{axis}", (F.col(f"i_{axis}") + n).cast(df.schema[f"i_{axis}"].dataType)), self.dims[name])
        more.save(f"{path}/more/{k}")


def appended(spark: SparkSession, path: str) -> list[str]:
    """The folders of what was appended, in order."""
    fs, at = folders.hadoop(spark, f"{path}/more")
    found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return [f"{path}/more/{k}" for k in sorted(int(x) for x in found if x.isdigit())]


def load(spark: SparkSession, path: str, datasets: list[str] | None = None) -> Container:
    """The container in a folder; datasets stay unread until they are used."""
    spec = json.loads(spark.read.text(f"{path}/_spec").first()[0])
    wanted = sorted(spec["dims"]) if datasets is None else datasets
    if missing := set(wanted) - set(spec["dims"]):
        raise ValueError(f"no such datasets: {sorted(missing)}")
    specs = [(p, json.loads(spark.read.text(f"{p}/_spec").first()[0])) for p in appended(spark, path)]

    def table(kind: str, name: str, having: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{kind}/{name}", *[f"{p}/{kind}/{name}" for p, own in specs if name in own[having]])

    out = Container({n: table("data", n, "dims") for n in wanted}, {a: table("axes", a, "axes") for a in spec["axes"]}, {n: spec["dims"][n] for n in wanted})
    for r in spark.read.parquet(f"{path}/_attrs").collect():
        out.attrs.setdefault(r["path"], {})[r["key"]] = json.loads(r["json"])
    out.history = [(r["name"], json.loads(r["json"])) for r in spark.read.parquet(f"{path}/_history").orderBy(F.col("seq")).collect()]
    return out


def concatenate(parts: list[Container], axis: str = "time", start: int = 0, stop: int | None = None, datasets: list[str] | None = None, dataset_filter: Callable[[str, DataFrame], DataFrame] | None = None) -> Container:
    """One container with the parts one after another along an axis.

    Datasets without the axis, attributes and history come from the first part; ``start`` and
    ``stop`` are positions of the whole axis, negative ones from its end."""
    first = parts[0]
    wanted = list(first.datasets) if datasets is None else datasets
    if missing := set(wanted) - set(first.datasets):
        raise ValueError(f"no such datasets: {sorted(missing)}")
    if any(axis not in p.axes for p in parts):
        raise ValueError(f"a part has no axis {axis}")
    lengths = [p.axes[axis].count() for p in parts]
    start, stop, _ = slice(start, stop).indices(sum(lengths))
    for k, part in enumerate(parts[1:], 1):
        for name in wanted:
            if name not in part.datasets or part.dims[name] != first.dims[name] or dict(part.datasets[name].dtypes) != dict(first.datasets[name].dtypes):
                raise ValueError(f"{name} of part {k} doesn't fit that of the first")

    def joined(frames: list[DataFrame], column: str) -> DataFrame:
        at, out = 0, None
        for df, n in zip(frames, lengths, strict=True):
            moved = df.withColumn(column, (F.col(column) + at).cast("long"))
            out, at = moved if out is None else out.unionByName(moved), at + n
        return slice_axis(out, column, start, stop)

    out = Container(axes=dict(first.axes), attrs=dict(first.attrs), history=list(first.history))
    out.axes[axis] = joined([p.axes[axis] for p in parts], "idx")
    for name in wanted:
        filtered = [p.datasets[name] if dataset_filter is None else dataset_filter(name, p.datasets[name]) for p in parts]
        out.add(name, joined(filtered, f"i_{axis}") if axis in first.dims[name] else filtered[0], first.dims[name])
    return out


def load_many(spark: SparkSession, paths: list[str], axis: str = "time", **options: Any) -> Container:
    """The containers of several folders, in the order given, concatenated along an axis."""
    return concatenate([load(spark, p) for p in paths], axis, **options)
