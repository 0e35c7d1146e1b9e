"""A lazy reader of many containers along one axis: which are opened is planned from their axis tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.sources import folders
from gridframe.sources.store import Container, load

PART = r"^(.*)/(?:axes|data)/"


def part_of() -> Column:
    """The container's folder that a row was read from; slashes after the scheme are told apart by no one."""
    return F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), PART, 1), "^([a-z0-9]+):/+", "$1:/")


@dataclass
class Reader:
    """Containers found by patterns, one after another along ``axis``, with selections that are applied when it reads.

    Labels grow along the axis and from part to part.  Only axis tables are read to plan; the driver gets
    one small row a part.  Parts outside the selection aren't opened, parts on its edges are read
    under a pushed filter, and all others in one scan."""

    spark: SparkSession
    patterns: str | list[str]
    axis: str = "time"
    datasets: list[str] | None = None
    start: int = 0
    stop: int | None = None
    parts: list[tuple[str, int, int]] = field(init=False)  # path, first position, length

    def __post_init__(self) -> None:
        paths = folders.find(self.spark, self.patterns)
        sizes = {r["part"]: r["n"] for r in self.axis_rows(paths).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        at, self.parts = 0, []
        for path in paths:
            n = sizes.get(self.known(path), 0)
            self.parts.append((path, at, n))
            at += n

    def known(self, path: str) -> str:
        """A path as ``part_of`` gives it."""
        fs, at = folders.hadoop(self.spark, path)
        return re.sub("^([a-z0-9]+):/+", r"\1:/", fs.makeQualified(at).toUri().toString())

    def axis_rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{p}/axes/{self.axis}" for p in paths]).select("idx", "label", part_of().alias("part"))

    @property
    def length(self) -> int:
        return sum(n for _, _, n in self.parts)

    def select_index_range(self, start: int | None = None, stop: int | None = None) -> Reader:
        """Positions from start to stop; negative ones count from the end."""
        self.start, self.stop, _ = slice(start, stop).indices(self.length)
        self.stop = max(self.start, self.stop)
        return self

    def select_range(self, low: Any = None, high: Any = None) -> Reader:
        """Positions whose labels are from low (included) to high (excluded)."""
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("label") >= F.lit(low))
        if high is not None:
            inside = inside & (F.col("label") < F.lit(high))
        offsets = {self.known(p): at for p, at, _ in self.parts}
        found = self.axis_rows([p for p, _, n in self.parts if n]).where(inside).groupBy("part").agg(F.min("idx").alias("low"), F.max("idx").alias("high")).collect()
        if not found:
            self.start = self.stop = 0
            return self
        self.start = min(offsets[r["part"]] + r["low"] for r in found)
        self.stop = max(offsets[r["part"]] + r["high"] for r in found) + 1
        return self

    def select_datasets(self, *names: str) -> Reader:
        self.datasets = list(names)
        return self

    def plan(self) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int]]]:
        """Parts that are read whole (path, shift of positions), and those on an edge with the first and last position wanted."""
        stop = self.length if self.stop is None else self.stop
        whole, edges = [], []
        for path, at, n in self.parts:
            if n and self.start < stop and at < stop and at + n > self.start:
                if at >= self.start and at + n <= stop:
                    whole.append((path, at - self.start))
                else:
                    edges.append((path, at - self.start, max(0, self.start - at), min(n, stop - at) - 1))
        return whole, edges

    def read(self) -> Container:
        """One container; datasets without the axis, attributes and history are those of the first part that is read."""
        whole, edges = self.plan()
        first = load(self.spark, ([*whole, *edges] or [(self.parts[0][0], 0)])[0][0], self.datasets)
        out = Container(axes=dict(first.axes), attrs=dict(first.attrs), history=list(first.history))

        def joined(below: str, column: str, empty: DataFrame) -> DataFrame:
            found = None
            if whole:
                shifts = F.broadcast(self.spark.createDataFrame([(self.known(p), s) for p, s in whole], "part string, shift long"))  # a row a part
                rows = self.spark.read.parquet(*[f"{p}/{below}" for p, _ in whole]).select("*", part_of().alias("part"))
                found = rows.join(shifts, "part").withColumn(column, F.col(column) + F.col("shift")).drop("part", "shift")
            for path, shift, low, high in edges:
                own = self.spark.read.parquet(f"{path}/{below}").where(F.col(column).between(low, high)).withColumn(column, F.col(column) + shift)
                found = own if found is None else found.unionByName(own)
            return empty.where("false") if found is None else found.select(*empty.columns)

        out.axes[self.axis] = joined(f"axes/{self.axis}", "idx", first.axes[self.axis])
        for name, df in first.datasets.items():
            out.add(name, joined(f"data/{name}", f"i_{self.axis}", df) if self.axis in first.dims[name] else df, first.dims[name])
        return out


def load_each(spark: SparkSession, patterns: str | list[str] | list[dict[str, Any]], datasets: list[str] | None = None, **selections: slice | list[int]) -> Iterator[Container]:
    """The containers one by one, lazily, each under selections of its axes and with the attribute ``tag``.

    Groups are dicts with ``tag`` and ``files`` (patterns): a group's containers have its tag and a number."""
    groups = [{"files": patterns}] if isinstance(patterns, str) or not patterns or isinstance(patterns[0], str) else patterns
    for group in groups:
        for k, path in enumerate(folders.find(spark, group["files"])):
            held = load(spark, path, datasets)
            chosen = {a: s for a, s in selections.items() if a in held.axes}
            held = held.select(**chosen) if chosen else held
            tag = f"{group['tag']}_{k}" if "tag" in group else path.rstrip("/").rpartition("/")[2]
            held.attrs[""] = {**held.attrs.get("", {}), "tag": tag}
            yield held


def load_from_attrs(spark: SparkSession, template: str, container: Container, **options: Any) -> Container:
    """The container whose path is a template filled from another one's attributes."""
    own = container.attrs.get("", {})
    try:
        path = template.format(**own)
    except KeyError as missing:
        raise KeyError(f"the container has no attribute {missing}") from None
    return load(spark, path, **options)


def save_output(spark: SparkSession, container: Container, template: str, task: str, parameters: dict[str, Any], overwrite: bool = False) -> str:
    """Saves under a path filled from the attributes, with the task, its parameters and versions in the history."""
    import pyspark

    path = template.format(**container.attrs.get("", {}))
    held = Container(dict(container.datasets), dict(container.axes), dict(container.dims), dict(container.attrs), list(container.history))
    held.add_history(task, {"parameters": json.loads(json.dumps(parameters, default=str)), "versions": {"pyspark": pyspark.__version__}})
    held.save(path, "overwrite" if overwrite else "errorifexists")
    return path
