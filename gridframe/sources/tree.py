"""Groups of groups: datasets by path, with attributes, under one folder.

A tree is made of handles: copying it copies no cell, and a dataset is read when it is used.  Paths are
names between slashes; the root is "".  A saved tree is one Parquet folder a dataset and one table of
attributes, written aside and renamed last.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions import strings
from gridframe.operators.axes import slice_axis, take_axis
from gridframe.sources import folders
from gridframe.sources.store import encode


def clean(path: str) -> str:
    return "/".join(x for x in path.split("/") if x)


def above(path: str) -> list[str]:
    """The groups that hold a path, the root first."""
    names = path.split("/")
    return ["/".join(names[:i]) for i in range(len(names))] if path else []


@dataclass
class Tree:
    """Groups and datasets by path.  A dataset's cells have a position column for each axis named in ``dims``."""

    groups: set[str] = field(default_factory=lambda: {""})
    datasets: dict[str, DataFrame] = field(default_factory=dict)
    dims: dict[str, list[str]] = field(default_factory=dict)
    attrs: dict[str, dict[str, Any]] = field(default_factory=dict)

    def create_group(self, path: str) -> str:
        """A new group, with those above it; one that is there, or a dataset on the way, is an error."""
        path = clean(path)
        if path in self.groups or path in self.datasets:
            raise ValueError(f"{path} exists")
        return self.require_group(path)

    def require_group(self, path: str) -> str:
        path = clean(path)
        for p in [*above(path), path]:
            if p in self.datasets:
                raise TypeError(f"{p} is a dataset")
        self.groups.update([*above(path), path])
        return path

    def create_dataset(self, path: str, df: DataFrame, dims: list[str] = (), **attrs: Any) -> str:
        path = clean(path)
        if path in self.groups or path in self.datasets:
            raise ValueError(f"{path} exists")
        if missing := set(dims) - set(df.columns):
            raise ValueError(f"{path} has no columns {sorted(missing)}")
        self.require_group("/".join(path.split("/")[:-1]))
        self.datasets[path], self.dims[path] = df, list(dims)
        if attrs:
            self.attrs[path] = dict(attrs)
        return path

    def __contains__(self, path: str) -> bool:
        return clean(path) in self.groups or clean(path) in self.datasets

    def __getitem__(self, path: str) -> DataFrame | Tree:
        """The dataset at a path, or the group there as a tree of its own."""
        path = clean(path)
        if path in self.datasets:
            return self.datasets[path]
        if path not in self.groups:
            raise KeyError(path)
        start = len(path) + 1 if path else 0
        inside = [p for p in (*self.groups, *self.datasets) if not path or p == path or p.startswith(f"{path}/")]
        own = {p: p[start:] for p in inside}
        return Tree({own[p] for p in inside if p in self.groups}, *[{own[p]: d[p] for p in inside if p in d} for d in (self.datasets, self.dims, self.attrs)])

    def __delitem__(self, path: str) -> None:
        """Takes a dataset out, or a group with all that it holds."""
        path = clean(path)
        if path not in self or not path:
            raise KeyError(path)
        gone = [p for p in (*self.groups, *self.datasets) if p == path or p.startswith(f"{path}/")]
        for p in gone:
            self.groups.discard(p)
            for d in (self.datasets, self.dims, self.attrs):
                d.pop(p, None)

    def children(self, path: str = "") -> list[str]:
        """Names right below a group, in order."""
        path = clean(path)
        if path not in self.groups:
            raise KeyError(path)
        return sorted({p.split("/")[-1] for p in (*self.groups, *self.datasets) if p and "/".join(p.split("/")[:-1]) == path})

    def walk(self) -> Iterator[tuple[str, bool]]:
        """(path, whether a dataset) of all that is below the root, a group before what it holds."""
        yield from sorted([*((p, False) for p in self.groups if p), *((p, True) for p in self.datasets)], key=lambda x: x[0].split("/"))

    def sizes(self) -> DataFrame:
        """(path, cells) of every dataset, counted in one job."""
        if not self.datasets:
            raise ValueError("a tree without datasets")
        return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("cells")).select(F.lit(p).alias("path"), "cells") for p, df in self.datasets.items()])

    def copy(self, selections: dict[str, slice | list[int]] | None = None, within: str = "", keep: Callable[[str], bool] | None = None, as_text: bool = False, as_bytes: bool = False, shared: tuple[str, ...] = ()) -> Tree:
        """A copy of a group, with a selection on each named axis of every dataset that has it.

        ``keep`` tells by path which datasets are copied; bytes become text, or text bytes, on demand.  Datasets
        named as ``shared`` are handed on as they are: a selection that would cut one is an error, as is one
        of an axis that no dataset has."""
        if as_text and as_bytes:
            raise ValueError("text or bytes")
        source, selections = self[within] if clean(within) else self, selections or {}
        if not isinstance(source, Tree):
            raise TypeError(f"{within} is a dataset")
        if unknown := set(selections) - {a for d in source.dims.values() for a in d}:
            raise ValueError(f"no such axes: {sorted(unknown)}")
        out = Tree(set(source.groups))
        for path, df in source.datasets.items():
            if keep is not None and not keep(path):
                continue
            cut = [a for a in source.dims[path] if a in selections]
            if path in shared:
                if cut:
                    raise ValueError(f"{path} is shared and can't be selected from")
            else:
                for axis in cut:
                    df = selected(df, axis, selections[axis])
                df = strings.ensure_unicode(df) if as_text else strings.ensure_bytes(df) if as_bytes else df
            out.create_dataset(path, df, source.dims[path])
        out.attrs = {p: dict(a) for p, a in source.attrs.items() if p in out}
        return out

    def save(self, spark: SparkSession, path: str, overwrite: bool = False, compression: str = "zstd") -> None:
        """Writes all datasets aside and renames the folder when all are there."""
        with folders.committed(spark, path, overwrite) as aside:
            for name, df in self.datasets.items():
                df.write.option("compression", compression).parquet(f"{aside}/data/{name}/_cells")
            rows = [(p, False, None, encode(self.attrs.get(p, {}))) for p in sorted(self.groups)]
            rows += [(p, True, self.dims[p], encode(self.attrs.get(p, {}))) for p in sorted(self.datasets)]
            spark.createDataFrame(rows, "path string, dataset boolean, dims array<string>, attrs string").coalesce(1).write.parquet(f"{aside}/_tree")


def selected(df: DataFrame, axis: str, by: slice | list[int]) -> DataFrame:
    if not isinstance(by, slice):
        return take_axis(df, axis, by).select(*df.columns)
    from_end = any(x is not None and x < 0 for x in (by.start, by.stop))
    n = df.agg(F.coalesce(F.max(axis) + 1, F.lit(0))).first()[0] if from_end else None
    return slice_axis(df, axis, by.start or 0, by.stop, by.step or 1, n)


def load(spark: SparkSession, path: str, within: str = "") -> Tree:
    """The tree in a folder, or a group of it; datasets stay unread until they are used."""
    out, held = Tree(), clean(within)
    rows = spark.read.parquet(f"{path}/_tree").collect()  # one row a group or dataset
    if held and not any(r["path"] == held for r in rows):
        raise KeyError(held)
    for r in rows:
        if held and r["path"] != held and not r["path"].startswith(f"{held}/"):
            continue
        if r["dataset"]:
            out.create_dataset(r["path"], spark.read.parquet(f"{path}/data/{r['path']}/_cells"), r["dims"])
        else:
            out.require_group(r["path"])
        if own := json.loads(r["attrs"]):
            out.attrs[r["path"]] = own
    return out[held] if held else out
