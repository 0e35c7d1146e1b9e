"""Steps from containers to containers: tags and attributes, a gate for bad values, and committed results.

A step is a function of containers; what it makes stays lazy until a gate counts bad values or a result
is saved.  One job a result does each of these, over all of its datasets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.sources.store import Container, load

FLOATING = (T.FloatType, T.DoubleType)


def bad(value: Column, kind: T.DataType) -> Column | None:
    """Whether a value, or any number within it, is NaN or infinite; nothing for kinds that hold no such number."""
    if isinstance(kind, FLOATING):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    if isinstance(kind, T.ArrayType):
        if bad(F.lit(None), kind.elementType) is None:
            return None
        return F.coalesce(F.exists(value, lambda x: bad(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.StructType):
        inner = [b for f in kind.fields if (b := bad(value[f.name], f.dataType)) is not None]
        return reduce(Column.__or__, inner) if inner else None
    return None


def census(held: Container) -> DataFrame | None:
    """(dataset, cells, bad): cells of each dataset, and those with a NaN or infinite value; nothing if no
    dataset can hold one.  One job over all datasets."""
    parts = []
    for name, df in held.datasets.items():
        inner = [b for f in df.schema.fields if (b := bad(F.col(f"`{f.name}`"), f.dataType)) is not None]
        if inner:
            parts.append(df.agg(F.count(F.lit(1)).alias("cells"), F.count_if(reduce(Column.__or__, inner)).alias("bad")).select(F.lit(name).alias("dataset"), "cells", "bad"))
    return reduce(DataFrame.unionByName, parts) if parts else None


@dataclass
class ContainerStep:
    """A function of containers, and what is done with each container that it makes.

    ``tag``, ``save_to`` and ``bad_to`` are templates of ``tag`` (the first input's, else the count), ``input_tags``,
    ``count``, ``name`` and the result's own attributes.  Results with bad values are saved at ``bad_to`` if it is
    set, and dropped unless ``drop_bad`` is off.  ``attrs`` are set on each result, with text filled in as a template.
    ``config`` goes to the history of what is saved."""

    run: Callable[..., Container | None]
    name: str = ""
    tag: str = "{tag}"
    attrs: dict[str, Any] = field(default_factory=dict)
    gate: bool = True
    drop_bad: bool = True
    bad_to: str | None = None
    save_to: str | None = None
    config: dict[str, Any] = field(default_factory=dict)
    count: int = 0

    def __post_init__(self) -> None:
        self.name = self.name or self.run.__name__

    def __call__(self, *inputs: Container) -> Container | None:
        """The result for these inputs; nothing if the function made none or the gate dropped it."""
        made = self.run(*inputs)
        tags = [str(c.attrs.get("", {}).get("tag", "")) for c in inputs]
        place, self.count = self.count, self.count + 1
        if made is None:
            return None
        own = made.attrs.get("", {})
        parts = {**own, "tag": own.get("tag") or next((t for t in tags if t), place), "input_tags": tags, "count": place, "name": self.name}
        filled = {k: v.format(**parts) if isinstance(v, str) else v for k, v in {**self.attrs, "tag": self.tag}.items()}
        out = Container(dict(made.datasets), dict(made.axes), dict(made.dims), {**made.attrs, "": {**own, **filled, "input_tags": tags}}, list(made.history))
        parts |= filled
        if self.gate and (found := census(out)) is not None and not found.where("bad > 0").isEmpty():
            if self.bad_to is not None:
                self.commit(out, self.bad_to.format(**parts))
            if self.drop_bad:
                return None
        return out if self.save_to is None else self.commit(out, self.save_to.format(**parts))

    def commit(self, out: Container, path: str) -> Container:
        """The container saved with the step in its history, and read again, so nothing is worked out twice."""
        out.add_history(self.name, {"config": self.config, "input_tags": out.attrs[""]["input_tags"]})
        out.save(path)
        return load(next(iter([*out.datasets.values(), *out.axes.values()])).sparkSession, path)

    def over(self, inputs: Iterable[Container | tuple[Container, ...]]) -> Iterator[Container]:
        """The results for each input, or tuple of them, in turn."""
        for each in inputs:
            made = self(*(each if isinstance(each, tuple) else (each,)))
            if made is not None:
                yield made


def first_of(parts: Iterable[Container]) -> Container | None:
    return next(iter(parts), None)


def last_of(parts: Iterable[Container]) -> Container | None:
    out = None
    for out in parts:
        pass
    return out


def stacked(parts: Iterable[Container], dataset: str) -> DataFrame:
    """One dataset of several containers below one another, with the ``tag`` of each."""
    frames = [c.datasets[dataset].withColumn("tag", F.lit(str(c.attrs.get("", {}).get("tag", i)))) for i, c in enumerate(parts)]
    if not frames:
        raise ValueError("no containers")
    return reduce(DataFrame.unionByName, frames)
