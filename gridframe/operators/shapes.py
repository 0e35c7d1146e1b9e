"""Shapes of arrays in cell layout: reshaping, masks, reductions that keep their axes, and broadcasting.

A shape is a dict of axes, in order, with their lengths; cells that are not there count as no cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.operators.axes import AxisException
from gridframe.operators.series import with_positions

#: Reductions with the value that no cell at all gives (null: undefined, as for the minimum).
REDUCTIONS = {
    "sum": (F.sum, 0),
    "prod": (F.product, 1),
    "min": (lambda c: F.when(F.bool_or(F.isnan(c.cast("double"))), F.lit(float("nan"))).otherwise(F.min(c)), None),
    "max": (F.max, None),
    "mean": (F.avg, None),
    "all": (F.bool_and, True),
    "any": (F.bool_or, False),
    "count": (F.count, 0),
}


def runs_between(shape: dict[str, int | None], kept: list[str]) -> list[list[str]]:
    """The axes before, between and after those kept."""
    runs: list[list[str]] = [[]]
    for axis in shape:
        if axis in kept:
            runs.append([])
        else:
            runs[-1].append(axis)
    return runs


def resolved(old: list[int], new: list[int]) -> list[int]:
    """The new lengths with -1 worked out; both sides have as many cells."""
    cells, known = math.prod(old), math.prod(n for n in new if n != -1)
    if new.count(-1) == 1 and known and cells % known == 0:
        return [cells // known if n == -1 else n for n in new]
    if -1 in new or cells != known:
        raise ValueError(f"axes of {old} can't become {new}")
    return new


def reshape(df: DataFrame, shape: dict[str, int | None], into: dict[str, int | None]) -> DataFrame:
    """Axes of one shape become those of another, the last one running fastest; no cell moves.

    An axis of length None is kept: it stands in both shapes, in the same order, and the axes between two
    kept ones have as many cells before and after.  One -1 a run is worked out from the rest."""
    kept = [a for a, n in shape.items() if n is None]
    if kept != [a for a, n in into.items() if n is None]:
        raise AxisException(f"the axes {kept} are kept, in this order")
    made: dict[str, Column] = {}
    whole = df
    for old, new in zip(runs_between(shape, kept), runs_between(into, kept), strict=True):
        sizes = [shape[a] for a in old]
        if new.count(-1) > 1 or [into[a] for a in new].count(-1) > 1:
            raise ValueError("one length at most is -1")
        lengths = resolved(sizes, [into[a] for a in new])
        flat = F.lit(0).cast("long")
        for axis, n in zip(old, sizes, strict=True):
            flat = flat * n + F.col(axis)
        inner = 1
        for axis, n in reversed(list(zip(new, lengths, strict=True))):
            made[axis] = F.pmod(F.floor(flat / inner), F.lit(n)).cast("long")
            inner *= n
    rest = [c for c in whole.columns if c not in shape]
    if clash := set(rest) & set(into):
        raise ValueError(f"{sorted(clash)} are columns of values")
    return whole.select(*[F.col(a) if a in kept else made[a].alias(a) for a in into], *rest)


def ravel(df: DataFrame, shape: dict[str, int], name: str = "i") -> DataFrame:
    """One axis of all cells, the last axis of the shape running fastest."""
    return reshape(df, shape, {name: -1})


def mask_axis(df: DataFrame, axis: str, mask: DataFrame) -> DataFrame:
    """Cells at the positions where ``mask`` (idx, keep) is true, numbered anew in their order.

    Null is false.  The mask is numbered by ranges of positions and joined, so it may be as long as the data."""
    wanted = with_positions(mask.where("keep").select("idx"), ["idx"], "_to")
    return df.join(wanted, F.col(axis) == F.col("idx")).drop("idx", axis).withColumnRenamed("_to", axis)


def reduce_over(df: DataFrame, shape: list[str], value: str, how: str, over: list[str] | None = None, keepdims: bool = False, fixed: str | None = None, name: str | None = None) -> DataFrame:
    """A reduction over some axes (None: over all, one row).

    ``keepdims`` leaves a reduced axis with position 0; an axis that is ``fixed`` can't be reduced.  Where all
    axes are reduced and there is no cell, a sum is 0, a product 1, ``all`` true, ``any`` false, others null."""
    over = list(shape) if over is None else over
    if unknown := set(over) - set(shape):
        raise AxisException(f"no such axes: {sorted(unknown)}")
    if fixed in over:
        raise AxisException(f"{fixed} is fixed")
    if how not in REDUCTIONS:
        raise ValueError(f"{how} is no reduction")
    f, start = REDUCTIONS[how]
    keep = [a for a in shape if a not in over]
    total = f(F.col(value)) if start is None else F.coalesce(f(F.col(value)), F.lit(start))
    out = df.groupBy(*keep).agg(total.alias(name or value))
    return out.select(*[F.lit(0).cast("long").alias(a) if a in over else a for a in shape if a not in over or keepdims], name or value)


def broadcast_shapes(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    """The shape of an operation on two arrays: by axis name, a length of 1 is repeated, others must be equal."""
    out = dict(a)
    for axis, n in b.items():
        if axis in out and 1 not in (out[axis], n) and out[axis] != n:
            raise AxisException(f"{axis} has {out[axis]} and {n} positions")
        out[axis] = n if out.get(axis, 1) == 1 else out[axis]
    return out


def together(a: DataFrame, a_shape: dict[str, int], b: DataFrame, b_shape: dict[str, int]) -> DataFrame:
    """Cells of two arrays side by side in their common shape (columns: its axes, then the values of both).

    They are joined on the axes along which both have more than one position.  Where there is none, one of
    both must be a single cell; two arrays that share no axis have no cells side by side."""
    shape = broadcast_shapes(a_shape, b_shape)
    joint = [x for x in shape if a_shape.get(x, 1) > 1 and b_shape.get(x, 1) > 1]
    values = [[c for c in df.columns if c not in own] for df, own in ((a, a_shape), (b, b_shape))]
    if clash := set(values[0]) & set(values[1]):
        raise ValueError(f"{sorted(clash)} are values of both")
    left, right = (df.drop(*[x for x in own if own[x] == 1]) for df, own in ((a, a_shape), (b, b_shape)))
    if joint:
        both = left.join(right, joint)
    elif max(b_shape.values(), default=1) == 1:
        both = left.join(F.broadcast(right.limit(1)))  # a shape of ones has one cell
    elif max(a_shape.values(), default=1) == 1:
        both = right.join(F.broadcast(left.limit(1)))
    else:
        raise AxisException("the arrays share no axis")
    return both.select(*[F.col(x) if shape[x] > 1 else F.lit(0).cast("long").alias(x) for x in shape], *values[0], *values[1])
