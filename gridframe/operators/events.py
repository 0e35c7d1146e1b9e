"""Roots of a column's function of time in intervals, and from them transits, risings and settings.

Each interval is a row.  A grid over it (``step`` apart) is evaluated in an array of the row, so
nothing is shuffled and each point is worked out once; a pair of neighbours of opposite signs brackets a root, and
steps of the Illinois rule (regula falsi that halves the end that stays) refine it inside one
expression, until a step would move it by less than doubles can tell (a fixed number at most).  A root that is nearer to another one than ``step`` may be missed with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions.sky import Body, Observer
from gridframe.functions.timescale import STELLAR_S, bound

DAY_S, GRID_DAYS, STEPS = 86400.0, 0.2, 12
#: A step that is smaller than this share of the time leads nowhere (two units in the last place).
SMALLEST = 4e-16
#: Sun or Moon and refraction at the horizon, degrees: the upper limb is on the horizon.
VISIBLE = 100.0 / 60


def refined(f: Callable[[Column], Column], a: Column, fa: Column, b: Column, fb: Column, steps: int = STEPS) -> Column:
    """The root of f between a and b, where f has opposite signs (or is 0)."""

    def step(s: Column, _: Column) -> Column:
        middle = F.when(s["fb"] == s["fa"], s["b"]).otherwise(s["b"] - s["fb"] * (s["b"] - s["a"]) / F.nullif(s["fb"] - s["fa"], F.lit(0.0)))

        def out(v: Column) -> Column:
            crossed = v["f"] * s["fb"] <= 0
            return F.struct(F.when(crossed, s["b"]).otherwise(s["a"]).alias("a"), F.when(crossed, s["fb"]).otherwise(s["fa"] / 2).alias("fa"), v["x"].alias("b"), v["f"].alias("fb"))

        def at(x: Column) -> Column:
            there = F.struct(s["a"].alias("a"), s["fa"].alias("fa"), x.alias("b"), F.lit(0.0).alias("fb"))
            return F.when(F.abs(x - s["b"]) <= F.abs(x) * SMALLEST, there).otherwise(bound(F.struct(x.alias("x"), f(x).cast("double").alias("f")), out))

        return F.when(s["fb"] == 0, s).otherwise(bound(middle, at))

    start = F.struct(a.cast("double").alias("a"), fa.cast("double").alias("fa"), b.cast("double").alias("b"), fb.cast("double").alias("fb"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["b"])


def roots(df: DataFrame, f: Callable[[Column], Column], start: Column, stop: Column | None = None, step_days: Column | float | None = None, rising: bool | None = None, steps: int = STEPS) -> DataFrame:
    """The rows of ``df``, each once a root of f from start to stop, with ``root`` and ``increasing``.

    Without a stop it is a stellar day after the start.  Without a step it is 0.2 days, or a fifth of an
    interval of less than a day.  ``rising`` keeps roots where f grows (True) or falls (False).
    Rows without a start give none; a stop that isn't after the start, or a step that isn't
    shorter than the interval, is an error.
    """
    held = df.withColumn("_a", start.cast("double")).withColumn("_z", F.col("_a") + DAY_S * STELLAR_S if stop is None else stop.cast("double"))
    length = F.col("_z") - F.col("_a")
    step = F.when(length >= DAY_S, GRID_DAYS * DAY_S).otherwise(length / 5) if step_days is None else F.lit(step_days) * DAY_S if not isinstance(step_days, Column) else step_days * DAY_S
    wrong = F.when(length <= 0, F.raise_error("an interval ends before it starts")).when(step >= length, F.raise_error("a search step is longer than its interval"))
    many = F.greatest(F.ceil(length / step), F.lit(2)).cast("int")
    held = held.where("_a is not null and _z is not null").withColumn("_n", F.coalesce(wrong.cast("int"), many))

    def value(t: Column) -> Column:
        return bound(t, lambda x: F.struct(x.alias("t"), f(x).cast("double").alias("f")))

    points = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: value(F.col("_a") + k * (F.col("_z") - F.col("_a")) / (F.col("_n") - 1)))
    crosses = {None: lambda p: p["l"]["f"] * p["r"]["f"] <= 0, True: lambda p: (p["l"]["f"] * p["r"]["f"] <= 0) & (p["l"]["f"] < p["r"]["f"]), False: lambda p: (p["l"]["f"] * p["r"]["f"] <= 0) & (p["l"]["f"] >= p["r"]["f"])}[rising]
    pairs = bound(points, lambda p: F.filter(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.struct(p[k - 1].alias("l"), p[k].alias("r"))), crosses))
    found = held.withColumn("_p", F.explode(pairs))
    left, right = F.col("_p.l"), F.col("_p.r")
    found = found.withColumns({"root": refined(f, left["t"], left["f"], right["t"], right["f"], steps), "increasing": left["f"] < right["f"]})
    return found.drop("_a", "_z", "_n", "_p")


def transit_times(df: DataFrame, observer: Observer, body: Body, start: Column, stop: Column | None = None, step_days: Column | float | None = None, lower: bool = False, return_dec: bool = False) -> DataFrame:
    """The rows, each once a transit, with ``time`` and, if asked for, ``dec`` (of date, seen from the observer)."""

    def angle(t: Column) -> Column:
        ha = observer.place(body, t)["ha"]
        return bound(ha, lambda h: F.when(h < 0, h + 180).otherwise(h - 180)) if lower else ha

    found = roots(df, angle, start, stop, step_days, rising=True).drop("increasing").withColumnRenamed("root", "time")
    return found.withColumn("dec", observer.place(body, F.col("time"))["dec"]) if return_dec else found


def rise_set_times(df: DataFrame, observer: Observer, body: Body, start: Column, stop: Column | None = None, step_days: Column | float | None = None, diameter: float = 0.0, rising: bool | None = None) -> DataFrame:
    """The rows, each once a rising or setting, with ``time`` and ``rising``; half of ``diameter`` (degrees) is below the horizon."""
    found = roots(df, lambda t: observer.altitude_of(body, t) + diameter / 2, start, stop, step_days, rising)
    return found.withColumnsRenamed({"root": "time", "increasing": "rising"})


def visible_rise_set_times(df: DataFrame, observer: Observer, body: Body, start: Column, stop: Column | None = None, step_days: Column | float | None = None, rising: bool | None = None) -> DataFrame:
    """Conventional risings and settings of the Sun or the Moon, with their size and refraction at the horizon."""
    return rise_set_times(df, observer, body, start, stop, step_days, VISIBLE, rising)
