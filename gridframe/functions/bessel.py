"""Spherical Bessel functions of the first kind and their derivatives, for orders and arguments from 0 on.

Where the argument exceeds the order the recurrence runs upwards; below, it runs downwards from far
above the order (Miller) and is scaled by the known functions of orders 0 and 1.  Orders over 20 use
the asymptotic series where the argument is under a fifth or over ten times of the order.  Null
and negative arguments or orders give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridframe.functions.timescale import bound

HALF_PI = 1.5707963267948966
#: Orders above this have asymptotic branches; below and above these ratios of argument and order.
LARGE_ORDER, LOW, HIGH = 20, 0.2, 10.0
#: A downward run is scaled back when it grows beyond this.
OVERFLOW = 1e120


def below(order: Column, z: Column) -> Column:
    """Uniform series for arguments well under the order."""
    nu = order + 0.5

    def series(r: Column) -> Column:
        t = nu / r
        corrections = 1 + (3 - 5 * t * t) / (24 * r) + (81 - 462 * t * t + 385 * t * t * t * t) / (1152 * r * r)
        return F.exp(r - nu * F.acosh(nu / z)) * corrections / (2 * F.sqrt(z * r))

    return bound(F.sqrt(nu * nu - z * z), series)


def beyond(order: Column, z: Column) -> Column:
    """Uniform series for arguments well over the order."""
    nu = order + 0.5

    def series(r: Column) -> Column:
        t = nu / r
        phase = r - nu * F.acos(nu / z) - HALF_PI / 2
        return (F.cos(phase) * (1 - (81 + 462 * t * t + 385 * t * t * t * t) / (1152 * r * r)) + F.sin(phase) * (3 + 5 * t * t) / (24 * r)) / F.sqrt(z * r)

    return bound(F.sqrt(z * z - nu * nu), series)


def first(z: Column) -> tuple[Column, Column]:
    """Orders 0 and 1 of a positive argument; the second by its series where the difference would cancel."""
    small = z / 3 - F.pow(z, 3) / 30 + F.pow(z, 5) / 840
    return F.sin(z) / z, F.when(z < 0.02, small).otherwise((F.sin(z) / z - F.cos(z)) / z)


def upwards(order: Column, z: Column) -> Column:
    j0, j1 = first(z)

    def step(s: Column, k: Column) -> Column:
        return F.struct(s["b"].alias("a"), ((2 * k + 1) / z * s["b"] - s["a"]).alias("b"))

    start = F.struct(j0.alias("a"), j1.alias("b"))
    steps = F.when(order > 0, F.slice(F.sequence(F.lit(0).cast("long"), order), 2, F.greatest((order - 1).cast("int"), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(order == 0, j0).otherwise(F.aggregate(steps, start, step, lambda s: s["b"]))


def downwards(order: Column, z: Column) -> Column:
    j0, j1 = first(z)
    top = order + 20 + F.ceil(F.sqrt(40.0 * (order + 1)))

    def step(s: Column, k: Column) -> Column:  # from orders k and k + 1 to k - 1
        def scaled(c: Column) -> Column:
            less = F.when(F.abs(c) > OVERFLOW, 1 / OVERFLOW).otherwise(1.0)
            return F.struct((s["a"] * less).alias("b"), (c * less).alias("a"), (F.when(k - 1 == order, c).otherwise(s["own"]) * less).alias("own"))

        return bound((2 * k + 1) / z * s["a"] - s["b"], scaled)

    zero = F.struct(F.lit(0.0).alias("b"), F.lit(1e-60).alias("a"), F.lit(0.0).alias("own"))
    run = F.aggregate(F.sequence(top, F.lit(1).cast("long"), F.lit(-1).cast("long")), zero, step)
    # two neighbours can't both be near 0, so both scale the run
    return bound(run, lambda s: s["own"] * (j0 * s["a"] + j1 * s["b"]) / (s["a"] * s["a"] + s["b"] * s["b"]))


def jl(order: Column, z: Column) -> Column:
    def of(s: Column) -> Column:
        n, x = s["n"], s["z"]
        large = n > LARGE_ORDER
        known = F.when((n < 0) | (x < 0) | F.isnan(x), None).when(x == 0, F.when(n == 0, 1.0).otherwise(0.0)).when(n == 0, F.sin(x) / x)
        return known.when(large & (x < LOW * n), below(n, x)).when(large & (x > HIGH * n), beyond(n, x)).when(x > n, upwards(n, x)).otherwise(downwards(n, x))

    return bound(F.struct(order.cast("long").alias("n"), z.cast("double").alias("z")), of)


def jl_d(order: Column, z: Column) -> Column:
    """First derivative (null at 0)."""
    return order / F.nullif(z.cast("double"), F.lit(0.0)) * jl(order, z) - jl(order + 1, z)


def jl_d2(order: Column, z: Column) -> Column:
    """Second derivative (null at 0)."""
    x = F.nullif(z.cast("double"), F.lit(0.0))
    return (order * (order - 1) / (x * x) - 1) * jl(order, z) + 2 / x * jl(order + 1, z)
