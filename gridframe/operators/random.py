"""Random numbers that depend on the seed and the position alone, not on partitions.

Each number is made from a hash of the position, a seed and a stream (a counter-based generator), so a row
gets the same numbers wherever and however often it is worked out.  Distributions that reject
draw again from further streams; the attempts are bounded (``ATTEMPTS``), and all fail with a
probability below 10^-15.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridframe.functions.timescale import bound

ATTEMPTS = 32
#: Means from which Poisson numbers come by rejection, not by multiplying uniform ones.
LARGE_MEAN = 10.0


def seed_of(seed: int, *names: Column | str | int) -> Column:
    """A seed for a part of a job, mixed from the job's seed and the part's names (as ranks or tasks have)."""
    return F.xxhash64(F.lit(seed), *[n if isinstance(n, Column) else F.lit(n) for n in names])


def uniform(position: Column, seed: Column | int, stream: Column | int = 0) -> Column:
    """From 0 (included) to 1 (excluded), 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(position, F.lit(seed), F.lit(stream)), 11) / F.lit(float(1 << 53))


def normal(position: Column, seed: Column | int, stream: Column | int = 1) -> Column:
    """Standard normal, by Box and Muller's method; takes its stream and the next."""
    return F.sqrt(-2 * F.ln(1 - uniform(position, seed, stream))) * F.cos(2 * F.pi() * uniform(position, seed, stream + 1))


def integers(position: Column, seed: Column | int, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(uniform(position, seed, 3) * (high - low))).cast("long")


def exponential(position: Column, seed: Column | int, scale: Column | float = 1.0, stream: Column | int = 4) -> Column:
    return -F.ln(1 - uniform(position, seed, stream)) * scale


def power(position: Column, seed: Column | int, exponent: Column | float, stream: Column | int = 5) -> Column:
    """From 0 to 1, with a density that grows as x to the power ``exponent - 1``."""
    return F.pow(1 - uniform(position, seed, stream), 1 / F.lit(exponent))


def pareto(position: Column, seed: Column | int, exponent: Column | float, stream: Column | int = 6) -> Column:
    """From 0 on, with a density that falls as (1 + x) to the power ``-exponent - 1``."""
    return F.pow(1 - uniform(position, seed, stream), -1 / F.lit(exponent)) - 1


def gamma(position: Column, seed: Column | int, shape: Column | float, scale: Column | float = 1.0) -> Column:
    """By Marsaglia and Tsang's rejection from a cubed normal; shapes below 1 by a power of a further uniform."""
    k = F.lit(shape).cast("double")
    whole = F.when(k < 1, k + 1).otherwise(k)
    d = whole - 1.0 / 3

    def attempt(found: Column, n: Column) -> Column:
        x = normal(position, seed, 1000 + 3 * n)

        def judged(s: Column) -> Column:
            v = F.pow(1 + s["x"] / F.sqrt(9 * d), 3)
            good = (v > 0) & (F.ln(1 - uniform(position, seed, 1002 + 3 * n)) < 0.5 * s["x"] * s["x"] + d - d * v + d * F.ln(F.when(v > 0, v).otherwise(1.0)))
            return F.when(good, d * v)

        return F.when(found.isNotNull(), found).otherwise(bound(F.struct(x.alias("x")), judged))

    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("double"), attempt)
    return drawn * F.when(k < 1, F.pow(1 - uniform(position, seed, 999), 1 / k)).otherwise(1.0) * scale


def poisson(position: Column, seed: Column | int, mean: Column | float) -> Column:
    """Small means by multiplying uniform numbers, larger ones by Hoermann's transformed rejection."""
    lam = F.lit(mean).cast("double")

    def multiply(s: Column, n: Column) -> Column:
        p = s["p"] * (1 - uniform(position, seed, 2000 + n))
        return F.when(s["p"] <= F.exp(-lam), s).otherwise(F.struct(p.alias("p"), (s["k"] + (p > F.exp(-lam)).cast("long")).alias("k")))

    start = F.struct(F.lit(1.0).alias("p"), F.lit(0).cast("long").alias("k"))
    few = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, multiply, lambda s: s["k"])

    b = 0.931 + 2.53 * F.sqrt(lam)
    a = -0.059 + 0.02483 * b

    def attempt(found: Column, n: Column) -> Column:
        u, v = uniform(position, seed, 3000 + 2 * n) - 0.5, 1 - uniform(position, seed, 3001 + 2 * n)

        def judged(s: Column) -> Column:
            us = 0.5 - F.abs(s["u"])
            k = F.floor((2 * a / us + b) * s["u"] + lam + 0.43)
            at_once = (us >= 0.07) & (s["v"] <= 0.9277 - 3.6224 / (b - 2))
            hit = F.ln(s["v"] * (1.1239 + 1.1328 / (b - 3.4)) / (a / (us * us) + b)) <= k * F.ln(lam) - lam - log_factorial(k)
            return F.when((k >= 0) & (at_once | ((us >= 0.013) | (s["v"] <= us)) & hit), k)

        return F.when(found.isNotNull(), found).otherwise(bound(F.struct(u.alias("u"), v.alias("v")), judged))

    many = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("long"), attempt)
    return F.when(lam == 0, F.lit(0).cast("long")).when(lam < LARGE_MEAN, few).otherwise(many)


def log_factorial(k: Column) -> Column:
    """Stirling's series from 10 on, the sum of logarithms below."""
    x = F.greatest(k.cast("double"), F.lit(1.0))
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(k.cast("int"), F.lit(10)), F.lit(1))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))
    return F.when(k >= 10, series).otherwise(small)
