"""Safe reciprocals, error-bounded truncation and complex numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One over the largest double and float; anything smaller has no finite reciprocal.
LEAST_DOUBLE, LEAST_FLOAT = 5.562684646268003e-309, 2.938735877055719e-39


def invert_no_zero(x: Column, single: bool = False) -> Column:
    """1/x, and 0 where x is too small for that to be finite."""
    return F.when(F.abs(x) < F.lit(LEAST_FLOAT if single else LEAST_DOUBLE), 0.0).otherwise(F.lit(1.0) / x)


def invert_no_zero_complex(z: Column) -> Column:
    """Reciprocal of struct(re, im), scaled by the larger part; 0 where both parts are too small."""
    re, im = z["re"], z["im"]
    most = F.greatest(F.abs(re), F.abs(im))
    tiny = most < F.lit(LEAST_DOUBLE)
    scale = F.when(tiny, 1.0).otherwise(most)
    x, y = re / scale, im / scale
    size = F.when(tiny, 1.0).otherwise(x * x + y * y)
    return F.struct(F.when(tiny, 0.0).otherwise(x / size / scale).alias("re"), F.when(tiny, 0.0).otherwise(-y / size / scale).alias("im"))


def max_non_zero(value: Column, weight: Column) -> Column:
    """The largest value with a weight above zero; of all values if there is none (an aggregate)."""
    return F.coalesce(F.max(F.when(weight > 0, value)), F.max(value))


def min_non_zero(value: Column, weight: Column) -> Column:
    """The smallest value with a weight above zero; of all values if there is none (an aggregate)."""
    return F.coalesce(F.min(F.when(weight > 0, value)), F.min(value))


def power_above(x: Column) -> Column:
    """The smallest power of two greater than x > 0."""
    guess = F.pow(F.lit(2.0), F.floor(F.log2(x)) + 1)
    return F.when(guess <= x, guess * 2).when(guess > 2 * x, guess / 2).otherwise(guess)


def bit_truncate(x: Column, error: Column, bits: int = 52) -> Column:
    """The multiple, nearest to x, of the smallest power of two above the error (ties to even).

    An error below the last of ``bits`` fraction bits changes nothing; a negative or
    infinite one gives 0.  A NaN error is an error."""
    infinite = F.lit(float("inf"))
    step = power_above(error)
    last = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - bits)
    checked = F.when(F.isnan(error), F.raise_error(F.lit("the error of a truncation is NaN")).cast("double"))
    return (
        checked.when((error == infinite) | (error == -infinite), 0.0)
        .when((x == 0) | (error == 0) | F.isnan(x) | (F.abs(x) == infinite), x)
        .when(F.abs(error) < last, x)
        .when(error < 0, 0.0)
        .otherwise(F.rint(x / step) * step)
    )


def bit_truncate_int(x: Column, error: Column) -> Column:
    """As bit_truncate, for integers: the error is at least that of a whole number."""
    return F.when(error < 0, F.lit(0).cast("long")).when(error == 0, x.cast("long")).otherwise((F.rint(x / power_above(error.cast("double"))) * power_above(error.cast("double"))).cast("long"))


def bit_truncate_relative(x: Column, precision: float) -> Column:
    return bit_truncate(x, F.abs(x * F.lit(float(precision))))


def bit_truncate_weights(x: Column, inverse_variance: Column, fallback: float) -> Column:
    """The error is the standard deviation; where none is known, ``fallback`` times the size of x."""
    return bit_truncate(x, F.when(inverse_variance == 0, F.abs(x * F.lit(float(fallback)))).otherwise(1 / F.sqrt(F.when(inverse_variance == 0, 1.0).otherwise(inverse_variance))))


def bit_truncate_max_complex(z: Column, precision: float, row_precision: float, row_max: Column) -> Column:
    """Truncates both parts to max(|z| * precision, row_precision * the largest |z| of the row)."""
    error = F.greatest(F.hypot(z["re"], z["im"]) * precision, row_max * row_precision)
    return F.struct(bit_truncate(z["re"], error, 23).alias("re"), bit_truncate(z["im"], error, 23).alias("im"))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def complex_angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def divmod_floor(x: Column, y: Column) -> Column:
    """Floored quotient and the remainder with the divisor's sign."""
    q = F.floor(x / y)
    return F.struct(q.cast("double").alias("quotient"), (x - q * y).alias("remainder"))
