"""Weighted quantiles and moving weighted medians."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("split", "lower", "higher")
#: Groups whose places may go through the driver (one row each), and rows of a group that one task orders at once.
FEW_GROUPS, FEW_ROWS = 10_000, 1 << 17


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float = 0.5, method: str = "split", name: str = "quantile", keep_type: bool = False) -> DataFrame:
    """One weighted quantile for each group; ``by`` may be empty.

    Where all weights are 0 all count as 1.  Where the target falls between two values the
    method takes the lower, the higher or their mean; ``keep_type`` gives the type of the
    values, a mean of integers truncated.  Null values take no part (a group of them has no
    row), null weights are 0, weights are not negative.

    No task orders a whole group: weights are added up in buckets of values (combined before
    the shuffle), the bucket of the target is found and divided again, and only the values of
    the last one, some 2^21 distinct doubles at most, are ordered.  Each level reads the input
    once; places of up to ``FEW_GROUPS`` groups are broadcast, those of more are joined."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if not 0 <= q <= 1:
        raise ValueError("q must be from 0 to 1")
    rows = df.select(*by, F.col(value).alias("_v"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w")).where("_v is not null")
    place = None
    for key in (coarse, fine):
        near = cumulated(inside(rows, by, place), by, key(F.col("_v")), q, place is None).where("_near")
        span = near.groupBy(*by).agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.min("_before").alias("_base"), F.max("_t").alias("_t"), F.max("_unit").alias("_unit"), F.sum("_n").alias("_rows"))
        few = span.limit(FEW_GROUPS + 1).toArrow()
        if few.num_rows > FEW_GROUPS:
            place = span, key
            continue
        place = F.broadcast(df.sparkSession.createDataFrame(few, span.schema)), key
        if max((n or 0 for n in few.column("_rows").to_pylist()), default=0) <= FEW_ROWS:
            break
    placed = cumulated(inside(rows, by, place), by, F.col("_v"), q, False)
    low, high = (F.min(F.when(condition, F.col("_key"))) for condition in (F.col("_c") >= F.col("_t"), F.col("_c") > F.col("_t")))
    ends = placed.groupBy(*by).agg(F.coalesce(low, F.max("_key")).alias("_lo"), high.alias("_hi"))
    return ends.select(*by, pick(F.col("_lo"), F.coalesce("_hi", "_lo"), method, rows.schema["_v"].dataType, keep_type).alias(name))


def coarse(value: Column) -> Column:
    """A number that grows with the value: the bucket of its logarithm, in 4096 for each factor of e; NaN is last."""
    x = value.cast("double")
    size = F.least(F.floor((F.log(F.when(x == 0, 1.0).otherwise(F.abs(x))) + 745) * 4096), F.lit(1 << 39)) + 1
    return F.when(F.isnan(x), F.lit(1 << 40)).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


def fine(value: Column) -> Column:
    """The coarse bucket and the part of it that holds the value, in some 2^20 equal parts."""
    k, x = coarse(value), value.cast("double")
    edge = F.greatest(F.exp((F.abs(k) - 1) / F.lit(4096.0) - 745), F.lit(5e-324))
    part = F.floor(F.abs(x) / edge * F.lit(2.0**32))
    return F.struct(k.alias("k"), F.when((x == 0) | F.isnan(x), F.lit(0)).when(x > 0, part).otherwise(-part).alias("part"))


def inside(rows: DataFrame, by: list[str], place: tuple[DataFrame, Callable[[Column], Column]] | None) -> DataFrame:
    """The rows whose bucket is one of those found for their group."""
    if place is None:
        return rows
    span, key = place
    span = span.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_low", "_high", "_base", "_t", "_unit")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.lit(True))
    return rows.join(span, same).where(key(F.col("_v")).between(F.col("_low"), F.col("_high")))


def cumulated(rows: DataFrame, by: list[str], key: Column, q: float, start: bool) -> DataFrame:
    """For each key: its weight, the weight up to it, the group's target, and whether the quantile may lie at it."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = rows.groupBy(*by, key.alias("_key"), *([] if start else ["_base", "_t", "_unit"])).agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"))
    if start:
        sums = sums.withColumns({"_unit": F.sum("_w").over(group) == 0, "_base": F.lit(0.0)})
    sums = sums.withColumn("_w", F.when(F.col("_unit"), F.col("_n").cast("double")).otherwise(F.col("_w"))).where("_w > 0")
    order = group.orderBy("_key")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_c", F.col("_base") + F.sum("_w").over(upto))
    if start:
        sums = sums.withColumn("_t", F.lit(float(q)) * F.max("_c").over(group))
    sums = sums.withColumns({"_before": F.lag("_c").over(order), "_after": F.lead("_c").over(order)})
    c, t, before = F.col("_c"), F.col("_t"), F.col("_before")
    near = (c >= t) & (before.isNull() | (before < t)) | (c > t) & (before.isNull() | (before <= t)) | (c < t) & F.col("_after").isNull()
    return sums.withColumns({"_near": near, "_before": F.coalesce("_before", "_base")})


def pick(low: Column, high: Column, method: str, kind: T.DataType | None = None, keep_type: bool = False) -> Column:
    whole = isinstance(kind, T.IntegralType)
    if whole and method == "split":
        low, high = (c.cast("decimal(20,0)" if keep_type else "double") for c in (low, high))
    out = {"lower": low, "higher": high, "split": (low + high) / 2}[method]
    return out.cast(kind) if keep_type else out


def moving_weighted_median(df: DataFrame, keys: list[str], axes: dict[str, int], value: str, weight: str, method: str = "split") -> DataFrame:
    """The weighted median over a centred window for each cell; ``axes`` gives each position column's odd size.

    Each cell is sent to the centres of the windows that it lies in, so windows of any
    number of axes are one shuffle, and each centre orders its own window.  A window without
    weight gives NaN.  A position is one cell; null values and weights take no part."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if any(size < 1 or size % 2 == 0 for size in axes.values()):
        raise ValueError("window sizes must be odd")
    at = [*keys, *axes]
    v, w = F.col(value), F.col(weight).cast("double")
    spread = df.select(*at, F.when((w > 0) & v.isNotNull(), F.struct(v.alias("v"), w.alias("w"))).alias("_item"), F.lit(True).alias("_own"))
    for axis, size in axes.items():
        spread = spread.withColumn("_o", F.explode(F.sequence(F.lit(-(size // 2)), F.lit(size // 2))))
        spread = spread.withColumns({axis: F.col(axis) + F.col("_o"), "_own": F.col("_own") & (F.col("_o") == 0)}).drop("_o")
    windows = spread.where("_own or _item is not null").groupBy(*at).agg(F.array_sort(F.collect_list("_item")).alias("_items"), F.max("_own").alias("_own")).where("_own")
    windows = windows.withColumn("_t", F.aggregate("_items", F.lit(0.0), lambda a, x: a + x["w"]) / 2)

    def step(a: Column, x: Column) -> Column:
        c = a["c"] + x["w"]
        found = [F.when(a[end].isNull() & reached, x["v"]).otherwise(a[end]).alias(end) for end, reached in (("lo", c >= F.col("_t")), ("hi", c > F.col("_t")))]
        return F.struct(c.alias("c"), *found)

    none = F.lit(None).cast(df.schema[value].dataType)
    ends = F.aggregate("_items", F.struct(F.lit(0.0).alias("c"), none.alias("lo"), none.alias("hi")), step)
    low, high = F.col("_ends.lo"), F.coalesce("_ends.hi", "_ends.lo")
    return windows.withColumn("_ends", ends).select(*at, F.coalesce(pick(low, high, method, df.schema[value].dataType).cast("double"), F.lit(float("nan"))).alias("median"))
