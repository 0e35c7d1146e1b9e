"""Error-bounded truncation of whole datasets: by rows' largest cells, and of all datasets of a container."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions import numeric
from gridframe.operators.axes import align
from gridframe.sources.store import Container

PRECISION, VARIANCE_INCREASE = 1e-4, 1e-3


def truncate_rows(df: DataFrame, rows: list[str], z: str, precision: float, row_precision: float) -> DataFrame:
    """Complex cells, both parts to the larger of two errors: shares of the cell's size and of the largest in its row.

    A row is what shares ``rows``; its largest cell is found by partial aggregation and joined back."""
    size = F.hypot(F.col(f"{z}.re"), F.col(f"{z}.im"))
    largest = df.groupBy(*rows).agg(F.max(size).alias("_most"))
    return df.join(largest, rows).withColumn(z, numeric.bit_truncate_max_complex(F.col(z), precision, row_precision, F.col("_most"))).drop("_most")


def parameters(given: Any) -> dict[str, Any] | None:
    """A dataset's settings: False or none leaves it, a number is the relative precision, a dict overrides defaults."""
    if given is None or given is False:
        return None
    own = {"fixed_precision": PRECISION, "variance_increase": VARIANCE_INCREASE, "weight_dataset": None}
    return own | (given if isinstance(given, dict) else {} if given is True else {"fixed_precision": float(given)})


def each_part(df: DataFrame, f: Any) -> Column:
    """f of a real value, or of both parts of a complex one."""
    if df.schema["value"].dataType.typeName() == "struct":
        return F.struct(f(F.col("value.re")).alias("re"), f(F.col("value.im")).alias("im"))
    return f(F.col("value").cast("double")).cast(df.schema["value"].dataType)


def truncate(container: Container, settings: dict[str, Any]) -> Container:
    """The container with its datasets truncated as ``settings`` says by name; others stay as they are.

    With a ``weight_dataset`` (inverse variances, repeated along axes it lacks) the error is the noise times
    the root of ``variance_increase`` times 3, the share of a uniform error's variance; complex parts
    have half the variance each.  A cell without a weight, or with weight 0, has the relative error."""
    out = Container(dict(container.datasets), dict(container.axes), dict(container.dims), dict(container.attrs), list(container.history))
    for name, given in settings.items():
        own = parameters(given)
        if own is None:
            continue
        if name not in container.datasets:
            raise KeyError(name)
        df, precision = container.datasets[name], own["fixed_precision"]
        if own["weight_dataset"] is None:
            out.datasets[name] = df.withColumn("value", each_part(df, lambda x, p=precision: numeric.bit_truncate_relative(x, p)))
            continue
        weights, shared = own["weight_dataset"], container.dims[own["weight_dataset"]]
        if extra := set(shared) - set(container.dims[name]):
            raise ValueError(f"{weights} has axes that {name} lacks: {sorted(extra)}")
        half = 2.0 if df.schema["value"].dataType.typeName() == "struct" else 1.0
        keys = [f"i_{a}" for a in shared]
        weighed = align(df, container.datasets[weights].select(*keys, F.col("value").cast("double").alias("_w")), keys, "left")
        weight = F.coalesce(F.col("_w"), F.lit(0.0)) * half / (3 * own["variance_increase"])
        out.datasets[name] = weighed.withColumn("value", each_part(df, lambda x, w=weight, p=precision: numeric.bit_truncate_weights(x, w, p))).drop("_w")
    return out
