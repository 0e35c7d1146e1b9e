"""Steps over a stream whose state outlasts its micro-batches: batches by count, and the first and last rows.

State is kept by key in Spark's state store, so keys are dealt over tasks and a restart goes on from the
checkpoint.  What is still incomplete when a stream ends is read back from that store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counted_batches(stream: DataFrame, key: str, position: str, value: str, size: int) -> DataFrame:
    """(key, batch, n, members): each ``size`` rows of a key, in the order of positions within what arrives together.

    An incomplete batch waits for more; ``incomplete`` reads those that are left at the end.
    Rows without a key are a key of their own; null values are members too."""
    schema = stream.schema
    kind, cell = schema[key].dataType.simpleString(), schema[value].dataType.simpleString()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, waiting = state.get if state.exists else (0, [])
        rows = pd.concat([f[[position, value]] for f in frames], ignore_index=True).sort_values(position, kind="stable")
        waiting = [*waiting, *(None if pd.isna(v) else v for v in rows[value].tolist())]
        out = []
        while len(waiting) >= size:
            out.append((keys[0], done, size, waiting[:size]))
            done, waiting = done + 1, waiting[size:]
        state.update((done, waiting))
        yield pd.DataFrame(out, columns=[key, "batch", "n", "members"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, batch long, n long, members array<{cell}>", f"done long, waiting array<{cell}>", "append", GroupStateTimeout.NoTimeout)


def incomplete(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, batch, n, members): what ``counted_batches`` had not completed when the stream with this checkpoint ended."""
    rows = spark.read.format("statestore").load(checkpoint)
    state = F.col("value.groupState")
    return rows.select(F.col(f"key.{key}").alias(key), state["done"].alias("batch"), F.size(state["waiting"]).cast("long").alias("n"), state["waiting"].alias("members")).where("n > 0")
