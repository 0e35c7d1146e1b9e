"""Batches by count over arriving files, against the same batches of a table."""

import pytest
from pyspark.sql import functions as F

from gridframe.operators import series
from gridframe.streaming import arrivals, steps


@pytest.mark.parametrize("files", [1, 3])
def test_counted_batches(spark, tmp_path, files):
    rows = [(k, i, None if i == 5 else float(10 * k + i)) for k in (0, 1, 2) for i in range(7 + k)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    out = []

    def keep(batch, _):
        out.extend((r["k"], r["batch"], r["n"], r["members"]) for r in batch.collect())

    for part in range(files):  # each arrives before the stream goes on
        df.where(F.floor(F.col("i") * files / 10) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = steps.counted_batches(arrivals.arriving(spark, f"{tmp_path}/in", "k long, i long, v double"), "k", "i", "v", 3)
        arrivals.each_arrival(stream, keep, f"{tmp_path}/checkpoint").awaitTermination()
    want = []
    for k in (0, 1, 2):
        want += [(k, r["batch"], r["n"], r["members"]) for r in series.batches(df.where(F.col("k") == k), "i", 3, "v").collect()]
    assert sorted(out) == sorted(want) and len(out) == 2 + 2 + 3
    left = {r["k"]: (r["batch"], r["n"], r["members"]) for r in steps.incomplete(spark, f"{tmp_path}/checkpoint", "k").collect()}
    assert left == {0: (2, 1, [6.0]), 1: (2, 2, [16.0, 17.0])}
