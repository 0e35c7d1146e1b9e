"""Axes, typed tables and ranges of labels of containers."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.functions import timescale
from gridframe.sources import schema, store


def held(spark):
    out = schema.add_axis(store.Container(), "x", [10, 20, 30, 40])
    schema.add_axis(out, "k", 2)
    cells = spark.range(8).select((F.col("id") % 4).alias("i_x"), F.floor(F.col("id") / 4).alias("i_k"), F.col("id").cast("double").alias("value"))
    return out.add("d", cells, ["x", "k"])


def test_axes(spark):
    c = held(spark)
    schema.add_axis(c, "free", spark.createDataFrame([(0, "a")], "idx long, label string"))
    assert [r["label"] for r in c.axes["k"].orderBy("idx").collect()] == [0, 1]
    assert "free" not in schema.drop_axis(c, "free").axes
    with pytest.raises(KeyError):
        schema.drop_axis(c, "free")
    for wrong in (lambda: schema.drop_axis(c, "x"), lambda: schema.add_axis(c, "x", 3), lambda: schema.add_axis(c, "y", spark.range(2))):
        with pytest.raises(ValueError):
            wrong()
    assert schema.described(c) == [{"name": "d", "axes": ["x", "k"], "columns": {"value": "double"}}]


def test_datasets_that_must_fit(spark):
    c = held(spark)
    d = c.datasets["d"]
    assert schema.require_dataset(c, "d", d.where("false"), ["x", "k"]) is d
    assert schema.require_dataset(c, "e", d, ["x", "k"]) is c.datasets["e"]
    with pytest.raises(ValueError):
        schema.require_dataset(c, "d", d, ["k", "x"])
    with pytest.raises(TypeError):
        schema.require_dataset(c, "d", d.withColumn("value", F.col("value").cast("float")), ["x", "k"])
    c.add("far", spark.createDataFrame([(3, 1.0), (4, 1.0), (None, 2.0)], "i_x long, value double"), ["x"])
    assert sorted(map(tuple, schema.misfits(c).collect())) == [("d", "k", 0), ("d", "x", 0), ("e", "k", 0), ("e", "x", 0), ("far", "x", 2)]
    assert schema.misfits(store.Container()) is None


@pytest.mark.parametrize(("start", "stop", "labels"), [(20, 40, [20, 30]), (None, 25, [10, 20]), (15, None, [20, 30, 40]), (None, None, [10, 20, 30, 40]), (40, 20, []), (99, None, []), (21, 29, [])])
def test_ranges_of_labels(spark, start, stop, labels):
    part = schema.select_range(held(spark), "x", start, stop)
    assert [tuple(r) for r in part.axes["x"].orderBy("idx").collect()] == list(enumerate(labels))
    want = sorted((i, k, float(4 * k + label / 10 - 1)) for i, label in enumerate(labels) for k in range(2))
    assert sorted(map(tuple, part.datasets["d"].select("i_x", "i_k", "value").collect())) == want


def test_ranges_of_converted_labels(spark):
    days = spark.createDataFrame([(i, datetime(2020, 1, 1 + i)) for i in range(5)], "idx long, label timestamp")
    c = store.Container(axes={"time": days}).add("v", spark.range(5).select(F.col("id").alias("i_time")), ["time"])
    second = schema.select_range(c, "time", 1577923200.0, 1577923200.0 + 86400, timescale.unix_time)
    assert [r["label"].day for r in second.axes["time"].collect()] == [2] and second.datasets["v"].count() == 1


def test_typed_tables(spark):
    spec = schema.TableSpec({"n": "smallint", "name": "string"}, "row")
    assert spec.schema == T.StructType([T.StructField("n", T.ShortType()), T.StructField("name", T.StringType())])
    rows = spark.createDataFrame([(0, 5, "a"), (1, None, "b")], "i_row int, n long, name string")
    assert sorted(map(tuple, spec.of(rows).collect())) == [(0, 5, "a"), (1, None, "b")]
    assert spec.of(rows).dtypes == [("i_row", "bigint"), ("n", "smallint"), ("name", "string")]
    with pytest.raises(PySparkException, match="n doesn't hold 70000"):
        spec.of(rows.withColumn("n", F.lit(70000))).collect()
    with pytest.raises(ValueError):
        spec.of(rows.drop("name"))


def test_on_disk_and_in_memory(spark, tmp_path):
    c, key = held(spark), "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(key)
    there = schema.moved_to_disk(c, f"{tmp_path}/c", rows_per_file=1)
    assert len(list((tmp_path / "c/data/d").glob("*.parquet"))) == 8 and spark.conf.get(key) == before
    assert sorted(there.datasets["d"].collect()) == sorted(c.datasets["d"].collect())
    assert schema.sizes_on_disk(spark, f"{tmp_path}/c")["d"] > 0 and schema.sizes_on_disk(spark, f"{tmp_path}/none") == {}
    kept = schema.moved_to_memory(there)
    assert kept.datasets["d"].is_cached and kept.datasets["d"].count() == 8
    kept.datasets["d"].unpersist()
    with pytest.raises(FileExistsError):
        schema.moved_to_disk(c, f"{tmp_path}/c")
