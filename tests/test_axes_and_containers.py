"""Indexing rules, selections, containers, times and text on small tables."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.functions import numeric, sphere, strings, timescale
from gridframe.operators import axes
from gridframe.sources import store


def cells(spark, n=6):
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 10).alias("v"))


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_slices(spark):
    df = cells(spark)
    assert got(axes.slice_axis(df, "i", -4, -1, 2, 6), "i", "v") == [(0, 20), (1, 40)]
    assert got(axes.index_axes(df, ["i"], (-1,), {"i": 6}), "v") == [(50,)]
    assert got(axes.index_axes(df, ["i"], (None, ..., slice(4, None))), "i", "new_0", "v") == [(0, 0, 40), (1, 0, 50)]
    for key in [(..., ...), (1, 2), (-1,)]:
        with pytest.raises(IndexError):
            axes.index_axes(df, ["i"], key)
    with pytest.raises(IndexError):
        axes.slice_axis(df, "i", -2)


def test_partitions(spark):
    parts = [r[0] for r in spark.range(7).orderBy("id").select(axes.partition_of(F.col("id"), 3, "con", F.lit(7))).collect()]
    assert parts == [0, 0, 0, 1, 1, 2, 2]
    assert {r[0] for r in spark.range(50).select(axes.partition_of(F.col("id"), 3, "rand")).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        axes.partition_of(F.col("id"), 3, "other")


def test_container(spark):
    specs = {"a": {"axes": ["x", "y"], "initialise": True, "start": 1}, "b": {"axes": ["x"]}}
    one = store.Container.of_axes(spark, specs, x=2, y=["p", "q", "r"])
    assert one.datasets["a"].count() == 6 and "b" not in one.datasets
    one.add("b", cells(spark, 2).select(F.col("i").alias("i_x"), F.col("v").alias("value")), ["x"])
    other = store.Container.of_axes(spark, {}, copy_from=one)
    assert set(other.datasets) == {"a", "b"}
    with pytest.raises(RuntimeError):
        store.Container.of_axes(spark, specs, x=2)
    kept = one.copy_filtered("y", slice(1, 3))
    assert set(kept.datasets) == {"a"} and kept.datasets["a"].count() == 4
    assert set(one.copy_filtered("x", [1], exclude_axes=("y",)).datasets) == {"b"}
    with pytest.raises(ValueError):
        one.project("c")


def test_concatenation(spark, tmp_path):
    for k in range(2):
        c = store.Container(axes={"time": cells(spark, 3).select(F.col("i").alias("idx"), F.col("v").alias("label"))}, attrs={"": {"k": k}})
        c.add("x", cells(spark, 3).select(F.col("i").alias("i_time"), (F.col("v") + k).alias("value")), ["time"])
        c.save(f"{tmp_path}/{k}")
    whole = store.load_many(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], start=1, stop=-1)
    assert got(whole.datasets["x"], "i_time", "value") == [(0, 10), (1, 20), (2, 1), (3, 11)] and whole.attrs[""]["k"] == 0
    cut = store.concatenate([store.load(spark, f"{tmp_path}/0")] * 2, dataset_filter=lambda _, df: df.withColumn("value", -F.col("value")))
    assert got(cut.datasets["x"], "i_time")[-1] == (5,) and min(got(cut.datasets["x"], "value")) == (-20,)


def test_scalars_at_the_edges(spark):
    row = spark.range(1).select(
        numeric.invert_no_zero_complex(numeric.complex_of(F.lit(1e-200), F.lit(0.0))).alias("small"),
        numeric.invert_no_zero_complex(numeric.complex_of(F.lit(0.0), F.lit(1e200))).alias("large"),
        numeric.bit_truncate(F.lit(1.0), F.lit(-1e-30)).alias("kept"), numeric.bit_truncate(F.lit(1.0), F.lit(-0.5)).alias("gone"),
        sphere.cart_to_sph(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("origin"), sphere.norm_vec2(F.lit(3.0), F.lit(4.0)).alias("unit"),
        sphere.great_circle_points(*[sphere.sph_to_cart(F.lit(1.0), F.lit(2.0))] * 2, 3).alias("same"),
    ).first()
    assert math.isclose(row["small"]["re"], 1e200) and math.isclose(row["large"]["im"], -1e-200)
    assert (row["kept"], row["gone"], row["origin"]["theta"]) == (1.0, 0.0, 0.0) and tuple(row["unit"]) == (0.6, 0.8)
    assert all(math.isclose(p["z"], math.cos(1.0)) for p in row["same"])
    with pytest.raises(Exception, match="opposite"):
        spark.range(1).select(sphere.great_circle_points(sphere.sph_to_cart(F.lit(0.0), F.lit(0.0)), sphere.sph_to_cart(F.lit(math.pi), F.lit(0.0)), 3)).collect()


def test_times(spark):
    zero = spark.range(1).select(timescale.lsd_zero(1.5e9, 100.0)).first()[0]
    days = spark.range(5).select((F.col("id") * 1.75).alias("d"))
    assert all(abs(r[0] - r[1]) < 1e-6 for r in days.select("d", timescale.lsd(timescale.lsd_to_unix(F.col("d"), 100.0, zero), 100.0, zero)).collect())
    times = spark.createDataFrame([("20200101T000000Z", "2020-01-01 00:00:00", "x")], "a string, b string, c string")
    assert tuple(times.select(*[timescale.ensure_unix(F.col(c), "string") for c in "abc"]).first()) == (1577836800.0, 1577836800.0, None)
    with pytest.raises(TypeError):
        timescale.ensure_unix(F.col("a"), "array<int>")


def test_text(spark):
    df = spark.createDataFrame([(["ä"], {"k": "v"}, ("x", None))], "a array<string>, m map<string,string>, s struct<p:string,q:string>")
    held = strings.ensure_bytes(df)
    assert strings.has_kind(held.schema, T.BinaryType) and not strings.has_kind(held.schema, T.StringType)
    assert strings.ensure_unicode(held).collect() == df.collect()
    assert strings.all_equal({"a": [1, float("nan")]}, {"a": (1, float("nan"))}) and not strings.all_equal([1], [2])
    assert strings.unit("kilo_gram") == 1.0 and math.isclose(strings.unit("milli_second"), 1e-3)
    for name in ("kilo_mega_gram", "furlong"):
        with pytest.raises(AttributeError):
            strings.unit(name)
