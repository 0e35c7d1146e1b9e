"""Shapes against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import shapes
from gridframe.operators.axes import AxisException

A = np.arange(24.0).reshape(2, 3, 4) - 5


def cells(spark, array, *axes, name="v"):
    rows = [(*map(int, at), float(x)) for at, x in np.ndenumerate(array) for at in [at]]
    return spark.createDataFrame(rows, ", ".join([*[f"{a} long" for a in axes], f"{name} double"]))


def dense(df, axes, name="v"):
    rows = df.collect()
    out = np.full([max(r[a] for r in rows) + 1 for a in axes], np.nan)
    for r in rows:
        out[tuple(r[a] for a in axes)] = r[name]
    return out


@pytest.mark.parametrize(
    ("shape", "into", "expected"),
    [
        ({"a": 2, "b": 3, "c": 4}, {"p": 6, "q": -1}, A.reshape(6, 4)),
        ({"a": 2, "b": 3, "c": 4}, {"b": 4, "a": 3, "c": 2}, A.reshape(4, 3, 2)),
        ({"a": 2, "b": None, "c": 4}, {"a": 2, "b": None, "p": 2, "q": -1}, A.reshape(2, 3, 2, 2)),
        ({"a": None, "b": 3, "c": 4}, {"a": None, "p": -1}, A.reshape(2, 12)),
    ],
)
def test_reshape(spark, shape, into, expected):
    df = shapes.reshape(cells(spark, A, "a", "b", "c"), shape, into)
    assert df.columns == [*into, "v"]
    assert np.array_equal(dense(df, list(into)), expected)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_reshape_errors(spark):
    df = cells(spark, A, "a", "b", "c")
    for into in [{"p": 5, "q": -1}, {"p": 25}, {"p": -1, "q": -1}, {"p": 0, "q": -1}]:
        with pytest.raises(ValueError):
            shapes.reshape(df, {"a": 2, "b": 3, "c": 4}, into)
    with pytest.raises(AxisException):
        shapes.reshape(df, {"a": None, "b": 3, "c": 4}, {"p": 24})
    with pytest.raises(ValueError):  # sizes around a kept axis don't mix
        shapes.reshape(df, {"a": 2, "b": None, "c": 4}, {"p": 4, "b": None, "q": 2})
    with pytest.raises(ValueError):
        shapes.reshape(df, {"a": 2, "b": 3, "c": 4}, {"v": 24})
    assert np.array_equal(dense(shapes.ravel(df, {"a": 2, "b": 3, "c": 4}), ["i"]), A.ravel())


def test_mask(spark):
    keep = [True, False, None, True]
    mask = spark.createDataFrame(list(enumerate(keep)), "idx long, keep boolean")
    out = shapes.mask_axis(cells(spark, A, "a", "b", "c"), "c", mask)
    assert np.array_equal(dense(out, ["a", "b", "c"]), A[:, :, [0, 3]])
    assert shapes.mask_axis(cells(spark, A, "a", "b", "c"), "c", mask.where("not keep")).count() == 0


@pytest.mark.parametrize("how", ["sum", "prod", "min", "max", "mean"])
@pytest.mark.parametrize("over", [["a"], ["a", "c"], None])
def test_reductions(spark, how, over):
    axes = ["a", "b", "c"]
    out = shapes.reduce_over(cells(spark, A, *axes), axes, "v", how, over, keepdims=True)
    expected = getattr(np, how)(A, axis=None if over is None else tuple(axes.index(a) for a in over), keepdims=True)
    assert np.allclose(dense(out, axes), expected)
    plain = shapes.reduce_over(cells(spark, A, *axes), axes, "v", how, over)
    assert plain.columns == [a for a in axes if over is not None and a not in over] + ["v"]


def test_reductions_of_nothing_and_nan(spark):
    none = cells(spark, A, "a", "b", "c").where("false")
    got = {how: shapes.reduce_over(none, ["a", "b", "c"], "v", how).first()[0] for how in ("sum", "prod", "min", "count")}
    assert got == {"sum": 0, "prod": 1, "min": None, "count": 0}
    flags = spark.createDataFrame([(0, True), (1, False)], "i long, f boolean")
    assert [shapes.reduce_over(flags, ["i"], "f", how).first()[0] for how in ("all", "any")] == [False, True]
    assert [shapes.reduce_over(flags.where("false"), ["i"], "f", how).first()[0] for how in ("all", "any")] == [True, False]
    bad = cells(spark, np.array([1.0, np.nan, 2.0]), "i")
    assert all(np.isnan(shapes.reduce_over(bad, ["i"], "v", how).first()[0]) for how in ("min", "max", "sum"))
    for wrong in [{"over": ["x"]}, {"over": ["i"], "fixed": "i"}]:
        with pytest.raises(AxisException):
            shapes.reduce_over(bad, ["i"], "v", "sum", **wrong)
    with pytest.raises(ValueError):
        shapes.reduce_over(bad, ["i"], "v", "middle")


def test_broadcasting(spark):
    row, one = A[:, :1, :], np.array([[[7.0]]])
    big = {"a": 2, "b": 3, "c": 4}
    for other, shape in [(row, {"a": 2, "b": 1, "c": 4}), (one, {"a": 1, "b": 1, "c": 1}), (A + 1, big)]:
        both = shapes.together(cells(spark, A, "a", "b", "c"), big, cells(spark, other, "a", "b", "c", name="w"), shape)
        assert np.array_equal(dense(both.select("a", "b", "c", (F.col("v") - F.col("w")).alias("v")), ["a", "b", "c"]), A - other)
    swapped = shapes.together(cells(spark, one[0, 0], "c", name="w"), {"c": 1}, cells(spark, A[0, 0], "c"), {"c": 4})
    assert np.array_equal(dense(swapped, ["c"]), A[0, 0]) and set(r["w"] for r in swapped.collect()) == {7.0}
    with pytest.raises(AxisException):
        shapes.together(cells(spark, A[0], "b", "c"), {"b": 3, "c": 4}, cells(spark, A[0, :2], "b", "c", name="w"), {"b": 2, "c": 4})
    with pytest.raises(AxisException):
        shapes.together(cells(spark, A[0, 0], "c"), {"c": 4}, cells(spark, A[0, 0], "d", name="w"), {"d": 4})
