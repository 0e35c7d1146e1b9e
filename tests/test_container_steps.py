"""Checked parameters and steps from containers to containers."""

from datetime import datetime
from typing import Annotated

import pytest
from pyspark.sql import functions as F

from gridframe.plans import containers, parameters, steps
from gridframe.sources import folders, store


def test_values():
    assert parameters.between(0, 1)("0.5") == 0.5 and parameters.between(0, 1)(1) == 1.0
    assert parameters.one_of("a", 2)(2) == 2 and parameters.list_of(int, 2)((1, 2)) == [1, 2] and parameters.list_of(at_most=1)([]) == []
    day = 1577934245.0
    assert [parameters.utc_seconds(x) for x in ("2020-01-02T03:04:05", "2020-01-02T04:04:05+01:00", datetime(2020, 1, 2, 3, 4, 5), day)] == [day] * 4
    for check, value in [
        (parameters.between(0, 1), 1.01), (parameters.between(0, 1), float("nan")), (parameters.between(0, 1), "x"), (parameters.one_of("a"), "b"),
        (parameters.list_of(), "ab"), (parameters.list_of(int), [1, "2"]), (parameters.list_of(length=2), [1]), (parameters.list_of(length=0), [1]), (parameters.list_of(at_most=1), [1, 2]),
        (parameters.utc_seconds, "soon"), (parameters.utc_seconds, None), (parameters.utc_seconds, True),
    ]:
        with pytest.raises(ValueError):
            check(value)


def test_steps_check_values(spark, monkeypatch):
    monkeypatch.setattr(steps, "STEPS", {})

    @steps.step
    def above(df, low: Annotated[float, parameters.between(0, 10)], columns: Annotated[list, parameters.list_of(str)] = ("id",)):
        return df.where(F.col("id") > low).select(*columns)

    def described(**params):
        return [{"type": "above", "in": ["rows"], "out": "kept", "params": params}]

    assert steps.build(described(low="2"), {"rows": spark.range(5)})["kept"].count() == 2
    assert parameters.template(above) == {"columns": ("id",)}
    assert steps.lint(described(low=11, columns=[1]), {"rows"}) == ["step 0: low: 11 is not between 0 and 10", "step 0: columns: 1 at place 0 is of type int"]
    assert len(steps.lint(described(lowest=1), {"rows"})) == 1
    with pytest.raises(steps.ConfigError):
        steps.build(described(low=-1), {"rows": spark.range(5)})


def held(spark, *values, tag=None):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, value double")
    return store.Container(attrs={"": {"tag": tag}} if tag else {}).add("x", rows, ["i"])


def doubled(c):
    return store.Container(attrs={"x": {"unit": "m"}}).add("x", c.datasets["x"].withColumn("value", F.col("value") * 2), ["i"])


def test_census(spark):
    c = held(spark, 1.0, float("nan"), None, float("-inf"))
    c.add("whole", spark.range(3), []).add("a.b", spark.sql("SELECT array(array(1.0D, double('nan'))) AS `v.w`, named_struct('re', 1.0D) AS z"), [])
    c.add("none", spark.sql("SELECT cast(null AS array<double>) AS v, array(1) AS n"), [])
    assert sorted(map(tuple, containers.census(c).collect())) == [("a.b", 1, 1), ("none", 1, 0), ("x", 4, 2)]
    assert containers.census(store.Container().add("whole", spark.range(3), [])) is None


def test_tags_and_attributes(spark):
    step = containers.ContainerStep(doubled, attrs={"made_by": "{name} of {input_tags[0]}", "n": 3}, tag="{tag}_{count}")
    one, two = step.over([held(spark, 1.0, tag="a"), held(spark, 2.0)])
    assert one.attrs == {"x": {"unit": "m"}, "": {"made_by": "doubled of a", "n": 3, "tag": "a_0", "input_tags": ["a"]}}
    assert two.attrs[""]["tag"] == "1_1" and two.attrs[""]["input_tags"] == [""]
    assert sorted((r["tag"], r["value"]) for r in containers.stacked([one, two], "x").collect()) == [("1_1", 4.0), ("a_0", 2.0)]
    assert containers.first_of([one, two]) is one and containers.last_of([one, two]) is two
    assert containers.first_of([]) is None and containers.last_of([]) is None
    with pytest.raises(ValueError):
        containers.stacked([], "x")
    pair = containers.ContainerStep(lambda a, b: doubled(b), "second")
    assert [c.attrs[""]["input_tags"] for c in pair.over([(held(spark, 1.0, tag="a"), held(spark, 2.0, tag="b"))])] == [["a", "b"]]
    assert list(containers.ContainerStep(lambda c: None, "none").over([held(spark, 1.0)])) == []


def test_gate_and_saving(spark, tmp_path):
    good, wrong = held(spark, 1.0, None, tag="good"), held(spark, float("inf"), tag="wrong")
    step = containers.ContainerStep(doubled, save_to=f"{tmp_path}/{{tag}}", bad_to=f"{tmp_path}/bad_{{tag}}", config={"k": 1})
    assert [c.attrs[""]["tag"] for c in step.over([good, wrong])] == ["good"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad_wrong", "good"]
    back = store.load(spark, f"{tmp_path}/good")
    assert back.history == [("doubled", {"config": {"k": 1}, "input_tags": ["good"]})] and back.attrs["x"] == {"unit": "m"}
    assert sorted(r["value"] or 0 for r in back.datasets["x"].collect()) == [0, 2.0]
    for loose in (containers.ContainerStep(doubled, drop_bad=False), containers.ContainerStep(doubled, gate=False)):
        assert len(list(loose.over([wrong]))) == 1
    with pytest.raises(FileExistsError):
        step(good)
    assert folders.exists(spark, f"{tmp_path}/good")
