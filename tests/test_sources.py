"""Committed writes, appending, patterns, and the reader of many containers."""

import pytest
from pyspark.sql import functions as F

from gridframe.sources import folders, reader, store

LENGTHS = (15, 67, 35, 23, 91)


def part(spark, first, n, value=1.0):
    times = spark.range(n).select(F.col("id").alias("idx"), (262.0 + 12 * (F.col("id") + first)).alias("label"))
    held = store.Container(axes={"time": times}, attrs={"": {"day": "7"}})
    held.axes["chan"] = spark.range(3).select(F.col("id").alias("idx"), F.col("id").alias("label"))
    cells = spark.range(n).select(F.col("id").alias("i_time"), F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("i_chan"))
    held.add("a", cells.withColumn("value", value * (F.col("i_time") + first) * F.col("i_chan")), ["chan", "time"])
    return held.add("c", held.axes["chan"].select(F.col("idx").alias("i_chan"), F.col("label").alias("value")), ["chan"])


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    root, at = tmp_path_factory.mktemp("parts"), 0
    for k, n in enumerate(LENGTHS):
        part(spark, at, n).save(f"{root}/part-{k}")
        at += n
    return str(root)


def test_patterns(spark, parts):
    names = [p.rpartition("/")[2] for p in folders.find(spark, [f"{parts}/part-[34]", f"{parts}/part-*"])]
    assert names == ["part-3", "part-4", "part-0", "part-1", "part-2"]
    with pytest.raises(FileNotFoundError):
        folders.find(spark, [f"{parts}/part-*", f"{parts}/nothing*"])


@pytest.mark.parametrize(("low", "high", "opened"), [(7, 87, 3), (None, None, 5), (-1, None, 1), (82, 117, 1), (100, 40, 0), (230, 500, 1)])
def test_reader_of_positions(spark, parts, low, high, opened):
    held = reader.Reader(spark, f"{parts}/part-*").select_index_range(low, high)
    assert sum(map(len, held.plan())) == opened
    out = held.read()
    wanted = list(range(231))[low:high]
    labels = [(r["idx"], r["label"]) for r in out.axes["time"].orderBy("idx").collect()]
    assert labels == [(i, 262.0 + 12 * t) for i, t in enumerate(wanted)]
    cells = {(r["i_time"], r["i_chan"]): r["value"] for r in out.datasets["a"].collect()}
    assert cells == {(i, c): float(t * c) for i, t in enumerate(wanted) for c in range(3)}
    assert out.datasets["c"].count() == 3 and out.attrs[""]["day"] == "7"


def test_reader_of_labels_pushes_its_filter(spark, parts):
    held = reader.Reader(spark, [f"{parts}/part-*"]).select_range(300.0, 500.0).select_datasets("a")
    assert (held.start, held.stop) == (4, 20)
    whole, edges = held.plan()
    assert not whole and [(p[-1], low, high) for p, _, low, high in edges] == [("0", 4, 14), ("1", 0, 4)]
    out = held.read()
    assert out.axes["time"].count() == 16 and list(out.datasets) == ["a"]
    plan = out.datasets["a"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i_time,4)" in plan and "LessThanOrEqual(i_time,14)" in plan and "part-2" not in plan
    assert reader.Reader(spark, f"{parts}/part-*").select_range(9e9).read().datasets["a"].count() == 0


def test_each_container(spark, parts):
    tags = [(c.attrs[""]["tag"], c.axes["time"].count()) for c in reader.load_each(spark, [{"tag": "x", "files": f"{parts}/part-[01]"}, {"tag": "y", "files": [f"{parts}/part-4"]}], time=slice(-20, None))]
    assert tags == [("x_0", 15), ("x_1", 20), ("y_0", 20)]
    assert next(reader.load_each(spark, f"{parts}/part-2")).attrs[""]["tag"] == "part-2"
    with pytest.raises(KeyError, match="no attribute"):
        reader.load_from_attrs(spark, parts + "/part-{night}", store.Container())
    assert reader.load_from_attrs(spark, parts + "/part-{k}", store.Container(attrs={"": {"k": 3}})).axes["time"].count() == 23


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = part(spark, 0, 5)
    bad.datasets["a"] = bad.datasets["a"].withColumn("value", F.when(F.col("i_time") == 3, F.raise_error("broken").cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="broken"):
        bad.save(f"{tmp_path}/x")
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(Exception, match="broken"):
        bad.save(f"{tmp_path}/x", preserve=True)
    assert len(list(tmp_path.iterdir())) == 1 and not folders.exists(spark, f"{tmp_path}/x")
    part(spark, 0, 5).save(f"{tmp_path}/y")
    with pytest.raises(FileExistsError):
        part(spark, 0, 5).save(f"{tmp_path}/y")
    with pytest.raises(Exception, match="broken"):
        bad.save(f"{tmp_path}/y", "overwrite")
    assert store.load(spark, f"{tmp_path}/y").axes["time"].count() == 5
    part(spark, 0, 6).save(f"{tmp_path}/y", "overwrite")
    assert store.load(spark, f"{tmp_path}/y").axes["time"].count() == 6
    with pytest.raises(ValueError):
        bad.save(f"{tmp_path}/z", "append")


def test_appending(spark, tmp_path):
    at = f"{tmp_path}/x"
    part(spark, 0, 4).save(at)
    part(spark, 4, 3).append(at)
    part(spark, 7, 2).append(at)
    held = store.load(spark, at)
    assert [r["label"] for r in held.axes["time"].orderBy("idx").collect()] == [262.0 + 12 * i for i in range(9)]
    assert {(r["i_time"], r["i_chan"]): r["value"] for r in held.datasets["a"].collect()} == {(t, c): float(t * c) for t in range(9) for c in range(3)}
    assert held.datasets["c"].count() == 3
    other = part(spark, 9, 1)
    other.datasets["a"] = other.datasets["a"].withColumn("value", F.lit("text"))
    with pytest.raises(ValueError, match="doesn't fit"):
        other.append(at)
    bad = part(spark, 9, 1)
    bad.datasets["a"] = bad.datasets["a"].withColumn("value", F.raise_error("broken").cast("double"))
    with pytest.raises(Exception, match="broken"):
        bad.append(at)
    assert store.load(spark, at).axes["time"].count() == 9
    with pytest.raises(FileExistsError), folders.committed(spark, f"{at}/more/9") as aside:  # another writer was first
        part(spark, 0, 1).save(aside)
        part(spark, 0, 1).save(f"{at}/more/9")


def test_output_with_history(spark, tmp_path):
    path = reader.save_output(spark, part(spark, 0, 2), f"{tmp_path}/day-{{day}}", "smooth", {"width": 3})
    assert path.endswith("day-7")
    name, entry = store.load(spark, path).history[-1]
    assert name == "smooth" and entry["parameters"] == {"width": 3} and "pyspark" in entry["versions"]


def test_selection_from_the_end_and_parts_that_differ(spark):
    held = part(spark, 0, 10)
    assert [r["idx"] for r in held.select(time=slice(-3, None)).axes["time"].orderBy("idx").collect()] == [0, 1, 2]
    assert held.select(time=slice(-3, -1)).datasets["a"].count() == 6
    other = part(spark, 10, 2)
    del other.datasets["c"], other.dims["c"]
    with pytest.raises(ValueError, match="doesn't fit"):
        store.concatenate([held, other])
