"""Trees of groups and collections of containers on small tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridframe.sources import collections, folders, store, tree


def cells(spark, n=6, start=0):
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 10 + start).alias("value"))


def sample(spark):
    out = tree.Tree()
    out.create_dataset("/a/b/x", cells(spark), ["i"], unit="m")
    out.create_dataset("a/y", spark.createDataFrame([(0, bytearray(b"one")), (1, None)], "i long, name binary"), ["i"])
    out.create_dataset("whole", spark.range(1).select(F.lit(5).alias("value")))
    out.create_group("empty/inner")
    out.attrs["a"] = {"kind": "pair", "n": [1, 2]}
    return out


def test_paths(spark):
    t = sample(spark)
    assert list(t.walk()) == [("a", False), ("a/b", False), ("a/b/x", True), ("a/y", True), ("empty", False), ("empty/inner", False), ("whole", True)]
    assert t.children() == ["a", "empty", "whole"] and t.children("a") == ["b", "y"] and t.children("empty/inner") == []
    assert "a/b/" in t and "/a/b/x" in t and "b" not in t
    assert t.require_group("a/b") == "a/b"
    for make in (t.create_group, lambda p: t.create_dataset(p, cells(spark))):
        for path in ("a/b", "a/b/x", ""):
            with pytest.raises(ValueError):
                make(path)
    with pytest.raises(TypeError):
        t.create_group("a/b/x/y")
    with pytest.raises(ValueError):
        t.create_dataset("z", cells(spark), ["j"])
    for path in ("none", "a/none"):
        with pytest.raises(KeyError):
            t[path]
        with pytest.raises(KeyError):
            del t[path]
    assert t["a/b"].datasets.keys() == {"x"} and t["a"].attrs == {"": {"kind": "pair", "n": [1, 2]}, "b/x": {"unit": "m"}}
    assert {r["path"]: r["cells"] for r in t.sizes().collect()} == {"a/b/x": 6, "a/y": 2, "whole": 1}
    del t["a/b"]
    assert "a/b/x" not in t and "a/y" in t and "a/b/x" not in t.attrs
    with pytest.raises(KeyError):
        del t[""]


def test_copy(spark):
    t = sample(spark)
    part = t.copy({"i": slice(1, None, 2)}, as_text=True)
    assert sorted(map(tuple, part["a/b/x"].collect())) == [(0, 10), (1, 30), (2, 50)]
    assert [tuple(r) for r in part["a/y"].collect()] == [(0, None)] and dict(part["a/y"].dtypes)["name"] == "string"
    assert part["whole"].count() == 1 and part.attrs == t.attrs and part.groups == t.groups
    part.create_group("new")
    part.attrs["a"]["kind"] = "other"
    assert "new" not in t and t.attrs["a"]["kind"] == "pair" and t["a/b/x"].count() == 6
    assert sorted(map(tuple, t.copy({"i": [4, 0, 4]}, "a/b")["x"].collect())) == [(0, 40), (1, 0), (2, 40)]
    assert sorted(map(tuple, t.copy({"i": slice(-2, None)}, "a/b")["x"].collect())) == [(0, 40), (1, 50)]
    assert t.copy(shared=("a/b/x",))["a/b/x"] is t["a/b/x"]
    assert list(t.copy(keep=lambda p: p == "whole").datasets) == ["whole"]
    assert dict(part.copy(as_bytes=True)["a/y"].dtypes)["name"] == "binary"
    for wrong in [{"selections": {"i": [0]}, "shared": ("a/b/x",)}, {"selections": {"k": [0]}}, {"as_text": True, "as_bytes": True}]:
        with pytest.raises(ValueError):
            t.copy(**wrong)
    with pytest.raises(TypeError):
        t.copy(within="whole")


def test_tree_on_disk(spark, tmp_path):
    t, at = sample(spark), f"{tmp_path}/t"
    t.save(spark, at)
    back = tree.load(spark, at)
    assert list(back.walk()) == list(t.walk()) and back.attrs == t.attrs and back.dims == t.dims
    assert sorted(back["a/b/x"].collect()) == sorted(t["a/b/x"].collect())
    assert list(tree.load(spark, at, "a").walk()) == [("b", False), ("b/x", True), ("y", True)]
    with pytest.raises(KeyError):
        tree.load(spark, at, "b")
    with pytest.raises(FileExistsError):
        t.save(spark, at)
    broken = tree.Tree()
    broken.create_dataset("x", spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(1).alias("value")))
    with pytest.raises(PySparkException):
        broken.save(spark, at, overwrite=True)
    assert list(tree.load(spark, at).walk()) == list(t.walk()) and [p.name for p in tmp_path.iterdir()] == ["t"]


@pytest.fixture
def saved(spark, tmp_path):
    for k, tag in enumerate(["red", "blue"]):
        held = store.Container(axes={"place": spark.range(3).select(F.col("id").alias("idx"), F.col("id").alias("label"))})
        held.add("level", cells(spark, 3, 100 * k).withColumnRenamed("i", "i_place"), ["place"]).save(f"{tmp_path}/{tag}.v1")
    return str(tmp_path)


def test_names_of_files(spark, saved):
    assert [collections.stem(x) for x in ("/a/b.tar.gz", "b/", ".hidden", "x.cells")] == ["b.tar", "b", ".hidden", "x"]
    found = collections.groups_of_files(spark, [{"files": f"{saved}/*.v1"}, {"files": [f"{saved}/red*"], "tag": "one"}])
    assert [(t, [collections.stem(p) for p in ps]) for t, ps in found] == [("group_0", ["blue", "red"]), ("one", ["red"])]
    with pytest.raises(FileNotFoundError):
        collections.groups_of_files(spark, [{"files": f"{saved}/green*"}])
    with pytest.raises(ValueError):
        collections.groups_of_files(spark, [{"files": f"{saved}/red*", "tag": "x"}, {"files": f"{saved}/red*", "tag": "x"}])
    assert collections.paths_and_tags(["a/{tag}", "b/{tag}.x"], ["p", "q"]) == [("a/p", "p"), ("a/q", "q"), ("b/p.x", "p"), ("b/q.x", "q")]
    assert collections.path_from_attributes("in/{day:03d}", {"day": 7, "other": 1}) == "in/007"
    with pytest.raises(ValueError, match="'day'"):
        collections.path_from_attributes("in/{day}", {})


def test_collection(spark, saved):
    paths = folders.find(spark, f"{saved}/*.v1")
    held = collections.collection(spark, paths, "level")
    assert sorted(tuple(r) for r in held.select("tag", "i_place", "value").collect()) == [(t, i, 100 * k + 10 * i) for k, t in ((1, "blue"), (0, "red")) for i in range(3)]
    named = collections.collection(spark, list(zip(paths, ["second", "first"])), "level")
    assert {r["tag"]: r["m"] for r in named.groupBy("tag").agg(F.max("value").alias("m")).collect()} == {"second": 120, "first": 20}
    with pytest.raises(ValueError):
        collections.collection(spark, [(p, "same") for p in paths], "level")
    with pytest.raises(ValueError):
        collections.collection(spark, [], "level")
    wants = spark.createDataFrame([(0, "red"), (1, "blue"), (2, "green"), (3, None)], "n long, colour string")
    sums = held.groupBy("tag").agg(F.sum("value").alias("total"))

    def got(missing):
        return sorted((r["n"], r["total"]) for r in collections.matched(wants, sums, F.col("colour"), missing=missing).select("n", "total").collect())

    assert got("drop") == [(0, 30), (1, 330)] and got("keep") == [(0, 30), (1, 330), (2, None), (3, None)]
    with pytest.raises(PySparkException, match="no container is tagged"):
        got("fail")
    with pytest.raises(ValueError):
        got("other")
    turns = collections.in_turn(wants, "n", sums, collections.in_order(spark, paths))
    assert sorted((r["n"], r["tag"], r["total"]) for r in turns.collect()) == [(0, "blue", 330), (1, "red", 30), (2, "blue", 330), (3, "red", 30)]
