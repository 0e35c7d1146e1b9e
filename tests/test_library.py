import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe import queries as library
from gridframe.functions import numeric, timescale
from gridframe.operators import axes, quantile, series, signal
from gridframe.plans import steps
from gridframe.sources import store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def cell(v):
    return (0, "") if v is None else (1, "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) else str(v))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    got = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(library.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize(("x", "e", "want"), [(32.121, 1.0, 32.0), (0.9191919191, 0.001, 0.919921875), (32.121, -1.0, 0.0), (32.121, math.inf, 0.0), (129.0, 1.0, 128.0)])
def test_truncation_goldens(spark, x, e, want):
    assert spark.range(1).select(numeric.bit_truncate(F.lit(x), F.lit(e))).first()[0] == want


def test_quantile_goldens(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 0), (1, 4, 2), (2, 1, 0), (2, 2, 0), (2, 4, 0), (2, 3, 0)], "g int, v int, w int")
    got = {r["g"]: r["quantile"] for r in quantile.weighted_quantile(rows, ["g"], "v", "w").collect()}
    assert got == {1: 3.0, 2: 2.5}
    with pytest.raises(ValueError):
        quantile.weighted_quantile(rows, ["g"], "v", "w", 1.5)


def test_moving_median_goldens(spark):
    rows = spark.createDataFrame([(i, i + 1.0, i + 1.0) for i in range(8)], "i long, v double, w double")
    got = [r["median"] for r in quantile.moving_weighted_median(rows, [], {"i": 3}, "v", "w").orderBy("i").collect()]
    assert got == [2, 2.5, 3, 4, 5, 6, 7, 8]


def test_era_golden(spark):
    assert abs(spark.range(1).select(timescale.era(F.lit(1459648860.0))).first()[0] - (221 + 52 / 60 + 50.828 / 3600)) < 1e-3


def test_concatenate_and_positions(spark):
    rows = spark.createDataFrame([(5.0,), (1.0,), (3.0,)], "t double")
    assert [(r["i"], r["t"]) for r in series.with_positions(rows, ["t"], partitions=2).orderBy("i").collect()] == [(0, 1.0), (1, 3.0), (2, 5.0)]
    parts = [spark.range(n).withColumnRenamed("id", "i") for n in (3, 4)]
    assert sorted(r["i"] for r in series.concatenate(parts, "i", [3, 4], 2, -1).collect()) == [0, 1, 2, 3]


def test_container_round_trip(spark, tmp_path):
    c = store.Container(axes={"time": spark.range(6).select(F.col("id").alias("idx"), (F.col("id") * 10.0).alias("label"))})
    c.add("data", spark.range(6).select(F.col("id").alias("i_time"), (F.col("id") * 2.0).alias("value")), ["time"])
    c.attrs["/"] = {"a": {"b": [1, 2]}}
    c.add_history("made", {"by": "test"})
    c.save(str(tmp_path / "c"))
    back = store.load(spark, str(tmp_path / "c")).select(time=slice(1, 6, 2))
    assert sorted(tuple(r) for r in back.datasets["data"].collect()) == [(0, 2.0), (1, 6.0), (2, 10.0)]
    assert back.attrs == {"/": {"a": {"b": [1, 2]}}} and back.history == [("made", {"by": "test"})]
    with pytest.raises(RuntimeError):
        c.select(freq=[1])


def test_steps_are_checked(spark):
    @steps.step
    def keep_above(df, least=0):
        return df.where(F.col("id") > least)

    good = [{"type": "keep_above", "in": ["x"], "out": "y", "params": {"least": 2}}]
    assert steps.build(good, {"x": spark.range(5)})["y"].count() == 2
    with pytest.raises(steps.ConfigError):
        steps.build([{"type": "keep_above", "in": ["z"], "out": "y"}], {"x": spark.range(5)})


def test_align_needs_a_shared_axis(spark):
    with pytest.raises(axes.AxisException):
        axes.align(spark.range(1), spark.range(1), [])


def plain_quantile(pairs, q, method):
    if sum(w for _, w in pairs) == 0:
        pairs = [(v, 1) for v, _ in pairs]
    pairs, c, lo, hi = sorted(p for p in pairs if p[1] > 0), 0, None, None
    target = q * sum(w for _, w in pairs)
    for v, w in pairs:
        c += w
        lo = v if lo is None and c >= target else lo
        hi = v if hi is None and c > target else hi
    hi = lo if hi is None else hi
    return {"lower": lo, "higher": hi, "split": lo if lo == hi else (lo + hi) / 2}[method]


@pytest.mark.parametrize(("few_groups", "few_rows", "q", "methods"), [(10_000, 1 << 17, 0.5, quantile.METHODS), (10_000, 0, 0.0, ["split"]), (10_000, 0, 0.25, ["split"]), (10_000, 0, 1.0, ["split"]), (1, 0, 0.5, ["split"])])
def test_quantile_against_plain_python(spark, monkeypatch, few_groups, few_rows, q, methods):
    """All ways through the levels give the same: one level, both, and with more groups than are broadcast."""
    monkeypatch.setattr(quantile, "FEW_GROUPS", few_groups)
    monkeypatch.setattr(quantile, "FEW_ROWS", few_rows)
    some = [0.0, -0.5, 1.0, 1.0000000000000002, 1.0000001, 5e-324, 1e-310, -1e300, 1e300, math.inf, -math.inf, -7.25, 3.0, 3.0]
    data = {"a": [(v, i % 4) for i, v in enumerate(some)], "b": [(float(i * i % 101) - 50, i % 3) for i in range(300)], None: [(2.0, 0), (8.0, 0)], "c": [(1e-3 * i, 1) for i in range(64)]}
    rows = spark.createDataFrame([(g, v, w) for g, pairs in data.items() for v, w in pairs] + [("a", None, 5), ("a", 4.0, None), ("d", None, 1)], "g string, v double, w int")
    for method in methods:
        got = {r["g"]: r["quantile"] for r in quantile.weighted_quantile(rows, ["g"], "v", "w", q, method).collect()}
        assert got == {g: plain_quantile(pairs, q, method) for g, pairs in data.items()}


def test_quantile_without_groups_and_of_an_empty_table(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(1000)], "v long, w long")
    assert quantile.weighted_quantile(rows, [], "v", "w").first()[0] == plain_quantile([(i, i % 5) for i in range(1000)], 0.5, "split")
    assert [tuple(r) for r in quantile.weighted_quantile(rows.where("false"), [], "v", "w").collect()] == [(None,)]
    assert quantile.weighted_quantile(rows.where("false"), ["w"], "v", "w").count() == 0


def test_quantile_keeps_the_type_of_integers(spark):
    rows = spark.createDataFrame([(v, 1) for v in (-4, -1)], "v int, w int")
    out = quantile.weighted_quantile(rows, [], "v", "w", keep_type=True)
    assert out.schema["quantile"].dataType.typeName() == "integer" and out.first()[0] == -2


def test_moving_median_of_null_and_weightless_cells(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.0), (1, None, 2.0), (2, 5.0, None), (5, 3.0, 1.0), (6, 9.0, 1.0), (7, 4.0, 3.0)], "i long, v double, w double")
    got = [(r["i"], r["median"]) for r in quantile.moving_weighted_median(rows, [], {"i": 3}, "v", "w").orderBy("i").collect()]
    assert [i for i, _ in got] == [0, 1, 2, 5, 6, 7] and all(math.isnan(m) for _, m in got[:3])
    assert [m for _, m in got[3:]] == [6.0, 4.0, 4.0]


def test_rfft_of_several_lengths_and_nulls(spark):
    arrays = [[1.0, 2.0, 3.0], None, [4.0, -1.0, 0.5, 2.0], [0.0, 1.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(arrays)), "i int, v array<double>").coalesce(1)
    for r in rows.select("i", signal.rfft(F.col("v")).alias("z")).collect():
        want = None if arrays[r["i"]] is None else np.fft.rfft(arrays[r["i"]])
        assert (r["z"] is None) == (want is None)
        assert want is None or np.allclose([complex(z["re"], z["im"]) for z in r["z"]], want)
