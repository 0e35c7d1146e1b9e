"""Convolution, transforms, filter bank, Bessel functions, truncation and random streams against plain computations."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.functions import bessel, numeric, sphere, timescale
from gridframe.operators import random, signal, truncation
from gridframe.sources.store import Container
from gridframe.streaming import arrivals

rng = np.random.default_rng(7)


def series_of(spark, values, name="v"):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], f"i long, {name} double")


@pytest.mark.parametrize(("n", "taps", "block"), [(1, 1, 4), (7, 3, 2), (40, 5, 8), (40, 11, 4), (5, 9, 4), (64, 64, 16)])
@pytest.mark.parametrize("circular", [True, False])
def test_convolution(spark, n, taps, block, circular):
    x, kernel = rng.normal(size=n), rng.normal(size=taps)
    got = {r["i"]: r["v"] for r in signal.convolve(series_of(spark, x), "i", "v", kernel.tolist(), n, block=block, circular=circular).collect()}
    want = [sum(kernel[k] * x[(i - k) % n] for k in range(taps) if circular or k <= i) for i in range(n)]
    assert sorted(got) == list(range(n)) and np.allclose([got[i] for i in range(n)], want, atol=1e-12)


def test_convolution_of_gaps(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 5, None), ("b", 9, 2.0), ("b", 99, 5.0)], "g string, i long, v double")
    got = {(r["g"], r["i"]): round(r["v"], 12) for r in signal.convolve(rows, "i", "v", [1.0, 0.5], 10, by=("g",), block=5).collect()}
    assert got["a", 1] == 0.5 and got["a", 5] == 0 and got["b", 9] == 2.0 and got["b", 0] == 1.0
    assert signal.convolve(rows.where("false"), "i", "v", [1.0], 10).count() == 0


def test_transforms(spark):
    rows = [(k, None if k == 2 else [(float(a), float(b)) for a, b in rng.normal(size=(n, 2))]) for k, n in enumerate((8, 5, 1, 8, 1))]
    df = spark.createDataFrame(rows, "k int, z array<struct<re:double,im:double>>")
    got = df.select("k", signal.fft(F.col("z")).alias("f"), signal.ifft(signal.fft(F.col("z"))).alias("back"), signal.fft_window(F.col("z"), F.transform("z", lambda z: F.lit(2.0))).alias("twice")).collect()
    for r, (_, z) in zip(sorted(got), rows, strict=True):
        if z is None:
            assert r["f"] is None and r["back"] is None
            continue
        whole = np.array([complex(*x) for x in z])
        assert np.allclose([complex(*x) for x in r["f"]], np.fft.fft(whole), atol=1e-12)
        assert np.allclose([complex(*x) for x in r["back"]], whole, atol=1e-12) and np.allclose([complex(*x) for x in r["twice"]], 2 * whole, atol=1e-12)


@pytest.mark.parametrize("shape", ["hamming", "hann", "none"])
def test_filter_bank(spark, shape):
    x, length, taps = rng.normal(size=100), 8, 3
    w = np.sinc((np.arange(24) / 24 - 0.5) * 3) * signal.TAPERS[shape](24)
    got = {(r["block"], r["channel"]): complex(r["re"], r["im"]) for r in signal.pfb(series_of(spark, x), "i", "v", length, taps, shape).collect()}
    assert len(got) == (100 // 8 - 2) * 4
    assert all(abs(z - sum(x[8 * b + n] * w[n] * np.exp(-2j * np.pi * c * n / 8) for n in range(24))) < 1e-10 for (b, c), z in got.items())
    at = spark.createDataFrame([(v,) for v in (0.0, 0.3, -4.0, 4.1, None)], "x double")
    rows = at.select("x", signal.channel_profile(F.col("x"), length, taps, shape).alias("p"), signal.decorrelation_ratio(F.col("x"), length, taps, shape).alias("d")).collect()
    assert [r["p"] is None for r in rows] == [False, False, False, True, True]
    assert abs(complex(*rows[0]["p"]) - 1) < 1e-12 and abs(complex(*rows[1]["p"]) - (w * np.exp(-2j * np.pi * 0.3 * np.arange(24) / 8)).sum() / w.sum()) < 1e-12
    assert rows[0]["d"] == pytest.approx(1) and rows[2]["d"] == pytest.approx((w[4:] * w[:-4]).sum() / (w * w).sum()) and rows[4]["d"] is None
    assert at.select(signal.decorrelation_ratio(F.lit(25.0), length, taps, shape)).first()[0] == 0


def exact(order: int, z: float) -> float:
    """The power series in fractions."""
    x, total, term, k = Fraction(z), Fraction(0), Fraction(1), 0
    for m in range(1, order + 1):
        term /= 2 * m + 1
    while k < 20 or abs(term) > abs(total) / 10**25:
        total += term
        k += 1
        term *= -x * x / (2 * k * (2 * order + 2 * k + 1))
    return float(total * x**order)


def test_bessel(spark):
    cases = [(n, z) for n in (0, 1, 2, 5, 20, 21, 50) for z in (0.001, 0.5, 3.0, 4.0, 11.0, 25.0, 60.0)] + [(30, 1.0), (40, 401.0), (21, 212.0)]
    df = spark.createDataFrame(cases, "n long, z double")
    for r in df.select("n", "z", bessel.jl(F.col("n"), F.col("z")).alias("j"), bessel.jl_d(F.col("n"), F.col("z")).alias("d"), bessel.jl_d2(F.col("n"), F.col("z")).alias("e")).collect():
        n, z = r["n"], r["z"]
        assert r["j"] == pytest.approx(exact(n, z), rel=2e-5 if n > 20 else 1e-9, abs=1e-300), (n, z)
        if 0.5 <= z < 200 and n <= 20:
            assert r["d"] == pytest.approx(n / z * exact(n, z) - exact(n + 1, z), rel=1e-7, abs=1e-12)
            assert r["e"] == pytest.approx((n * n - n) / (z * z) * exact(n, z) - exact(n, z) + 2 / z * exact(n + 1, z), rel=1e-6, abs=1e-12)
    edges = spark.createDataFrame([(0, 0.0), (3, 0.0), (1, math.pi * 1.4302966531242027), (2, -1.0), (-1, 1.0), (None, 1.0), (1, None)], "n long, z double")
    got = [r[0] for r in edges.select(bessel.jl(F.col("n"), F.col("z"))).collect()]
    assert got[:2] == [1.0, 0.0] and abs(got[2]) < 1e-9 and got[3:] == [None] * 4


def moments(df, column):
    r = df.agg(F.avg(column).alias("m"), F.var_samp(column).alias("v")).first()
    return r["m"], r["v"]


def test_random_streams(spark):
    n = 40_000
    df = spark.range(n)
    i = F.col("id")
    drawn = df.select(
        "id", random.exponential(i, 3, 2.0).alias("e"), random.power(i, 3, 3.0).alias("p"), random.pareto(i, 3, 5.0).alias("q"), random.gamma(i, 3, 2.5, 2.0).alias("g"), random.gamma(i, 3, 0.4).alias("h"),
        random.poisson(i, 3, 3.5).alias("few"), random.poisson(i, 3, 40.0).alias("many"), random.poisson(i, 3, 0.0).alias("none"), random.normal(i, random.seed_of(3, "other", 1)).alias("z"), random.uniform(i, 3).alias("u"),
    ).cache()
    wanted = {"e": (2.0, 4.0), "p": (0.75, 0.0375), "q": (0.25, 5 / 48), "g": (5.0, 10.0), "h": (0.4, 0.4), "few": (3.5, 3.5), "many": (40.0, 40.0), "z": (0.0, 1.0), "u": (0.5, 1 / 12)}
    for c, (mean, var) in wanted.items():
        m, v = moments(drawn, c)
        assert abs(m - mean) < 5 * math.sqrt(var / n) and abs(v / var - 1) < (0.3 if c == "q" else 0.06), c
    assert drawn.where("g is null or h is null or many is null or few is null or none <> 0").count() == 0
    assert abs(drawn.agg(F.corr("z", "u")).first()[0]) < 0.02 and abs(drawn.agg(F.corr("g", "many")).first()[0]) < 0.02
    counts = {r["few"]: r["n"] for r in drawn.groupBy("few").agg(F.count("*").alias("n")).collect()}
    assert all(abs(counts[k] / n - math.exp(-3.5) * 3.5**k / math.factorial(k)) < 0.01 for k in range(8))
    again = {r["id"]: r["m"] for r in df.repartition(7).select("id", random.poisson(i, 3, 40.0).alias("m")).where("id % 1000 = 0").collect()}
    assert again == {r["id"]: r["many"] for r in drawn.where("id % 1000 = 0").collect()}
    assert abs(drawn.alias("a").join(drawn.alias("b"), F.col("a.id") == F.col("b.id") + 1).agg(F.corr("a.u", "b.u")).first()[0]) < 0.02
    assert random_seed(spark, "x") != random_seed(spark, "y")


def random_seed(spark, name):
    return spark.range(1).select(random.seed_of(1, name)).first()[0]


def test_truncation_of_datasets(spark):
    cells = [(i, j, (32.121 * (i + 1), -0.0 if j else 7.5)) for i in range(3) for j in range(2)]
    held = Container().add("z", spark.createDataFrame(cells, "i_a long, i_b long, value struct<re:double,im:double>"), ["a", "b"])
    held.add("w", spark.createDataFrame([(0, 1 / 32), (1, 0.0)], "i_a long, value double"), ["a"]).add("n", spark.createDataFrame([(0, 1.25)], "i_a long, value float"), ["a"])
    out = truncation.truncate(held, {"z": {"weight_dataset": "w", "variance_increase": 1 / 3, "fixed_precision": 0.1}, "n": True, "w": None})
    got = {(r["i_a"], r["i_b"]): tuple(r["value"]) for r in out.datasets["z"].collect()}
    # weights of complex parts count twice: an error of 4 for the first row, a tenth of the size for the others
    assert got[0, 0] == (32.0, 8.0) and got[1, 0] == (64.0, 8.0) and got[2, 0] == (96.0, 8.0) and got[1, 1][1] == 0
    assert out.datasets["n"].schema["value"].dataType.simpleString() == "float" and out.datasets["w"].count() == 2
    with pytest.raises(KeyError):
        truncation.truncate(held, {"absent": 0.1})
    with pytest.raises(ValueError, match="lacks"):
        truncation.truncate(held, {"w": {"weight_dataset": "z"}})
    rows = spark.createDataFrame([(1, (100.0, 0.6)), (1, (0.3, 0.2)), (2, (0.3, 0.2)), (3, None)], "r int, z struct<re:double,im:double>")
    cut = truncation.truncate_rows(rows, ["r"], "z", 1e-6, 0.01).collect()
    assert sorted((r["r"], r["z"]["re"], r["z"]["im"]) for r in cut if r["z"]["re"] is not None) == [(1, 0.0, 0.0), (1, 100.0, 0.0), (2, pytest.approx(0.3, abs=0.004), pytest.approx(0.2, abs=0.004))]
    assert len(cut) == 4


def test_integer_truncation(spark):
    rows = spark.createDataFrame([(129, 1), (-129, 1), (1, 1), (129, 0), (129, -1)], "x long, e long")
    assert [r[0] for r in rows.select(numeric.bit_truncate_int(F.col("x"), F.col("e"))).collect()] == [128, -128, 0, 129, 0]


def test_places_on_the_sphere(spark):
    df = spark.createDataFrame([(0.3, 0.8, 1.1, 0.4), (2.0, 0.9, 0.5, -1.0)], "ha double, dec double, lat double, x double")
    ground = sphere.sph_to_ground(F.col("ha"), F.col("lat"), F.col("dec"))
    for r in df.select("*", ground.alias("g")).collect():
        h, d, lat = r["ha"], r["dec"], r["lat"]
        back = sphere.ground_to_sph(F.lit(r["g"]["x"]), F.lit(r["g"]["y"]), F.lit(lat))
        if r["g"]["z"] > 0:
            found = spark.range(1).select(back.alias("b")).first()["b"]
            assert math.cos(found["ha"] - h) == pytest.approx(1) and found["dec"] == pytest.approx(d)
        east, north = -math.cos(d) * math.sin(h), math.cos(lat) * math.sin(d) - math.sin(lat) * math.cos(d) * math.cos(h)
        up = math.sin(lat) * math.sin(d) + math.cos(lat) * math.cos(d) * math.cos(h)
        assert np.allclose(list(r["g"]), (east, north, up))
    one = df.select(sphere.projected_distance(F.col("ha"), F.col("lat"), F.col("dec"), F.lit(3.0), F.lit(-1.0), F.lit(0.5)).alias("p"), ground.alias("g"), sphere.tangent_basis(F.col("ha"), F.col("dec")).alias("t"), sphere.sph_to_cart(F.col("ha"), F.col("dec")).alias("c"))
    for r in one.collect():
        assert r["p"] == pytest.approx(3 * r["g"]["x"] - r["g"]["y"] + 0.5 * r["g"]["z"])
        basis = np.array([list(r["c"]), list(r["t"]["theta_hat"]), list(r["t"]["phi_hat"])])
        assert np.allclose(basis @ basis.T, np.eye(3)) and np.linalg.det(basis) == pytest.approx(1)


def test_naive_times_and_gates(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1.0, "2020-01-02 03:04:05"), (float("nan"), None), (float("inf"), None), (None, None)], "v double, s string").withColumn("ts", F.expr("cast(s as timestamp_ntz)"))
    try:
        for name in ("UTC", "America/Vancouver"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert df.select(timescale.unix_time(timescale.naive_to_utc(F.col("ts")))).first()[0] == 1577934245.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["v"] for r in arrivals.finite_only(df, ["v"]).collect()] == [1.0, None]
