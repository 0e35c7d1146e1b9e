"""Queries of convolution, spectral windows, filter-bank profiles, Bessel functions, truncation and random streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions import bessel, numeric
from gridframe.operators import signal, truncation
from gridframe.queries import POSITIONS, positions, query, table
from gridframe.sources.store import Container

KERNEL = [0.5, -0.25, 0.125, 1.0, 0.0625]
TAPS = ", ".join(f"({k}, {v!r})" for k, v in enumerate(KERNEL))


@query(f"SELECT s.i, round(sum(k.v * x.value), 9) + 0.0 AS smooth FROM (SELECT i, value, (SELECT count(*) FROM events) AS n FROM {POSITIONS}) s, (VALUES {TAPS}) k(k, v) JOIN {POSITIONS} x ON x.i = (s.i - k.k + s.n) % s.n GROUP BY s.i")
def convolve_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir)
    found = signal.convolve(rows, "i", "value", KERNEL, rows.count(), block=512)
    return found.select("i", (F.round("value", 9) + 0.0).alias("smooth"))


@query(f"""SELECT user_id, s.i, round(sum(k.v * x.value), 9) + 0.0 AS smooth FROM (SELECT user_id, event_id % 100 AS i FROM events WHERE user_id % 10 = 0 GROUP BY ALL) s, (VALUES {TAPS}) k(k, v)
  JOIN (SELECT user_id AS u, event_id % 100 AS i, sum(value) AS value FROM events GROUP BY ALL) x ON x.i = s.i - k.k AND x.u = s.user_id GROUP BY ALL""")
def convolve_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear convolution along an axis of 100 places for each user of a group; places without events are left out again."""
    cells = table(spark, sf_dir, "events").where("user_id % 10 = 0").groupBy("user_id", (F.col("event_id") % 100).alias("i")).agg(F.sum("value").alias("value"))
    found = signal.convolve(cells, "i", "value", KERNEL, 100, by=("user_id",), block=40, circular=False)
    return found.join(cells.select("user_id", "i"), ["user_id", "i"]).select("user_id", "i", (F.round("value", 9) + 0.0).alias("smooth"))


@query("""WITH x AS (SELECT vec_id, n, embedding[2 * n + 1]::DOUBLE AS re, embedding[2 * n + 2]::DOUBLE AS im FROM embeddings, range(32) r(n)),
  z AS (SELECT vec_id, k, sum(re * cos(2 * pi() * k * n / 32) + im * sin(2 * pi() * k * n / 32)) / (1 + k) AS re, sum(im * cos(2 * pi() * k * n / 32) - re * sin(2 * pi() * k * n / 32)) / (1 + k) AS im FROM x, range(32) r(k) GROUP BY vec_id, k)
  SELECT vec_id, n, round(sum(re * cos(2 * pi() * k * n / 32) - im * sin(2 * pi() * k * n / 32)) / 32, 6) + 0.0 AS re, round(sum(re * sin(2 * pi() * k * n / 32) + im * cos(2 * pi() * k * n / 32)) / 32, 6) + 0.0 AS im FROM z, range(32) r(n) GROUP BY vec_id, n""")
def fft_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 32 complex numbers, each frequency k over 1 + k."""
    e = F.col("embedding")
    z = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda n: numeric.complex_of(e[2 * n], e[2 * n + 1]))
    window = F.array(*[F.lit(1 / (1 + k)) for k in range(32)])
    found = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.fft_window(z, window)).alias("n", "z"))
    return found.select("vec_id", F.col("n").cast("long").alias("n"), *[(F.round(f"z.{c}", 6) + 0.0).alias(c) for c in ("re", "im")])


WINDOW = "(SELECT n, CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END * (0.54 - 0.46 * cos(2 * pi() * n / 127)) AS w FROM (SELECT n, (n / 128.0::DOUBLE - 0.5) * 4 AS x FROM range(128) r(n)))"


@query(f"SELECT s_suppkey, round(sum(w * cos(2 * pi() * f * n / 32)) / any_value(t), 9) + 0.0 AS re, round(sum(-w * sin(2 * pi() * f * n / 32)) / any_value(t), 9) + 0.0 AS im FROM (SELECT s_suppkey, s_acctbal / 4000 AS f FROM supplier), {WINDOW}, (SELECT sum(w) AS t FROM {WINDOW}) GROUP BY s_suppkey")
def channel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "supplier").select("s_suppkey", signal.channel_profile(F.col("s_acctbal") / 4000, 32).alias("z"))
    return found.select("s_suppkey", *[(F.round(f"z.{c}", 9) + 0.0).alias(c) for c in ("re", "im")])


@query(f"SELECT s_suppkey, round(CASE WHEN d >= 128 THEN 0 ELSE sum(a.w * b.w) / any_value(t) END, 9) + 0.0 AS ratio FROM (SELECT s_suppkey, s_suppkey % 140 AS d FROM supplier), {WINDOW} a, {WINDOW} b, (SELECT sum(w * w) AS t FROM {WINDOW}) WHERE b.n = a.n + d OR d >= 128 AND a.n = b.n GROUP BY s_suppkey, d")
def decorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At whole delays the window's plain autocorrelation."""
    delay = (F.col("s_suppkey") % 140).cast("double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.round(signal.decorrelation_ratio(delay, 32), 9) + 0.0).alias("ratio"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DOUBLE AS z, l_linenumber % 3 AS l FROM lineitem),
  a AS (SELECT *, sin(z) / z AS j0, sin(z) / (z * z) - cos(z) / z AS j1 FROM z), b AS (SELECT *, 3 / z * j1 - j0 AS j2 FROM a), c AS (SELECT *, 5 / z * j2 - j1 AS j3 FROM b), d AS (SELECT *, 7 / z * j3 - j2 AS j4 FROM c),
  e AS (SELECT *, CASE l WHEN 0 THEN j0 WHEN 1 THEN j1 ELSE j2 END AS p, CASE l WHEN 0 THEN j1 WHEN 1 THEN j2 ELSE j3 END AS q, CASE l WHEN 0 THEN j2 WHEN 1 THEN j3 ELSE j4 END AS r FROM d)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 9) + 0.0 AS j, round(l / z * p - q, 9) + 0.0 AS d1, round(r - (2 * l + 1) / z * q + (l * l - l) / (z * z) * p, 9) + 0.0 AS d2 FROM e""")
def spherical_bessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, z = (F.col("l_linenumber") % 3).cast("long"), F.col("l_quantity")
    found = [(F.round(f(order, z), 9) + 0.0).alias(n) for n, f in (("j", bessel.jl), ("d1", bessel.jl_d), ("d2", bessel.jl_d2))]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *found)


def truncated(x: str, e: str) -> str:
    step = f"pow(2::DOUBLE, floor(log2({e})) + 1)"
    return f"CASE WHEN {x} = 0 OR {e} = 0 THEN {x} ELSE round_even(({x} / {step})::DOUBLE, 0)::DOUBLE * {step} END + 0.0"


@query(f"""WITH z AS (SELECT vec_id, k, embedding[2 * k + 1]::DOUBLE AS re, embedding[2 * k + 2]::DOUBLE AS im FROM embeddings, range(32) r(k)),
  e AS (SELECT *, greatest(sqrt(re * re + im * im) * 0.001, max(sqrt(re * re + im * im)) OVER (PARTITION BY vec_id) * 0.01) AS e FROM z)
  SELECT vec_id, k, {truncated("re", "e")} AS re, {truncated("im", "e")} AS im FROM e""")
def truncate_by_row_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda n: numeric.complex_of(e[2 * n], e[2 * n + 1]))
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pairs).alias("k", "z"))
    found = truncation.truncate_rows(cells, ["vec_id"], "z", 0.001, 0.01)
    return found.select("vec_id", F.col("k").cast("long").alias("k"), (F.col("z.re") + 0.0).alias("re"), (F.col("z.im") + 0.0).alias("im"))


@query(f"""WITH p AS (SELECT l_suppkey, l_linenumber, sum(l_extendedprice)::DOUBLE AS price, sum(l_tax)::DOUBLE AS tax FROM lineitem GROUP BY ALL), w AS (SELECT s_suppkey, s_nationkey / 1000.0 AS w FROM supplier),
  e AS (SELECT *, CASE WHEN w = 0 THEN price * 0.0001 ELSE 1 / sqrt(w / 0.003) END AS e, tax * 0.01 AS f FROM p JOIN w ON s_suppkey = l_suppkey)
  SELECT l_suppkey::BIGINT AS i_supplier, l_linenumber::BIGINT AS i_line, {truncated("price", "e")} AS price, {truncated("tax", "f")} AS tax FROM e""")
def truncate_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets over (supplier, line): one by weights that have the supplier's axis alone, one by relative precision."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("i_supplier"), F.col("l_linenumber").cast("long").alias("i_line"))
    held = Container(axes={"supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_suppkey").alias("label"))})
    held.add("price", cells.agg(F.sum("l_extendedprice").cast("double").alias("value")), ["supplier", "line"])
    held.add("tax", cells.agg(F.sum("l_tax").cast("double").alias("value")), ["supplier", "line"])
    held.add("weight", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("i_supplier"), (F.col("s_nationkey") / 1000.0).alias("value")), ["supplier"])
    cut = truncation.truncate(held, {"price": {"weight_dataset": "weight"}, "tax": 0.01, "weight": False})
    price, tax = (cut.datasets[n].withColumnRenamed("value", n) for n in ("price", "tax"))
    return price.join(tax, ["i_supplier", "i_line"]).select("i_supplier", "i_line", (F.col("price") + 0.0).alias("price"), (F.col("tax") + 0.0).alias("tax"))
