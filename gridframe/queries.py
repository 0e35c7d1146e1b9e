"""The queries of the library over the test tables, each beside DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridframe.functions import numeric, sphere, timescale
from gridframe.operators import axes, quantile, random, series, signal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantile_sql(source: str, by: str, value: str, weight: str, q: float, out: str, name: str) -> str:
    g = f"PARTITION BY {by}"
    return f"""WITH s AS (SELECT {by}, {value} v, sum({weight})::DOUBLE w, count(*)::DOUBLE n FROM {source} GROUP BY ALL),
      u AS (SELECT {by}, v, CASE WHEN sum(w) OVER ({g}) = 0 THEN n ELSE w END w FROM s),
      c AS (SELECT {by}, v, sum(w) OVER ({g} ORDER BY v ROWS UNBOUNDED PRECEDING) c, {q} * sum(w) OVER ({g}) t FROM u WHERE w > 0),
      e AS (SELECT {by}, min(v) FILTER (c >= t) lo, min(v) FILTER (c > t) hi0 FROM c GROUP BY ALL)
      SELECT {by}, {out} AS {name} FROM (SELECT {by}, lo, coalesce(hi0, lo) hi FROM e)"""


def weighted(name: str, by: str, q: float, method: str, weight: str = "l_quantity") -> None:
    out = {"split": "(lo + hi) / 2", "lower": "lo", "higher": "hi"}[method]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select(by, "l_extendedprice", F.expr(weight).alias("w"))
        return quantile.weighted_quantile(rows, [by], "l_extendedprice", "w", q, method, "price")

    QUERIES[name], ORACLE_SQL[name] = run, quantile_sql("lineitem", by, "l_extendedprice", weight, q, out, "price")


weighted("weighted_median_split", "l_returnflag", 0.5, "split")
weighted("weighted_median_lower", "l_returnflag", 0.5, "lower")
weighted("weighted_median_higher", "l_returnflag", 0.5, "higher")
weighted("weighted_quantile_q25", "l_linestatus", 0.25, "split")
weighted("weighted_quantile_q90", "l_linestatus", 0.9, "split")
weighted("weighted_median_zero_weights", "l_returnflag", 0.5, "split", "CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(l_discount) < 5.562684646268003e-309 THEN 0 ELSE 1 / l_discount END AS inverse FROM lineitem")
def invert_no_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEY, numeric.invert_no_zero(F.col("l_discount")).alias("inverse"))


TRUNCATED = "CASE WHEN {x} = 0 OR {e} = 0 THEN {x} ELSE round_even(({x} / g)::DOUBLE, 0)::DOUBLE * g END AS kept FROM (SELECT *, pow(2::DOUBLE, floor(log2(CASE WHEN {e} > 0 THEN {e} ELSE 1 END)) + 1) g FROM (SELECT *, {error} AS {e} FROM lineitem))"


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + TRUNCATED.format(x="l_extendedprice", e="e", error="abs(l_extendedprice * 0.001)"))
def bit_truncate_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*KEY, numeric.bit_truncate_relative(F.col("l_extendedprice"), 0.001).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + TRUNCATED.format(x="l_extendedprice", e="e", error="CASE WHEN l_quantity = 0 THEN abs(l_extendedprice * 0.001) ELSE 1 / sqrt(l_quantity) END"))
def bit_truncate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*KEY, numeric.bit_truncate_weights(F.col("l_extendedprice"), F.col("l_quantity"), 0.001).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + TRUNCATED.format(x="l_extendedprice", e="e", error="l_quantity"))
def bit_truncate_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*KEY, numeric.bit_truncate(F.col("l_extendedprice"), F.col("l_quantity")).alias("kept"))


@query("SELECT l_suppkey, round(sum(l_extendedprice), 4) AS total, count(*) AS n FROM lineitem GROUP BY ALL")
def reduce_sum_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.reduce_axes(table(spark, sf_dir, "lineitem"), ["l_suppkey"], total=F.round(F.sum("l_extendedprice"), 4), n=F.count(F.lit(1)))


@query("SELECT l_returnflag, min(l_discount) AS low, max(l_discount) AS high, bool_and(l_tax >= 0) AS all_taxed FROM lineitem GROUP BY ALL")
def reduce_minmax_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return axes.reduce_axes(rows, ["l_returnflag"], low=axes.nan_min(F.col("l_discount")), high=F.max("l_discount"), all_taxed=F.bool_and(F.col("l_tax") >= 0))


@query("SELECT round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS middle, count(*) AS n FROM lineitem")
def reduce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    totals = axes.reduce_axes(rows, [], total=F.round(F.sum("l_quantity"), 4), mean=F.round(F.avg("l_quantity"), 6), n=F.count(F.lit(1)))
    middle = quantile.weighted_quantile(rows.select("l_quantity", F.lit(1.0).alias("w")), [], "l_quantity", "w", 0.5, "split", "middle")
    return totals.join(F.broadcast(middle)).select("total", "mean", "middle", "n")  # one row beside one row


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS running FROM orders")
def cumsum_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = axes.accumulate(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "running")
    return rows.select("o_custkey", "o_orderkey", F.round("running", 4).alias("running"))


MOVING = """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value v, event_id % 5 AS w FROM events),
  x AS (SELECT e.user_id, i + o AS i, v, w FROM e, (VALUES (-2), (-1), (0), (1), (2)) t(o) WHERE w > 0),
  c AS (SELECT user_id, i, v, sum(w) OVER (PARTITION BY user_id, i ORDER BY v, w ROWS UNBOUNDED PRECEDING) c, 0.5 * sum(w) OVER (PARTITION BY user_id, i) t FROM x),
  m AS (SELECT user_id, i, min(v) FILTER (c >= t) lo, min(v) FILTER (c > t) hi FROM c GROUP BY ALL)
  SELECT e.user_id, e.i, coalesce((lo + coalesce(hi, lo)) / 2, 'nan'::DOUBLE) AS median FROM e LEFT JOIN m USING (user_id, i)"""


@query(MOVING)
def moving_weighted_median_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").select("user_id", place.cast("long").alias("i"), "value", (F.col("event_id") % 5).alias("w"))
    return quantile.moving_weighted_median(rows, ["user_id"], {"i": 5}, "value", "w")


GRID = "SELECT l_suppkey % 16 AS y, l_partkey % 24 AS x, max(l_quantity) AS v, min(l_linenumber) AS w FROM lineitem GROUP BY ALL"


@query(f"""WITH e AS ({GRID}), o AS (SELECT a.o AS dy, b.o AS dx FROM (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) b(o)),
  s AS (SELECT y + dy AS y, x + dx AS x, v, w FROM e, o WHERE w > 0),
  c AS (SELECT y, x, v, sum(w) OVER (PARTITION BY y, x ORDER BY v, w ROWS UNBOUNDED PRECEDING) c, 0.5 * sum(w) OVER (PARTITION BY y, x) t FROM s),
  m AS (SELECT y, x, min(v) FILTER (c >= t) lo, min(v) FILTER (c > t) hi FROM c GROUP BY ALL)
  SELECT e.y, e.x, (lo + coalesce(hi, lo)) / 2 AS median FROM e JOIN m USING (y, x)""")
def moving_weighted_median_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("y"), (F.col("l_partkey") % 24).alias("x")).agg(F.max("l_quantity").alias("v"), F.min("l_linenumber").alias("w"))
    return quantile.moving_weighted_median(rows, [], {"y": 3, "x": 3}, "v", "w")


POSITIONS = "(SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, event_id, value, event_type FROM events)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_positions(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("i", "event_id", "value", "event_type")


@query(f"SELECT (i - 10) // 3 AS i, event_id FROM {POSITIONS} WHERE i >= 10 AND i < 500 AND (i - 10) % 3 = 0")
def axis_slice_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.slice_axis(positions(spark, sf_dir).select("i", "event_id"), "i", 10, 500, 3)


@query(f"SELECT t.k AS i, event_id FROM {POSITIONS} e JOIN (VALUES (0, 0), (1, 7), (2, 2), (3, 7)) t(k, p) ON e.i = t.p")
def axis_take_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.take_axis(positions(spark, sf_dir).select("i", "event_id"), "i", [0, 7, 2, 7])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#34')")
def axis_map_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("label"))
    return axes.select_labels(table(spark, sf_dir, "lineitem").select(*KEY), "l_partkey", labels, ["Brand#12", "Brand#23", "Brand#34"])


@query("SELECT s_suppkey, s_nationkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("label"))
    return axes.with_labels(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", labels, "nation")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * p_size AS weighted FROM lineitem JOIN part ON l_partkey = p_partkey")
def broadcast_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return axes.align(table(spark, sf_dir, "lineitem"), weights, ["l_partkey"]).select(*KEY, (F.col("l_quantity") * F.col("p_size")).alias("weighted"))


@query("SELECT i - 100 AS i, event_id FROM (SELECT event_id AS i, event_id FROM events) WHERE i >= 100 AND i < (SELECT count(*) FROM events) - 50")
def time_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    n = events.count()
    cuts = [n * k // 5 for k in range(6)]
    parts = [events.where((F.col("event_id") >= a) & (F.col("event_id") < b)).withColumn("i", F.col("event_id") - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return series.concatenate(parts, "i", [b - a for a, b in zip(cuts, cuts[1:], strict=False)], 100, -50).select("i", "event_id")


@query("SELECT event_id, value FROM events WHERE epoch_us(ts) >= 1704499200000000 AND epoch_us(ts) < 1705708800000000")
def time_range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.where("ts >= timestamp_ntz'2024-01-06 00:00:00' AND ts < timestamp_ntz'2024-01-20 00:00:00'").select("event_id", "value")


@query("""WITH g AS (SELECT epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY epoch_us(ts), event_id) d FROM events)
  SELECT event_id, round(epoch_us(ts) / 1e6 + (SELECT abs(quantile_cont(d, 0.5)) FROM g) / 2, 2) AS centre FROM events""")
def time_bin_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", timescale.unix_time(F.col("ts")).alias("t"))
    return series.bin_centres(rows, "t", ["t", "event_id"], 1.0).select("event_id", F.round("centre", 2).alias("centre"))


@query(f"SELECT i // 7 AS batch, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY i) AS members FROM {POSITIONS} GROUP BY ALL HAVING count(*) = 7")
def batch_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.batches(positions(spark, sf_dir), "i", 7, "event_id").withColumn("members", F.array_join("members", ","))


@query(f"WITH p AS {POSITIONS}, n AS (SELECT count(*) AS n, count(*) // 7 AS b, count(*) % 7 AS r FROM events) SELECT event_id, CASE WHEN i < r * (b + 1) THEN i // (b + 1) ELSE r + (i - r * (b + 1)) // b END AS block FROM p, n")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir)
    return rows.select("event_id", axes.block_of(F.col("i"), rows.count(), 7).alias("block"))


@query("SELECT o_orderkey, o_orderkey % 6 AS part FROM orders")
def partition_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", axes.partition_of(F.col("o_orderkey"), 6, "alt").alias("part"))


@query(f"SELECT event_type, min(i) AS first_seen FROM {POSITIONS} GROUP BY ALL")
def unique_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.unique_ordered(positions(spark, sf_dir), "event_type", "i")


@query("SELECT vec_id * 64 + k AS cell, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)")
def reshape_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = axes.unpack(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "k", "v")
    return axes.reshape_flat(cells.withColumn("v", F.col("v").cast("double")), "vec_id", "k", 64, "cell").select("cell", "v")


@query("SELECT k, count(*) AS n, round(sum(v), 3) AS total FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY ALL")
def transpose_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = axes.unpack(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "k", "v")
    packed = axes.pack(cells.withColumn("v", F.col("v").cast("double")), "k", "v", ["vec_id"])
    return axes.reduce_axes(axes.unpack(packed, "v", "k", "x"), ["k"], n=F.count(F.lit(1)), total=F.round(F.sum("x"), 3))


@query("SELECT count(*) FILTER (event_id % 11 = 0) AS v_nan, count(*) FILTER (event_id % 11 = 1) AS v_inf FROM events")
def nan_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("CASE event_id % 11 WHEN 0 THEN double('nan') WHEN 1 THEN double('-infinity') ELSE value END")
    return axes.nan_census(table(spark, sf_dir, "events").select(v.alias("v")), ["v"])


THETA, PHI = "radians(1 + c_custkey % 178)", "radians(c_custkey % 360 - 180)"


@query(f"SELECT c_custkey, round(sin({THETA}) * cos({PHI}), 9) + 0 AS x, round(sin({THETA}) * sin({PHI}), 9) + 0 AS y, round(cos({THETA}), 9) + 0 AS z FROM customer")
def sph_to_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("s", sphere.sph_to_cart(F.expr(THETA), F.expr(PHI)))
    return rows.select("c_custkey", *[F.round(f"s.{c}", 9).alias(c) for c in "xyz"])


XYZ = ("1 + c_custkey % 7", "2 - c_custkey % 5", "3 + c_nationkey")


@query("SELECT c_custkey, round(sqrt(x*x + y*y + z*z), 9) + 0 AS r, round(acos(z / sqrt(x*x + y*y + z*z)), 9) + 0 AS theta, round(atan2(y, x), 9) + 0 AS phi FROM (SELECT c_custkey, (1 + c_custkey % 7)::DOUBLE x, (2 - c_custkey % 5)::DOUBLE y, (3 + c_nationkey)::DOUBLE z FROM customer)")
def cart_to_sph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("s", sphere.cart_to_sph(*[F.expr(e).cast("double") for e in XYZ]))
    return rows.select("c_custkey", *[F.round(f"s.{c}", 9).alias(c) for c in ("r", "theta", "phi")])


LON, LAT = "radians(c_custkey % 360)", "radians(c_nationkey * 7 - 85)"


@query(f"SELECT c_custkey, round(2 * asin(sqrt(pow(sin((0.5 - {LAT}) / 2), 2) + cos({LAT}) * cos(0.5) * pow(sin((1.5 - {LON}) / 2), 2))), 9) + 0 AS distance FROM customer")
def sphdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sphere.sphdist(F.expr(LON), F.expr(LAT), F.lit(1.5), F.lit(0.5))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(d, 9).alias("distance"))


@query(f"SELECT c_custkey, round(-cos({LAT}) * sin({LON}), 9) + 0 AS x, round(cos(0.86) * sin({LAT}) - sin(0.86) * cos({LAT}) * cos({LON}), 9) + 0 AS y, round(sin(0.86) * sin({LAT}) + cos(0.86) * cos({LAT}) * cos({LON}), 9) + 0 AS z FROM customer")
def sph_to_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("s", sphere.sph_to_ground(F.expr(LON), F.lit(0.86), F.expr(LAT)))
    return rows.select("c_custkey", *[F.round(f"s.{c}", 9).alias(c) for c in "xyz"])


@query("""WITH a AS (SELECT c_custkey, (1 + c_custkey % 7)::DOUBLE x, (2 - c_custkey % 5)::DOUBLE y, (3 + c_nationkey)::DOUBLE z FROM customer),
  b AS (SELECT c_custkey, x * cos(0.3) - y * sin(0.3) x1, x * sin(0.3) + y * cos(0.3) y1, z FROM a),
  c AS (SELECT c_custkey, x1, y1 * cos(0.2) + z * sin(0.2) y2, -y1 * sin(0.2) + z * cos(0.2) z2 FROM b)
  SELECT c_custkey, round(x1 * cos(0.1) - z2 * sin(0.1), 9) + 0 AS x, round(y2, 9) + 0 AS y, round(x1 * sin(0.1) + z2 * cos(0.1), 9) + 0 AS z FROM c""")
def rotate_ypr(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = sphere.rotate_ypr(F.lit(0.3), F.lit(0.2), F.lit(0.1), *[F.expr(e).cast("double") for e in XYZ])
    rows = table(spark, sf_dir, "customer").withColumn("s", turned)
    return rows.select("c_custkey", *[F.round(f"s.{c}", 9).alias(c) for c in "xyz"])


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, epoch_us(ts) / 1e6 AS unix, round(epoch_us(ts) / 1e6 - floor(epoch_us(ts) / 1e6 / 86400) * 86400, 6) AS of_day FROM events")
def unix_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timescale.unix_time(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", timescale.time_string(F.col("ts")).alias("stamp"), t.alias("unix"), F.round(timescale.time_of_day(t), 6).alias("of_day"))


TURNS = "(0.7790572732640::DOUBLE + 0.00273781191135448::DOUBLE * d + (d - floor(d)))"


@query(f"WITH t AS (SELECT event_id, epoch_us(ts) / 1e6 / 86400 - 10957.5::DOUBLE AS d FROM events), e AS (SELECT event_id, 360 * ({TURNS} - floor({TURNS})) AS a FROM t) SELECT event_id, round(a, 6) AS era, round((a + 240.38) - floor((a + 240.38) / 360) * 360, 6) AS lsa FROM e")
def earth_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timescale.unix_time(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(timescale.era(t), 6).alias("era"), F.round(timescale.lsa(t, 240.38), 6).alias("lsa"))


@query("SELECT o_orderkey, (SELECT count(*) FROM (VALUES " + ", ".join(f"('{d}')" for d in timescale.LEAP_DAYS) + ") l(d) WHERE d::DATE <= o_orderdate) AS leaps FROM orders")
def leap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", timescale.leap_seconds(timescale.unix_time(F.col("o_orderdate"))).alias("leaps"))


@query("SELECT vec_id, round(a * c - b * d, 9) + 0 AS re, round(a * d + b * c, 9) + 0 AS im, round(sqrt(a * a + b * b), 9) + 0 AS size FROM (SELECT vec_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c, embedding[4]::DOUBLE d FROM embeddings)")
def complex_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    x, y = numeric.complex_of(e[0], e[1]), numeric.complex_of(e[2], e[3])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", numeric.complex_multiply(x, y).alias("z"), numeric.complex_abs(x).alias("size"))
    return rows.select("vec_id", F.round("z.re", 9).alias("re"), F.round("z.im", 9).alias("im"), F.round("size", 9).alias("size"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT i, round(CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END * (0.54 - 0.46 * cos(2 * pi() * i / 255)), 9) + 0 AS w
  FROM (SELECT range AS i, (range / 256.0::DOUBLE - 0.5) * 4 AS x FROM range(256))""")
def window_sinc_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(256).select(F.col("id").alias("i"), F.round(signal.sinc_window(F.col("id"), 4, 64), 9).alias("w"))


@query("""WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  z AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * i / 64)) re, sum(v * sin(2 * pi() * k * i / 64)) im FROM c, (SELECT range AS k FROM range(33)) GROUP BY ALL)
  SELECT vec_id, k, round(re * re + im * im, 6) AS power FROM z""")
def fft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectrum = table(spark, sf_dir, "embeddings").select("vec_id", signal.power(signal.rfft(F.col("embedding").cast("array<double>"))).alias("p"))
    return spectrum.select("vec_id", F.posexplode("p").alias("k", "power")).select("vec_id", "k", F.round("power", 6).alias("power"))


PFB_SQL = f"""WITH w AS (SELECT n, CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END * (0.54 - 0.46 * cos(2 * pi() * n / 127)) AS w FROM (SELECT n, (n / 128.0::DOUBLE - 0.5) * 4 AS x FROM range(128) r(n))),
  s AS (SELECT i, value AS v FROM {POSITIONS}), b AS (SELECT b FROM range((SELECT count(*) // 32 - 3 FROM s)::BIGINT) r(b)),
  cells AS (SELECT b, n, v * w AS x FROM b, w JOIN s ON i = 32 * b + n)
  SELECT b AS block, c AS channel, round(sum(x * cos(2 * pi() * c * n / 32)), 6) + 0.0 AS re, round(sum(-x * sin(2 * pi() * c * n / 32)), 6) + 0.0 AS im FROM cells, range(16) r(c) GROUP BY ALL"""


@query(PFB_SQL)
def pfb_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = signal.pfb(positions(spark, sf_dir), "i", "value", 32)
    return z.select("block", "channel", *[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")])


def xxh64_sql(h: str, of: str, long: bool) -> list[dict[str, str]]:
    """Layers that continue the hash column ``h`` by an integer of 8 or 4 bytes: XXH64, in unsigned numbers of 128 bits."""
    p = [f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
    word = "18446744073709551616::UHUGEINT"
    times = lambda a, b: f"(({a}) * {b} % {word})"
    rolled = lambda a, r: f"(({a}) * {1 << r}::UHUGEINT % {word} + ({a}) // {1 << 64 - r}::UHUGEINT)"
    mixed = times(rolled(times(f"{of}::UHUGEINT", p[1]), 31), p[0]) if long else times(f"{of}::UHUGEINT", p[0])
    steps = [{"h0": f"xor(({h} + {p[4]} + {8 if long else 4}::UHUGEINT) % {word}, {mixed})"}]
    steps.append({"h1": f"({times(rolled('h0', 27 if long else 23), p[0] if long else p[1])} + {p[3] if long else p[2]}) % {word}"})
    for shift, factor in ((33, p[1]), (29, p[2])):
        steps.append({f"g{shift}": f"xor(h{1 if shift == 33 else 2}, h{1 if shift == 33 else 2} // {1 << shift}::UHUGEINT)"})
        steps.append({f"h{2 if shift == 33 else 3}": times(f"g{shift}", factor)})
    return [*steps, {"h4": f"xor(h3, h3 // {1 << 32}::UHUGEINT)"}]


def uniform_sql(stream: int, seed: int = 5) -> str:
    """(event_id, u): the uniform numbers of a stream."""
    source = "SELECT event_id, 42::UHUGEINT AS h FROM events"
    for of, long in (("event_id", True), (str(seed), False), (str(stream), False)):
        for step in xxh64_sql("h", of, long):
            source = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM ({source})"
        source = f"SELECT event_id, h4 AS h FROM ({source})"
    return f"(SELECT event_id, (h // 2048::UHUGEINT)::DOUBLE / {1 << 53} AS u{stream} FROM ({source}))"


@query(f"SELECT event_id, u0 AS u, round(sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2), 9) + 0.0 AS z, floor(u3 * 10)::BIGINT AS k FROM {uniform_sql(0)} JOIN {uniform_sql(1)} USING (event_id) JOIN {uniform_sql(2)} USING (event_id) JOIN {uniform_sql(3)} USING (event_id)")
def rng_reproducible(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", random.uniform(i, 5).alias("u"), (F.round(random.normal(i, 5), 9) + 0.0).alias("z"), random.integers(i, 5, 0, 10).alias("k"))


@query("""WITH e AS (SELECT s_suppkey, radians(1 + s_suppkey % 178) t, radians(s_nationkey * 5) p, radians(s_nationkey * 9) q FROM supplier),
  v AS (SELECT s_suppkey, sin(t) * cos(p) ax, sin(t) * sin(p) ay, cos(t) az, sin(t) * cos(q) bx, sin(t) * sin(q) b_y, cos(t) bz FROM e),
  d AS (SELECT *, acos(greatest(-1, least(1, ax * bx + ay * b_y + az * bz))) g, k, k / 4.0 f FROM v, range(5) r(k)),
  w AS (SELECT *, CASE WHEN sin(g) = 0 THEN 1 - f ELSE sin((1 - f) * g) / sin(g) END a, CASE WHEN sin(g) = 0 THEN f ELSE sin(f * g) / sin(g) END b FROM d)
  SELECT s_suppkey, k, round(a * ax + b * bx, 6) + 0.0 AS x, round(a * ay + b * b_y, 6) + 0.0 AS y, round(a * az + b * bz, 6) + 0.0 AS z FROM w""")
def great_circle_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [sphere.sph_to_cart(F.radians(1 + F.col("s_suppkey") % 178), F.radians(F.col("s_nationkey") * s)) for s in (5, 9)]
    points = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(sphere.great_circle_points(*ends, 5)).alias("k", "p"))
    return points.select("s_suppkey", F.col("k").cast("long").alias("k"), *[(F.round(F.col(f"p.{c}"), 6) + 0.0).alias(c) for c in "xyz"])
