"""More queries of the library over the test tables: selections, containers, times, text, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions import numeric, sphere, strings, timescale
from gridframe.operators import axes
from gridframe.queries import query, table
from gridframe.sources import folders, reader, store

LONGITUDE, DAY_ZERO = 240.38, 1384489290.0
SUPPLIERS = "(SELECT s_suppkey::BIGINT AS i, s_acctbal AS v, s_nationkey AS nation FROM supplier)"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("nation"))


@query(f"SELECT (i - n + 40)::BIGINT AS i, v FROM {SUPPLIERS}, (SELECT count(*) n FROM supplier) WHERE i >= n - 40 AND i < n - 5")
def slice_negative_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suppliers(spark, sf_dir)
    return axes.slice_axis(rows, "i", -40, -5, 1, rows.count()).select("i", "v")


@query(f"SELECT i, CASE WHEN i >= 10 AND i < 20 THEN 0 ELSE v END AS v FROM {SUPPLIERS}")
def slice_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.put_slice(suppliers(spark, sf_dir), "i", 10, 20, "v", F.lit(0.0)).select("i", "v")


@query("SELECT (l_linenumber - 2)::BIGINT AS line, 0::BIGINT AS new_0, sum(l_quantity) AS quantity FROM lineitem WHERE l_suppkey = 3 AND l_linenumber BETWEEN 2 AND 4 GROUP BY ALL")
def index_with_ellipsis_and_new_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("supplier"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("long").alias("line"), "l_quantity")
    part = axes.index_axes(cells, ["supplier", "order", "line"], (3, ..., slice(2, 5), None))
    return axes.reduce_axes(part, ["line", "new_0"], quantity=F.sum("l_quantity"))


@query(f"SELECT (i // 3)::BIGINT AS i, v FROM {SUPPLIERS} WHERE i < 60 AND i % 3 = 0")
def select_range_before_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = suppliers(spark, sf_dir).select(F.col("i").alias("idx"), F.col("nation").alias("label"))
    return axes.select_axis(suppliers(spark, sf_dir), "i", (0, 60, 3), [1, 2], (labels, [7])).select("i", "v")


@query(f"SELECT i, v FROM {SUPPLIERS} WHERE nation IN (3, 7, 11)")
def select_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = suppliers(spark, sf_dir).select(F.col("i").alias("idx"), F.col("nation").alias("label"))
    return axes.select_axis(suppliers(spark, sf_dir), "i", labels=(labels, [3, 7, 11])).select("i", "v")


def container(spark: SparkSession, sf_dir: str) -> store.Container:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("label"))
    held = store.Container(axes={"nation": nations})
    held.axes["region"] = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("idx"), F.col("r_name").alias("label"))
    held.add("length", nations.select(F.col("idx").alias("i_nation"), F.length("label").cast("long").alias("value")), ["nation"])
    return held.add("code", held.axes["region"].select(F.col("idx").alias("i_region"), F.length("label").cast("long").alias("value")), ["region"])


@query("SELECT 'code' AS dataset, r_regionkey::BIGINT AS i, length(r_name)::BIGINT AS value FROM region UNION ALL SELECT 'length', (n_nationkey - 5)::BIGINT, length(n_name)::BIGINT FROM nation WHERE n_nationkey BETWEEN 5 AND 14")
def copy_with_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = container(spark, sf_dir).copy_filtered("nation", slice(5, 15), copy_without_selection=True)
    return kept.datasets["code"].select(F.lit("code").alias("dataset"), F.col("i_region").alias("i"), "value").unionByName(kept.datasets["length"].select(F.lit("length").alias("dataset"), F.col("i_nation").alias("i"), "value"))


@query("SELECT n_nationkey::BIGINT AS i_nation, r AS i_region, 2.5::DOUBLE AS value FROM nation, range(3) t(r)")
def dataset_of_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = {"map": {"axes": ["nation", "region"], "initialise": True, "start": 2.5}}
    return store.Container.of_axes(spark, specs, axes_from=container(spark, sf_dir), region=3).datasets["map"]


@query("SELECT i_nation, value FROM (SELECT n_nationkey::BIGINT AS i_nation, length(n_name)::BIGINT AS value FROM nation UNION ALL SELECT n_nationkey + 25, length(n_name) FROM nation) WHERE i_nation >= 10 AND i_nation < 45")
def concatenate_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = container(spark, sf_dir)
    whole = store.concatenate([one, container(spark, sf_dir)], "nation", 10, -5)
    return whole.datasets["length"].select((F.col("i_nation") + 10).alias("i_nation"), "value")


@query("SELECT r_regionkey::BIGINT AS i_region, length(r_name)::BIGINT AS value FROM region")
def concatenate_keeps_other_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.concatenate([container(spark, sf_dir), container(spark, sf_dir)], "nation").project("code").datasets["code"]


@query("SELECT i, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS part FROM (SELECT s_suppkey::BIGINT AS i FROM supplier), (SELECT count(*) AS n FROM supplier)")
def partition_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suppliers(spark, sf_dir)
    return rows.select("i", axes.partition_of(F.col("i"), 7, "con", F.lit(rows.count())).alias("part"))


@query("SELECT user_id, low, high, f_low, f_high FROM (SELECT user_id, event_id AS low, lead(event_id) OVER w AS high, f AS f_low, lead(f) OVER w AS f_high FROM (SELECT user_id, event_id, value - 5 AS f FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE f_low * f_high <= 0")
def sign_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - 5).alias("f"))
    return axes.sign_changes(rows, ["user_id"], "event_id", "f")


@query("SELECT l_returnflag, coalesce(max(l_extendedprice) FILTER (l_discount > 0.05), max(l_extendedprice)) AS most, coalesce(min(l_extendedprice) FILTER (l_discount > 0.05), min(l_extendedprice)) AS least FROM lineitem GROUP BY ALL")
def extremes_of_positive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, weight = F.col("l_extendedprice"), F.col("l_discount") - 0.05
    return table(spark, sf_dir, "lineitem").withColumn("w", F.when(F.col("l_discount") > 0.05, weight).otherwise(0.0)).groupBy("l_returnflag").agg(numeric.max_non_zero(value, F.col("w")).alias("most"), numeric.min_non_zero(value, F.col("w")).alias("least"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN m = 0 THEN 0 ELSE l_discount / m / (pow(l_discount / m, 2) + pow(l_tax / m, 2)) / m END + 0.0 AS re, CASE WHEN m = 0 THEN 0 ELSE -l_tax / m / (pow(l_discount / m, 2) + pow(l_tax / m, 2)) / m END + 0.0 AS im FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax, greatest(l_discount, l_tax) AS m FROM lineitem)")
def invert_no_zero_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = numeric.invert_no_zero_complex(numeric.complex_of(F.col("l_discount"), F.col("l_tax")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (z["re"] + 0.0).alias("re"), (z["im"] + 0.0).alias("im"))


@query("SELECT event_id, 0.0::DOUBLE AS by_angle, 0.0::DOUBLE AS by_day, 0.0::DOUBLE AS by_stamp FROM events")
def time_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many seconds each way there and back misses the time."""
    t, rows = F.col("t"), table(spark, sf_dir, "events").select("event_id", timescale.unix_time(F.col("ts")).alias("t"))
    rows = rows.select("event_id", "t", timescale.lsa(t, LONGITUDE).alias("angle"), timescale.lsd(t, LONGITUDE, DAY_ZERO).alias("day"))
    by_angle = timescale.lsa_to_unix(F.col("angle"), t - 3600, LONGITUDE)
    by_day = timescale.lsd_to_unix(F.col("day"), LONGITUDE, DAY_ZERO)
    by_stamp = timescale.unix_time(timescale.unix_to_timestamp(t))
    return rows.select("event_id", *[(F.round(c - t, 3) + 0.0).alias(n) for n, c in (("by_angle", by_angle), ("by_day", by_day), ("by_stamp", by_stamp))])


@query("SELECT event_id, round(epoch(ts), 3) AS from_stamp, floor(epoch(ts)) AS from_text, event_id::DOUBLE AS from_number FROM events")
def ensure_unix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", timescale.time_string(F.col("ts")).alias("text"))
    stamp, text, number = (timescale.ensure_unix(F.col(c), dict(rows.dtypes)[c]) for c in ("ts", "text", "event_id"))
    return rows.select("event_id", F.round(stamp, 3).alias("from_stamp"), text.alias("from_text"), number.alias("from_number"))


@query("SELECT n_nationkey, n_name AS name, n_name || '/' || n_regionkey AS path FROM nation")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.struct(F.array("n_name").alias("names")).alias("held"))
    back = strings.ensure_unicode(strings.ensure_bytes(nested))
    name = F.col("held.names")[0]
    return back.select("n_nationkey", name.alias("name"), strings.from_template("{tag}/{region}", tag=name, region=F.col("n_regionkey")).alias("path"))


@query("SELECT s_suppkey, round(s_acctbal / r, 9) AS x, round(s_nationkey / r, 9) AS y FROM (SELECT *, sqrt(s_acctbal * s_acctbal + s_nationkey * s_nationkey) AS r FROM supplier)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sphere.norm_vec2(F.col("s_acctbal"), F.col("s_nationkey").cast("double"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(v["x"], 9).alias("x"), F.round(v["y"], 9).alias("y"))


@query("SELECT s_suppkey, i, j, round(sqrt(pow(s_nationkey + i - 2 * j, 2) + 2 * (s_nationkey + i) * 2 * j * 0.75), 9) AS side FROM supplier, range(2) a(i), range(3) b(j)")
def cosine_rule_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1 = F.array(*[(F.col("s_nationkey") + i).cast("double") for i in range(2)])
    sides = sphere.cosine_rule_outer(F.lit(0.25), x1, F.array(*[F.lit(2.0 * j) for j in range(3)]))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(sides).alias("i", "row"))
    return rows.select("s_suppkey", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "side")).select("s_suppkey", "i", F.col("j").cast("long").alias("j"), F.round("side", 9).alias("side"))


@query("SELECT i - min(i) OVER () AS i_place, i AS label, v AS value FROM (SELECT s_suppkey::BIGINT AS i, s_acctbal AS v FROM supplier) WHERE i >= (SELECT count(*) // 3 FROM supplier) AND i < (SELECT count(*) // 3 * 2 FROM supplier)")
def containers_read_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers saved as four containers, the last of them in two writes, and a range of labels read back from them."""
    rows = suppliers(spark, sf_dir).select("i", "v")
    n, at = rows.count(), folders.scratch(spark)

    def part(low: int, high: int) -> store.Container:
        own = rows.where((F.col("i") >= low) & (F.col("i") < high)).withColumn("i_place", F.col("i") - low)
        held = store.Container(axes={"place": own.select(F.col("i_place").alias("idx"), F.col("i").alias("label"))})
        return held.add("balance", own.select("i_place", F.col("v").alias("value")), ["place"])

    first = rows.agg(F.min("i")).first()[0]
    edges = [first + k * n // 4 for k in range(4)]
    for k, (low, high) in enumerate(zip(edges, [*edges[1:], first + n * 7 // 8], strict=True)):
        part(low, high).save(f"{at}/part-{k}")
    part(first + n * 7 // 8, first + n).append(f"{at}/part-3", "place")
    held = reader.Reader(spark, f"{at}/part-*", "place").select_range(n // 3, n // 3 * 2).read()
    return held.datasets["balance"].join(held.axes["place"].withColumnRenamed("idx", "i_place"), "i_place").select("i_place", "label", "value")
