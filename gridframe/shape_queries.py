"""Queries of shapes, group trees and collections of containers over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions import timescale
from gridframe.operators import quantile, series, shapes
from gridframe.plans import containers
from gridframe.queries import query, table
from gridframe.sources import collections, folders, schema, store, tree

CELLS = "(SELECT vec_id AS v, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.posexplode("embedding").alias("k", "x")).select("v", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"))


@query(f"SELECT v, (k // 16)::BIGINT AS a, (k // 4 % 4)::BIGINT AS b, (k % 4)::BIGINT AS c, x FROM {CELLS}")
def reshape_one_to_three_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of 64 as 4 x 4 x 4, the axis of vectors kept."""
    return shapes.reshape(vectors(spark, sf_dir), {"v": None, "k": 64}, {"v": None, "a": 4, "b": -1, "c": 4})


@query(f"SELECT v, ((k // 16) * 2 + (k // 8) % 2)::BIGINT AS row, (k % 8)::BIGINT AS col, x FROM {CELLS}")
def reshape_three_to_two_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = shapes.reshape(vectors(spark, sf_dir), {"v": None, "k": 64}, {"v": None, "a": 4, "b": 4, "c": 4})
    return shapes.reshape(cube, {"v": None, "a": 4, "b": 4, "c": 4}, {"v": None, "row": 8, "col": -1})


@query(f"SELECT v, 0::BIGINT AS k, round(product(1 + x / 100), 9) AS grown FROM {CELLS} GROUP BY v")
def product_keeps_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = vectors(spark, sf_dir).withColumn("x", 1 + F.col("x") / 100)
    return shapes.reduce_over(cells, ["v", "k"], "x", "prod", ["k"], keepdims=True, name="grown").withColumn("grown", F.round("grown", 9))


@query(f"SELECT v, k, round(x - m, 9) AS rest FROM {CELLS} JOIN (SELECT v, avg(x) AS m FROM {CELLS} GROUP BY v) USING (v)")
def subtract_kept_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values less their mean along an axis that the mean keeps with one position."""
    cells = vectors(spark, sf_dir)
    mean = shapes.reduce_over(cells, ["v", "k"], "x", "mean", ["k"], keepdims=True, name="m")
    n = cells.agg(F.max("v") + 1).first()[0] or 0
    both = shapes.together(cells, {"v": n, "k": 64}, mean, {"v": n, "k": 1})
    return both.select("v", "k", F.round(F.col("x") - F.col("m"), 9).alias("rest"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal AS balance FROM customer WHERE c_acctbal > 0")
def boolean_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("balance"))
    return shapes.mask_axis(rows, "i", rows.select(F.col("i").alias("idx"), (F.col("balance") > 0).alias("keep"))).select("i", "balance")


@query("SELECT round(median(l_extendedprice), 4) AS middle FROM lineitem")
def median_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a whole table by dividing buckets of values, so no task orders all of them."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", F.lit(1.0).alias("w"))
    return quantile.weighted_quantile(rows, [], "l_extendedprice", "w", 0.5, "split", "middle").select(F.round("middle", 4).alias("middle"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def attributes_in_typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def kinds(spark: SparkSession, sf_dir: str) -> tree.Tree:
    """Orders and customers as a tree: the prices of orders by status, and the balances and names of customers."""
    out = tree.Tree()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    for status in "FOP":
        out.create_dataset(f"orders/{status}/price", orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), ["i"], status=status)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("value"), F.col("c_name").cast("binary").alias("name"))
    out.create_dataset("customers/balance", customers.select("i", "value"), ["i"])
    out.create_dataset("customers/name", customers.select("i", "name"), ["i"])
    return out


@query("SELECT 'orders/' || o_orderstatus || '/price' AS path, count(*) AS cells FROM orders GROUP BY ALL UNION ALL SELECT unnest(['customers/balance', 'customers/name']), count(*) FROM customer")
def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each dataset of a tree that was saved and read again."""
    at = folders.scratch(spark)
    kinds(spark, sf_dir).save(spark, at)
    return tree.load(spark, at).sizes()


@query("SELECT (o_orderkey - 100)::BIGINT // 2 AS i, o_orderstatus AS status, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND (o_orderkey - 100) % 2 = 0 AND o_orderstatus <> 'P'")
def tree_copied_with_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group copied with every second position from the hundredth on, without one of its datasets."""
    part = kinds(spark, sf_dir).copy({"i": slice(100, None, 2)}, "orders", lambda path: not path.startswith("P/"))
    return reduce(DataFrame.unionByName, [df.select("i", F.lit(part.attrs[p]["status"]).alias("status"), "value") for p, df in part.datasets.items()])


@query("SELECT c_custkey AS i, c_name AS name FROM customer WHERE c_custkey < (SELECT max(c_custkey) FROM customer) - 9")
def tree_copied_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names held as bytes, copied as text without the last ten positions."""
    return kinds(spark, sf_dir).copy({"i": slice(None, -10)}, "customers", as_text=True)["name"]


def balances(spark: SparkSession, sf_dir: str) -> list[str]:
    """Containers of customers' balances, one for each segment in a folder of its name."""
    at = folders.scratch(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i_place"), F.col("c_acctbal").alias("value"), "c_mktsegment")
    for segment in ("BUILDING", "AUTOMOBILE", "MACHINERY"):
        own = rows.where(F.col("c_mktsegment") == segment).drop("c_mktsegment")
        held = store.Container(axes={"place": own.select(F.col("i_place").alias("idx"), F.col("i_place").alias("label"))})
        held.add("balance", own, ["place"]).save(f"{at}/of_{segment.lower()}.cells")
    return folders.find(spark, f"{at}/of_*.cells")


@query("SELECT o_orderkey, 'of_' || lower(c_mktsegment) AS tag, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')")
def containers_matched_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order beside its customer's balance, from the container that a key of the order's row names."""
    held = collections.collection(spark, balances(spark, sf_dir), "balance")
    wants = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_custkey").alias("i_place"), "c_mktsegment")
    both = collections.matched(wants, held, F.format_string("of_%s", F.lower("c_mktsegment")), ["i_place"])
    return both.select("o_orderkey", "tag", F.col("value").alias("balance"))


@query("SELECT n_nationkey, s.tag, count(c.c_custkey) AS n, round(sum(c_acctbal), 4) AS total FROM nation JOIN (VALUES (0, 'of_automobile'), (1, 'of_building'), (2, 'of_machinery')) s(k, tag) ON n_nationkey % 3 = s.k JOIN customer c ON 'of_' || lower(c_mktsegment) = s.tag GROUP BY ALL")
def containers_matched_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations beside the containers of a collection in turn: how much lies in each one's container."""
    paths = balances(spark, sf_dir)
    held = collections.collection(spark, paths, "balance").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    return collections.in_turn(nations, "n_nationkey", held, collections.in_order(spark, paths)).select("n_nationkey", "tag", "n", "total")


@query("SELECT 'roots' AS dataset, count(*) AS cells, count(*) FILTER (c_acctbal < 0) AS bad FROM customer UNION ALL SELECT 'powers', count(*), count(*) FILTER (c_acctbal > 709.782712893384) FROM customer UNION ALL SELECT 'pairs', count(*), count(*) FILTER (c_acctbal < 0 OR c_acctbal > 709.782712893384) FROM customer")
def bad_values_of_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with NaN or infinite values in the datasets of a container, whole columns, arrays and pairs alike."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.sqrt("c_acctbal").alias("root"), F.exp("c_acctbal").alias("power"))
    held = store.Container()
    held.add("roots", rows.select("i", "root"), ["i"]).add("powers", rows.select("i", F.array("power").alias("powers")), ["i"])
    return containers.census(held.add("pairs", rows.select("i", F.struct("root", "power").alias("pair")), ["i"]))


@query("SELECT o_orderstatus AS tag, count(*) AS n, round(sum(sqrt(o_totalprice)), 4) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def containers_through_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of orders' prices, a container for each status; one of them is given with its sign turned, so it is stopped."""
    at = folders.scratch(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("value"), "o_orderstatus")

    def of_status(status: str) -> store.Container:
        own = rows.where(F.col("o_orderstatus") == status).select("i", F.when(F.lit(status == "P"), -1 - F.col("value")).otherwise(F.col("value")).alias("value"))
        return store.Container(attrs={"": {"tag": status}}).add("price", own, ["i"])

    def roots(held: store.Container) -> store.Container:
        return store.Container().add("root", held.datasets["price"].withColumn("value", F.sqrt("value")), ["i"])

    step = containers.ContainerStep(roots, save_to=f"{at}/{{name}}_{{tag}}")
    passed = containers.stacked(step.over(map(of_status, "FOP")), "root")
    return passed.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i_time, event_id, value FROM events WHERE epoch(ts) >= (SELECT epoch(min(ts)) + 0.25 * (epoch(max(ts)) - epoch(min(ts))) FROM events) AND epoch(ts) < (SELECT epoch(min(ts)) + 0.5 * (epoch(max(ts)) - epoch(min(ts))) FROM events)")
def container_cut_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the events' time, chosen on an axis table of timestamps by seconds since 1970."""
    rows = series.with_positions(table(spark, sf_dir, "events").select("ts", "event_id", "value"), ["ts", "event_id"], "i_time")
    held = store.Container(axes={"time": rows.select(F.col("i_time").alias("idx"), F.col("ts").alias("label"))})
    held.add("value", rows.select("i_time", "event_id", "value"), ["time"])
    first, last = rows.agg(F.min(timescale.unix_time(F.col("ts"))), F.max(timescale.unix_time(F.col("ts")))).first()
    return schema.select_range(held, "time", first + 0.25 * (last - first), first + 0.5 * (last - first), timescale.unix_time).datasets["value"]


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag) - 1 AS i_line, l_quantity::SMALLINT AS quantity, l_discount::FLOAT AS discount, l_returnflag AS flag FROM lineitem")
def table_of_typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as records of narrower types, saved in files of bounded length and read again."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*key, F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))
    spec = schema.TableSpec({"quantity": "smallint", "discount": "float", "flag": "string"}, "line")
    held = store.Container().add("lines", spec.of(series.with_positions(rows, [*key, *spec.columns], "i_line")), ["line"])
    return schema.moved_to_disk(held, folders.scratch(spark), rows_per_file=1_000_000).datasets["lines"]
