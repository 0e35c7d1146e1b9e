"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap of ids: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: ASCII upper case to lower case, everything else kept.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on this machine alone (in tests) is one made.
    """
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage
    so that a lost executor costs one read, and fixes values made inside tasks."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, column: str = "text", rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``limit`` bytes in ``column``, at least one row and at most ``rows`` each."""
    for b in batches:
        offsets = np.frombuffer(b.column(column).buffers()[1], np.int32)[b.column(column).offset :][: b.num_rows + 1].astype(np.int64) if b.num_rows else np.zeros(1, np.int64)
        at = 0
        while at < b.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
            yield b.slice(at, end - at)
            at = end


def tidy(work: Callable, *given: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work(batches, *given)`` for mapInArrow; gives memory back when a task ends, as workers are used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches, *given)
        finally:
            give_back()

    return run


def give_back(cycles: bool = True) -> None:
    """Memory to the system; a look for cycles takes some hundredths of a second, too much for each of many small groups."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def id_remainder(column: Column, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def text_rows(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes, and the named columns; all others are dropped,
    so extra columns can't clash with those an operator adds."""
    return documents.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``hit``: whether a row's doc_id is one of ``ids`` (a few others may be hit too).

    The ids become a bitmap of fixed size, so no row is shuffled."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = ids.select("doc_id").distinct().groupBy(F.bitmap_bucket_number(at).alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    hit = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int), cast(_place % 8 as int)) & 1 = 1")
    placed = rows.withColumns({"_k": F.bitmap_bucket_number(at), "_place": F.bitmap_bit_position(at)})
    return placed.join(F.broadcast(materialize(bits, "bits")), "_k", "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_k", "_place", "_bits")


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components of ``links(a, b)``: (node, component), component the smallest node.

    Alternates large-star and small-star rounds until every node points to its component
    only, so long chains take a logarithmic number of rounds; every round is a table.
    A component's smallest node may be missing from the result.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while not only_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node of `large` now points to smaller nodes only
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(pointed).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def only_stars(edges: DataFrame) -> bool:
    """Whether each node u of ``edges(u, v)`` points once, and to a node that points nowhere."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("out")), F.struct(F.col("v").alias("n"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.n").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least")).where("out > least").isEmpty()
