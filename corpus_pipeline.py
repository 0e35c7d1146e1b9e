"""A corpus for training: stages that each take the documents the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import entries
from gridframe.llm import op02_decontamination as decontamination
from gridframe.llm import op03_packing as packing
from gridframe.llm import op04_language as language
from gridframe.llm import op07_repeats as repeats
from gridframe.llm import op09_jaccard as jaccard
from gridframe.llm.common import id_remainder, materialize, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``row``, a number of its own for each row: the doc_id for one row of each
    id; for others, and rows without an id, a number above all ids (ids are taken to be below 2**62)."""
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if shared.isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    placed = materialize(docs.withColumn("at", F.monotonically_increasing_id()), "placed")
    most = placed.agg(F.coalesce(F.greatest(F.max("doc_id"), F.lit(-1)), F.lit(-1))).first()[0]
    first = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("at").alias("at")).select("at", F.col("doc_id").alias("row"))
    return placed.join(first, "at", "left").withColumn("row", F.coalesce("row", F.lit(most + 1) + F.col("at"))).drop("at")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go.  Where no document teaches a language, all stay."""
    model = language.train(docs.where(F.coalesce(id_remainder(F.col("doc_id"), 3) != 1, F.lit(True))).select("doc_id", F.col("text").cast("binary").alias("text"), "lang"))
    if not model.languages:
        return docs.select(*COLUMNS)
    return language.identify(docs, model, *COLUMNS[1:]).where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (runs of 4 words, similarity 0.85): one with the smallest id, or
    without an id if the group has none.  Rows without words are in no group and stay."""
    rows = numbered(docs)
    groups = jaccard.near_groups(rows.select(F.col("row").alias("doc_id"), "text"))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("row"))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long strings that start earlier too; bytes of a letter cut in two go with it.
    Rows without an id, and those of an id after its first, are the latest.  Empty texts go."""
    rows = numbered(docs).select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id"), "text", *COLUMNS[2:4])
    found = repeats.remove_repeats(rows, keep=("id", *COLUMNS[2:4]))
    whole = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    had = F.col("text").cast("string").contains("\ufffd")  # then the sign may be the text's own
    cut = found.withColumn("text", F.when(had, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(whole))
    return cut.where("octet_length(kept) > 0").select(F.col("id").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark items."""
    found = decontamination.contamination(docs, entries.table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where("not contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens."""
    return packing.pack_documents(docs, entries.tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table that the next one reads."""
    docs = entries.table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
