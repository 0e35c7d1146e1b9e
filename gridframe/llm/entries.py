"""The thin queries of this subpackage, one per operator, and the SQL that has their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import op01_lm as lm
from gridframe.llm import op02_decontamination as decontamination
from gridframe.llm import op03_packing as packing
from gridframe.llm import op04_language as language
from gridframe.llm import op05_quality as quality
from gridframe.llm import op06_license as license_scan
from gridframe.llm import op07_repeats as repeats
from gridframe.llm import op08_html as pages_html
from gridframe.llm import op09_jaccard as jaccard
from gridframe.llm import op10_topk as topk
from gridframe.llm import op11_filters as filters
from gridframe.llm import op12_lexical as lexical
from gridframe.llm import op13_simhash as simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.cross_fit(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.cross_fit(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return license_scan.scan(documents, license_scan.known_licenses(documents))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_html.extract(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_benchmark_decontamination, op3_best_fit_packing, op4_language_id, op5_quality_classifier, op6_license_scan, op7_suffix_array_dedup, op8_html_extraction, op9_ngram_jaccard_join, op10_exact_topk, op11_filter_audit, op12_lexical_search, op13_simhash_groups)}
ORACLE_SQL: dict[str, str] = {"op6_license_scan": license_scan.oracle_sql(), "op11_filter_audit": filters.oracle_sql(), "op12_lexical_search": lexical.oracle_sql()}
