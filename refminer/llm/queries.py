"""Queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.llm.decontamination import find_overlaps, overlaps_sql
from refminer.llm.license_scan import scan_licenses
from refminer.llm.ngram_join import similarity_classes, similarity_classes_sql
from refminer.llm.packing import pack_documents
from refminer.llm.pii import find_pii
from refminer.llm.quality_classifier import classify_quality
from refminer.llm.quality_rules import quality_rules, quality_rules_sql
from refminer.llm.secrets import scan_secrets
from refminer.llm.token_counts import count_tokens
from refminer.llm.url_filter import corpus_statistics, filter_urls, label_by_seeds
from refminer.llm.url_filter import train as train_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labelled = label_by_seeds(pages)
    statistics = corpus_statistics(pages, labelled)
    return filter_urls(pages, train_urls(labelled, statistics=statistics), statistics=statistics)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(count_tokens(table(spark, sf_dir, "documents")), length=F.col("n_tokens"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify_quality(docs, docs, table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filters, op2_packing, op3_quality_rules, op4_license_scans, op5_decontamination, op6_token_counts, op7_ngram_jaccard_join, op8_pii, op9_secret_scans, op10_quality_classifier)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules_sql(), "op5_decontamination": overlaps_sql(), "op7_ngram_jaccard_join": similarity_classes_sql()}
