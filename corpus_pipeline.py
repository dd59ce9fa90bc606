"""Corpus pipeline: five operators of refminer.llm over the table documents, each stage written as Parquet and read again.

Null and empty texts pass the first stage if the model rates texts without words high enough, and all others; packing gives
them no row. Rows with a null doc_id are judged by their own text; the join takes no part in them. Repeated rows stay
repeated, but for those of one doc_id that the join drops together. Further columns, whatever their names, go along up to
the last stage. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.llm.decontamination import decontaminate
from refminer.llm.ngram_join import drop_similar
from refminer.llm.packing import pack_documents
from refminer.llm.pii import mask_pii
from refminer.llm.quality_classifier import graded, select_quality, train
from refminer.llm.storage import ensure_checkpoint_dir, remove
from refminer.llm.token_counts import count_tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose probability of the best grade is high enough; the model is trained on the rated documents."""
    rated = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return select_quality(docs, train(rated, graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of copies and near copies."""
    return drop_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no run of 13 words with a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens: doc_id, piece, start, n_tokens, window_id, offset."""
    return pack_documents(count_tokens(docs), length=F.col("n_tokens"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Trained models decide in two stages, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn. Their results lie in the shared checkpoint folder, each until the next is written; the last one's stays."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
