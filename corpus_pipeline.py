"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Stages: the quality classifier drops documents that it rejects; line dedup cuts blocks that earlier documents have and drops
documents that are nothing but such blocks; of each group of near duplicates the first document stays; documents that hold
benchmark passages go; the rest is encoded. Every stage but the last returns the columns of its documents.

Results for odd input are those of the operators (``spendaudit/llm``): rows with a null id are classified and scanned, but
never take part in dedup; rows with null or empty texts are scored like any other, and match nothing later; an empty table
gives empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendaudit.llm.decontaminate import keep_clean
from spendaudit.llm.jaccard_join import keep_first
from spendaudit.llm.line_dedup import dedup_lines
from spendaudit.llm.quality_cnn import keep_good, train
from spendaudit.llm.queries import model_file, table
from spendaudit.llm.sentencepiece_codec import encode_documents
from spendaudit.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = f"_{uuid.uuid4().hex}"
    edited = dedup_lines(docs, flag=cut)
    return edited.filter((F.col(cut) == 0) | (F.col("text") != "")).drop(cut)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, model_file(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL can't express the classifier, patience alignment or the merge order of pieces; the pipeline is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
