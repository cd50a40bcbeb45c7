"""Training-data pipeline: from ``documents`` to token ids in five stages.

1. quality classifier: documents that the line field rejects go;
2. line dedup: repeated lines stay only in their first document; texts change, no document goes;
3. n-gram Jaccard join: one document of each group of near duplicates stays (five-word shingles,
   similarity of 0.8 or more);
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece encoding: (doc_id, ids) of what is left.

Every stage works on all rows that the one before kept, written as Parquet and read again. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from callwarden.llm.decontaminate import decontaminate_stage
from callwarden.llm.line_crf import quality_stage
from callwarden.llm.line_dedup import dedup_stage
from callwarden.llm.sentencepiece_codec import encode_stage
from callwarden.llm.shingle_join import near_duplicate_stage
from callwarden.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicate_stage(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate_stage(spark, docs, sf_dir)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_stage(spark, docs, sf_dir)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]

#: The classifier, the sketches and the encoder can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder."""
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{home}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
