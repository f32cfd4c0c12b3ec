"""A training-corpus pipeline of five stages over the documents table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. What a stage returns is written as Parquet and read again as the next
one's documents.

All stages take nulls in any column, empty and very long texts, repeated rows and ids,
and an empty table. Null and empty texts: the classifier scores them by what every
document has, they are no duplicates, hold no secrets and have no tokens. A null id is
kept by every stage that chooses by id. Columns beside doc_id and text are carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrid.lineage import shared_folder
from citygrid.llm import jaccard, mixing, pieces, quality, secrets
from citygrid.llm.common import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Shingles of five words and a similarity of 0.8.
    """
    return jaccard.keep_one(docs, jaccard.near_groups(docs, words=5, percent=80))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return secrets.redact(docs, secrets.train(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents are to have a hundredth of their tokens, all others as many as now,
    without repeating any."""
    mixed = mixing.mix_documents(docs, mixing.label_domains(table(spark, sf_dir, "labels")), {"good": 1.0, "poor": 1.0, "toxic": 0.01}, top=1.0, absolute=True)
    return mixing.apply_copies(docs, mixed)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each remaining document."""
    return pieces.encode_documents(docs, keep_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: The learned stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
