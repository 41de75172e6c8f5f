"""The corpus pipeline: five operators in a row, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, mixing, secrets, similarity, toxicity
from tesserae.llm.common import checkpoint_dir, removed, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the classifier, fitted on the labelled ones of the training part.

    Null and empty texts have the score of no words; repeated rows fare alike; an empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that 80 % Jaccard of five-word shingles links.

    Texts without words, null or not, are nobody's copies. Rows that repeat an id and text are one document; rows
    without an id can't be told apart and stay.
    """
    return similarity.one_of_each(docs, words=5, num=80, den=100)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of any benchmark item occurs; null and empty texts are among them."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), mode="documents", min_items=1)


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets redacted; n_chars follows. Null texts stay null."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their columns, and size, source_size, target and taken for the target weights of the sources.

    A null text has size 0; null sources are one source; repeated rows are separate documents.
    """
    return mixing.mix(docs, keep=True)


STAGES = [
    ("toxicity", toxic),
    ("jaccard join", near_duplicates),
    ("decontamination", leaks),
    ("secret scans", credentials),
    ("source mixing", mixture)
]
#: The stages learn, join by similarity and follow seeded orders, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared checkpoint folder and read again.

    A stage's result goes when that of the next one is written: the last one stays.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
