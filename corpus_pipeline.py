"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes the session, the documents that the one before kept, and the
folder of the tables. All but the last return documents with their own columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventpipe.llm import classifier, decontaminate, near_dedup, pieces, secrets
from eventpipe.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return classifier.keep(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark of their kind; every document stays."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their digest and that of the decoded text."""
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digests(encoded, keep_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", contamination),
    ("secret scan", secret_values),
    ("sentencepiece", tokens),
]

#: The classifier and the sketches have no SQL form; tests check each stage's operator against brute force, and the stages' rows for what must go and stay.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
