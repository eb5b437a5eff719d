"""A training-data pipeline over ``documents``: each stage works on what the one before it kept.

Each stage is written as Parquet in the shared folder and read again, so a lost
executor repeats one stage at most.

* ``quality``: documents that the weak-label classifier rejects go.
* ``near_copies``: of each group of copies and near copies (five-word shingles, similarity 0.8) the smallest id stays.
* ``pii``: personal data is replaced by the name of its kind, ``n_chars`` counted anew.
* ``mixing``: sources are drawn to their tempered weights; a document drawn twice is two rows.
* ``tokens``: texts become token ids; decoding gives the text back.

Rows with nulls stay where a stage has no reason to drop them: a null text is an
empty one, which the classifier rejects; a null id or source is a value of its
own. Columns beyond those of documents are dropped. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import bpe, mixing, pii, quality_classifier, queries, simhash
from phasegrid.llm.common import DOCUMENT_COLUMNS, scratch, table


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in DOCUMENT_COLUMNS.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.good_documents(_documents(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(_documents(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row."""
    path = queries.vocabulary_path()
    return queries.digests(bpe.decode(bpe.encode(docs, path), path), "ids")


STAGES = [("quality", quality), ("near_copies", near_copies), ("pii", personal_data), ("mixing", mix), ("tokens", tokens)]

#: models, fingerprints and merges are beyond SQL; tests compare each stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # what a stage stored on the way goes as soon as its output lies there
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
