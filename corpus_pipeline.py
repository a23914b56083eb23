"""A training-data pipeline of five stages, each one of the operators in ``terrazzo.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read back as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrazzo.llm import linededup, mixing, simhash, spiece, toxicity
from terrazzo.storage import discard, materialize, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity grammar, fitted on the labelled ones, rejects.

    Null and blank texts stay; equal texts share their fate, whatever their
    ids; labels of one kind, or none, reject nothing; empty tables stay empty;
    other columns are carried along.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows.

    All rows stay. Null texts stay null; a null id comes first; rows of equal
    id are in order of a hash of their text, and ones that repeat both are one
    document and stay equal; ``n_chars`` follows the text; empty tables stay empty.
    """
    return linededup.strip(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: five-word shingles, similarity 0.8 or more.

    The smallest id stays, rows without one come last, ties go by a hash of the
    text; of rows that repeat id and text one stays; all null and blank texts
    are one class; empty tables stay empty; other columns are carried along.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights.

    A null source is one of its own; null and blank texts are taken no times
    and go; rows that repeat an id are dealt like different documents; where a
    quota ends inside a text, a row holds its first words; empty tables stay empty.
    """
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, the source bytes at which each piece ends, and the decoded text.

    One row per row; null and empty texts give empty lists and an empty text;
    only ``doc_id``, ``source`` and ``text`` are read; empty tables give empty results.
    """
    return spiece.encoded(docs, spiece.default_model())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Learned scores and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and what it used removed."""
    docs, used = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(path)
        if used:
            discard(spark, used)
        used = path
    return STAGES[-1][1](spark, docs, sf_dir)
