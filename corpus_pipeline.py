"""A training corpus from `documents`: classified, deduplicated, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import minhash, mixing, packing, quality_classifier, substrings
from parlance.llm.common import discard, materialize
from parlance.llm.queries import tokenizer_files

WINDOW = 50  # words of a passage that another document has first


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels of the training fold only.

    Defined results: null and empty texts are scored like any other (as a text without words); repeated rows share one
    decision; ties with the threshold stay; columns of any name pass unchanged; an empty table gives an empty one.
    """
    return quality_classifier.accepted(docs, quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8): that with the smallest doc_id.

    Defined results: texts that are null or without words, and rows without doc_id, stay; rows that repeat a doc_id stay or go
    together; columns of any name pass unchanged; an empty table gives an empty one.
    """
    gone = minhash.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of WINDOW words that a document with a smaller id has too are cut out.

    Defined results: null texts, texts of fewer words and rows without doc_id pass unchanged; rows that repeat a doc_id are one
    document; a text that loses words has the rest joined by single blanks, and n_chars set anew; an empty table gives an
    empty one.
    """
    return substrings.deduplicated(docs, window=WINDOW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their weights: rows repeat where a source is taken more than once, so a doc_id can occur again.

    Defined results: texts that are null or without words have no size and leave the mix; a null source is one of its own;
    repeated rows and rows without doc_id count as rows, each at most three times; the document on a source's boundary
    gives its first words; an empty table gives an empty one.
    """
    return mixing.mixed(docs, weights=(5, 2, 1), epochs=3, seed=0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences of 1,024 tokens.

    Defined results: a null or empty text is its end mark alone; repeated rows and rows without doc_id are placed as often as
    they occur; other columns are not read; an empty table gives an empty one.
    """
    return packing.pack_documents(docs, *tokenizer_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", mix),
    ("packing", pack),
]

#: The classifier is fitted by gradient descent, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(docs)  # the stage before is read no more
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
