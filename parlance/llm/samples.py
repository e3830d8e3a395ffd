"""Bounded samples of labelled rows, for fitting only, and fits that run in one task on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, of: int) -> Column:
    """crc32(doc_id as text) mod `of`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def labelled(docs: DataFrame, labels: DataFrame, where: Column, most: int, seed: int = 0) -> DataFrame:
    """doc_id, text, quality of at most `most` labelled documents, those with the smallest seeded hash of their id; whole texts.

    `where` is a condition on doc_id. The ids are cut by a top-n (each task passes on at most `most`) before any text is
    read, so the broadcast side has at most `most` rows of two numbers. Labels that are null or no 0 or 1 do not count; of
    several labels of a document the smallest does, of several texts the first by code point.
    """
    marks = labels.where(where & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))


def fitted(rows: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], object]) -> object:
    """What `fit` makes of a bounded sample's rows, which come to one executor task in the order of doc_id; None of no rows.

    The model is all that reaches the driver, and a lost executor costs one try of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(batches))], pa.binary())})

    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None
