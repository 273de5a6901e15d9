"""Labelled rows for the two classifiers, and the split that keeps some of them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 16_384


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that no model learns from: crc32(doc_id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``rows`` labelled documents of each label (text, label) from outside the held-out fold.

    Ids are taken in the order of their hash from the labels alone, at most ``2 * rows``
    in all, which bounds the broadcast. Texts longer than ``chars`` code points are not
    learnt from (they are scored like all others), which bounds what reaches the driver.
    Null labels and rows without doc_id or text are no examples; of rows that repeat a doc_id
    the least text is one, so no more rows than ids reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label")).distinct()
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.where(F.length("text") <= chars).select(F.col("doc_id").alias("d"), "text")
    joined = texts.join(F.broadcast(chosen), F.col("d") == F.col("doc_id"))
    return joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
