"""Labelled rows for learned scores: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT_FOLD = 4, 2


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` texts of each class, chosen by a hash of their ids, and the count of all that may be learned from.

    Only labels of 0 or 1 outside the held-out fold count; of an id with several
    rows, the greatest label and the least text do.  Only ids and labels are ranked.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    totals = {row.y: row.n for row in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in sorted(totals):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    if chosen is None:
        chosen = known.limit(0)
    # The sample is at most 2 * per_class ids, so it can be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")), totals
