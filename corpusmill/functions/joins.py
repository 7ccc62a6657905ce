"""Joins for large corpora: no hot task, no needless shuffle of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import settle

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame's values, counted by a job."""
    row = df.select(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()
    return row.n or 0


def meet(
    texts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str,
    spread: list[str] | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a derived lookup to rows that carry text.

    The lookup is settled and its size counted.  Within ``limit`` it is broadcast
    and the text stays where it was read.  Beyond that both sides are shuffled,
    hot keys dealt over salts by the ``spread`` columns where there may be any.
    """
    lookup = settle(lookup)
    if measured_bytes(lookup) <= limit:
        return texts.join(F.broadcast(lookup), keys, how)
    if spread:
        return attach(texts, lookup, keys, spread, how)
    return texts.join(lookup, keys, how)


def hot_keys(rows: DataFrame, keys: list[str], slots: int) -> Column:
    """Map from the digest of each hot key to its number of salts, as a one-row subquery.

    Hot is a key with more than ``1 / slots`` of all rows by a top-k sketch of fixed size;
    it gets as many salts as shares of that size.  All of them together are at most
    ``2 * slots``.  Other keys are not in the map.
    """
    sketch = rows.agg(
        F.expr(f"approx_top_k({_digest_sql(keys)}, {slots}, {max(10_000, 4 * slots)})").alias("top"), F.count(F.lit(1)).alias("total")
    )
    hot = F.filter("top", lambda t: t["count"] * slots > F.col("total"))
    entry = F.transform(hot, lambda t: F.struct(t["item"], F.ceil(t["count"] * slots / F.col("total")).cast("int")))
    return sketch.select(F.map_from_entries(entry)).scalar()


def _digest_sql(keys: list[str]) -> str:
    return f"xxhash64({', '.join(f'`{key}`' for key in keys)})"


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "left",
    slots: int | None = None,
) -> DataFrame:
    """Join ``lookup`` (one row per key) to ``rows`` without a hot task.

    Rows of hot keys are dealt over salts by a hash of the ``spread`` columns, and the
    lookup's rows of these keys are repeated per salt; all other keys have one salt and
    their lookup rows are not copied.  ``slots`` is the cluster's parallelism where not given.
    Spark's own size check may still turn this into a broadcast of the lookup; nothing
    is broadcast by hand.
    """
    slots = slots or max(8, rows.sparkSession.sparkContext.defaultParallelism)
    salts = F.coalesce(F.try_element_at(hot_keys(rows, keys, slots), F.expr(_digest_sql(keys))), F.lit(1))
    dealt = rows.withColumn("_slot", F.pmod(F.xxhash64(*spread), salts).cast("int"))
    repeated = lookup.withColumn("_slot", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(repeated, [*keys, "_slot"], how).drop("_slot")
