"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.landing import land


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them.

    ``larger``: neighbours above the node, of the two-way graph; else those below
    it and the node itself.  Only minima per node are aggregated, so a node with a
    third of all links is a partial minimum per task.
    """
    if larger:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        below = edges.join(least, "a")
        moved = below.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node with a link; component is its smallest node.

    Rounds of large and small stars until every node hangs directly on its
    component's smallest node, which takes about log(n) rounds.  Nothing but two
    sums per round reaches the driver.
    """
    edges = land(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        edges = land(_contract(_contract(edges, True), False), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.select(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)") % 1000003), F.lit(0)).alias("s"),
    ).first()
    return row.n, row.x, int(row.s)
