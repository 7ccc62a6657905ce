"""Near-duplicate vectors by exact, tiled comparison in PCA order.

Vectors are normalised and rotated onto the principal axes of all of them, so that
the leading dimensions carry most of every product.  They are dealt into tiles of
bounded size along the leading axes.  Tiles are compared in pairs: products of the
leading dimensions first; where these and the product of the suffix norms cannot
reach the threshold, a pair of vectors is given up, and where that holds for the
bounds of two tiles, they are never brought together.  Only the pairs that remain get
their full product, in double precision on the vectors as they came.

Copies of a vector are compared once and counted.  A tile pair yields the link counts
of its vectors and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.landing import land

COSINE = 0.95
TILE_ROWS = 4096
TILES_AT_ONCE = 8
BLOCK_ROWS = 1024
LEADING = (8, 24)
SLACK = 1e-9


def _usable(dims: int, kind: str):
    """Vectors of one width that can link, as bytes of their own type; the rest are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = [], []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vector is None or len(vector) != dims or None in vector:
                    continue
                x = np.array(vector, float)
                if np.isfinite(x).all() and x.any():
                    ids.append(key)
                    raws.append((x + 0.0).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], names=["id", "raw"])

    return run


def _unit(raws, dims: int) -> np.ndarray:  # noqa: ANN001
    """Unit vectors in double precision, of bytes of single or double precision."""
    raw = b"".join(raws)
    x = np.frombuffer(raw, "f4" if len(raw) == 4 * dims * len(raws) else "f8").astype(float).reshape(len(raws), dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(dims: int):
    """Sum of outer products of a task's unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(0).to_pylist(), dims)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    return run


def _axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Principal axes, greatest first: one number per pair of dimensions reaches the driver."""
    rows = vectors.select("raw").mapInArrow(_moments(dims), "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    second = np.zeros(dims * dims)
    for row in rows:
        second[row.at] = row.value
    second = second.reshape(dims, dims)
    return np.linalg.eigh((second + second.T) / 2)[1][:, ::-1]


def _led(axes: np.ndarray):
    """The first two coordinates of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.zeros((batch.num_rows, 2))
            if batch.num_rows:
                own = _unit(batch.column(1).to_pylist(), len(axes)) @ axes[:, :2]
                lead[:, : own.shape[1]] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead[:, 0]), pa.array(lead[:, 1])], names=["node", "raw", "copies", "x", "y"])

    return run


def _bounds(axes: np.ndarray, leading: int):
    """Per tile: least and greatest leading coordinates, and greatest suffix norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raws in batch.column(1).to_pylist():
                z = _unit(raws, len(axes)) @ axes
                rows.append((z[:, :leading].min(0).tolist(), z[:, :leading].max(0).tolist(), float(np.sqrt((z[:, leading:] ** 2).sum(1).max()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())))],
                names=["tile", "low", "high", "rest"],
            )

    return run


def _compared(axes: np.ndarray, cosine: float):
    """Links between two tiles: ``(node, n, other)``, a count per vector, and the forest's links with count 0."""
    stops = [k for k in LEADING if k < len(axes)]

    def pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zx, zy = x @ axes, y @ axes
        first, second = (stops + [0, 0])[:2]
        if not first:
            return np.nonzero(np.ones((len(x), len(y)), bool))
        norms = lambda z, k: np.sqrt((z[:, k:] ** 2).sum(1))
        bound = zx[:, :first] @ zy[:, :first].T
        alive = bound + np.outer(norms(zx, first), norms(zy, first)) >= cosine - SLACK
        i, j = np.nonzero(alive)
        if second and len(i):
            # Go on with what the first dimensions left: as a block where that is most of it.
            if len(i) > alive.size // 8:
                bound += zx[:, first:second] @ zy[:, first:second].T
                i, j = np.nonzero(alive & (bound + np.outer(norms(zx, second), norms(zy, second)) >= cosine - SLACK))
            else:
                more = bound[i, j] + np.einsum("nd,nd->n", zx[i, first:second], zy[j, first:second])
                keep = more + norms(zx, second)[i] * norms(zy, second)[j] >= cosine - SLACK
                i, j = i[keep], j[keep]
        return i, j

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left):
            mine = left.iloc[0]
            x, nodes, copies = _unit(mine.own_raws, len(axes)), np.array(mine.own_nodes), np.array(mine.own_copies)
            for other in right.itertuples():
                y, others, other_copies = _unit(other.raws, len(axes)), np.array(other.nodes), np.array(other.copies)
                found = []
                for r in range(0, len(x), BLOCK_ROWS):
                    for c in range(0, len(y), BLOCK_ROWS):
                        i, j = pairs(x[r : r + BLOCK_ROWS], y[c : c + BLOCK_ROWS])
                        i, j = i + r, j + c
                        if other.b == mine.own:
                            i, j = i[i < j], j[i < j]
                        hit = np.einsum("nd,nd->n", x[i], y[j]) >= cosine
                        found.append((i[hit], j[hit]))
                i, j = (np.concatenate(part) for part in zip(*found, strict=True))
                if not len(i):
                    continue
                counts = np.bincount(i, other_copies[j], len(x)).astype(np.int64)
                other_counts = np.bincount(j, copies[i], len(y)).astype(np.int64)
                out += [(int(n), int(c), -1) for n, c in zip(nodes[counts > 0], counts[counts > 0], strict=True)]
                out += [(int(n), int(c), -1) for n, c in zip(others[other_counts > 0], other_counts[other_counts > 0], strict=True)]
                parent: dict[int, int] = {}

                def root(v: int, parent: dict[int, int] = parent) -> int:
                    while parent.setdefault(v, v) != v:
                        parent[v] = parent[parent[v]]
                        v = parent[v]
                    return v

                for a, b in zip(nodes[i].tolist(), others[j].tolist(), strict=True):
                    ra, rb = root(a), root(b)
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
                        out.append((a, 0, b))
        return pd.DataFrame(out, columns=["node", "n", "other"])

    return run


def link_embeddings(embeddings: DataFrame, cosine: float = COSINE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row with an id, by cosine of ``cosine`` or more.

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, the others with those of their own width: each width is a run of its own,
    so widths should be few.  Of rows that repeat an id, one counts (its greatest
    vector).  Other columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), "embedding").where("id IS NOT NULL").groupBy("id").agg(F.max("embedding").alias("embedding"))
    rows = land(rows, "vectors")
    widths = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("w")).count().where("count > 1").orderBy("w").collect()
    lone = rows.select(F.col("id").alias("vec_id"))
    if not widths:
        return lone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    kind = "f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "f8"
    linked = reduce(DataFrame.unionByName, [_linked(rows, width.w, kind, cosine, tile_rows) for width in widths])
    return lone.join(linked, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def _linked(rows: DataFrame, dims: int, kind: str, cosine: float, tile_rows: int) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of the vectors of one width that can link."""
    usable = land(rows.where(F.size("embedding") == dims).mapInArrow(_usable(dims, kind), "id bigint, raw binary"), "usable")
    # Copies: one node per distinct vector, named by its smallest id.
    nodes = land(usable.groupBy("raw").agg(F.min("id").alias("node"), F.count("*").alias("copies")).select("node", "raw", "copies"), "nodes")
    member = usable.join(nodes, "raw").select("id", "node", "copies")
    axes = _axes(nodes, dims)
    tiles, n_tiles = _tiles(nodes, axes, tile_rows)
    leading = min(LEADING[0], dims)
    bounds = land(tiles.select("tile", "raws").mapInArrow(_bounds(axes, leading), "tile bigint, low array<double>, high array<double>, rest double"), "bounds")
    lots = -(-n_tiles // TILES_AT_ONCE)
    met = land(_tile_pairs(bounds, cosine, leading).withColumn("lot", F.pmod(F.xxhash64("b"), F.lit(lots))), "tile-pairs")
    own = tiles.select(F.col("tile").alias("own"), F.col("nodes").alias("own_nodes"), F.col("copies").alias("own_copies"), F.col("raws").alias("own_raws"))
    left = met.select(F.col("a").alias("own"), F.col("lot").alias("own_lot")).distinct().join(own, "own")
    right = met.join(tiles.withColumnRenamed("tile", "b"), "b")
    compared = land(
        left.groupBy("own", "own_lot").cogroup(right.groupBy("a", "lot")).applyInPandas(_compared(axes, cosine), "node bigint, n bigint, other bigint"),
        "compared",
    )
    counts = compared.where("other = -1").groupBy("node").agg(F.sum("n").alias("n"))
    closed = components(compared.where("other <> -1").select(F.col("node").alias("a"), F.col("other").alias("b")))
    return (
        member.select("id", "node", "copies")
        .join(counts, "node", "left")
        .join(closed, "node", "left")
        .select(
            F.col("id").alias("vec_id"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )


def _tiles(nodes: DataFrame, axes: np.ndarray, tile_rows: int) -> tuple[DataFrame, int]:
    """``(tile, nodes, copies, raws)``: vectors of a cell of even cuts along two axes, in lots of about ``tile_rows``.

    The cuts are quantiles; their number grows as the root of the number of tiles.
    """
    placed = land(nodes.mapInArrow(_led(axes), "node bigint, raw binary, copies bigint, x double, y double"), "placed")
    total = placed.count()
    cuts = int(np.ceil(np.sqrt(max(1, total / tile_rows))))
    inner = [k / cuts for k in range(1, cuts)]
    bounds = placed.approxQuantile(["x", "y"], inner, 0.2 / cuts) if inner else [[], []]
    cell = lambda c, edges: sum(((F.col(c) > e).cast("int") for e in edges), F.lit(0))
    celled = placed.withColumn("cell", cell("x", bounds[0]) * cuts + cell("y", bounds[1]))
    sizes = {row.cell: row.n for row in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    lots = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // tile_rows))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = celled.withColumn("tile", F.col("cell") * (1 << 20) + F.pmod(F.xxhash64("node"), lots[F.col("cell")]))
    tiles = dealt.groupBy("tile").agg(F.collect_list(F.struct("node", "copies", "raw")).alias("v"))
    tiles = tiles.select(F.col("tile").cast("bigint").alias("tile"), F.col("v.node").alias("nodes"), F.col("v.copies").alias("copies"), F.col("v.raw").alias("raws"))
    return land(tiles, "tiles"), sum(-(-n // tile_rows) for n in sizes.values())


def _tile_pairs(bounds: DataFrame, cosine: float, leading: int) -> DataFrame:
    """Pairs ``a <= b`` of tiles whose bounds let some pair of their vectors reach the threshold.

    Vectors that link differ by at most ``sqrt(2 - 2 cosine)`` in every coordinate, so
    tiles meet by equal steps of that width on the first axis (a tile is listed under
    each step that it covers and, on one side, its neighbours), then by all bounds.
    """
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    step = lambda c: F.floor(c / F.lit(reach))
    a = bounds.select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.col("rest").alias("rest_a")).withColumn(
        "step", F.explode(F.sequence(step(F.col("low_a")[0]) - 1, step(F.col("high_a")[0]) + 1))
    )
    b = bounds.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("rest").alias("rest_b")).withColumn(
        "step", F.explode(F.sequence(step(F.col("low_b")[0]), step(F.col("high_b")[0])))
    )
    most = F.lit(0.0)
    for k in range(leading):
        corners = [F.col(f"{x}_a")[k] * F.col(f"{y}_b")[k] for x in ("low", "high") for y in ("low", "high")]
        most = most + F.greatest(*corners)
    fits = (F.col("a") <= F.col("b")) & (most + F.col("rest_a") * F.col("rest_b") >= cosine - SLACK)
    return a.join(b, "step").where(fits).select("a", "b").distinct()


# The same rows in DuckDB SQL over ``embeddings`` with distinct ids and vectors of one width without bad components.
SQL = """
WITH RECURSIVE links AS (
  SELECT x.vec_id AS a, y.vec_id AS b
  FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), degrees AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(other) AS component_id, min(other) = vec_id AS kept
FROM embeddings LEFT JOIN degrees USING (vec_id) JOIN reach ON node = vec_id GROUP BY vec_id
"""
