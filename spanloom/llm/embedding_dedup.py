"""Near copies among embeddings, by int8 tile products with error bounds.

Vectors of one label are dealt into blocks of a bounded number of rows, and
every pair of blocks is a cell, compared in one task.  There a vector of length
one is written as ``scale * codes + rest`` with codes in -127..127.  Products of
codes are whole numbers, so a tile of them is one exact matrix product, and

    |u.v - s_u s_v (codes_u . codes_v)|  <=  n_u e_v + e_u n_v + e_u e_v

with ``n`` the length of ``scale * codes`` and ``e`` that of the rest.  A pair
that cannot reach the threshold within this bound is done with; the others are
computed again in double precision.

A cell yields no pairs but, per linked vector, how many links it has there and
the first vector of its component there: at most a row per vector, however
many copies meet.  The cosines cost the square of a label, cut into cells of
bounded size; what is shuffled is each vector once per block of its label.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kept, own_column

#: Room for the rounding of the bounds themselves, which are computed in double precision.
_SLACK = 1e-9
_CELL = pa.schema([("row_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix."""
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length one; scaled by their largest entry first, so that no square is out of range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


class Quantised:
    """Unit vectors with their int8 codes (held as floats that multiply exactly), scales and bounds."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.scale = np.abs(vectors).max(axis=1) / 127.0
        codes = np.rint(vectors / self.scale[:, None])
        near = codes * self.scale[:, None]
        self.length = np.sqrt(np.einsum("ij,ij->i", near, near)) + 1e-12
        rest = vectors - near
        self.rest = np.sqrt(np.einsum("ij,ij->i", rest, rest)) + 1e-12
        # Sums of up to 1040 products of codes are below 2^24, which single precision holds exactly.
        self.codes = codes.astype(np.float32 if vectors.shape[1] <= 1040 else np.float64)

    def tile(self, start: int, rows: int) -> Quantised:
        part = object.__new__(Quantised)
        for name in ("vectors", "scale", "length", "rest", "codes"):
            setattr(part, name, getattr(self, name)[start : start + rows])
        return part


def candidates(a: Quantised, b: Quantised, threshold: float) -> np.ndarray:
    """Which pairs of a tile may reach the threshold; never misses one that does."""
    products = a.codes @ b.codes.T
    # By the worst vector of the other side first, which leaves one number per row to compare with.
    reach = threshold - _SLACK - (a.length + a.rest) * b.rest.max() - a.rest * b.length.max()
    least = np.where(reach > 0, reach / (a.scale * b.scale.max()), -np.inf)
    found = products >= least.astype(products.dtype)[:, None] * (1 - 1e-6)
    if 0 < np.count_nonzero(found) <= found.size >> 6:
        i, j = np.nonzero(found)
        bound = a.length[i] * b.rest[j] + a.rest[i] * (b.length[j] + b.rest[j])
        close = a.scale[i] * b.scale[j] * products[i, j] + bound >= threshold - _SLACK
        found[i[~close], j[~close]] = False
    return found


def linked(a: Quantised, b: Quantised, threshold: float) -> np.ndarray:
    """Which pairs of a tile have a cosine of at least ``threshold``, in double precision."""
    found = candidates(a, b, threshold)
    n = np.count_nonzero(found)
    if n > found.size >> 6:
        return found & (a.vectors @ b.vectors.T >= threshold)
    if n:
        i, j = np.nonzero(found)
        below = np.einsum("ij,ij->i", a.vectors[i], b.vectors[j]) < threshold
        found[i[below], j[below]] = False
    return found


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of ``i`` and ``j``; ``root`` holds the first member of each one's component."""
    while len(i):
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root[:] = further
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]


def compare_cell(threshold: float, tile_rows: int) -> Callable[[pa.Table], pa.Table]:
    """Links of one cell: all pairs of its two sides, or of its one side with itself."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.take(pa.compute.sort_indices(cell, [("side", "ascending"), ("row_id", "ascending")]))
        ids, side = cell["row_id"].to_numpy(), cell["side"].to_numpy()
        first = int(np.searchsorted(side, 1))
        twofold = cell["low"][0] != cell["high"][0]
        if twofold and first in (0, len(ids)):
            return _CELL.empty_table()
        all_ = Quantised(unit(matrix(cell["vector"])))
        links = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))
        for x in range(0, first, tile_rows):
            a = all_.tile(x, min(tile_rows, first - x))
            for y in range(first if twofold else x, len(ids), tile_rows):
                b = all_.tile(y, tile_rows)
                found = linked(a, b, threshold)
                if x == y:
                    found &= np.tri(*found.shape, k=-1, dtype=bool).T
                if not found.any():
                    continue
                links[x : x + found.shape[0]] += np.count_nonzero(found, axis=1)
                links[y : y + found.shape[1]] += np.count_nonzero(found, axis=0)
                apart = found & (root[x : x + found.shape[0], None] != root[None, y : y + found.shape[1]])
                i, j = np.nonzero(apart)
                merge(root, i + x, j + y)
        some = links > 0
        # The root that counts is the smallest row of the component, not the first by side.
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(least[root][some])], schema=_CELL)

    return run


def _numbered(frame: DataFrame, vector: str, group: str, id_: str) -> DataFrame:
    """``(row_id, vec_id, label, dim, vector)``; ``dim`` is NULL for a vector that links with nothing."""
    single = dict(frame.dtypes).get(vector) == "array<float>"
    v = own_column(frame, vector, "array<float>" if single else "array<double>")
    label = F.col(f"`{group}`") if group in frame.columns else F.lit(None).cast("int")
    rows = frame.select(own_column(frame, id_, "bigint").alias("vec_id"), label.alias("label"), v.alias("vector"))
    sound = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)")
    return rows.select(
        F.monotonically_increasing_id().alias("row_id"), "vec_id", "label", F.when(sound & F.col("label").isNotNull(), F.size("vector")).alias("dim"), "vector"
    )


def partial_links(rows: DataFrame, threshold: float, block_rows: int, tile_rows: int) -> DataFrame:
    """``(row_id, links, root)`` of every cell, from ``(row_id, label, dim, vector)``."""
    able = rows.filter("dim IS NOT NULL")
    blocks = able.groupBy("label", "dim").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = blocks.select("label", "dim", F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("blocks"))
    dealt = able.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "label",
        "dim",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "row_id",
        "vector",
    )
    return cells.groupBy("label", "dim", "low", "high").applyInArrow(compare_cell(threshold, tile_rows), "row_id bigint, links bigint, root bigint")


def near_vectors(
    frame: DataFrame,
    threshold: float = 0.98,
    vector: str = "embedding",
    group: str = "label",
    id_: str = "vec_id",
    block_rows: int = 4096,
    tile_rows: int = 1024,
) -> DataFrame:
    """One row per row of ``frame``: ``(vec_id, n_links, component_id, kept)``.

    Two vectors of one label and one length are linked if their cosine is at
    least ``threshold``.  Rows that repeat are vectors of their own, linked
    with each other.  A row whose label or vector is null, whose vector is
    empty or zero, or holds a null or an entry that is not finite, has no
    links.  ``component_id`` is the smallest ``vec_id`` of the component, null
    ids aside; a row without links has its own.  A null id is kept if it has
    no other in its component.  An empty table gives an empty one; other
    columns play no part.
    """
    rows = kept(_numbered(frame, vector, group, id_))
    found = kept(partial_links(rows.select("row_id", "label", "dim", "vector"), threshold, block_rows, tile_rows))
    links = found.groupBy("row_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("row_id").alias("a"), F.col("root").alias("b")))
    # Every linked vector with the root of its component; a root has no row among the links to roots.
    plain = rows.select("row_id", "vec_id")
    members = plain.join(links, "row_id").join(roots.withColumnRenamed("node", "row_id"), "row_id", "left")
    members = kept(members.select("row_id", "vec_id", "links", F.coalesce("root", "row_id").alias("root")))
    least = members.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    done = members.join(least, "root").select("vec_id", "links", "component_id")
    alone = plain.join(members.select("row_id"), "row_id", "left_anti").select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).select(
        "vec_id", F.col("links").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
