"""Most similar vectors through an inverted file, exact by the bounds of its cells.

Centroids are fitted on a bounded sample, and every vector goes to the cell of its nearest one. A query first searches the
cells nearest to it. What it has found there bounds the rest: angles between vectors keep the triangle inequality, so a cell
none of whose vectors can be as near is left out and the others are searched as well. The result is that of a search of all
vectors; how much of it is spared depends on how well these fall into cells. A cell's vectors lie in parts of a bounded number, so
a large cell is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.storage import materialize

#: Vectors that centroids are fitted on, and centroids, at most; passes of the fit.
SAMPLE, CELLS, PASSES = 20_000, 1024, 8
#: Vectors of a cell that one task holds, queries that it multiplies at a time, and cells that a query searches first.
PART, CHUNK, PROBES = 8_000, 256, 3
#: Angles closer than this count as equal where a cell is left out; similarities are told apart to six decimals.
SLACK = 2e-3
#: Bytes, as doubles, of the vectors and of the queries that one task compares where all pairs of a label are.
VECTOR_BYTES, QUERY_BYTES = 2 << 20, 8 << 20

FOUND = "query_id long, vec_id long, similarity double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def unit(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding at length one; vectors that are null, empty, zero, or hold a null or NaN are left out."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.sqrt(squares).alias("norm"))
    rows = rows.where((F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf")))
    return rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")).alias("embedding"))


def fit(units: DataFrame, sample: int = SAMPLE, cells: int = CELLS) -> np.ndarray:
    """Centroids, as rows of length one, of about ``sample`` of the vectors (all if fewer), drawn by a hash; about the square root of the vectors, ``cells`` at most."""
    total = units.count()
    share = sample / max(total, 1)
    drawn = units if share >= 1 else units.where(F.pmod(F.xxhash64(F.lit(29), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = drawn.orderBy("vec_id").select("embedding").toArrow()["embedding"].combine_chunks()
    points = _matrix(found)
    if not len(points):
        return points
    number = max(1, min(cells, round(total**0.5), len(points)))
    centres = points[np.random.default_rng(7).choice(len(points), number, replace=False)]
    for _ in range(PASSES):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def in_cells(units: DataFrame, centres: np.ndarray) -> DataFrame:
    """``units`` with cell, the number of the nearest centroid, and angle, how far it is."""
    shared = units.sparkSession.sparkContext.broadcast(centres)  # CELLS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                angles = _angles(_matrix(batch.column("embedding")), shared.value)
                near = angles.argmin(axis=1)
                yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(near)), near])], names=[*batch.schema.names, "cell", "angle"])

    return units.mapInArrow(run, "vec_id long, embedding array<double>, cell int, angle double")


def _search(k: int, floor: float):
    """The ``k`` best of a part of a cell for each query, by six decimals, then vec_id."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.sort_by("vec_id")
            ids, held = vectors["vec_id"].to_numpy(), _matrix(vectors["embedding"].combine_chunks())
            for at in range(0, queries.num_rows, CHUNK):
                some = queries.slice(at, CHUNK)
                own = some["query_id"].to_numpy()
                near = np.round(_matrix(some["embedding"].combine_chunks()) @ held.T + 1e-9, 6)
                near[(own[:, None] == ids[None, :]) | (near < floor)] = -9.0
                best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(near, best, axis=1)
                row, column = np.nonzero(got > -9.0)
                out.append((own[row], ids[best[row, column]], got[row, column]))
        columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(columns, names=["query_id", "vec_id", "similarity"])

    return run


def most_similar(k: int, floor: float, digits: int, nudge: float):
    """query_id, vec_id, similarity: for each query the ``k`` vectors of greatest cosine, rounded to ``digits``, ``floor`` or more, but itself; ties go by vec_id.

    Queries and vectors have embedding, all of one length, and norm. NaN is the greatest.
    """

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.sort_by("vec_id")
            ids, norms, held = vectors["vec_id"].to_numpy(), vectors["norm"].to_numpy(), _matrix(vectors["embedding"].combine_chunks())
            for at in range(0, queries.num_rows, CHUNK):
                some = queries.slice(at, CHUNK)
                own = some["query_id"].to_numpy()
                with np.errstate(all="ignore"):
                    near = _matrix(some["embedding"].combine_chunks()) @ held.T
                    near = np.round(near / (some["norm"].to_numpy()[:, None] * norms) + nudge, digits)
                near[np.isnan(near)] = np.inf
                near[(own[:, None] == ids) | (near < floor)] = -np.inf
                # The k-th best bounds what counts; of the ties at the bound the least ids, which come first, are kept.
                least = np.partition(near, -k, axis=1)[:, -k, None] if k < len(ids) else -np.inf
                row, column = np.nonzero((near >= least) & (near > -np.inf))
                order = np.lexsort((column, -near[row, column], row))
                row, column = row[order], column[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, column = row[first], column[first]
                got = near[row, column]
                out.append((own[row], ids[column], np.where(got == np.inf, np.nan, got)))
        names = {"query_id": queries, "vec_id": vectors}
        columns = [pa.array(np.concatenate([x[i] for x in out]) if out else [], rows.schema.field(c).type) for i, (c, rows) in enumerate(names.items())]
        return pa.table([*columns, pa.array(np.concatenate([x[2] for x in out]) if out else [], pa.float64())], names=[*names, "similarity"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.6, sample: int = SAMPLE, cells: int = CELLS, part: int = PART, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, similarity: the ``k`` vectors of greatest cosine to each query but itself, ``floor`` or more.

    ``vectors`` and ``queries`` have vec_id and embedding, all of one length; vec_ids are distinct. Similarities are rounded to six decimals, ties go by
    vec_id. Rows without a direction (see ``unit``) are neither found nor find anything; an empty side gives an empty result.
    """
    units = materialize(unit(vectors), "units")
    centres = fit(units, sample, cells)
    asked = unit(queries).withColumnRenamed("vec_id", "query_id")
    if not len(centres):
        return asked.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("similarity")).limit(0)
    placed = in_cells(units, centres)
    placed = materialize(placed, "in-cells")
    sizes = materialize(placed.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"), F.min("angle").alias("inner"), F.max("angle").alias("outer")), "cells")
    bounds = {r.cell: (r.inner, r.outer) for r in sizes.collect()}  # CELLS at most
    shared = units.sparkSession.sparkContext.broadcast((centres, np.array([bounds.get(c, (9.0, -9.0)) for c in range(len(centres))])))
    dealt = placed.join(F.broadcast(sizes.select("cell", "parts")), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "vec_id", "embedding")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that each query has to search: the nearest ones if nothing is known yet, then those that could hold something better."""
        centres, edges = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                angles = _angles(_matrix(batch.column("embedding")), centres)
                angles[:, edges[:, 1] < 0] = 99.0  # cells without a vector
                first = np.zeros(angles.shape, bool)
                np.put_along_axis(first, np.argsort(angles, axis=1, kind="stable")[:, :probes], True, axis=1)
                first &= angles < 99.0
                known = batch.column("reach").to_numpy(zero_copy_only=False)
                if np.isnan(known.astype(float)).all():
                    wanted = first
                else:
                    bound = np.maximum(angles - edges[:, 1], edges[:, 0] - angles)
                    wanted = (bound <= known[:, None] + SLACK) & ~first & (angles < 99.0)
                row, cell = np.nonzero(wanted)
                yield pa.record_batch([batch.column("query_id").take(pa.array(row)), batch.column("embedding").take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["query_id", "embedding", "cell"])

    def searched(rows: DataFrame) -> DataFrame:
        visits = rows.select("query_id", "embedding", "reach").mapInArrow(reach, "query_id long, embedding array<double>, cell int")
        visits = visits.join(F.broadcast(sizes.select("cell", "parts")), "cell").select("query_id", "embedding", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
        return visits.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInArrow(_search(k, floor), FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    near = materialize(searched(asked.withColumn("reach", F.lit(None).cast("double"))), "near")
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.acos(F.least("similarity", F.lit(1.0))).alias("kth"))
    widest = float(np.arccos(np.clip(floor, -1.0, 1.0)))
    rest = searched(asked.join(kth, "query_id", "left").withColumn("reach", F.coalesce("kth", F.lit(widest))))
    return near.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")
