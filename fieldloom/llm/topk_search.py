"""Exact top-k search by vector-approximation files.

Vectors are integers, floor(scale * component); the score is the inner product. Every vector is written once as cells
of a grid, `CELLS` to a dimension, one byte each, in a column of its own beside the exact vector. For a block of
queries a scan of the cells alone gives each score within a slack that depends on the query only; a task keeps what
may be among the k best of its rows. Of all that is left, the k with the highest bounds are read exactly, by a join;
then those whose bound reaches the kth exact score so far. No other vector can be among the k best.

Queries are broadcast in slices of at most `slice_bytes`, each a scan of the cells. Of exact copies of one vector only
the k + 1 rows of smallest vec_id are kept: no query can need more. Ties go to the smaller vec_id, so results are exact.
Vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null vec_id. Shorter
vectors count as if followed by zeros. A row is no candidate for a query of its own vec_id; repeated rows of other
ids are candidates of their own; a query id that is repeated asks once, with the largest of its vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CELLS = 256
BLOCK_ROWS = 4096


def integer_vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that take part, and their vectors as whole numbers in doubles, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    upto = np.append(0, np.cumsum(sizes))
    odd = np.append(0, np.cumsum(~np.isfinite(flat)))
    rows = np.flatnonzero(np.asarray(column.is_valid()) & (np.diff(odd[upto]) == 0))
    out = np.zeros((len(rows), int(sizes[rows].max()) if len(rows) else 0))
    at = np.repeat(np.arange(len(rows)), sizes[rows])
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
    out[at, place] = np.floor(scale * flat[np.repeat(upto[rows], sizes[rows]) + place])
    return rows, out


def padded(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, max(0, width - a.shape[1]))))[:, :width]


def grid_of(vectors: DataFrame, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest value in each dimension and the cells' size there; the driver sees a row for each dimension."""

    def run(batches):
        low, high, n = np.empty(0), np.empty(0), 0
        for batch in batches:
            _, found = integer_vectors(batch.column("embedding"), scale)
            if len(found):
                width = max(len(low), found.shape[1])
                new = np.zeros((2, width))
                new[0, : found.shape[1]], new[1, : found.shape[1]] = found.min(axis=0), found.max(axis=0)
                old = np.stack([np.pad(x, (0, width - len(x))) for x in (low, high)]) if n else new
                low, high, n = np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), n + len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high)], names=["place", "low", "high"])

    found = vectors.select("embedding").mapInArrow(run, "place int, low double, high double")
    # 0 is in the range of every dimension, as the shorter vectors' components are 0
    found = found.groupBy("place").agg(F.least(F.min("low"), F.lit(0.0)).alias("low"), F.greatest(F.max("high"), F.lit(0.0)).alias("high")).orderBy("place").toArrow()
    low, high = found.column("low").to_numpy(), found.column("high").to_numpy()
    return low, (high - low) / CELLS


def approximation_file(vectors: DataFrame, low: np.ndarray, size: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, embedding, cells) of the rows that take part."""
    shared = vectors.sparkSession.sparkContext.broadcast((low, size))

    def run(batches):
        low, size = shared.value
        step = np.where(size > 0, size, 1)
        for batch in batches:
            rows, found = integer_vectors(batch.column("embedding"), scale)
            cells = np.clip((padded(found, len(low)) - low) / step, 0, CELLS - 1).astype(np.uint8)
            columns = [batch.column(c).take(pa.array(rows)) for c in ("vec_id", "embedding")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in cells], pa.binary())], names=["vec_id", "embedding", "cells"])

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, cells binary")


def scan_cells(cells: DataFrame, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, size: np.ndarray, k: int) -> DataFrame:
    """(query_id, row, near, slack): rows whose score, `near` give or take `slack`, may be among a task's k best."""
    shared = cells.sparkSession.sparkContext.broadcast((ids, queries, low, size))

    def run(batches):
        ids, queries, low, size = shared.value
        queries = padded(queries, len(low))
        reach = np.abs(queries)
        slack = reach @ (size * 0.5) + 1 + 1e-9 * (reach @ (np.abs(low) + CELLS * size))
        kept = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
        for batch in batches:
            rows, vec_ids = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
            grid = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(len(rows), -1)
            for a in range(0, len(rows), BLOCK_ROWS):
                middle = low + (grid[a : a + BLOCK_ROWS] + 0.5) * size
                for b in range(0, len(ids), 256):
                    near = queries[b : b + 256] @ middle.T
                    near[ids[b : b + 256, None] == vec_ids[None, a : a + BLOCK_ROWS]] = -np.inf
                    for q, scores in enumerate(near, b):
                        had, at = kept[q]
                        least = had.min() if len(had) >= k else -np.inf
                        new = np.flatnonzero(scores >= least) if least > -np.inf else np.flatnonzero(scores > -np.inf)
                        if len(new):
                            had, at = np.append(had, scores[new]), np.append(at, rows[a : a + BLOCK_ROWS][new])
                            if len(had) > k:
                                stay = had >= np.partition(had, -k)[-k] - 2 * slack[q]
                                had, at = had[stay], at[stay]
                            kept[q] = had, at
        sizes = [len(at) for _, at in kept]
        near, rows = (np.concatenate([x[c] for x in kept]) if kept else np.empty(0) for c in (0, 1))
        arrays = [pa.array(np.repeat(ids, sizes), pa.int64()), pa.array(rows, pa.int64()), pa.array(near), pa.array(np.repeat(slack, sizes))]
        yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "row", "near", "slack"])

    return cells.mapInArrow(run, "query_id long, row long, near double, slack double")


def exact_scores(found: DataFrame, file: DataFrame, asked: DataFrame, scale: int) -> DataFrame:
    """(query_id, row, vec_id, score) of the pairs in `found`, from the exact vectors."""
    both = found.select("query_id", "row").join(file.select("row", "vec_id", "embedding"), "row")
    both = both.join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")

    def run(batches):
        for batch in batches:
            x, y = (integer_vectors(batch.column(c), scale)[1] for c in ("embedding", "query"))
            width = max(x.shape[1], y.shape[1])
            x, y = padded(x, width), padded(y, width)
            if len(x) and (np.abs(x) * np.abs(y)).sum(axis=1).max(initial=0) >= 2.0**53:  # beyond exact doubles
                scores = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(x.tolist(), y.tolist(), strict=True)]
            else:
                scores = np.einsum("ij,ij->i", x, y).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "row", "vec_id")), pa.array(scores, pa.int64())], names=["query_id", "row", "vec_id", "score"])

    return both.select("query_id", "row", "vec_id", "embedding", "query").mapInArrow(run, "query_id long, row long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, slice_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `vectors` for each of `queries` (both: vec_id, embedding)."""

    def plain(df):
        usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        df = df.where(usable).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        return df.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    rows = plain(vectors)
    low, size = grid_of(rows, scale)
    few = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    file = approximation_file(rows.withColumn("few", few).where(F.col("few") <= k + 1).drop("few"), low, size, scale)
    file = written(file.withColumn("row", F.monotonically_increasing_id()), "approximation-file")
    asked = plain(queries).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    n_bytes = asked.agg(F.sum(F.size("embedding") * 8 + 16)).first()[0] or 0
    n_slices, found = max(1, -(-int(n_bytes) // slice_bytes)), None
    for s in range(n_slices):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_slices)) == s).toArrow()
        part = scan_cells(file.select("row", "vec_id", "cells"), part.column("vec_id").to_numpy(), integer_vectors(part.column("embedding"), scale)[1], low, size, k)
        found = part if found is None else found.unionByName(part)
    found = written(found, "candidates")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("near"), "row")
    first = found.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= k)
    first = written(exact_scores(first, file, asked, scale), "first-scores")
    sure = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    more = found.join(sure, "query_id").where((F.col("n") < k) | (F.col("near") + F.col("slack") >= F.col("kth")))
    more = more.join(first.select("query_id", "row"), ["query_id", "row"], "left_anti")
    scores = first.unionByName(exact_scores(more, file, asked, scale))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
