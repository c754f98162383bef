"""Exact top-k search by inner product with a vector-approximation file.

Each dimension is cut into ``2**bits`` cells between its smallest and largest value; the approximation file holds one
cell number a dimension for every vector. A query scans this file in blocks: the ends of the cells give an upper and a
lower bound of each score by two matrix products. Candidates whose upper bound is below the k-th best lower bound are
out. The exact vectors of the others are read in order of their bounds, first a few for each query, then those whose
upper bound still reaches the k-th exact score; what lies below can't enter the result.

Equal vectors are one entry of the file with their k + 1 smallest ids, as no others can be in a result; a group of copies
of any size is pruned map-side. Queries are the stated set; they are broadcast in blocks of ``block_queries``.

Defined results: components are floor(256 * x). Vectors that are NULL or hold NULL or non-finite components take no
part, nor do rows without an id. A shorter vector counts as padded with zeros. Rows that repeat an id and its vector count
once; rows with the query's id are never its result. Ties go to the smaller id. A score that leaves 64 bits is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import stored, work_folder


def integer_vectors(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, v``: the integer components of all vectors that take part."""
    finite = f"`{vector}` IS NOT NULL AND forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return frame.where(F.col(key).isNotNull()).where(finite).select(
        F.col(key).cast("long").alias("vec_id"),
        F.expr(f"transform(`{vector}`, x -> floor(256D * cast(x AS double)))").alias("v"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List rows as a matrix, padded with zeros."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and dimension, the smallest and the largest value; vectors that end before count as zero."""
    low = high = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        width = max(len(low), pa.compute.max(pa.compute.list_value_length(batch.column("v"))).as_py())
        values = _matrix(batch.column("v"), width)
        old = np.zeros((2, width), np.int64)
        old[0, :len(low)], old[1, :len(high)] = low, high
        low, high = np.minimum(old[0], values.min(axis=0)), np.maximum(old[1], values.max(axis=0))
    yield pa.record_batch([pa.array(range(len(low)), pa.int32()), pa.array(low), pa.array(high)], ["dim", "low", "high"])


def cell_ends(low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest integer of each cell of each dimension (dimension x cell)."""
    span = (high - low + 1)[:, None].astype(object)
    cells = np.arange((1 << bits) + 1, dtype=object)
    edges = low[:, None].astype(object) + -(-cells[None, :] * span // (1 << bits))
    return edges[:, :-1].astype(np.float64), np.maximum(edges[:, 1:] - 1, edges[:, :-1]).astype(np.float64)


def _approximate(low: np.ndarray, high: np.ndarray, bits: int):
    """Rows of the approximation file: the cell numbers of each vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([[-(-c * int(h - lo + 1) // (1 << bits)) + int(lo) for c in range(1, 1 << bits)] for lo, h in zip(low, high)], np.int64)
        for batch in batches:
            values = _matrix(batch.column("v"), len(low))
            codes = np.empty(values.shape, np.uint8)
            for d in range(len(low)):
                codes[:, d] = np.searchsorted(edges[d], values[:, d], "right")
            yield pa.record_batch([batch.column("vec_id"), pa.array([row.tobytes() for row in codes], pa.binary())], ["vec_id", "cells"])

    return run


def _scan(queries, ends, k: int):
    """Per task, the candidates of each query whose upper bound reaches the k-th lower bound seen so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = queries.value
        lower, upper = ends.value
        plus, minus = np.maximum(matrix, 0).astype(np.float64), np.minimum(matrix, 0).astype(np.float64)
        width = matrix.shape[1]
        # float sums of integers are exact up to 2**53; beyond, the bounds are widened by more than the rounding
        most = np.maximum(np.abs(lower), np.abs(upper)).max(axis=1) if width else np.zeros(0)
        reach = (np.abs(matrix).astype(np.float64) * most).sum(axis=1)
        slack = np.where(reach < 2.0 ** 52, 0, reach * 2.0 ** -40)
        best = np.full((len(ids), k), -np.inf)
        dims = np.arange(width)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                vec = part.column("vec_id").to_numpy()
                codes = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(len(vec), width)
                low, high = lower[dims, codes], upper[dims, codes]
                up = plus @ high.T + minus @ low.T + slack[:, None]
                down = plus @ low.T + minus @ high.T - slack[:, None]
                own = ids[:, None] == vec[None, :]
                up[own] = down[own] = -np.inf
                best = -np.sort(-np.concatenate([best, down], axis=1), axis=1)[:, :k]
                q, c = np.nonzero((up >= best[:, -1:]) & ~own)
                yield pa.record_batch([pa.array(ids[q]), pa.array(vec[c]), pa.array(down[q, c]), pa.array(up[q, c])],
                                      ["query_id", "vec_id", "low", "up"])

    return run


def _ranked(frame: DataFrame, k: int, *order: Column) -> DataFrame:
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def top_k(frame: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", bits: int = 6,
          first_reads: int = 4, block_queries: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query row with all other rows.

    ``is_query`` is a condition on the key column. ``first_reads * k`` exact vectors are read first for each query.
    """
    spark = frame.sparkSession
    folder = work_folder(spark)
    rows = integer_vectors(frame, key, vector)
    order = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    exact = stored(rows.withColumn("turn", order).where(F.col("turn") <= k + 1).select("vec_id", "v").distinct(), f"{folder}/exact")
    asked = stored(rows.withColumnRenamed("vec_id", key).where(is_query).withColumnRenamed(key, "query_id")
                   .withColumnRenamed("v", "q").distinct(), f"{folder}/queries")
    marks = exact.mapInArrow(_ranges, "dim int, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    marks = marks.orderBy("dim").toArrow()
    low, high = marks["low"].to_numpy(), marks["high"].to_numpy()
    width = max(len(low), asked.agg(F.max(F.size("q"))).first()[0] or 0)
    low, high = np.append(low, np.zeros(width - len(low), np.int64)), np.append(high, np.zeros(width - len(high), np.int64))
    ends = spark.sparkContext.broadcast(cell_ends(low, high, bits))
    file = stored(exact.mapInArrow(_approximate(low, high, bits), "vec_id long, cells binary"), f"{folder}/cells")

    out = None
    n_blocks = max(1, -(-asked.count() // block_queries))
    for n in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == n)
        got = block.toArrow().combine_chunks()
        ids = got["query_id"].to_numpy()
        vectors = _matrix(got["q"].combine_chunks(), width) if len(ids) else np.zeros((0, width), np.int64)
        queries = spark.sparkContext.broadcast((ids, vectors))
        seen = stored(file.mapInArrow(_scan(queries, ends, k), "query_id long, vec_id long, low double, up double").distinct(),
                      f"{folder}/candidates-{n}")
        certain = _ranked(seen, k, F.desc("low")).where(F.col("rank") == k).select("query_id", F.col("low").alias("least"))
        left = seen.join(certain, "query_id", "left").where(F.col("least").isNull() | (F.col("up") >= F.col("least")))
        turns = left.select("query_id", "vec_id", "up",
                            F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("up"), "vec_id")).alias("turn"))
        score = F.expr("aggregate(zip_with(q, v, (a, b) -> try_multiply(coalesce(a, 0L), coalesce(b, 0L))), 0L, (s, x) -> try_add(s, x))")

        def scored(part: DataFrame) -> DataFrame:
            return (part.join(exact, "vec_id").join(block, "query_id")
                    .select("query_id", "vec_id", score.alias("score")).where("score IS NOT NULL").distinct())

        early = stored(scored(turns.where(F.col("turn") <= first_reads * k)), f"{folder}/early-{n}")
        bar = _ranked(early, k, F.desc("score"), F.asc("vec_id")).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        late = scored(turns.where(F.col("turn") > first_reads * k).join(bar, "query_id", "left")
                      .where(F.col("bar").isNull() | (F.col("up") >= F.col("bar"))))
        best = _ranked(early.union(late), k, F.desc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.union(best)
    return out
