"""Exact top-k inner-product search: columnar branch and bound.

Vectors are quantised to integers. Candidates and queries are dealt into blocks; each pair of blocks is one task group.
A block holds its candidates one dimension after another. For a query, partial scores grow by a block of dimensions at a
time; a candidate whose partial score plus the most that the remaining dimensions can add (the product of the remaining
norms) stays under the k-th best known score is dropped, and the survivors are compacted. The best k of every block pair
meet in one ranking per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenguard.llm.common import table

CANDIDATES, QUERIES = 8192, 2048  # rows of a block, about
DIMENSIONS = 8
SAFE = float(2**52)  # integers below are exact in doubles
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Not null, not empty of meaning: no null, NaN or infinite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to width."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def best_of_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, id, score) of each query's k best among the block's vectors, ties to the smaller id."""
    if not len(ids) or not len(query_ids):
        return
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    width = vectors.shape[1]
    if np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(width, 1) >= SAFE:
        whole = [[int(x) for x in v] for v in vectors]  # too large for doubles: Python's integers
        for q, query in zip(query_ids, queries, strict=True):
            scored = sorted((-sum(int(a) * b for a, b in zip(query, v, strict=True)), int(i)) for i, v in zip(ids, whole, strict=True) if i != q)
            yield from ((q, i, max(-LONG - 1, min(LONG, -s))) for s, i in scored[:k])
        return
    columns = np.ascontiguousarray(vectors.T)  # one dimension after another
    cuts = [*range(0, width, DIMENSIONS), width]
    rest = [np.sqrt(np.square(columns[a:]).sum(0)) for a in cuts]
    sample = columns[:, : min(len(ids), 64 * k)]
    for q, query in zip(query_ids, queries, strict=True):
        own = query @ sample
        own = own[ids[: len(own)] != q]
        floor = np.partition(own, len(own) - k)[len(own) - k] if len(own) >= k else -np.inf
        alive, score = None, np.zeros(len(ids))
        for step, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            score = score + query[a:b] @ (columns[a:b] if alive is None else columns[a:b, alive])
            left = math.sqrt(float(np.square(query[b:]).sum())) * (rest[step + 1] if alive is None else rest[step + 1][alive])
            keep = score + left * (1 + 1e-9) + 1e-6 >= floor
            if keep.mean() < 0.9:
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                score = score[keep]
        found = ids if alive is None else ids[alive]
        score, found = score[found != q], found[found != q]
        if len(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            score, found = score[score >= least], found[score >= least]
        for i in np.lexsort((found, -score))[:k]:
            yield q, found[i], int(score[i])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of floor(scale * x).

    vectors and queries hold (vec_id long, embedding array). A query is not its own candidate: rows with its vec_id are
    left out. Of repeated query ids the smallest vector asks; repeated candidates each take a place. Vectors of different
    lengths are compared over the shorter one. Null vectors and those with null or non-finite components take no part;
    nor do rows without a vec_id. With fewer candidates than k all are returned; scores beyond long stop at its ends."""

    def prepared(df: DataFrame) -> DataFrame:
        kept = df.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable(F.col("x")))
        return kept.select(F.col("vec_id").cast("long"), F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("double")).alias("x"))

    asked = prepared(queries).groupBy("vec_id").agg(F.min("x").alias("x"))
    every = prepared(vectors)
    rows, questions = every.count(), asked.count()
    across, down = max(1, math.ceil(rows / CANDIDATES)), max(1, math.ceil(questions / QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = every.withColumn("a", block(across)).withColumn("b", all_of(down))
    asking = asked.withColumn("b", block(down)).withColumn("a", all_of(across))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, vs), (qids, qs) = ([t.column(n).combine_chunks() for n in ("vec_id", "x")] for t in (left, right))
        width = max([0, *(int(pa.compute.max(pa.compute.list_value_length(x)).as_py() or 0) for x in (vs, qs) if len(x))])
        found = list(best_of_block(ids.to_numpy(), matrix(vs, width), qids.to_numpy(), matrix(qs, width), k))
        return pa.table({n: pa.array([int(x[i]) for x in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    grouped = candidates.groupBy("a", "b").cogroup(asking.groupBy("a", "b"))
    partial = grouped.applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
