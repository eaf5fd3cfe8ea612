"""Similarity retrieval: candidates by cosine, optional reranking, fused scores.

Encoder and reranker are plug-points (functions of columns, which may be pandas UDFs). No model weights are assumed: the
defaults are stand-ins, a hashing encoder and lexical overlap, and say nothing about a trained model's quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenguard import params
from tokenguard.functions import numeric as N
from tokenguard.functions import text as T

QUERY_BYTES = 64 << 20  # of the vectors of queries that meet the corpus at once; more go in further rounds


def hashing_encoder(text: Column, dim: int = 64) -> Column:
    """Word counts by hash (of the MD5 digest); the zero vector for blank text."""

    @F.arrow_udf("array<double>")
    def counts(words: pa.Array) -> pa.Array:
        n, every = len(words), words.flatten().dictionary_encode()
        places = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in every.dictionary.to_pylist()], np.int64)  # of each different word
        rows = np.repeat(np.arange(n), words.value_lengths().to_numpy(zero_copy_only=False))
        found = np.bincount(rows * dim + places[every.indices.to_numpy()], minlength=n * dim) if len(rows) else np.zeros(n * dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(found.astype(float)))

    return counts(T.split_spaces(F.lower(text)))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's different words that the text holds."""
    q, t = (F.array_distinct(T.split_spaces(F.lower(x))) for x in (query, text))
    return T.once(F.struct(q.alias("q"), t.alias("t")), lambda x: F.coalesce(F.try_divide(F.size(F.array_intersect(x["q"], x["t"])).cast("double"), F.size(x["q"])), F.lit(0.0)))


def exactly_rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half to even on the exact binary value, as numeric.rounded."""
    scaled = x * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    for i in np.argwhere(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):  # scaling may have crossed the middle
        out[tuple(i)] = round(float(x[tuple(i)]), digits)
    return out


TILE = (512, 1024)  # questions and vectors that are compared at a time
FIRST = 128  # vectors that are compared first, which leaves floors for the others


class Best:
    """The k best of some questions' rows by similarity and id, as (question, value, id) in this order."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.kept: tuple = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.new: list[tuple] = []  # not yet sorted in

    def add(self, rows: np.ndarray, values: np.ndarray, names: np.ndarray) -> None:
        self.new.append((rows, values, names))
        if sum(len(x[0]) for x in self.new) >= len(self.kept[0]):
            self.sort()

    def sort(self) -> None:
        rows, values, names = (np.concatenate([x for x in xs if len(x)]) for xs in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((names, -values, rows))
        rows = rows[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.kept, self.new = (rows[best], values[order][best], names[order][best]), []
        at = np.searchsorted(self.kept[0], np.arange(len(self.floor) + 1))
        full = np.flatnonzero(np.diff(at) == self.k)
        self.floor[full] = self.kept[1][at[full + 1] - 1]


def similarities(a: np.ndarray, b: np.ndarray, a_norms: np.ndarray, b_norms: np.ndarray, digits: int) -> np.ndarray:
    """Of each row of a with the same row of b, rounded; -inf where there is none."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        found = np.einsum("ij,ij->i", a, b) / (a_norms * b_norms)
    finite = np.isfinite(found)
    found[~finite] = -np.inf
    found[finite] = exactly_rounded(found[finite], digits)
    return found


def directions(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """In single precision, with NaN for rows whose length is no ordinary number."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return np.where(((norms > 1e-100) & (norms < 1e100))[:, None], x / norms[:, None], np.nan).astype(np.float32)


def best_of(rows: Iterator[pa.RecordBatch], asked: np.ndarray, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """(question, tie, similarity) of the k rows (tie, vector) most similar to each of the questions, of all the batches.
    Rows without a direction have no similarity and come last.

    What single precision puts surely below a question's k-th best is not looked at again; the others, a few for each
    question, are compared in double precision."""
    with np.errstate(over="ignore"):
        norms = np.sqrt(np.square(asked).sum(1))
    slack = 0.5 * 10.0**-digits + (asked.shape[1] + 8) * 2.0**-23  # rounding to digits, and that of sums in single precision
    blank = norms == 0  # such questions have the smallest ids as their best, whatever the vectors
    live = np.flatnonzero(~blank)
    groups = [(mine, directions(asked[mine], norms[mine]), Best(len(mine), k)) for mine in (live[a : a + TILE[0]] for a in range(0, len(live), TILE[0]))]
    room = np.empty(TILE[0] * TILE[1], np.float32)
    least = np.zeros(0, np.int64)
    started = False
    for batch in rows:
        if not batch.num_rows:
            continue
        vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        names = np.array(batch.column(0).to_pylist())
        with np.errstate(over="ignore"):
            lengths = np.sqrt(np.square(vectors).sum(1))
        ways = directions(vectors, lengths)
        odd = np.flatnonzero(np.isnan(ways).any(1) & (lengths != 0))  # too long, too short or no number: always compared
        ways[lengths == 0] = 0
        if blank.any():
            least = np.sort(np.concatenate([least, names]) if len(least) else names)[:k]
        at = 0
        while at < len(vectors):
            part = slice(at, at + (TILE[1] if started else min(FIRST, TILE[1])))
            at, started = part.stop, True
            own = odd[(odd >= part.start) & (odd < part.stop)] - part.start
            none = np.flatnonzero(lengths[part] == 0)
            for mine, quick, best in groups:
                near = np.matmul(quick, ways[part].T, out=room[: len(mine) * (wide := len(ways[part]))].reshape(len(mine), wide))
                near[:, none] = -np.inf
                near[:, own] = np.nan
                bound = (best.floor - slack).astype(np.float32)
                some = np.flatnonzero(~(near.max(1) < bound))  # not below: also where it is no number
                i, j = np.divmod(np.flatnonzero(~(near[some] < bound[some, None])), wide)
                for a in range(0, len(i), 1 << 16):
                    own_i, v = some[i[a : a + (1 << 16)]], j[a : a + (1 << 16)] + part.start
                    q = mine[own_i]
                    value = similarities(asked[q], vectors[v], norms[q], lengths[v], digits)
                    on = value >= best.floor[own_i]  # ties with the last stay: their ids decide
                    if on.any():
                        best.add(own_i[on], value[on], names[v[on]])
    for _, _, best in groups:
        if best.new:
            best.sort()
    found = [(mine[best.kept[0]], *best.kept[1:]) for mine, _, best in groups if len(best.kept[0])]
    if len(least):
        found.append((np.repeat(np.flatnonzero(blank), len(least)), np.full(blank.sum() * len(least), -np.inf), np.tile(least, blank.sum())))
    question, values, names = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    yield pa.RecordBatch.from_arrays([pa.array(question, pa.int64()), pa.array(names.tolist()) if len(values) else pa.array([], pa.int64()), pa.array(values.astype(float), pa.float64(), mask=~np.isfinite(values.astype(float)))], ["_question", "_tie", "similarity"])


def top_k(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 4, tie: str = "chunk_id") -> DataFrame:
    """(query_id, rank, similarity, columns of chunks) of the k chunks of highest cosine; queries and chunks have `vector`
    of one length.

    Similarities are rounded before they are ranked, ties go to the smaller id; chunks repeat no id. The queries' vectors are
    collected and broadcast in rounds of a bounded size. Chunks are compared where they are, batch by batch, and a task
    passes on k chunks for each query; the other columns are fetched for the winners alone."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("_q"))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("_q")), F.lit(0))).first()
    rounds = max(1, -(-n * 8 * max(1, width) // QUERY_BYTES))
    kind = chunks.schema[tie].dataType.simpleString()
    rows = chunks.select(tie, F.col("vector").cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "_tie")
    out = None
    for i in range(rounds):
        mine = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i)
        got = mine.where("_q IS NOT NULL").toArrow()
        vectors = got.column("_q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, max(1, width)))
        shared = spark.sparkContext.broadcast(vectors)
        numbers = pa.table({"_question": pa.array(range(got.num_rows), pa.int64()), "query_id": got.column("query_id")})
        names = spark.createDataFrame(numbers, f"_question long, query_id {asked.schema['query_id'].dataType.simpleString()}")
        found = rows.mapInArrow(lambda batches, shared=shared: best_of(batches, shared.value, k, digits), f"_question long, _tie {kind}, similarity double")
        found = found.join(F.broadcast(names), "_question").drop("_question")  # a row for each query of the round
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)
    if chunks.columns == [tie, "vector"]:
        return out.withColumnRenamed("_tie", tie).select("query_id", tie, "similarity", "rank")
    return out.join(chunks.drop("vector"), F.col("_tie") == F.col(tie)).drop("_tie")


def rerank(hits: DataFrame, k: int, cross: Column, tie: str = "chunk_id", share: float = params.Retrieval().rerank_share) -> DataFrame:
    """The k hits of each query with the highest fused score; cross is the reranker's score of a hit."""
    best = Window.partitionBy("query_id").orderBy(F.desc("fused"), tie)
    scored = hits.withColumn("_cross", cross)  # computed once
    scored = scored.withColumns({"cross_score": N.rounded(F.col("_cross"), 4), "fused": N.fused(F.col("_cross"), F.col("similarity"), share)}).drop("_cross")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, chunks: DataFrame, r: params.Retrieval = params.Retrieval(), reranker: Callable[[Column, Column], Column] | None = lexical_overlap) -> DataFrame:
    """Twice k by cosine, then k by fused score: (query_id, query, vector) against (chunk_id, vector, text, ...).

    Without a reranker the cosine order stands and there is no cross_score."""
    if reranker is None:
        return top_k(queries, chunks, r.top_k).withColumnRenamed("similarity", "score")
    hits = top_k(queries, chunks, 2 * r.top_k).join(queries.select("query_id", "query"), "query_id")
    out = rerank(hits, r.top_k, reranker(F.col("query"), F.col("text")), share=r.rerank_share)
    return out.drop("query", "similarity").withColumnRenamed("fused", "score")


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context, top_score): the hits as numbered lines in rank order."""
    line = F.concat(F.lit("- Chunk "), F.col("rank").cast("string"), F.lit(" ["), F.col("case_id"), F.lit(" | "), F.col("activity"), F.lit(" | Score: "), F.col("score").cast("string"), F.lit("]: "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"), F.max("score").alias("top_score"))
