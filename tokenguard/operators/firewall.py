"""Query firewall: keyword rules first, then the similarity threshold."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenguard import params
from tokenguard.functions import text as T
from tokenguard.operators import evaluation as E
from tokenguard.operators import retrieval as R
from tokenguard.sources.shared import materialize

SIGNAL = "[INTERCEPTION: SEMANTIC ENTROPY > tau. ABORTING HALLUCINATED TOKEN GENERATION.]"


def verdict(query: Column, top_score: Column, keywords: Sequence[str] = params.POISON_KEYWORDS, r: params.Retrieval = params.Retrieval()) -> Column:
    """struct(is_poison, reason); top_score is null if nothing was retrieved."""
    word = T.first_keyword(query, keywords)
    reason = (
        F.when(word.isNotNull(), F.concat(F.lit("Explicit out-of-scope / poison keyword detected: '"), word, F.lit("'.")))
        .when(top_score.isNull(), "Zero ground-truth chunks retrieved from vector store.")
        .when(top_score < r.similarity_threshold, F.concat(F.lit("Top retrieval similarity score ("), F.format_number(top_score, 4), F.lit(f") below safety threshold ({r.similarity_threshold:.2f}). Context gap detected - risk of stochastic hallucination.")))
        .otherwise("Ground truth verified in vector store.")
    )
    poison = word.isNotNull() | top_score.isNull() | F.coalesce(top_score < r.similarity_threshold, F.lit(False))
    return F.struct(poison.alias("is_poison"), reason.alias("reason"))


def screen(queries: DataFrame, contexts: DataFrame, keywords: Sequence[str] = params.POISON_KEYWORDS, r: params.Retrieval = params.Retrieval()) -> DataFrame:
    """(query_id, query, status, is_poison, reason, context, interception_signal) of each query.

    contexts holds (query_id, context, top_score) of what was retrieved. A null query counts as empty."""
    met = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query")).join(contexts, "query_id", "left")
    met = met.withColumn("_v", verdict(F.col("query"), F.col("top_score"), keywords, r))
    poison = F.col("_v.is_poison")
    return met.select("query_id", "query", F.when(poison, "POISON_DETECTED").otherwise("GROUNDED").alias("status"), poison.alias("is_poison"), F.col("_v.reason").alias("reason"), F.when(~poison, F.col("context")).alias("context"), F.when(poison, SIGNAL).alias("interception_signal"))


def run_suite(suite: DataFrame, chunks: DataFrame, encoder: Callable[[Column], Column], r: params.Retrieval = params.Retrieval(), reranker: Callable[[Column, Column], Column] | None = R.lexical_overlap) -> tuple[DataFrame, DataFrame]:
    """Verdicts on the prompts of a suite (id, prompt, expected) against chunks with vectors, and the one-row report.

    All prompts go through one plan: retrieval, context, screening."""
    asked = suite.select(F.col("id").alias("query_id"), F.col("prompt").alias("query"), encoder(F.coalesce("prompt", F.lit(""))).alias("vector"))
    hits = R.retrieve(asked, chunks, r, reranker)
    verdicts = screen(asked, R.context(hits), r=r).join(suite.select(F.col("id").alias("query_id"), "expected"), "query_id")
    best = hits.where("rank = 1").select("query_id", F.col("score").alias("top_score"), T.snippet(F.col("text")).alias("snippet"))
    verdicts = verdicts.join(best, "query_id", "left").withColumn("passed", F.col("is_poison") == (F.col("expected") == "intercepted"))
    return verdicts, E.suite_report(verdicts)


def run_of_show(suite: DataFrame, chunks: DataFrame, encoder: Callable[[Column], Column], r: params.Retrieval = params.Retrieval(), reranker: Callable[[Column, Column], Column] | None = R.lexical_overlap) -> tuple[DataFrame, DataFrame]:
    """run_suite with latency_ms: the time of the run divided evenly among the prompts, since one plan answers them all.

    Verdicts are written to the shared folder as they are timed, and read from there."""
    verdicts, _ = run_suite(suite, chunks, encoder, r, reranker)
    began = time.perf_counter()
    done = materialize(verdicts)
    each = (time.perf_counter() - began) * 1000 / max(1, done.count())
    timed = done.withColumn("latency_ms", F.lit(round(each, 2)))
    return timed, E.suite_report(timed)
