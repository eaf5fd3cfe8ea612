"""Numeric functions over probabilities, log-probabilities and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenguard import params
from tokenguard.functions import text as T


def rounded(x: Column, n: int) -> Column:
    """Half to even on the exact binary value."""
    return F.replace(F.format_number(x, n), F.lit(","), F.lit("")).cast("double")


def clamp(low: float, high: float, x: Column) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def shannon_entropy(ps: Column) -> Column:
    """-sum p log2 p over positive entries, without normalisation."""
    return F.aggregate(F.filter(ps, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def surprise(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def normalized_probabilities(top: Column, logprob: Column) -> Column:
    """Probabilities of a map of log-probabilities, scaled to sum to 1; without a map, the token's own."""
    ps = F.transform(F.map_values(top), F.exp)
    whole = total(ps)
    return F.when(F.coalesce(F.cardinality(top), F.lit(0)) <= 0, F.array(F.exp(F.coalesce(logprob, F.lit(0.0))))).otherwise(F.when(whole > 0, F.transform(ps, lambda p: p / whole)).otherwise(ps))


def variance(xs: Column) -> Column:
    """Population variance of an array; 0 for fewer than two values."""
    n = F.cardinality(xs)
    mean = total(xs) / F.nullif(n, F.lit(0))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def pmi_penalty(logprob: Column, unconditioned: Column) -> Column:
    """How much less likely the context makes the token; 0 without a baseline."""
    return F.when(unconditioned.isNull() | logprob.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), unconditioned - logprob))


def uncertainty(p: Column, var: Column, weight: Column, pmi: Column | None = None, s: params.Scoring = params.Scoring()) -> Column:
    return ((1 - p) + s.variance_factor * var + s.pmi_factor * (F.lit(0.0) if pmi is None else pmi)) * weight


def draft_logprob(token: Column, similarity: Column) -> Column:
    """Estimate for a token without a log-probability, from its similarity to the context."""
    c = T.strip(F.coalesce(token, F.lit("")))
    b = clamp(0.01, 0.99, similarity)
    risky = c.rlike(T.DIGIT) | c.rlike("[$€£¥%]") | T.is_code(c)
    return (
        F.when(c == "", 0.0)
        .when(risky & (similarity < 0.7), F.log(F.greatest(F.lit(0.02), b * 0.15)))
        .when(risky, F.log(F.greatest(F.lit(0.85), b * 0.96)))
        .when(F.lower(c).isin(params.DRAFT_STOPWORDS), -0.02)
        .otherwise(F.log(F.greatest(F.lit(0.2), b * 0.9)))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def fused(cross: Column, similarity: Column, share: float = params.Retrieval().rerank_share) -> Column:
    """Weighted sum of the reranker's score and the similarity as rounded before."""
    return rounded(share * cross + (1 - share) * similarity, 4)


def saved_tokens(unprotected: Column, protected: Column) -> Column:
    return F.greatest(F.lit(0), unprotected - protected)


def saved_percent(unprotected: Column, protected: Column, default: float = 75.0) -> Column:
    return F.coalesce(rounded(F.try_divide(100.0 * saved_tokens(unprotected, protected), unprotected), 1), F.lit(default))


def saved_percent_whole(unprotected: Column, protected: Column) -> Column:
    """Whole percent, halves up; 0 without tokens."""
    return F.coalesce(F.floor(F.try_divide(100.0 * saved_tokens(unprotected, protected), unprotected) + 0.5), F.lit(0)).cast("int")


def latency_penalty(unprotected_seconds: Column, interception_ms: Column) -> Column:
    """How many times longer the unprotected answer took than its interception, with 1 decimal, as a label."""
    times = F.try_divide(unprotected_seconds, F.nullif(interception_ms, F.lit(0.0)) / 1000)
    return F.coalesce(F.concat(F.lit("+"), F.replace(F.format_number(times, 1), F.lit(","), F.lit("")), F.lit("x Penalty")), F.lit("Calculating..."))


DRAFT_VALUES = (math.log(0.15 * 0.15), math.log(0.95 * 0.96), -0.02, math.log(0.2), math.log(0.95 * 0.9))
