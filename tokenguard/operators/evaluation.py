"""Threshold calibration, confusion matrices and suite reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenguard import params
from tokenguard.functions import numeric as N
from tokenguard.sources.shared import materialize


def calibrate(scores: DataFrame, column: str = "score", s: params.Scoring = params.Scoring()) -> DataFrame:
    """One row, tau: the exact order statistic at min(int(n (1 - rate)), n - 1) of the ascending scores; tau stays if there
    are none.

    Found by counting: values are grouped (ties need no order), and a running count over range partitions' totals says in
    which partition the statistic lies, so no task sorts everything."""
    values = materialize(scores.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).count())
    n = values.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if not n:
        return scores.sparkSession.createDataFrame([(s.tau, 0)], "tau double, n long")
    wanted = min(int(n * (1 - s.false_positive_rate)), n - 1)
    ranges = values.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    low, high = float("-inf"), float("inf")
    before = 0
    for row in ranges.groupBy("part").agg(F.sum("count").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("low").collect():  # a row per partition
        if before + row["n"] > wanted:
            low, high = row["low"], row["high"]
            break
        before += row["n"]
    inside = values.where(F.col("v").between(low, high)).withColumn("upto", F.sum("count").over(Window.orderBy("v")) + before)
    return inside.where(F.col("upto") > wanted).agg(F.min("v").alias("tau")).select("tau", F.lit(n).cast("long").alias("n"))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(N.rounded(F.try_divide(100.0 * part, whole), 2), F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and accuracy, precision, recall, F1 in percent with 2 decimals; 0 where undefined."""
    counts = {"tp": predicted & actual, "fp": predicted & ~actual, "tn": ~predicted & ~actual, "fn": ~predicted & actual}
    out = df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    tp, fp, tn, fn = (F.col(k) for k in counts)
    out = out.withColumns({"accuracy": percent(tp + tn, tp + fp + tn + fn), "precision": percent(tp, tp + fp), "recall": percent(tp, tp + fn)})
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return out.withColumn("f1", F.coalesce(N.rounded(100.0 * F.try_divide(2 * p * r, p + r), 2), F.lit(0.0)))


def suite_report(results: DataFrame, expected: str = "expected", poison: str = "is_poison") -> DataFrame:
    """One row: passed and total of either kind, success rates in percent, and the verdicts on the firewall and on the run of
    the suite; latency_ms is averaged if given."""
    bad, good = F.col(expected) == "intercepted", F.col(expected) == "grounded"
    caught = F.col(poison)
    latency = [N.rounded(F.avg("latency_ms"), 2).alias("mean_latency_ms")] if "latency_ms" in results.columns else []
    out = results.agg(F.count_if(bad & caught).alias("intercepted"), F.count_if(bad).alias("poison_total"), F.count_if(good & ~caught).alias("verified"), F.count_if(good).alias("grounded_total"), *latency)
    out = out.withColumns({"interception_rate": percent(F.col("intercepted"), F.col("poison_total")), "verification_rate": percent(F.col("verified"), F.col("grounded_total"))})
    perfect = (F.col("interception_rate") == 100) & (F.col("verification_rate") == 100)
    # fixed values: the verdicts' texts, without the occasion that the second one names
    return out.withColumns({"reliability": F.when(perfect, "100% RELIABLE").otherwise("NEEDS CALIBRATION"), "verdict": F.when(perfect, "READY (100% ACCURACY)").otherwise("CALIBRATION REQUIRED")})
