"""Process event logs: chunks, leak checks and ground-truth aggregates. A case's order is its position, not its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenguard.functions import numeric as N
from tokenguard.functions import text as T

COMPLIANCE, BOTTLENECK = "Compliance Review", "Supply Chain Bottleneck Flagged"


def summary(events: DataFrame, position: str = "pos") -> DataFrame:
    """One row of aggregates over (case_id, position, activity, cycle_time_days): mean compliance time, mean last time of
    a case, flagged cases, all cases. Means have 1 decimal; without rows they are 0."""
    cases = events.groupBy("case_id").agg(
        F.sum(F.when(F.col("activity") == COMPLIANCE, F.col("cycle_time_days"))).alias("days"), F.count_if(F.col("activity") == COMPLIANCE).alias("reviews"),
        F.max_by("cycle_time_days", position).alias("last"), F.max(F.col("activity") == BOTTLENECK).alias("flagged"),
    )
    mean = lambda x: F.coalesce(N.rounded(x, 1), F.lit(0.0))
    return cases.agg(
        mean(F.try_divide(F.sum("days").cast("double"), F.sum("reviews"))).alias("avg_compliance_cycle_time_days"), mean(F.avg("last")).alias("avg_order_to_cash_days"),
        F.count_if("flagged").alias("orders_flagged_for_bottleneck"), F.count("*").alias("total_orders"),
    )


def chunks(events: DataFrame) -> DataFrame:
    """(case_id, activity, text): one redacted sentence for each event."""
    c = F.col
    return events.select("case_id", "activity", T.chunk_event(c("case_id"), c("activity"), c("timestamp"), c("resource"), c("department"), c("cost_center"), c("amount_usd"), c("cycle_time_days"), c("note")).alias("text"))


def summary_chunk(metrics: DataFrame) -> DataFrame:
    c = F.col
    text = T.chunk_summary(c("avg_compliance_cycle_time_days"), c("avg_order_to_cash_days"), c("orders_flagged_for_bottleneck"), c("total_orders"))
    return metrics.select(F.lit("SUMMARY").alias("case_id"), F.lit("aggregate_metrics").alias("activity"), text.alias("text"))


def corpus(events: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Chunks of all events, and the summary as one more."""
    return chunks(events).unionByName(summary_chunk(summary(events) if metrics is None else metrics))


def leak_count(df: DataFrame, column: str = "text") -> DataFrame:
    return df.agg(F.count_if(T.leaks_pii(F.col(column))).alias("leaks"), F.count("*").alias("rows"))


def refuse_leaks(df: DataFrame, column: str = "text") -> DataFrame:
    """df, failing as soon as the text of a row with personal data is read."""
    checked = T.once(F.col(column), lambda x: F.when(T.leaks_pii(x), F.raise_error(F.lit("personal data left in a chunk")).cast("string")).otherwise(x))
    return df.withColumn(column, checked)


def fill_average(events: DataFrame, metrics: DataFrame, mark: str = "{avg}") -> DataFrame:
    """The computed average in place of its mark in the notes of compliance events; metrics has one row."""
    average = F.col("avg_compliance_cycle_time_days").cast("string")
    filled = F.when(F.col("activity") == COMPLIANCE, F.replace("note", F.lit(mark), average)).otherwise(F.col("note"))
    return events.crossJoin(F.broadcast(metrics.select("avg_compliance_cycle_time_days"))).withColumn("note", filled).drop("avg_compliance_cycle_time_days")
