"""Labelled token streams: a literal suite, and streams made from an event log; how well each score separates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenguard.operators import evaluation as E
from tokenguard.operators import uncertainty as U
from tokenguard.plans.corpus import synthetic_sql
from tokenguard.plans.registry import query
from tokenguard.plans.streams import moments_sql
from tokenguard.sources import event_log

# Whether a stream must be stopped, and its tokens with their log-probabilities.
STREAMS = [
    (False, [("According", -0.02), ("to", -0.01), ("verified", -0.05), ("Celonis", -0.03), ("event", -0.02), ("logs,", -0.04), ("average", -0.03), ("compliance", -0.02), ("cycle", -0.01), ("time", -0.02), ("for", -0.01), ("orders", -0.03), ("above", -0.04), ("$100,000", -0.08), ("is", -0.02), ("12", -0.05), ("days.", -0.03)]),
    (False, [("Purchase", -0.03), ("Order", -0.02), ("CASE-10231", -0.07), ("was", -0.01), ("created", -0.04), ("by", -0.02), ("Anita", -0.08), ("Rao", -0.05), ("for", -0.01), ("$128,500.00.", -0.09)]),
    (True, [("Accessing", -0.04), ("Celonis", -0.05), ("event", -0.03), ("logs...", -0.06), ("Vendor", -0.08), ("contract", -0.09), ("override", -0.12), ("values", -0.1), ("indicate", -0.15), ("42.8_days_unverified_$5M", -2.85)]),
    (True, [("Warehouse", -0.05), ("node", -0.04), ("W-99", -2.65), ("recorded", -0.2), ("an", -0.05), ("unapproved", -0.15), ("delay_holding_99_days", -3.2)]),
    (True, [("Vendor", -0.02), ("invoice", -0.03), ("settlement", -0.04), ("stipulates", -0.08), ("an", -0.02), ("unapproved", -0.15), ("reconciliation", -0.2), ("balance", -0.1), ("of", -0.01), ("$14.2M_unverified_EUR_equivalent", -0.65), ("pending", -0.05), ("audit.", -0.02)]),
    (True, [("Under", -0.02), ("SOX", -0.04), ("Section", -0.03), ("404", -0.05), ("guidelines,", -0.04), ("all", -0.02), ("procurement", -0.03), ("sign-offs", -0.05), ("may", -0.05), ("bypass", -0.12), ("Chief_Audit_Executive_approval_in_California", -0.75)]),
    (True, [("Celonis", -0.02), ("EMS", -0.03), ("Order-to-Cash", -0.04), ("analytics", -0.03), ("certifies", -0.05), ("average", -0.02), ("approval", -0.03), ("turnaround", -0.04), ("at", -0.01), ("0.42_business_days", -0.6), ("without", -0.05), ("exceptions.", -0.02)]),
    (False, [("According", -0.02), ("to", -0.01), ("internal", -0.04), ("audit", -0.03), ("guidelines", -0.05), ("(revised", -0.2), ("Q2-2026,", -0.15), ("Addendum", -0.15), ("IV),", -0.1), ("standard", -0.02), ("P2P", -0.03), ("processing", -0.02), ("requires", -0.02), ("5", -0.04), ("days.", -0.02)]),
    (False, [("International", -0.03), ("invoices", -0.02), ("exceeding", -0.04), ("€250,000", -0.06), ("or", -0.01), ("£200,000", -0.07), ("follow", -0.02), ("standard", -0.02), ("two-tier", -0.04), ("reconciliation", -0.03), ("protocols.", -0.02)]),
    (True, [("Procurement", -0.02), ("ticket", -0.03), ("CASE-99999-UNAUTH", -0.85), ("was", -0.02), ("force-closed", -0.2), ("by", -0.02), ("external", -0.15), ("contractor.", -0.05)]),
    (False, [("Logistics", -0.03), ("transfers", -0.04), ("between", -0.02), ("Frankfurt", -0.08), ("and", -0.01), ("Singapore", -0.07), ("maintain", -0.02), ("continuous", -0.05), ("telemetry", -0.06), ("tracking", -0.03), ("across", -0.02), ("all", -0.01), ("nodes.", -0.02)]),
    (True, [("Historical", -0.02), ("audit", -0.03), ("records", -0.02), ("demonstrate", -0.04), ("flawless", -0.08), ("SLA", -0.04), ("execution", -0.03), ("at", -0.01), ("99.999%_uninterrupted", -0.7), ("uptime.", -0.02)]),
    (True, [("Mean", -0.02), ("cycle", -0.03), ("time", -0.02), ("is", -0.01), ("unverified_88_days", -1.25)]),
    (False, [("The", -0.05), ("process", -0.04), ("workflow", -0.45), ("for", -0.02), ("onboarding", -0.01), ("has", -0.01), ("been", -0.02), ("completed.", -0.01)]),
]
# Of the streams made from events; None stands for what the event says.
GROUNDED = [("Case", -0.02), (None, -0.05), ("recorded", -0.02), (None, -0.04), ("by", -0.02), (None, -0.06), ("with", -0.01), ("cycle", -0.02), ("time", -0.02), (None, -0.05), ("for", -0.01), (None, -0.06)]
INVENTED = [("Celonis", -0.03), ("log", -0.02), ("query", -0.04), ("extracts", -0.05), ("unauthorized", -0.12), ("override", -0.15), ("parameter:", -0.18), (None, -2.95)]


def literal_streams(spark: SparkSession) -> DataFrame:
    """(suite, stream, label, pos, token, logprob) of the literal streams."""
    rows = [("literal", i, label, pos, token, p) for i, (label, said) in enumerate(STREAMS) for pos, (token, p) in enumerate(said)]
    return spark.createDataFrame(rows, "suite string, stream int, label boolean, pos int, token string, logprob double")


def positional(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """The rows at positions start to end (from 0, end left out) in the given order."""
    return df.orderBy(*order).offset(start).limit(end - start)


def event_streams(events: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """Streams (see literal_streams) of the first n events, told as they are, and of the next n, with an invented number."""
    filled = lambda form, said: F.array(*[F.struct(F.coalesce(next(said) if t is None else F.lit(t), F.lit("")).alias("token"), F.lit(p).alias("logprob")) for t, p in form])
    c = F.col
    told = filled(GROUNDED, iter([c("case_id"), c("activity"), c("resource"), F.concat(c("cycle_time_days").cast("string"), F.lit("_days")), F.concat(F.lit("$"), F.format_number("amount_usd", 2))]))
    number = lambda of: F.concat((F.lit(99.5) + of).cast("string"), F.lit("_days_unverified_$"), (F.lit(10) + of).cast("string"), F.lit("M"))
    part = lambda start: positional(events, order, start, start + n)
    counted = lambda df: df.select(F.posexplode(F.array_sort(F.collect_list(F.struct(*order))))).select("col.*", F.col("pos").alias("_n"))  # noqa: E731  n rows
    as_rows = lambda df, label, tokens: df.select(F.lit("events").alias("suite"), (F.col("_n") + (n if label else 0)).cast("int").alias("stream"), F.lit(label).alias("label"), F.posexplode(tokens).alias("pos", "t")).select("suite", "stream", "label", "pos", "t.*")
    grounded = part(0).join(counted(part(0)), order)
    return as_rows(grounded, False, told).unionByName(as_rows(counted(part(n)), True, filled(INVENTED, iter([number(F.col("_n"))]))))


SCORES = {"v1": "score_v1", "v2": "score_v2", "v3": "score"}
VALUES = ", ".join(f"('literal', {i}, {str(label).lower()}, {pos}, '{token}', {p}::DOUBLE)" for i, (label, said) in enumerate(STREAMS) for pos, (token, p) in enumerate(said))


def told_sql(form: list, said: list[str]) -> str:
    it = iter(said)
    return "[" + ", ".join(f"{{'token': {next(it) if t is None else repr(t)}, 'p': {p}::DOUBLE}}" for t, p in form) + "]"


RATE = "format('{{:.2f}}', coalesce(100.0::DOUBLE * ({a}) / nullif(({b}), 0), 0))::DOUBLE"


@query("suite_variants", f"""WITH log AS ({synthetic_sql()}), places AS (SELECT *, row_number() OVER (ORDER BY case_id, pos) - 1 AS n FROM log),
  made AS (SELECT n AS stream, false AS label, {told_sql(GROUNDED, ['case_id', 'activity', 'resource', "cycle_time_days || '_days'", "'$' || format('{:,.2f}', amount_usd)"])} AS ts FROM places WHERE n < 50
    UNION ALL SELECT n, true, {told_sql(INVENTED, ["(99.5::DOUBLE + n - 50)::VARCHAR || '_days_unverified_$' || (10 + n - 50) || 'M'"])} FROM places WHERE n >= 50 AND n < 100),
  tokens AS (SELECT * FROM (VALUES {VALUES}) t(suite, stream, label, pos, token, logprob) UNION ALL SELECT 'events', stream, label, unnest(range(len(ts))), unnest(ts).token, unnest(ts).p FROM made),
  s AS (SELECT *, exp(logprob) AS p FROM tokens),{moments_sql('suite, stream')},
  hit AS (SELECT suite, stream, any_value(label) AS label, max(score_v1) > 0.65 AS v1, max(score_v2) > 0.65 AS v2, max(score) > 0.65 AS v3 FROM x GROUP BY suite, stream),
  long AS (SELECT suite, label, 'v1' AS variant, v1 AS said FROM hit UNION ALL SELECT suite, label, 'v2', v2 FROM hit UNION ALL SELECT suite, label, 'v3', v3 FROM hit),
  c AS (SELECT suite, variant, count(*) FILTER (said AND label) AS tp, count(*) FILTER (said AND NOT label) AS fp, count(*) FILTER (NOT said AND NOT label) AS tn, count(*) FILTER (NOT said AND label) AS fn FROM long GROUP BY suite, variant)
  SELECT suite, variant, tp, fp, tn, fn, {RATE.format(a='tp + tn', b='tp + fp + tn + fn')} AS accuracy, {RATE.format(a='tp', b='tp + fp')} AS precision, {RATE.format(a='tp', b='tp + fn')} AS recall,
    format('{{:.2f}}', coalesce(100.0::DOUBLE * 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0))::DOUBLE AS f1 FROM c""")
def suite_variants(spark, sf_dir):
    """Which streams each score stops: unweighted and weighted with window variance, weighted with exponential variance."""
    streams = literal_streams(spark).unionByName(event_streams(event_log.synthetic_events(spark), ["case_id", "pos"]))
    scored = U.score_streams(streams, ["suite", "stream"])
    stopped: dict[str, Column] = {k: F.max(F.col(v) > 0.65) for k, v in SCORES.items()}
    hits = scored.groupBy("suite", "stream").agg(F.first("label").alias("label"), *[v.alias(k) for k, v in stopped.items()])
    long = hits.select("suite", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(k).alias("said")) for k in SCORES])).alias("x")).select("suite", "label", "x.*")
    return E.confusion(long, F.col("said"), F.col("label"), ["suite", "variant"])

