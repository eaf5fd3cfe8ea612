"""Event-log documents, prompt suites, token payloads, vector collections, reports, and a synthetic log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenguard.functions import numeric as N
from tokenguard.sources import collection

EVENT = "case_id string, activity string, timestamp string, resource string, resource_email string, resource_phone string, department string, cost_center string, amount_usd double, cycle_time_days int, note string"
METRICS = "avg_compliance_cycle_time_days double, avg_order_to_cash_days double, orders_flagged_for_bottleneck int, total_orders int, note_ground_truth string"
LOG = f"process string, source_system string, extraction_timestamp string, events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>, summary_metrics struct<{METRICS.replace(' ', ':').replace(',:', ',')}>"
PROMPT = "struct<id:string,category:string,prompt:string,reason:string,expected_fact:string>"
SUITE = f"description string, poison_prompts array<{PROMPT}>, grounded_prompts array<{PROMPT}>"
MANIFEST = "dim int, metric string, row_count long"
PAYLOAD = "token string, logprob double, top_logprobs map<string,double>, unconditioned_logprob double"


def read_json(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """Whole JSON documents; a path that doesn't exist gives no rows, or an error if it must exist."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def events(log: DataFrame) -> DataFrame:
    """Events with their position in the document; a missing array has none."""
    return log.select(F.posexplode("events")).select("pos", "col.*")


def metrics(log: DataFrame) -> DataFrame:
    return log.where("summary_metrics IS NOT NULL").select("summary_metrics.*")


def suite(document: DataFrame) -> DataFrame:
    """(id, category, prompt, reason, expected_fact, expected) of both kinds of prompts."""
    one = lambda column, kind: document.select(F.explode(column).alias("p")).select("p.*", F.lit(kind).alias("expected"))
    return one("poison_prompts", "intercepted").unionByName(one("grounded_prompts", "grounded"))


def payload(raw: Column) -> Column:
    """struct(token, logprob, probabilities, unconditioned_logprob) of a token payload in JSON."""
    p = F.from_json(raw, PAYLOAD)
    logprob = F.coalesce(p["logprob"], F.lit(0.0))
    return F.struct(F.coalesce(p["token"], F.lit("")).alias("token"), logprob.alias("logprob"), N.normalized_probabilities(p["top_logprobs"], logprob).alias("probabilities"), p["unconditioned_logprob"].alias("unconditioned_logprob"))


def write_collection(chunks: DataFrame, path: str, dim: int, metric: str = "COSINE", gate: str | None = None) -> int:
    """Replace a vector collection by chunks (chunk_id, vector, case_id, activity, text) and return the number of its rows, which
    are counted as they are written. A vector of another length fails the write, and so does personal data in the column
    `gate`; the collection then stays as it was."""
    return collection.replace(chunks, path, dim, metric, key="chunk_id", gate=gate)


def has_collection(spark: SparkSession, path: str) -> bool:
    return collection.manifest(spark, path) is not None


def drop_collection(spark: SparkSession, path: str) -> None:
    folder, files = collection.files_of(spark, path)
    files.delete(folder, True)


def describe_collection(spark: SparkSession, path: str) -> DataFrame:
    """(dim, metric, row_count) of a collection."""
    found = collection.manifest(spark, path)
    return spark.createDataFrame([(found["dim"], found["metric"], found["row_count"])], MANIFEST)


def open_collection(spark: SparkSession, path: str, otherwise: DataFrame) -> DataFrame:
    """The rows of a collection, or another frame of chunks where there is none."""
    found = collection.read(spark, path, key="chunk_id")
    return otherwise if found is None else found


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


DEPARTMENTS = ["Purchasing", "Controls", "Accounts", "Logistics"]
PEOPLE = [(f"Clerk No{i + 1}", DEPARTMENTS[i % len(DEPARTMENTS)]) for i in range(8)]
APPROVERS = DEPARTMENTS[2]
COST_CENTERS = [f"CC-{1000 + 11 * i}" for i in range(5)]


def synthetic_events(spark: SparkSession, cases: int = 150, seed: int = 42) -> DataFrame:
    """Events of numbered cases: an order, a review if it is above 100,000, a bottleneck in a quarter of the cases, and an
    approval by the approvers' department. Times to date grow within a case; time stamps are drawn apart and follow no order."""
    draw = lambda k, n: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "case_no", F.lit(seed), F.lit(k))), 1, 12), 16, 10).cast("long"), F.lit(n))
    people = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("department")) for n, d in PEOPLE])
    row = spark.range(10001, 10001 + cases).withColumnRenamed("id", "case_no")
    row = row.withColumns({"amount": (800000 + draw(1, 44200001)) / F.lit(100.0), "d1": 1 + draw(2, 4), "d2": 3 + draw(3, 10), "d3": 2 + draw(4, 5), "d4": 1 + draw(5, 3), "flagged": draw(6, 4) == 0, "center": F.element_at(F.array(*[F.lit(c) for c in COST_CENTERS]), (draw(7, 5) + 1).cast("int")), "first": draw(8, 8), "people": people})
    row = row.withColumn("review", F.col("amount") > 100000)
    person = lambda k: F.element_at("people", (F.pmod(F.col("first") + k, F.lit(8)) + 1).cast("int"))
    days = [F.col("d1"), F.col("d1") + F.col("d2")]
    days.append(F.col("d1") + F.when(F.col("review"), F.col("d2")).otherwise(0) + F.col("d3"))
    days.append(F.col("d1") + F.when(F.col("review"), F.col("d2")).otherwise(0) + F.when(F.col("flagged"), F.col("d3")).otherwise(0) + F.col("d4"))
    pool = F.array(person(0), person(3), person(5))
    approver = F.coalesce(F.try_element_at(F.filter(pool, lambda x: x["department"] == APPROVERS), F.lit(1)), F.element_at("people", 3))
    mail = lambda x: F.concat(F.replace(F.lower(x), F.lit(" "), F.lit(".")), F.lit("@example.com"))
    notes = [F.lit(None).cast("string"), F.lit("Average compliance cycle time is {avg} days."), F.concat(F.lit("Held for "), F.col("d3").cast("string"), F.lit(" days, contact "), mail(person(5)["name"]), F.lit(" or +91-98765-43210")), F.lit(None).cast("string")]
    names = ["Purchase Order Created", "Compliance Review", "Supply Chain Bottleneck Flagged", "Invoice Approved"]
    made = [F.lit(True), F.col("review"), F.col("flagged"), F.lit(True)]
    who = [person(0), person(3), person(5), approver]
    stamp = lambda i: F.date_format(F.expr("TIMESTAMP_NTZ'2026-01-01 06:00:00'") + F.make_dt_interval(draw(20 + i, 200).cast("int"), F.lit(0), draw(30 + i, 720).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    steps = [F.struct(F.lit(i).alias("pos"), ok.alias("made"), F.lit(n).alias("activity"), stamp(i).alias("timestamp"), w["name"].alias("resource"), mail(w["name"]).alias("resource_email"), F.lit("+91-98765-43210").alias("resource_phone"), w["department"].alias("department"), d.cast("int").alias("cycle_time_days"), note.alias("note")) for i, (n, ok, w, d, note) in enumerate(zip(names, made, who, days, notes, strict=True))]
    return row.select(F.concat(F.lit("CASE-"), F.col("case_no").cast("string")).alias("case_id"), F.col("center").alias("cost_center"), F.col("amount").alias("amount_usd"), F.explode(F.filter(F.array(*steps), lambda s: s["made"])).alias("e")).select("case_id", "cost_center", "amount_usd", "e.*").drop("made")
