"""Served token streams as rows: event payloads, control markers, parsers, alignment, recovery answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenguard import params
from tokenguard.functions import numeric as N
from tokenguard.functions import text as T
from tokenguard.operators import uncertainty as U

GROUNDED_END, STATUS_END = "[COMPLETED: GROUND TRUTH VERIFIED]", "[COMPLETED: SYSTEM_STATUS]"
UNPROTECTED_END = "[UNPROTECTED_COMPLETED: UNGROUNDED HALLUCINATION GENERATED]"


def process_graphs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(params.PROCESS_GRAPHS, "graph string, name string, collection string, vector_count int, pii_masked boolean, cycle_time string, sla_compliance string")


def with_graph(df: DataFrame, column: str = "graph") -> DataFrame:
    """df with the graph's row beside it; unknown and null keys get the default graph's. The table has a fixed few rows."""
    graphs = process_graphs(df.sparkSession)
    known = [g[0] for g in params.PROCESS_GRAPHS]
    key = F.when(F.col(column).isin(known), F.col(column)).otherwise(params.DEFAULT_GRAPH)
    return df.withColumn("_graph", key).join(F.broadcast(graphs.withColumnRenamed("graph", "_graph")), "_graph", "left").drop("_graph")


def tokens(text: Column) -> Column:
    """Pieces between single spaces; empty ones stay."""
    return F.split(text, " ", -1)


def encode_events(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, seq, payload): each token of the text as an event."""
    return df.select(*keys, F.posexplode(tokens(F.coalesce(text, F.lit(""))))).select(*keys, F.col("pos").alias("seq"), F.concat(F.lit("data: "), F.col("col"), F.lit(" \n\n")).alias("payload"))


def event_text(payload: Column) -> Column:
    return T.strip(F.substring(payload, F.lit(7), F.length(payload)))


def parse_stripped(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Tokens of `data: ` lines up to an interception; other control markers are dropped, empty tokens stay."""
    rows = events.where(F.col("payload").startswith("data: ")).withColumn("token", event_text(F.col("payload")))
    stops = rows.where(F.col("token").startswith("[INTERCEPTION")).groupBy(*keys).agg(F.min(seq).alias("_stop"))
    kept = U.join_back(rows, stops, keys).where(F.col("_stop").isNull() | (F.col(seq) < F.col("_stop")))
    return kept.where(~F.col("token").startswith("[")).select(*keys, seq, "token")


def parse_words(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """(keys, seq, n, token) of the words of each event's text; empty ones are dropped, control markers end or skip."""
    whole = parse_stripped(events, keys, seq)
    words = F.filter(tokens(F.col("token")), lambda w: w != "")
    return whole.select(*keys, seq, F.posexplode(words)).withColumnsRenamed({"pos": "n", "col": "token"})


def align(left: DataFrame, right: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Two streams side by side by position; the shorter one's last value is carried on. Both have (keys, pos, value)."""
    met = left.withColumnRenamed("value", "left_value").join(right.withColumnRenamed("value", "right_value"), [*keys, pos], "full")
    return carried(met, keys, ["left_value", "right_value"], pos).select(*keys, pos, "left_value", "right_value")


def carried(df: DataFrame, keys: list[str], columns: list[str], pos: str = "pos") -> DataFrame:
    """df with nulls in the columns replaced by the last value before them in the stream. Streams are filled in stretches of
    positions, each beginning with what the stretches before it have left."""
    rows = df.withColumn("_stretch", F.floor(F.col(pos) / U.STRETCH))
    ends = rows.groupBy(*keys, "_stretch").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    ends = ends.select(*keys, "_stretch", *[F.last(f"_{c}", True).over(earlier).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_stretch").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(c, True).over(inside) for c in columns})
    met = U.join_back(filled, ends, [*keys, "_stretch"])
    return met.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_stretch", *[f"_{c}" for c in columns])


def grounded_text(name: Column, query: Column, cycle: Column, compliance: Column, chunk: Column) -> Column:
    logs = F.concat(F.lit("According to verified "), name, F.lit(" event logs, query analysis for '"), query, F.lit("' confirms a mean cycle time of "), cycle, F.lit(" with "), compliance, F.lit(" SLA compliance."))
    return F.when(chunk.isNotNull(), F.concat(F.lit("According to verified "), name, F.lit(" ground truth: "), chunk)).otherwise(logs)


def spoken(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The status texts (session, seq, text) of greetings among the sessions (session, query, graph, is_poison, top_chunk), and
    the tokens (session, query, pos, token, logprob, last) of the others."""
    rows = with_graph(sessions).withColumn("query", F.coalesce("query", F.lit("")))
    greeting = T.is_greeting(F.col("query"))
    texts = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit(f"{params.GATEWAY_STATUS} ").alias("text")), F.struct(F.lit(1).cast("long").alias("seq"), F.lit(STATUS_END).alias("text")))
    status = rows.where(greeting).select("session", F.explode(texts).alias("e")).select("session", "e.*")
    rows = rows.where(~greeting)
    preamble = F.concat(F.lit("Analyzing "), F.col("name"), F.lit(" via vector search... Query: '"), F.col("query"), F.lit("'. Attempting to extract unverified parameters: Vendor contract override values indicate "))
    text = F.when(F.col("is_poison"), preamble).otherwise(grounded_text(F.col("name"), F.col("query"), F.col("cycle_time"), F.col("sla_compliance"), F.col("top_chunk")))
    said = F.transform(tokens(text), lambda t: F.struct(t.alias("token"), F.when(F.col("is_poison"), params.POISON_LOGPROB).otherwise(params.GROUNDED_LOGPROB).alias("logprob")))
    halted = F.when(F.col("is_poison"), F.array(F.struct(F.lit(params.HALTED_TOKEN).alias("token"), F.lit(params.HALTED_LOGPROB).alias("logprob")))).otherwise(F.array().cast("array<struct<token:string,logprob:double>>"))
    rows = rows.withColumn("_said", F.concat(said, halted))
    stream = rows.select("session", "query", (F.size("_said") - 1).alias("_end"), F.posexplode("_said"))
    return status, stream.select("session", "query", F.col("pos").cast("long").alias("pos"), "col.*", (F.col("pos") == F.col("_end")).alias("last"))


def stop_texts(score: Column, token: Column, package: Column, s: params.Scoring = params.Scoring()) -> Column:
    """What a session says when it is stopped, in the place of the token: interception, fallback signal, recovery package."""
    signal = F.to_json(F.struct(F.lit("fallback_triggered").alias("event"), F.lit("semantic_entropy_spike").alias("reason"), token.alias("token"), score.alias("uncertainty")))
    return F.array(
        F.concat(F.lit("[INTERCEPTION: SEMANTIC ENTROPY ("), F.format_number(score, 2), F.lit(f") > τ ({s.tau}). ABORTING HALLUCINATED TOKEN GENERATION.]")),
        F.concat(F.lit("[FALLBACK_SIGNAL: "), signal, F.lit("]")), F.concat(F.lit("[SELF_HEALING_CONTEXT: "), F.to_json(package), F.lit("]")),
    )


def texts_of(s: params.Scoring = params.Scoring()) -> Column:
    """The texts, with their places, of a row that says, trips or ends (what, pos, token, score, ema_var, query, before)."""
    c = F.col
    package = U.recovery_package(c("query"), c("token"), c("score"), c("ema_var"), c("before"), s)
    texts = F.when(c("what") == "trip", stop_texts(c("score"), c("token"), package, s)).when(c("what") == "said", F.array(F.concat(F.coalesce("token", F.lit("")), F.lit(" ")))).otherwise(F.array(F.lit(GROUNDED_END)))
    return F.transform(texts, lambda t, i: F.struct((c("pos") + i).alias("seq"), t.alias("text")))


def as_events(texts: DataFrame) -> DataFrame:
    return texts.select("session", "seq", F.concat(F.lit("data: "), F.col("text"), F.lit("\n\n")).alias("payload"))


def protected_stream(sessions: DataFrame, s: params.Scoring = params.Scoring()) -> DataFrame:
    """(session, seq, payload) of each session (session, query, graph, is_poison, top_chunk).

    Greetings get the status. Poison sessions are scored token by token and halt where the score passes tau, with the
    interception, a fallback signal and a recovery package; grounded sessions run to their end unless a score passes tau."""
    status, stream = spoken(sessions)
    scored = U.score_streams(stream, ["session"], s=s)
    cut = U.cut_at_trip(scored, ["session"], s=s)
    before = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("tripped"), F.struct("pos", F.coalesce("token", F.lit("")).alias("t"))))), lambda x: x["t"]), " ")
    texts = U.join_back(cut.where("tripped"), cut.groupBy("session").agg(before.alias("before")), ["session"]).withColumn("what", F.lit("trip"))
    plain = cut.where("NOT tripped").withColumns({"before": F.lit(None).cast("string"), "what": F.lit("said")})
    columns = ["session", "query", "pos", "token", "score", "ema_var", "before", "what"]
    ends = plain.where("last").withColumns({"pos": F.col("pos") + 1, "what": F.lit("end")})
    every = texts.select(columns).unionByName(plain.select(columns)).unionByName(ends.select(columns))
    return as_events(status.unionByName(every.select("session", F.explode(texts_of(s)).alias("e")).select("session", "e.*")))


def unprotected_stream(sessions: DataFrame) -> DataFrame:
    """(session, seq, payload) of a stream that nothing halts; the keyword rule decides what it says."""
    rows = with_graph(sessions)
    invented = F.concat(F.lit("Analyzing "), F.col("name"), F.lit("... Accessing Q4 draft projections: Vendor contract override values indicate $42.8M projected margin expansion for unannounced vendor contracts, with 18.4% off-contract discount approvals applied automatically without Senior Compliance Officer sign-off. Expected execution cycle time: 1.2 days."))
    asked = F.when(F.coalesce("query", F.lit("")) == "", "the exact Q3 compliance cycle time for vendor onboarding").otherwise(F.col("query"))
    calm = F.concat(F.lit("According to event logs, query analysis for '"), asked, F.lit("' confirms a mean cycle time of "), F.col("cycle_time"), F.lit(" with "), F.col("sla_compliance"), F.lit(" SLA compliance."))
    poison = T.has_keyword(F.col("query"))
    said = F.concat(F.transform(tokens(F.when(poison, invented).otherwise(calm)), lambda t: F.concat(t, F.lit(" "))), F.array(F.when(poison, UNPROTECTED_END).otherwise(GROUNDED_END)))
    return rows.select("session", F.posexplode(said)).select("session", F.col("pos").cast("long").alias("seq"), F.concat(F.lit("data: "), F.col("col"), F.lit("\n\n")).alias("payload"))


def recovered(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Answers for (query_id, query, graph) from the best hit (query_id, rank, case_id, text, score), whatever the verdict."""
    best = hits.where("rank = 1").select("query_id", "case_id", "text", "score")
    met = requests.withColumn("query", F.coalesce("query", F.lit(""))).withColumn("graph", F.coalesce("graph", F.lit(params.DEFAULT_GRAPH))).join(best, "query_id", "left")
    case = F.coalesce("case_id", F.lit("CASE-10231"))
    missing = F.concat(F.lit("Event Logs ("), F.upper("graph"), F.lit(" Process): Verified mean cycle time is 4.2 business days with 99.4% SLA compliance. No out-of-boundary activity found for '"), F.col("query"), F.lit("'."))
    return met.select(
        "query_id", F.lit("RECOVERED_SUCCESSFULLY").alias("status"), T.salient_terms(F.col("query")).alias("search_query"), F.concat(F.lit("vector_rerank_dense_"), F.col("graph")).alias("repair_strategy"),
        F.coalesce("text", missing).alias("verified_ground_truth"), case.alias("case_id"), F.coalesce("score", F.lit(0.992)).alias("vector_score"),
    )


def savings(unprotected: DataFrame, protected: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of two streams, and those saved, in numbers and percent (by both conventions)."""
    n = unprotected.groupBy(*keys).agg(F.count("*").alias("unprotected")).join(protected.groupBy(*keys).agg(F.count("*").alias("protected")), keys, "full")
    u, p = (F.coalesce(x, F.lit(0)) for x in ("unprotected", "protected"))
    return n.select(*keys, u.alias("unprotected"), p.alias("protected"), N.saved_tokens(u, p).alias("saved"), N.saved_percent(u, p).alias("saved_percent"), N.saved_percent_whole(u, p).alias("saved_percent_whole"))
