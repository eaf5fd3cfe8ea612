"""Queries over token streams: every user's events in time order are a stream, exp(-value / 250) its probabilities."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenguard import params
from tokenguard.functions import numeric as N
from tokenguard.functions import text as T
from tokenguard.operators import evaluation as E
from tokenguard.operators import uncertainty as U
from tokenguard.plans.registry import query, quoted, table
from tokenguard.sources.shared import new_folder
from tokenguard.streaming import monitor

KEYS = ["user_id"]


def r6(name: str):
    return F.round(name, 6).alias(name)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("token"), (-F.col("value") / 250).alias("logprob"))
    return U.with_position(rows, KEYS, ["ts", "event_id"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.score_streams(event_stream(spark, sf_dir), KEYS)


def upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'))"


SPACE = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"


def weight_sql(token: str) -> str:
    c = rf"regexp_replace(coalesce({token}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"
    k = f"trim(lower({c}), '.,;:()')"
    return rf"""CASE WHEN {c} = '' THEN 0.4
      WHEN regexp_matches({c}, '[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨$€£¥₹%]') THEN 3.5
      WHEN contains({c}, '-') AND len(list_filter(string_split({c}, '-'), lambda part: {upper("part")})) > 0 THEN 3.0
      WHEN {k} IN ({quoted(params.ACRONYMS)}) OR ({upper(c)} AND length({c}) >= 2) THEN 2.5
      WHEN {k} IN ({quoted(params.TITLES)}) THEN 2.2
      WHEN regexp_matches({c}, '^\p{{Lu}}') AND length({c}) > 2 AND NOT {c}.ends_with('.') THEN 1.8
      WHEN {k} IN ({quoted(params.STOPWORDS)}) OR {c} IN ({quoted(params.MARKS)}) THEN 0.4 ELSE 1.0 END::DOUBLE"""


def moments_sql(key: str = "user_id") -> str:
    """Running moments of the streams s (key, pos, token, p), by a fold over each stream's list, the scores x, and trips."""
    return f"""
lists AS (SELECT {key}, list({{'pos': pos, 'm': p, 'v': 0::DOUBLE, 'p': p}} ORDER BY pos) AS xs FROM s GROUP BY {key}),
states AS (
  SELECT {key}, unnest(list_transform(range(1, len(xs) + 1), lambda i: list_reduce(xs[2:i], lambda a, x: {{
    'pos': x.pos, 'm': a.m + 0.35::DOUBLE * (x.p - a.m), 'v': 0.65::DOUBLE * (a.v + 0.35::DOUBLE * (x.p - a.m) * (x.p - a.m)), 'p': x.p}}, xs[1]))) AS st FROM lists),
e AS (SELECT {key}, st.pos AS pos, st.m AS ema_mean, st.v AS ema_var FROM states),
w AS (
  SELECT s.*, ema_mean, ema_var, coalesce(var_pop(p) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS window_var,
    {weight_sql("token")} AS weight FROM s JOIN e USING ({key}, pos)),
x AS (SELECT *, ((1 - p) + 2 * window_var) AS score_v1, ((1 - p) + 2 * window_var) * weight AS score_v2, ((1 - p) + 2 * ema_var) * weight AS score FROM w),
trip AS (SELECT {key}, min(pos) FILTER (WHERE score > 0.65) AS trip_at, count(*) AS tokens FROM x GROUP BY {key})
"""


#: The events' streams and their scores
CTE = f"""
s AS (
  SELECT user_id, event_id, event_type AS token, -value / 250 AS logprob, exp(-value / 250) AS p,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),{moments_sql()}"""


@query("ema_variance", f"WITH {CTE} SELECT user_id, event_id, pos, round(ema_mean, 6) AS ema_mean, round(ema_var, 6) AS ema_var FROM x")
def ema_variance(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumn("p", F.exp("logprob"))
    return U.ema(rows, KEYS).select("user_id", "event_id", "pos", r6("ema_mean"), r6("ema_var"))


@query("rolling_variance", f"WITH {CTE} SELECT user_id, event_id, round(window_var, 6) AS window_var FROM w")
def rolling_variance(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumn("p", F.exp("logprob"))
    return U.rolling(rows, KEYS).select("user_id", "event_id", r6("window_var"))


@query("uncertainty_score", f"WITH {CTE} SELECT user_id, event_id, weight, round(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END, 6) AS surprise, round(score_v1, 6) AS score_v1, round(score_v2, 6) AS score_v2, round(score, 6) AS score FROM x")
def uncertainty_score(spark, sf_dir):
    return scored(spark, sf_dir).select("user_id", "event_id", "weight", r6("surprise"), r6("score_v1"), r6("score_v2"), r6("score"))


@query("breaker_prefix", f"WITH {CTE} SELECT user_id, event_id, token, round(score, 6) AS score, round(ema_var, 6) AS ema_var, score > 0.65 AS tripped FROM x JOIN trip USING (user_id) WHERE trip_at IS NULL OR pos <= trip_at")
def breaker_prefix(spark, sf_dir):
    return U.cut_at_trip(scored(spark, sf_dir), KEYS).select("user_id", "event_id", "token", r6("score"), r6("ema_var"), "tripped")


@query("first_breach", f"WITH {CTE} SELECT t.user_id, trip_at IS NOT NULL AS tripped, coalesce(trip_at, -1) AS position, round(coalesce(score, 0), 6) AS score, round(coalesce(ema_var, 0), 6) AS variance, tokens FROM trip t LEFT JOIN x ON t.user_id = x.user_id AND x.pos = t.trip_at")
def first_breach(spark, sf_dir):
    return U.first_trip(scored(spark, sf_dir), KEYS).select("user_id", "tripped", F.col("position").cast("long").alias("position"), r6("score"), r6("variance"), "tokens")


@query("metrics_snapshot", f"WITH {CTE}, last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS back FROM x) SELECT user_id, 0.65::DOUBLE AS tau, 5 AS window_size, count(*)::INTEGER AS depth, format('{{:.4f}}', var_pop(p))::DOUBLE AS variance, list(format('{{:.4f}}', p)::DOUBLE ORDER BY pos) AS recent FROM last WHERE back <= 5 GROUP BY user_id")
def metrics_snapshot(spark, sf_dir):
    return U.snapshot(event_stream(spark, sf_dir).withColumn("p", F.exp("logprob")), KEYS)


TERMS = rf"list_filter(regexp_split_to_array(trim(query), ' +'), lambda t: length(t) > 3 AND NOT regexp_matches(t, '^[0-9]+$'))"


@query("recovery_package", f"""WITH {CTE}, q AS (SELECT x.*, 'user ' || user_id || ' asked about cycle time 2024' AS query, trip_at FROM x JOIN trip USING (user_id) WHERE trip_at IS NOT NULL AND pos <= trip_at),
  g AS (SELECT user_id, any_value(query) AS query, max(token) FILTER (WHERE pos = trip_at) AS halted_token, max(score) FILTER (WHERE pos = trip_at) AS score, max(ema_var) FILTER (WHERE pos = trip_at) AS var,
    coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (WHERE pos < trip_at), '') AS partial_context FROM q GROUP BY user_id)
  SELECT user_id, query, halted_token, format('{{:.4f}}', score)::DOUBLE AS uncertainty_score, format('{{:.4f}}', var)::DOUBLE AS rolling_variance, 0.65::DOUBLE AS tau_threshold, partial_context, {TERMS} AS suggested_query_terms,
    'SYSTEM: The previous generation was intercepted due to an intra-generation semantic entropy breach (Uncertainty=' || format('{{:.3f}}', score) || ' > tau=0.65, Variance=' || format('{{:.3f}}', var) || ').' || chr(10) || 'INTERCEPTED TOKEN: ''' || halted_token || '''' || chr(10) || 'ORIGINAL QUERY: ''' || query || '''' || chr(10) || 'VERIFIED PARTIAL CONTEXT: ''' || partial_context || '''' || chr(10) || 'DIRECTIVE: Execute vector similarity search for ''' || array_to_string({TERMS}, ' ') || ''', retrieve verified ground truth, and formulate the factual answer.' AS self_healing_prompt,
    'vector_rerank' AS fallback_strategy FROM g""")
def recovery_package(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("query", F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" asked about cycle time 2024")))
    return U.recovery(rows, KEYS)


TOKENS = "t AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS ts FROM conversations), k AS (SELECT conv_id, turn, unnest(range(len(ts))) AS pos, unnest(ts) AS token, ts FROM t)"


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)))
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("col").alias("token"))


@query("token_weight", f"WITH {TOKENS} SELECT conv_id, turn, pos, token, {weight_sql('token')} AS weight FROM k")
def token_weight(spark, sf_dir):
    return turn_tokens(spark, sf_dir).withColumn("weight", T.token_weight(F.col("token")))


@query("token_weight_hist", f"WITH k AS (SELECT lang, unnest(string_split(coalesce(text, ''), ' ')) AS token FROM documents) SELECT lang, {weight_sql('token')} AS weight, count(*) AS n FROM k GROUP BY ALL")
def token_weight_hist(spark, sf_dir):
    """Each different token of a language is weighed once."""
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("token"))
    tokens = rows.groupBy("lang", "token").agg(F.count("*").alias("n"))
    return tokens.groupBy("lang", T.token_weight(F.col("token")).alias("weight")).agg(F.sum("n").alias("n"))


def draft_sql() -> str:
    """n: the tokens of the turns with their estimated log-probability."""
    c = f"regexp_replace(token, '^{SPACE}+|{SPACE}+$', '', 'g')"
    near = f"CASE WHEN contains(array_to_string(list_transform(ts[1:pos], lambda z: lower(z)), chr(1)), lower({c})) AND pos > 0 THEN 0.95 ELSE 0.15 END::DOUBLE"
    risky = rf"(regexp_matches(c, '[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨$€£¥%]') OR (contains(c, '-') AND len(list_filter(string_split(c, '-'), lambda part: {upper('part')})) > 0))"
    return f"""{TOKENS}, c AS (SELECT *, {c} AS c, {near} AS near FROM k),
      n AS (SELECT conv_id, turn, pos, token, CASE WHEN c = '' THEN 0 WHEN {risky} AND near < 0.7 THEN ln(greatest(0.02::DOUBLE, near * 0.15::DOUBLE)) WHEN {risky} THEN ln(greatest(0.85::DOUBLE, near * 0.96::DOUBLE))
        WHEN lower(c) IN ({quoted(params.DRAFT_STOPWORDS)}) THEN -0.02 ELSE ln(greatest(0.2::DOUBLE, near * 0.9::DOUBLE)) END::DOUBLE AS logprob FROM c)"""


@query("draft_logprob", f"WITH {draft_sql()} SELECT conv_id, turn, pos, token, round(logprob, 6) AS logprob FROM n")
def draft_logprob(spark, sf_dir):
    rows = U.draft_estimates(turn_tokens(spark, sf_dir).withColumn("logprob", F.lit(None).cast("double")), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "pos", "token", r6("logprob"))


@query("draft_breaker", f"""WITH {draft_sql()}, s AS (SELECT *, exp(logprob) AS p FROM n),{moments_sql('conv_id, turn')}
  SELECT t.conv_id, t.turn, trip_at IS NOT NULL AS tripped, coalesce(trip_at, -1) AS position, round(coalesce(score, 0), 6) AS score, round(coalesce(ema_var, 0), 6) AS variance, tokens
  FROM trip t LEFT JOIN x ON t.conv_id = x.conv_id AND t.turn = x.turn AND x.pos = t.trip_at""")
def draft_breaker(spark, sf_dir):
    keys = ["conv_id", "turn"]
    rows = U.draft_estimates(turn_tokens(spark, sf_dir).withColumn("logprob", F.lit(None).cast("double")), keys)
    out = U.first_trip(U.score_streams(rows, keys), keys)
    return out.select(*keys, "tripped", "position", r6("score"), r6("variance"), "tokens")


@query("shannon_entropy", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY user_id")
def shannon_entropy(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    lists = counts.groupBy("user_id").agg(F.collect_list("count").alias("ns"))
    ps = F.transform("ns", lambda n: n / N.total(F.transform("ns", lambda m: m.cast("double"))))
    return lists.select("user_id", F.round(N.shannon_entropy(ps), 6).alias("entropy"))


@query("top_logprob_norm", "WITH t AS (SELECT user_id, event_type, exp(max(-value / 250)) AS e FROM events GROUP BY ALL) SELECT user_id, event_type, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS p FROM t")
def top_logprob_norm(spark, sf_dir):
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(-F.col("value") / 250).alias("lp"))
    maps = best.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "lp")))).alias("top"))
    ps = N.normalized_probabilities(F.col("top"), F.lit(None).cast("double"))
    rows = maps.select("user_id", F.explode(F.arrays_zip(F.map_keys("top").alias("event_type"), ps.alias("p"))).alias("x"))
    return rows.select("user_id", F.col("x.event_type").alias("event_type"), F.round("x.p", 6).alias("p"))


@query("logprob_variance", "SELECT user_id, round(var_pop(-value / 250), 6) AS variance FROM events GROUP BY user_id")
def logprob_variance(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.coalesce(F.var_pop(-F.col("value") / 250), F.lit(0.0)), 6).alias("variance"))


@query("pmi_penalty", "SELECT event_id, round(CASE WHEN event_type = 'click' THEN 0 ELSE greatest(0, -0.5 - (-value / 250)) END, 6)::DOUBLE AS pmi FROM events")
def pmi_penalty(spark, sf_dir):
    baseline = F.when(F.col("event_type") != "click", F.lit(-0.5))
    return table(spark, sf_dir, "events").select("event_id", F.round(N.pmi_penalty(-F.col("value") / 250, baseline), 6).alias("pmi"))


@query("payload_scores", f"""WITH {CTE}, y AS (SELECT *, CASE WHEN token <> 'click' THEN greatest(0, -0.5::DOUBLE - logprob) ELSE 0 END AS pmi, exp(-1.0::DOUBLE) AS o FROM x)
  SELECT user_id, event_id, round(((1 - p) + 2 * ema_var + 0.45::DOUBLE * pmi) * weight, 6) AS score, round(-(p / (p + o)) * log2(p / (p + o)) - (o / (p + o)) * log2(o / (p + o)), 6) AS entropy FROM y""")
def payload_scores(spark, sf_dir):
    rows = event_stream(spark, sf_dir)
    top = F.create_map(F.lit("own"), F.col("logprob"), F.lit("other"), F.lit(-1.0))
    fields = F.struct("token", "logprob", top.alias("top_logprobs"), F.when(F.col("token") != "click", F.lit(-0.5)).alias("unconditioned_logprob"))
    out = U.score_payloads(rows.withColumn("payload", F.to_json(fields)), KEYS)
    return out.join(rows.select("user_id", "pos", "event_id"), ["user_id", "pos"]).select("user_id", "event_id", r6("score"), r6("entropy"))


@query("calibrate_tau", f"WITH {CTE}, l AS (SELECT list(round(score, 6) ORDER BY round(score, 6)) AS xs, count(*) AS n FROM x) SELECT xs[least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) + 1] AS tau, n FROM l")
def calibrate_tau(spark, sf_dir):
    return E.calibrate(scored(spark, sf_dir).select(r6("score")))


RATE = "format('{{:.2f}}', coalesce(100.0::DOUBLE * ({a}) / nullif(({b}), 0), 0))::DOUBLE"


@query("confusion_matrix", f"""WITH c AS (SELECT quality AS grp, count(*) FILTER (toxic = 1 AND n > 2000) AS tp, count(*) FILTER (toxic = 0 AND n > 2000) AS fp, count(*) FILTER (toxic = 0 AND n <= 2000) AS tn, count(*) FILTER (toxic = 1 AND n <= 2000) AS fn
    FROM (SELECT quality, toxic, n_chars AS n FROM labels JOIN documents USING (doc_id)) GROUP BY quality)
  SELECT grp, tp, fp, tn, fn, {RATE.format(a='tp + tn', b='tp + fp + tn + fn')} AS accuracy, {RATE.format(a='tp', b='tp + fp')} AS precision, {RATE.format(a='tp', b='tp + fn')} AS recall, format('{{:.2f}}', coalesce(100.0::DOUBLE * 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0))::DOUBLE AS f1 FROM c""")
def confusion_matrix(spark, sf_dir):
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return E.confusion(met.withColumnRenamed("quality", "grp"), F.col("n_chars") > 2000, F.col("toxic") == 1, ["grp"])


@query("stream_ema_state", f"WITH {CTE} SELECT user_id, event_id, pos + 1 AS n, round(ema_mean, 6) AS ema_mean, round(ema_var, 6) AS ema_var FROM x")
def stream_ema_state(spark, sf_dir):
    """The events as a stream of files in any order. Rows may come as late as the table is long, so all of them are put in
    order; last rows, after all files have been read, close the stream week by week."""
    static = table(spark, sf_dir, "events")
    out, read = new_folder(spark), spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 64)
    stream = read.parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.exp(-F.col("value") / 250).alias("p"))
    first, last = static.agg(F.min("ts"), F.max("ts")).first()
    if last is None:
        first = last = datetime.datetime(2000, 1, 1)
    late, width = last - first + datetime.timedelta(seconds=1), datetime.timedelta(days=7)
    rows = monitor.ema_stream(monitor.with_end(stream, f"{out}/end"), "user_id", "ts", ["event_id"], late=f"{int(late.total_seconds())} seconds", bucket="7 days")
    monitor.run_to_end(rows, f"{out}/rows", f"{out}/state")
    monitor.end(stream, "ts", f"{out}/end", first + late, last + late + width, width)
    done = monitor.run_to_end(rows, f"{out}/rows", f"{out}/state").where("user_id IS NOT NULL")
    return done.select("user_id", "event_id", "n", r6("ema_mean"), r6("ema_var"))


@query("stream_session_windows", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, round(sum(value), 4) AS total FROM n GROUP BY user_id, k""")
def stream_session_windows(spark, sf_dir):
    static = table(spark, sf_dir, "events")
    read = lambda path: spark.readStream.schema(static.schema).parquet(path)
    out = new_folder(spark)
    # a last row, a day after all others, moves the watermark past every session; its own session stays open
    end = static.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    end.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in static.schema]).write.parquet(f"{out}/end")
    stream = read(f"{sf_dir}/events.parquet*").unionByName(read(f"{out}/end")).select("user_id", "ts", "value")
    done = monitor.run_to_end(monitor.sessions(stream, "user_id", "ts", "6 hours"), f"{out}/rows", f"{out}/state").where("user_id IS NOT NULL")
    return done.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", F.round("total", 4).alias("total"))
