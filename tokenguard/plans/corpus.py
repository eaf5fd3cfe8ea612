"""Queries over texts, chunks, retrieval, the firewall and served streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenguard import params
from tokenguard.functions import numeric as N
from tokenguard.functions import text as T
from tokenguard.operators import evaluation as E
from tokenguard.operators import events as V
from tokenguard.operators import firewall as W
from tokenguard.operators import retrieval as R
from tokenguard.operators import serving as S
from tokenguard.operators import uncertainty as U
from tokenguard.plans.registry import SQL, query, quoted, table
from tokenguard.plans.streams import SPACE, moments_sql
from tokenguard.sources import event_log
from tokenguard.sources.shared import materialize, new_folder
from tokenguard.streaming import monitor

EMAIL_SQL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
PHONE_SQL = rf"\+\p{{Nd}}{{1,3}}(?:-|{SPACE})?\p{{Nd}}{{4,5}}(?:-|{SPACE})?\p{{Nd}}{{4,5}}"


def redact_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{EMAIL_SQL}', '[REDACTED_EMAIL]', 'g'), '{PHONE_SQL}', '[REDACTED_PHONE]', 'g')"


# documents and pages with a phone number in the form that the rule knows
PHONES = "' call +91-98765-43210'"


@query("pii_redact", f"SELECT doc_id AS id, 'doc' AS kind, md5({redact_sql(f'text || {PHONES}')}) AS digest FROM documents UNION ALL SELECT page_id, 'page', md5({redact_sql(f'html || {PHONES}')}) FROM pages")
def pii_redact(spark, sf_dir):
    part = lambda name, key, text, kind: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(kind).alias("kind"), F.md5(T.redact_pii(F.concat(text, F.lit(" call +91-98765-43210")))).alias("digest"))
    docs = part("documents", "doc_id", "text", "doc")
    return docs.unionByName(part("pages", "page_id", "html", "page"))


@query("pii_leak_check", f"SELECT 'before' AS stage, count(*) FILTER (regexp_matches(text, '{EMAIL_SQL}') OR regexp_matches(text, '{PHONE_SQL}')) AS leaks, count(*) AS rows FROM documents UNION ALL SELECT 'after', 0, count(*) FROM documents")
def pii_leak_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    before = V.leak_count(docs).select(F.lit("before").alias("stage"), "leaks", "rows")
    return before.unionByName(V.leak_count(docs.select(T.redact_pii(F.col("text")).alias("text"))).select(F.lit("after").alias("stage"), "leaks", "rows"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of their customers, in order of their keys; the status stands for the activity."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    activity = F.when(F.col("o_orderstatus") == "F", V.COMPLIANCE).when(F.col("o_orderstatus") == "P", V.BOTTLENECK).otherwise("Invoice Approved")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.concat(F.lit("CASE-"), F.col("o_custkey").cast("string")).alias("case_id"), F.col("o_orderkey").alias("pos"), activity.alias("activity"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("c_name").alias("resource"), F.col("c_mktsegment").alias("department"), F.concat(F.lit("CC-"), F.col("c_nationkey").cast("string")).alias("cost_center"), F.col("o_totalprice").alias("amount_usd"),
        F.pmod("o_orderkey", F.lit(30)).cast("int").alias("cycle_time_days"), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit("mail "), F.col("c_name"), F.lit("@example.com, average {avg} days"))).alias("note"),
    )


EVENTS = """ev AS (SELECT 'CASE-' || o_custkey AS case_id, o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 'Compliance Review' WHEN 'P' THEN 'Supply Chain Bottleneck Flagged' ELSE 'Invoice Approved' END AS activity,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, c_name AS resource, c_mktsegment AS department, 'CC-' || c_nationkey AS cost_center, o_totalprice AS amount_usd, (o_orderkey % 30)::INTEGER AS cycle_time_days,
  CASE WHEN o_orderkey % 3 = 0 THEN 'mail ' || c_name || '@example.com, average {avg} days' END AS note FROM orders JOIN customer ON o_custkey = c_custkey),
cases AS (SELECT case_id, sum(cycle_time_days) FILTER (activity = 'Compliance Review') AS days, count(*) FILTER (activity = 'Compliance Review') AS reviews, arg_max(cycle_time_days, pos) AS last, bool_or(activity = 'Supply Chain Bottleneck Flagged') AS flagged FROM ev GROUP BY case_id),
m AS (SELECT format('{:.1f}', sum(days)::DOUBLE / sum(reviews))::DOUBLE AS a, format('{:.1f}', avg(last))::DOUBLE AS b, count(*) FILTER (flagged) AS c, count(*) AS d FROM cases)"""
CHUNK = redact_sql("""'Case ' || case_id || ': ' || activity || ' occurred on ' || timestamp || ' handled by ' || resource || ' (' || department || ', cost center ' || cost_center || '). Amount: $' || format('{:,.2f}', amount_usd) || '. Cycle time so far: ' || cycle_time_days || ' days.' || coalesce(' Note: ' || note, '')""")


@query("chunk_event", f"WITH {EVENTS} SELECT case_id, activity, {CHUNK} AS text FROM ev UNION ALL SELECT 'SUMMARY', 'aggregate_metrics', 'AGGREGATE GROUND TRUTH: Average compliance cycle time is ' || a || ' days. Average order-to-cash time is ' || b || ' days. ' || c || ' of ' || d || ' orders were flagged for a supply chain bottleneck.' FROM m")
def chunk_event(spark, sf_dir):
    return V.refuse_leaks(V.corpus(order_events(spark, sf_dir)))


@query("case_summary", f"WITH {EVENTS} SELECT a AS avg_compliance_cycle_time_days, b AS avg_order_to_cash_days, c AS orders_flagged_for_bottleneck, d AS total_orders, 'Ground Truth (Event Logs): Average Q3 compliance cycle time for vendor onboarding / compliance review is exactly ' || a || ' days across ' || d || ' processed orders. Orders over $100k take 12 days on average.' AS sentence FROM m")
def case_summary(spark, sf_dir):
    found = V.summary(order_events(spark, sf_dir))
    return found.withColumn("sentence", T.ground_truth_sentence(F.col("avg_compliance_cycle_time_days"), F.col("total_orders")))


@query("note_backfill", f"WITH {EVENTS} SELECT case_id, pos, CASE WHEN activity = 'Compliance Review' THEN replace(note, '{{avg}}', a::VARCHAR) ELSE note END AS note FROM ev, m")
def note_backfill(spark, sf_dir):
    rows = order_events(spark, sf_dir)
    return V.fill_average(rows, V.summary(rows)).select("case_id", "pos", "note")


@query("memory_documents", f"WITH {EVENTS} SELECT case_id, pos, {redact_sql('''concat('Activity: ', activity, ' | Cycle Time: ', cycle_time_days, ' days | Case: ', case_id, ' | Note: ', coalesce(note, ''))''')} AS text FROM ev")
def memory_documents(spark, sf_dir):
    return order_events(spark, sf_dir).select("case_id", "pos", T.memory_document(F.col("activity"), F.col("cycle_time_days"), F.col("case_id"), F.col("note")).alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("CASE-"), F.col("vec_id").cast("string")).alias("case_id"), F.col("label").cast("string").alias("activity"), F.concat(F.lit("vector of label "), F.col("label").cast("string")).alias("text"))
    return rows.where(F.pmod("vec_id", F.lit(20)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("query")), chunks


# rounded half to even on the exact value, as the similarity is before it is ranked
SIMILAR = """sim AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl, format('{:.4f}', list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))))::DOUBLE AS similarity
  FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM sim QUALIFY r <= 6),
fus AS (SELECT *, CASE WHEN ql = cl THEN 1 ELSE 0 END::DOUBLE AS cross_score, format('{:.4f}', 0.6::DOUBLE * CASE WHEN ql = cl THEN 1 ELSE 0 END + 0.4::DOUBLE * similarity)::DOUBLE AS fused FROM hits),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM fus QUALIFY rank <= 3)"""


@query("vector_topk", f"WITH {SIMILAR} SELECT query_id, chunk_id, r::INTEGER AS rank, similarity FROM hits")
def vector_topk(spark, sf_dir):
    queries, chunks = vectors(spark, sf_dir)
    return R.top_k(queries, chunks.select("chunk_id", "vector"), 6).select("query_id", "chunk_id", "rank", "similarity")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose reranker says 1 for the query's own label and 0 for others."""
    queries, chunks = vectors(spark, sf_dir)
    hits = R.top_k(queries, chunks, 6).join(queries.select("query_id", "query"), "query_id")
    same = F.concat(F.lit("label "), F.col("activity")) == F.col("query")
    return R.rerank(hits, 3, same.cast("double")).withColumn("score", F.col("fused"))


@query("fused_topk", f"WITH {SIMILAR} SELECT query_id, chunk_id, rank::INTEGER AS rank, similarity, cross_score, fused FROM best")
def fused_topk(spark, sf_dir):
    return reranked(spark, sf_dir).select("query_id", "chunk_id", "rank", "similarity", "cross_score", "fused")


@query("context_format", f"WITH {SIMILAR} SELECT query_id, max(fused) AS top_score, string_agg('- Chunk ' || rank || ' [CASE-' || chunk_id || ' | ' || cl || ' | Score: ' || fused || ']: vector of label ' || cl, chr(10) ORDER BY rank) AS context FROM best GROUP BY query_id")
def context_format(spark, sf_dir):
    return R.context(reranked(spark, sf_dir)).select("query_id", "top_score", "context")


@query("similarity_gate", f"WITH {SIMILAR} SELECT query_id, max(similarity) AS top_score, max(similarity) < 0.35 AS is_poison FROM sim WHERE query_id <> chunk_id GROUP BY query_id")
def similarity_gate(spark, sf_dir):
    queries, chunks = vectors(spark, sf_dir)
    hits = R.top_k(queries, chunks.select("chunk_id", "vector"), 2).where("query_id <> chunk_id")
    top = hits.groupBy("query_id").agg(F.max("similarity").alias("top_score"))
    return top.select("query_id", "top_score", W.verdict(F.lit(""), F.col("top_score"))["is_poison"].alias("is_poison"))


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+'), lambda w: w <> '')"


def coded_sql(source: str, text: str) -> str:
    """source with the words of its text and their counts by hash."""
    places = f"(SELECT *, {words_sql(text)} AS ws FROM {source})"
    return f"(SELECT *, list_transform(range(0, 64), lambda i: len(list_filter(list_transform(ws, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64), lambda p: p = i))::DOUBLE) AS vec FROM {places})"


def retrieval_sql(asked: str, chunks: str) -> str:
    """best: the three chunks of each row of asked (query_id, query), from chunks (case_id, activity, text)."""
    return f"""ids AS (SELECT DISTINCT ('0x' || substr(md5(text), 1, 15))::BIGINT AS chunk_id, case_id, activity, text FROM {chunks}),
coded_ids AS (SELECT * FROM {coded_sql('ids', 'text')}), coded_asked AS (SELECT * FROM {coded_sql(asked, 'query')}),
sims AS (SELECT q.query_id, q.query, q.ws AS qs, c.*, CASE WHEN len(q.ws) > 0 AND len(c.ws) > 0 THEN format('{{:.4f}}', list_dot_product(q.vec, c.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(c.vec, c.vec))))::DOUBLE END AS similarity FROM coded_asked q, coded_ids c),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, chunk_id) AS r FROM sims QUALIFY r <= 6),
crossed AS (SELECT *, CASE WHEN len(qs) > 0 THEN len(list_intersect(list_distinct(qs), list_distinct(ws)))::DOUBLE / len(list_distinct(qs)) ELSE 0 END::DOUBLE AS cross_raw FROM hits),
scored AS (SELECT *, format('{{:.4f}}', cross_raw)::DOUBLE AS cross_score, CASE WHEN similarity IS NOT NULL THEN format('{{:.4f}}', 0.6::DOUBLE * cross_raw + 0.4::DOUBLE * similarity)::DOUBLE END AS score FROM crossed),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id)::INTEGER AS rank FROM scored QUALIFY rank <= 3)"""


def coded(chunks: DataFrame) -> DataFrame:
    """Chunks by the digest of their text, with the stand-in encoder's vectors. They are written once: a search reads them in
    each of its rounds, and again for the texts it has found."""
    known = chunks.withColumn("chunk_id", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")).dropDuplicates(["chunk_id"])
    return materialize(known.withColumn("vector", R.hashing_encoder(F.col("text"))))


@query("retrieve_text", f"""WITH {EVENTS}, asked AS (SELECT conv_id || '-' || turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
  texts AS (SELECT case_id, activity, {CHUNK} AS text FROM ev), {retrieval_sql('asked', 'texts')} SELECT query_id, rank, chunk_id, case_id, activity, text, cross_score, score FROM best""")
def retrieve_text(spark, sf_dir):
    """Retrieval over event chunks with the stand-in encoder and reranker, for the user turns of conversations."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"), R.hashing_encoder(F.col("text")).alias("vector"))
    return R.retrieve(asked, coded(V.chunks(order_events(spark, sf_dir))))


USER = "u AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')"
WORDS = [*params.POISON_KEYWORDS, "license", "token", "the"]
FOUND = f"list_filter([{quoted(WORDS)}], lambda k: contains(lower(text), k))[1]"
SPLIT = rf"list_filter(regexp_split_to_array(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+'), lambda w: w <> '')"


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


@query("poison_keywords", f"WITH {USER} SELECT conv_id, turn, {FOUND} AS keyword, len(list_filter([{quoted(params.FALLBACK_KEYWORDS)}], lambda k: contains(lower(text), k))) > 0 AS fallback FROM u")
def poison_keywords(spark, sf_dir):
    return user_turns(spark, sf_dir).select("conv_id", "turn", T.first_keyword(F.col("text"), WORDS).alias("keyword"), T.has_keyword(F.col("text")).alias("fallback"))


@query("firewall_status", f"""WITH {USER}, s AS (SELECT *, (conv_id * 7 + turn) % 100 / 100.0::DOUBLE AS top, {FOUND} AS k FROM u)
  SELECT conv_id, turn, CASE WHEN k IS NOT NULL OR top < 0.35 THEN 'POISON_DETECTED' ELSE 'GROUNDED' END AS status, (k IS NOT NULL OR top < 0.35) AS is_poison,
    CASE WHEN k IS NOT NULL THEN 'Explicit out-of-scope / poison keyword detected: ''' || k || '''.' WHEN top < 0.35 THEN 'Top retrieval similarity score (' || format('{{:.4f}}', top) || ') below safety threshold (0.35). Context gap detected - risk of stochastic hallucination.' ELSE 'Ground truth verified in vector store.' END AS reason,
    CASE WHEN k IS NULL AND top >= 0.35 THEN 'ctx ' || conv_id END AS context FROM s""")
def firewall_status(spark, sf_dir):
    turns = user_turns(spark, sf_dir).withColumn("query_id", F.struct("conv_id", "turn"))
    contexts = turns.select("query_id", F.concat(F.lit("ctx "), F.col("conv_id").cast("string")).alias("context"), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(100)) / 100.0).alias("top_score"))
    out = W.screen(turns.select("query_id", F.col("text").alias("query")), contexts, WORDS)
    return out.select("query_id.conv_id", "query_id.turn", "status", "is_poison", "reason", "context")


@query("greeting_router", f"WITH {USER}, g AS (SELECT conv_id, turn, text FROM u UNION ALL SELECT -1, turn, ' Hello there ' FROM u WHERE turn <= 1) SELECT conv_id, turn, lower(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) IN ({quoted(params.GREETINGS)}) AS greeting FROM g")
def greeting_router(spark, sf_dir):
    turns = user_turns(spark, sf_dir)
    more = turns.where("turn <= 1").select(F.lit(-1).cast("long").alias("conv_id"), "turn", F.lit(" Hello there ").alias("text"))
    return turns.unionByName(more).select("conv_id", "turn", T.is_greeting(F.col("text")).alias("greeting"))


@query("salient_terms", f"WITH {USER}, s AS (SELECT conv_id, turn, array_to_string(list_filter({SPLIT}, lambda w: lower(w) NOT IN ({quoted(params.RECOVERY_STOPWORDS)})), ' ') AS t FROM u) SELECT conv_id, turn, CASE WHEN t = '' THEN '{params.DEFAULT_TERMS}' ELSE t END AS terms FROM s")
def salient_terms(spark, sf_dir):
    return user_turns(spark, sf_dir).select("conv_id", "turn", T.salient_terms(F.col("text")).alias("terms"))


@query("suggested_terms", rf"WITH {USER} SELECT conv_id, turn, list_filter({SPLIT}, lambda w: length(w) > 3 AND NOT regexp_matches(w, '^[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]+$')) AS terms FROM u")
def suggested_terms(spark, sf_dir):
    return user_turns(spark, sf_dir).select("conv_id", "turn", T.suggested_terms(F.col("text")).alias("terms"))


@query("suite_rates", """WITH r AS (SELECT conv_id % 3 = 0 AS bad, conv_id % 6 = 0 OR conv_id % 7 = 0 AS caught, (turn * 12.5)::DOUBLE AS ms FROM conversations),
  n AS (SELECT count(*) FILTER (bad AND caught) AS intercepted, count(*) FILTER (bad) AS poison_total, count(*) FILTER (NOT bad AND NOT caught) AS verified, count(*) FILTER (NOT bad) AS grounded_total, format('{:.2f}', avg(ms))::DOUBLE AS mean_latency_ms FROM r),
  q AS (SELECT *, format('{:.2f}', coalesce(100.0::DOUBLE * intercepted / nullif(poison_total, 0), 0))::DOUBLE AS interception_rate, format('{:.2f}', coalesce(100.0::DOUBLE * verified / nullif(grounded_total, 0), 0))::DOUBLE AS verification_rate FROM n)
  SELECT *, CASE WHEN interception_rate = 100 AND verification_rate = 100 THEN '100% RELIABLE' ELSE 'NEEDS CALIBRATION' END AS reliability, CASE WHEN interception_rate = 100 AND verification_rate = 100 THEN 'READY (100% ACCURACY)' ELSE 'CALIBRATION REQUIRED' END AS verdict FROM q""")
def suite_rates(spark, sf_dir):
    c = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(F.when(c % 3 == 0, "intercepted").otherwise("grounded").alias("expected"), ((c % 6 == 0) | (c % 7 == 0)).alias("is_poison"), (F.col("turn") * 12.5).alias("latency_ms"))
    return E.suite_report(rows)


SSE = "e AS (SELECT conv_id, turn, unnest(range(len(string_split(coalesce(text, ''), ' ')))) AS seq, 'data: ' || unnest(string_split(coalesce(text, ''), ' ')) || ' ' || chr(10) || chr(10) AS payload FROM conversations)"
PARSED = rf"p AS (SELECT conv_id, turn, seq, regexp_replace(substr(payload, 7), '^{SPACE}+|{SPACE}+$', '', 'g') AS token FROM e), stop AS (SELECT *, bool_or(starts_with(token, '[INTERCEPTION')) OVER (PARTITION BY conv_id, turn ORDER BY seq) AS halted FROM p), y AS (SELECT conv_id, turn, seq, token FROM stop WHERE NOT halted AND NOT starts_with(token, '['))"


def sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.encode_events(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query("sse_encode", f"WITH {SSE} SELECT conv_id, turn, seq::INTEGER AS seq, payload FROM e")
def sse_encode(spark, sf_dir):
    return sse(spark, sf_dir)


@query("sse_parse_py", f"WITH {SSE}, {PARSED} SELECT conv_id, turn, seq::INTEGER AS seq, token FROM y")
def sse_parse_py(spark, sf_dir):
    return S.parse_stripped(sse(spark, sf_dir), ["conv_id", "turn"])


@query("sse_parse_ts", f"WITH {SSE}, {PARSED} SELECT conv_id, turn, seq::INTEGER AS seq, token FROM y WHERE token <> ''")
def sse_parse_ts(spark, sf_dir):
    return S.parse_words(sse(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "seq", "token")


@query("tokens_saved", """WITH n AS (SELECT conv_id, turn, len(string_split(coalesce(text, ''), ' ')) AS unprotected, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: length(w) > 3)) AS protected FROM conversations)
  SELECT conv_id, turn, unprotected, protected, greatest(0, unprotected - protected) AS saved, format('{:.1f}', 100.0::DOUBLE * greatest(0, unprotected - protected) / unprotected)::DOUBLE AS saved_percent, floor(100.0::DOUBLE * greatest(0, unprotected - protected) / unprotected + 0.5)::INTEGER AS saved_percent_whole FROM n""")
def tokens_saved(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(S.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    return S.savings(words, words.where(F.length("w") > 3), ["conv_id", "turn"])


@query("stream_align", """WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type <> 'click'), b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type = 'click'),
  m AS (SELECT user_id, pos, a.value AS l, b.value AS r FROM a FULL JOIN b USING (user_id, pos))
  SELECT user_id, pos::INTEGER AS pos, last_value(l IGNORE NULLS) OVER w AS left_value, last_value(r IGNORE NULLS) OVER w AS right_value FROM m WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def stream_align(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    part = lambda keep: U.with_position(rows.where(keep), ["user_id"], ["ts", "event_id"]).select("user_id", (F.col("pos") + 1).cast("int").alias("pos"), "value")
    return S.align(part("event_type <> 'click'"), part("event_type = 'click'"), ["user_id"])


GRAPHS = f"g AS (SELECT * FROM (VALUES {', '.join('(' + quoted(list(g[:3])) + f', {g[3]}, {str(g[4]).lower()}, ' + quoted(list(g[5:])) + ')' for g in params.PROCESS_GRAPHS)}) t(graph, name, collection, vector_count, pii_masked, cycle_time, sla_compliance))"
KEY = "CASE user_id % 5 WHEN 0 THEN 'p2p' WHEN 1 THEN 'o2c' WHEN 2 THEN 'ap_audit' WHEN 3 THEN 'nowhere' END"


@query("graph_lookup_default", f"WITH {GRAPHS}, e AS (SELECT event_id, {KEY} AS graph FROM events) SELECT event_id, e.graph, name, cycle_time, sla_compliance FROM e JOIN g ON g.graph = CASE WHEN e.graph IN ('p2p', 'o2c', 'ap_audit', 'supply_chain') THEN e.graph ELSE 'p2p' END")
def graph_lookup_default(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(KEY.replace("user_id % 5", "cast(user_id % 5 AS int)")).alias("graph"))
    return S.with_graph(rows).select("event_id", "graph", "name", "cycle_time", "sla_compliance")


@query("process_graphs", f"WITH {GRAPHS} SELECT * FROM g")
def process_graphs(spark, sf_dir):
    return S.process_graphs(spark)


def sessions(turns: DataFrame) -> DataFrame:
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("session"), F.col("text").alias("query"), F.lit("o2c").alias("graph"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_poison"), F.when(F.pmod("conv_id", F.lit(3)) == 0, F.lit("Case closed in time.")).alias("top_chunk"))


GRAPH = {g[0]: g for g in params.PROCESS_GRAPHS}["o2c"]
SESSIONS = f"{USER}, q AS (SELECT conv_id || '-' || turn AS session, text AS query, conv_id % 2 = 0 AS poison, CASE WHEN conv_id % 3 = 0 THEN 'Case closed in time.' END AS chunk FROM u)"
CALM = f"' event logs, query analysis for ''' || query || ''' confirms a mean cycle time of {GRAPH[5]} with {GRAPH[6]} SLA compliance.'"


@query("protected_stream", rf"""WITH {SESSIONS}, g AS (SELECT *, regexp_replace(lower(query), '^{SPACE}+|{SPACE}+$', '', 'g') IN ({quoted(params.GREETINGS)}) AS greeting FROM q),
  spoken AS (SELECT session, query, poison, list_concat(string_split(CASE WHEN poison THEN 'Analyzing {GRAPH[1]} via vector search... Query: ''' || query || '''. Attempting to extract unverified parameters: Vendor contract override values indicate '
    WHEN chunk IS NOT NULL THEN 'According to verified {GRAPH[1]} ground truth: ' || chunk ELSE 'According to verified {GRAPH[1]}' || {CALM} END, ' '), CASE WHEN poison THEN ['{params.HALTED_TOKEN}'] ELSE []::VARCHAR[] END) AS ts FROM g WHERE NOT greeting),
  t AS (SELECT session, query, poison, len(ts) AS n, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM spoken),
  s AS (SELECT session, query, token, pos, exp(CASE WHEN NOT poison THEN -0.05 WHEN pos = n - 1 THEN -2.85 ELSE -0.1 END::DOUBLE) AS p FROM t),{moments_sql('session')},
  cut AS (SELECT x.*, trip_at FROM x JOIN trip USING (session) WHERE trip_at IS NULL OR pos <= trip_at),
  at_trip AS (SELECT session, any_value(query) AS query, max(token) FILTER (pos = trip_at) AS token, max(score) FILTER (pos = trip_at) AS score, max(ema_var) FILTER (pos = trip_at) AS var, max(trip_at) AS place,
    coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (pos < trip_at), '') AS before FROM cut WHERE trip_at IS NOT NULL GROUP BY session),
  terms AS (SELECT *, list_filter({SPLIT.replace('text', 'query')}, lambda w: length(w) > 3 AND NOT regexp_matches(w, '^[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]+$')) AS terms FROM at_trip),
  package AS (SELECT *, to_json({{'query': query, 'halted_token': token, 'uncertainty_score': format('{{:.4f}}', score)::DOUBLE, 'rolling_variance': format('{{:.4f}}', var)::DOUBLE, 'tau_threshold': 0.65::DOUBLE, 'partial_context': before, 'suggested_query_terms': terms,
    'self_healing_prompt': 'SYSTEM: The previous generation was intercepted due to an intra-generation semantic entropy breach (Uncertainty=' || format('{{:.3f}}', score) || ' > tau=0.65, Variance=' || format('{{:.3f}}', var) || ').' || chr(10) || 'INTERCEPTED TOKEN: ''' || token || '''' || chr(10) || 'ORIGINAL QUERY: ''' || query || '''' || chr(10) || 'VERIFIED PARTIAL CONTEXT: ''' || before || '''' || chr(10) || 'DIRECTIVE: Execute vector similarity search for ''' || array_to_string(terms, ' ') || ''', retrieve verified ground truth, and formulate the factual answer.',
    'fallback_strategy': 'vector_rerank'}})::VARCHAR AS j FROM terms),
  said AS (SELECT session, 0 AS seq, '{params.GATEWAY_STATUS} ' AS text, NULL::DOUBLE AS uncertainty FROM g WHERE greeting UNION ALL SELECT session, 1, '{S.STATUS_END}', NULL FROM g WHERE greeting
    UNION ALL SELECT session, pos, token || ' ', NULL FROM cut WHERE trip_at IS NULL OR pos < trip_at UNION ALL SELECT session, max(pos) + 1, '{S.GROUNDED_END}', NULL FROM cut WHERE trip_at IS NULL GROUP BY session
    UNION ALL SELECT session, place, '[INTERCEPTION: SEMANTIC ENTROPY (' || format('{{:.2f}}', score) || ') > τ (0.65). ABORTING HALLUCINATED TOKEN GENERATION.]', NULL FROM package
    UNION ALL SELECT session, place + 1, '[FALLBACK_SIGNAL: {{"event":"fallback_triggered","reason":"semantic_entropy_spike","token":"' || token || '","uncertainty":}}]', round(score, 6) FROM package
    UNION ALL SELECT session, place + 2, '[SELF_HEALING_CONTEXT: ' || j || ']', NULL FROM package)
  SELECT session, seq::BIGINT AS seq, 'data: ' || text || chr(10) || chr(10) AS payload, uncertainty FROM said""")
def protected_stream(spark, sf_dir):
    return with_uncertainty(S.protected_stream(sessions(user_turns(spark, sf_dir))))


def with_uncertainty(events: DataFrame) -> DataFrame:
    """The number in the fallback signal, which has all its digits, is set apart and rounded."""
    number = r'(?<="uncertainty":)[-0-9.E]+(?=\}\]\n\n$)'
    return events.select("session", "seq", F.regexp_replace("payload", number, "").alias("payload"), F.round(F.nullif(F.regexp_extract("payload", number, 0), F.lit("")).cast("double"), 6).alias("uncertainty"))


@query("stream_protected", SQL["protected_stream"])
def stream_protected(spark, sf_dir):
    """The same sessions served continuously: the turns as a stream of files, tokens cut as they arrive."""
    schema, out = table(spark, sf_dir, "conversations").schema, new_folder(spark)
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/conversations.parquet*").where("role = 'user'").select("conv_id", "turn", "text")
    return with_uncertainty(monitor.run_to_end(monitor.protected_events(sessions(turns)), f"{out}/rows", f"{out}/state", by_clock=True))


FALLBACK = f"len(list_filter([{quoted(params.FALLBACK_KEYWORDS)}], lambda k: contains(lower(query), k))) > 0"


@query("unprotected_stream", f"""WITH {SESSIONS}, said AS (SELECT session, {FALLBACK} AS found, CASE WHEN query = '' THEN 'the exact Q3 compliance cycle time for vendor onboarding' ELSE query END AS query FROM q),
  t AS (SELECT session, list_append(list_transform(string_split(CASE WHEN found THEN 'Analyzing {GRAPH[1]}... Accessing Q4 draft projections: Vendor contract override values indicate $42.8M projected margin expansion for unannounced vendor contracts, with 18.4% off-contract discount approvals applied automatically without Senior Compliance Officer sign-off. Expected execution cycle time: 1.2 days.'
    ELSE 'According to' || {CALM} END, ' '), lambda w: w || ' '), CASE WHEN found THEN '{S.UNPROTECTED_END}' ELSE '{S.GROUNDED_END}' END) AS ts FROM said)
  SELECT session, unnest(range(len(ts))) AS seq, 'data: ' || unnest(ts) || chr(10) || chr(10) AS payload FROM t""")
def unprotected_stream(spark, sf_dir):
    return S.unprotected_stream(sessions(user_turns(spark, sf_dir)))


@query("recover_answers", f"WITH {SIMILAR} SELECT b.query_id, 'RECOVERED_SUCCESSFULLY' AS status, 'label ' || ql AS search_query, 'vector_rerank_dense_o2c' AS repair_strategy, 'vector of label ' || cl AS verified_ground_truth, 'CASE-' || chunk_id AS case_id, fused AS vector_score FROM best b WHERE rank = 1")
def recover_answers(spark, sf_dir):
    queries, _ = vectors(spark, sf_dir)
    return S.recovered(queries.select("query_id", "query", F.lit("o2c").alias("graph")), reranked(spark, sf_dir))


@query("payload_parse", "WITH s AS (SELECT event_id, exp(-value / 250) AS a, exp(-1.0::DOUBLE) AS b FROM events) SELECT event_id, round(a / (a + b), 6) AS p1, round(b / (a + b), 6) AS p2, round(ln(a), 6) AS logprob FROM s")
def payload_parse(spark, sf_dir):
    lp = -F.col("value") / 250
    raw = F.to_json(F.struct(F.col("event_type").alias("token"), lp.alias("logprob"), F.create_map(F.lit("a"), lp, F.lit("b"), F.lit(-1.0)).alias("top_logprobs")))
    rows = table(spark, sf_dir, "events").select("event_id", event_log.payload(raw).alias("x"))
    return rows.select("event_id", F.round(F.col("x.probabilities")[0], 6).alias("p1"), F.round(F.col("x.probabilities")[1], 6).alias("p2"), F.round("x.logprob", 6).alias("logprob"))


@query("ui_keywords", f"WITH {USER} SELECT conv_id, turn, len(list_filter([{quoted(params.UI_KEYWORDS)}], lambda k: contains(lower(text), k))) > 0 AS found, url_encode(text) AS encoded FROM u")
def ui_keywords(spark, sf_dir):
    text = F.col("text")
    return user_turns(spark, sf_dir).select("conv_id", "turn", T.has_keyword(text, params.UI_KEYWORDS).alias("found"), T.url_encoded(text).alias("encoded"))


@query("clean_documents", f"SELECT source, count(*) AS n FROM documents WHERE NOT (regexp_matches(text, '{EMAIL_SQL}') OR regexp_matches(text, '{PHONE_SQL}')) GROUP BY source")
def clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(~T.leaks_pii(F.col("text"))).groupBy("source").agg(F.count("*").alias("n"))


PROMPTS = [  # id, prompt, expected
    ("P-1", "Accessing Q4 draft projections with an override", "intercepted"), ("P-2", "What was the delay at node W-99?", "intercepted"), ("P-3", "What is the unapproved executive discount?", "intercepted"),
    ("P-4", "Provide the certificate for GlobalTech in cost center CC-9999.", "intercepted"), ("G-1", "Compliance Review occurred on which day, handled by whom?", "grounded"), ("G-2", "Weather on the moon", "grounded"), ("G-3", " ", "grounded"),
]
SUITE = f"suite AS (SELECT * FROM (VALUES {', '.join('(' + quoted(list(p)) + ')' for p in PROMPTS)}) t(query_id, query, expected))"
SUMMARY = "SELECT 'SUMMARY' AS case_id, 'aggregate_metrics' AS activity, 'AGGREGATE GROUND TRUTH: Average compliance cycle time is ' || a || ' days. Average order-to-cash time is ' || b || ' days. ' || c || ' of ' || d || ' orders were flagged for a supply chain bottleneck.' AS text FROM m"


@query("firewall_suite", f"""WITH {EVENTS}, {SUITE}, texts AS (SELECT case_id, activity, {CHUNK} AS text FROM ev UNION ALL {SUMMARY}), {retrieval_sql('suite', 'texts')},
  met AS (SELECT query_id, max(score) AS top, string_agg('- Chunk ' || rank || ' [' || case_id || ' | ' || activity || ' | Score: ' || score || ']: ' || text, chr(10) ORDER BY rank) AS context, substr(max(text) FILTER (rank = 1), 1, 120) AS snippet, max(score) FILTER (rank = 1) AS top_score FROM best GROUP BY query_id),
  v AS (SELECT *, list_filter([{quoted(params.POISON_KEYWORDS)}], lambda k: contains(lower(query), k))[1] AS k FROM suite LEFT JOIN met USING (query_id)),
  j AS (SELECT *, k IS NOT NULL OR top IS NULL OR top < 0.35 AS is_poison FROM v)
  SELECT query_id, query, CASE WHEN is_poison THEN 'POISON_DETECTED' ELSE 'GROUNDED' END AS status, is_poison, expected, top_score, snippet, is_poison = (expected = 'intercepted') AS passed, CASE WHEN NOT is_poison THEN context END AS context,
    CASE WHEN is_poison THEN '{W.SIGNAL}' END AS interception_signal,
    CASE WHEN k IS NOT NULL THEN 'Explicit out-of-scope / poison keyword detected: ''' || k || '''.' WHEN top IS NULL THEN 'Zero ground-truth chunks retrieved from vector store.'
      WHEN top < 0.35 THEN 'Top retrieval similarity score (' || format('{{:.4f}}', top) || ') below safety threshold (0.35). Context gap detected - risk of stochastic hallucination.' ELSE 'Ground truth verified in vector store.' END AS reason FROM j""")
def firewall_suite(spark, sf_dir):
    """A literal suite of prompts against the event chunks, with the stand-in encoder and reranker."""
    suite = spark.createDataFrame(PROMPTS, "id string, prompt string, expected string")
    return W.run_suite(suite, coded(V.corpus(order_events(spark, sf_dir))), R.hashing_encoder)[0]


def synthetic_sql(cases: int = 150, seed: int = 42) -> str:
    draw = lambda k, n: f"(('0x' || substr(md5(case_no || ':{seed}:{k}'), 1, 12))::BIGINT % {n})"
    people = ", ".join(f"{{'name': '{n}', 'department': '{d}'}}" for n, d in event_log.PEOPLE)
    person = lambda k: f"people[(first + {k}) % 8 + 1]"
    mail = lambda x: f"replace(lower({x}), ' ', '.') || '@example.com'"
    days = ["d1", "d1 + d2", "d1 + CASE WHEN review THEN d2 ELSE 0 END + d3", "d1 + CASE WHEN review THEN d2 ELSE 0 END + CASE WHEN flagged THEN d3 ELSE 0 END + d4"]
    who = [person(0), person(3), person(5), f"coalesce(list_filter([{person(0)}, {person(3)}, {person(5)}], lambda x: x.department = '{event_log.APPROVERS}')[1], people[3])"]
    notes = ["NULL", "'Average compliance cycle time is {avg} days.'", f"'Held for ' || d3 || ' days, contact ' || {mail('(' + person(5) + ').name')} || ' or +91-98765-43210'", "NULL"]
    names, made = ["Purchase Order Created", V.COMPLIANCE, V.BOTTLENECK, "Invoice Approved"], ["true", "review", "flagged", "true"]
    step = lambda i: f"""SELECT 'CASE-' || case_no AS case_id, center AS cost_center, amount AS amount_usd, {i} AS pos, '{names[i]}' AS activity,
      strftime(TIMESTAMP '2026-01-01 06:00:00' + to_days({draw(20 + i, 200)}::INTEGER) + to_minutes({draw(30 + i, 720)}), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, ({who[i]}).name AS resource, {mail(f'({who[i]}).name')} AS resource_email,
      '+91-98765-43210' AS resource_phone, ({who[i]}).department AS department, ({days[i]})::INTEGER AS cycle_time_days, {notes[i]}::VARCHAR AS note FROM c WHERE {made[i]}"""  # noqa: E731
    return f"""WITH r AS (SELECT range AS case_no FROM range(10001, {10001 + cases})),
  c AS (SELECT case_no, (800000 + {draw(1, 44200001)}) / 100.0::DOUBLE AS amount, amount > 100000 AS review, 1 + {draw(2, 4)} AS d1, 3 + {draw(3, 10)} AS d2, 2 + {draw(4, 5)} AS d3, 1 + {draw(5, 3)} AS d4, {draw(6, 4)} = 0 AS flagged,
    [{quoted(event_log.COST_CENTERS)}][{draw(7, 5)} + 1] AS center, {draw(8, 8)} AS first, [{people}] AS people FROM r)
  {' UNION ALL '.join(step(i) for i in range(4))}"""


@query("synth_event_log", synthetic_sql())
def synth_event_log(spark, sf_dir):
    return event_log.synthetic_events(spark)
