"""Served streams, the firewall, sources and sinks."""

import json

from pyspark.errors import PySparkException
from pyspark.sql import functions as F
import pytest

from tokenguard import params
from tokenguard.functions import text as T
from tokenguard.operators import events as V
from tokenguard.operators import firewall as W
from tokenguard.operators import retrieval as R
from tokenguard.operators import serving as S
from tokenguard.sources import event_log


def lines(df, session):
    return [r["payload"] for r in df.where(F.col("session") == session).orderBy("seq").collect()]


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [("hi", " Hello ", "p2p", False, None), ("bad", "this is a poison prompt for q4", "p2p", True, None), ("good", "when?", "o2c", False, "Case 1 took five days."), ("none", None, "?", False, None)]
    return spark.createDataFrame(rows, "session string, query string, graph string, is_poison boolean, top_chunk string")


def test_protected(sessions):
    out = S.protected_stream(sessions).cache()
    hi = "".join(lines(out, "hi"))
    assert "Security Gateway Active" in hi and "[COMPLETED: SYSTEM_STATUS]" in hi and "INTERCEPTION" not in hi
    bad = lines(out, "bad")
    assert bad[-3].startswith("data: [INTERCEPTION: SEMANTIC ENTROPY (4.44) > τ (0.65)") and "[FALLBACK_SIGNAL:" in bad[-2]
    package = json.loads(bad[-1][len("data: [SELF_HEALING_CONTEXT: ") : -3])
    assert package["halted_token"] == params.HALTED_TOKEN and package["uncertainty_score"] == pytest.approx(4.44, abs=1e-3)
    assert bad[-4] == "data:  \n\n"  # the preamble ends in a space: its last token is empty
    good = lines(out, "good")
    assert good[-1] == f"data: {S.GROUNDED_END}\n\n" and "five" in "".join(good)
    assert "4.5 business" in " ".join(x[6:].strip() for x in lines(out, "none"))


def test_unprotected_and_parse(sessions):
    out = S.unprotected_stream(sessions)
    assert S.UNPROTECTED_END in lines(out, "bad")[-1] and S.GROUNDED_END in lines(out, "good")[-1]
    tokens = S.parse_stripped(S.protected_stream(sessions), ["session"]).where("session = 'bad'")
    assert tokens.where("token LIKE '[%'").count() == 0 and tokens.where("token = ''").count() == 1
    assert S.parse_words(S.protected_stream(sessions), ["session"]).where("token = ''").count() == 0


def test_firewall_order(spark):
    rows = spark.createDataFrame([("a", "Q4 override", 0.9), ("b", "fine", None), ("c", "fine", 0.1), ("d", "hackathon", 0.9), ("e", None, 0.9)], "query_id string, q string, s double")
    got = {r["query_id"]: r["v"] for r in rows.select("query_id", W.verdict(F.col("q"), F.col("s")).alias("v")).collect()}
    assert "'q4'" in got["a"]["reason"] and "Zero" in got["b"]["reason"] and "(0.1000)" in got["c"]["reason"] and "'hack'" in got["d"]["reason"]
    assert [got[k]["is_poison"] for k in "abcde"] == [True, True, True, True, False]


def test_redaction(spark):
    text = "ñandú@acmé.com and +91-98765-43210, 2026-01-01T00:00:00Z, +1 (555) 555-1234"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(T.redact_pii(F.col("t")).alias("t")).collect()
    assert got[0]["t"] == "[REDACTED_EMAIL] and [REDACTED_PHONE], 2026-01-01T00:00:00Z, +1 (555) 555-1234" and got[1]["t"] is None
    with pytest.raises(PySparkException):
        V.refuse_leaks(spark.createDataFrame([(text,)], "text string")).collect()


def test_event_log(spark, tmp_path):
    made = event_log.synthetic_events(spark, 400).cache()
    by = {r["activity"]: r["n"] for r in made.groupBy("activity").agg(F.count("*").alias("n")).collect()}
    assert by["Invoice Approved"] == by["Purchase Order Created"] == 400 and 50 < by[V.BOTTLENECK] < 160
    assert made.where((F.col("activity") == V.COMPLIANCE) & (F.col("amount_usd") <= 100000)).count() == 0
    metrics = V.summary(made)
    m = metrics.first()
    assert m["total_orders"] == 400 and m["orders_flagged_for_bottleneck"] == by[V.BOTTLENECK]
    filled = V.fill_average(made, metrics)
    assert filled.where("note LIKE '%{avg}%'").count() == 0
    chunks = V.corpus(filled)
    assert chunks.count() == made.count() + 1 and V.leak_count(chunks).first()["leaks"] == 0
    path = str(tmp_path / "log.json")
    event = made.limit(3).drop("pos").toPandas().to_dict("records")
    with open(path, "w") as f:
        json.dump({"process": "x", "events": event}, f)
    log = event_log.read_json(spark, path, event_log.LOG)
    assert event_log.events(log).count() == 3 and event_log.metrics(log).count() == 0
    assert event_log.read_json(spark, str(tmp_path / "no.json"), event_log.LOG).count() == 0
    with pytest.raises(PySparkException):
        event_log.read_json(spark, str(tmp_path / "no.json"), event_log.SUITE, missing_ok=False)


def test_collection_and_retrieval(spark, tmp_path):
    chunks = V.chunks(event_log.synthetic_events(spark, 20)).withColumn("chunk_id", F.monotonically_increasing_id()).withColumn("vector", R.hashing_encoder(F.col("text"), 32))
    path = str(tmp_path / "vectors")
    assert not event_log.has_collection(spark, path)
    assert event_log.write_collection(chunks, path, 32) == event_log.write_collection(chunks, path, 32) == chunks.count()
    assert event_log.has_collection(spark, path) and tuple(event_log.describe_collection(spark, path).first()) == (32, "COSINE", chunks.count())
    stored = event_log.open_collection(spark, path, chunks.limit(0))
    assert stored.count() == chunks.count() and event_log.open_collection(spark, str(tmp_path / "none"), chunks.limit(0)).count() == 0
    with pytest.raises(PySparkException):
        event_log.write_collection(chunks, str(tmp_path / "bad"), 16)
    event_log.drop_collection(spark, path)
    assert not event_log.has_collection(spark, path)
    event_log.write_collection(chunks, path, 32)
    stored = event_log.open_collection(spark, path, chunks.limit(0))
    asked = spark.createDataFrame([("q1", "Compliance Review of CASE-10003"), ("q2", "")], "query_id string, query string").withColumn("vector", R.hashing_encoder(F.col("query"), 32))
    hits = R.retrieve(asked, stored).cache()
    assert hits.groupBy("query_id").count().where("count <> 3").count() == 0
    plain = R.retrieve(asked, stored, reranker=None)
    assert "cross_score" not in plain.columns
    assert R.context(hits).where("query_id = 'q1'").first()["context"].startswith("- Chunk 1 [CASE-")


def test_suite(spark, tmp_path):
    path = str(tmp_path / "suite.json")
    prompt = {"id": "P-1", "category": "c", "prompt": "forecast?", "reason": "r"}
    with open(path, "w") as f:
        json.dump({"poison_prompts": [prompt], "grounded_prompts": [{**prompt, "id": "G-1", "prompt": "how long?"}]}, f)
    rows = event_log.suite(event_log.read_json(spark, path, event_log.SUITE))
    assert {(r["id"], r["expected"]) for r in rows.collect()} == {("P-1", "intercepted"), ("G-1", "grounded")}
    event_log.write_report(rows.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["n"] == 2


def test_top_k_against_brute_force(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    chunks, asked = r.integers(-3, 4, (400, 8)).astype(float), r.integers(-3, 4, (30, 8)).astype(float)
    chunks[5], asked[3] = 0, 0
    frame = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")
    norm = lambda x: np.sqrt(np.square(x).sum(1))
    with np.errstate(invalid="ignore"):
        cosine = asked @ chunks.T / (norm(asked)[:, None] * norm(chunks))
    want = set()
    for q, line in enumerate(cosine):
        ranked = sorted((-round(float(s), 4) if np.isfinite(s) else 9, i) for i, s in enumerate(line))[:5]
        want |= {(q, i, n + 1, None if s == 9 else -s) for n, (s, i) in enumerate(ranked)}
    for bytes_, tile in ((R.QUERY_BYTES, R.TILE), (500, (7, 64)), (R.QUERY_BYTES, (4, 3))):
        monkeypatch.setattr(R, "QUERY_BYTES", bytes_)
        monkeypatch.setattr(R, "TILE", tile)
        got = R.top_k(frame(asked, "query_id"), frame(chunks, "chunk_id").repartition(3), 5)
        assert {(r["query_id"], r["chunk_id"], r["rank"], r["similarity"]) for r in got.collect()} == want
    assert R.top_k(frame(asked, "query_id").limit(0), frame(chunks, "chunk_id"), 5).count() == R.top_k(frame(asked, "query_id"), frame(chunks, "chunk_id").limit(0), 5).count() == 0


def test_top_k_in_bounded_memory():
    """8,000 questions against batches of vectors: what is kept is k rows a question, beside one tile."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    asked, vectors = r.normal(size=(8_000, 16)), r.normal(size=(6_000, 16))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 3000)), pa.array(list(vectors[a : a + 3000]), pa.list_(pa.float64()))], ["t", "v"]) for a in (0, 3000)]
    tracemalloc.start()
    (out,) = R.best_of(iter(batches), asked, 5, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 40_000 and most < 200e6  # all similarities at once are 384 MB, and as much for each copy
    similar = np.round(asked[:50] @ vectors.T / (np.linalg.norm(asked[:50], axis=1)[:, None] * np.linalg.norm(vectors, axis=1)), 4)
    got = {(q, t) for q, t in zip(out.column(0).to_pylist(), out.column(1).to_pylist()) if q < 50}
    assert got == {(q, int(t)) for q in range(50) for t in np.lexsort((np.arange(6_000), -similar[q]))[:5]}


def test_top_k_compares_few_exactly(monkeypatch):
    """Single precision sorts out almost all pairs; what is left, vectors of odd lengths and ties are compared exactly."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    asked, vectors = r.integers(0, 4, (600, 16)).astype(float), r.integers(0, 4, (20_000, 16)).astype(float)
    asked[7], asked[8], vectors[11], vectors[12], vectors[13], vectors[14] = 0, 1e-170, 0, 1e-120, 1e200, np.nan
    vectors[15_000:15_200] = asked[20] * 2  # more ties than are asked for
    names, compared = r.permutation(20_000), []
    own = R.exactly_rounded
    monkeypatch.setattr(R, "exactly_rounded", lambda x, digits: (compared.append(x.size), own(x, digits))[1])
    batches = [pa.RecordBatch.from_arrays([pa.array(names[a : a + 5000]), pa.array(list(vectors[a : a + 5000]), pa.list_(pa.float64()))], ["t", "v"]) for a in range(0, 20_000, 5000)]
    (out,) = R.best_of(iter(batches), asked, 5, 4)
    got = set(zip(*(out.column(i).to_pylist() for i in range(3))))
    with np.errstate(all="ignore"):
        similar = asked @ vectors.T / (np.sqrt(np.square(asked).sum(1))[:, None] * np.sqrt(np.square(vectors).sum(1)))
    similar[~np.isfinite(similar)] = -np.inf
    similar = np.round(similar, 4)
    want = {(q, int(names[t]), None if similar[q, t] == -np.inf else similar[q, t]) for q in range(600) for t in np.lexsort((names, -similar[q]))[:5]}
    assert got == want
    assert sum(compared) < 0.1 * similar.size  # all of them before


def test_encoder_counts_words(spark):
    import hashlib

    texts = ["", None, "  a  B a\u2003c ", "x " * 500, "no \U0001f600 é É"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", R.hashing_encoder(F.col("t"), 8)).collect()
    for r in rows:
        want = [0.0] * 8
        for w in (r["t"] or "").lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
        assert r["v"] == want


def test_run_of_show_measures_latency(spark):
    chunks = V.corpus(event_log.synthetic_events(spark, 20)).withColumn("chunk_id", F.xxhash64("text")).withColumn("vector", R.hashing_encoder(F.col("text")))
    suite = spark.createDataFrame([("P", "poison", "intercepted"), ("G", "Compliance Review of CASE-10003", "grounded")], "id string, prompt string, expected string")
    verdicts, report = W.run_of_show(suite, chunks, R.hashing_encoder)
    assert verdicts.where("latency_ms > 0").count() == 2
    row = report.first()
    assert row["mean_latency_ms"] > 0 and row["reliability"] in ("100% RELIABLE", "NEEDS CALIBRATION") and row["intercepted"] == 1


def test_event_sink(spark, tmp_path):
    from tokenguard.streaming import monitor

    spark.createDataFrame([(1, "a b"), (2, None)], "k int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # what was sent is not sent again
        monitor.event_sink(stream, ["k"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    sent = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["k"], r["seq"], r["payload"]) for r in sent.collect()) == [(1, 0, "data: a \n\n"), (1, 1, "data: b \n\n"), (2, 0, "data:  \n\n")]


def test_parse_and_align_fill_across_stretches(spark, monkeypatch):
    from tokenguard.operators import uncertainty as U

    monkeypatch.setattr(U, "STRETCH", 4)
    left = spark.createDataFrame([(1, i, float(i)) for i in range(1, 30)] + [(None, 1, 5.0)], "k int, pos int, value double")
    right = spark.createDataFrame([(1, i, -float(i)) for i in range(1, 7)], "k int, pos int, value double")
    got = {(r["k"], r["pos"]): (r["left_value"], r["right_value"]) for r in S.align(left, right, ["k"]).collect()}
    assert got == {(1, i): (float(i), -float(min(i, 6))) for i in range(1, 30)} | {(None, 1): (5.0, None)}


def test_latency_penalty(spark):
    from tokenguard.functions import numeric as N

    one = lambda a, b: spark.range(1).select(N.latency_penalty(F.lit(a).cast("double"), F.lit(b).cast("double"))).first()[0]
    assert [one(3.0, 120.0), one(None, 1.0), one(1.0, 0.0)] == ["+25.0x Penalty", "Calculating...", "Calculating..."]
