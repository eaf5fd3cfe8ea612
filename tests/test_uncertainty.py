"""Goldens of the literal token suite, and invariants of the stream operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tokenguard import params
from tokenguard.functions import numeric as N
from tokenguard.functions import text as T
from tokenguard.operators import evaluation as E
from tokenguard.operators import uncertainty as U
from tokenguard.sources import event_log

# a token stream: text with `token@-logprob` in hundredths; label True: must be stopped; position of its first trip
SUITE = [
    (False, None, 0.2736, "According@2 to@1 verified@5 Celonis@3 event@2 logs,@4 average@3 compliance@2 cycle@1 time@2 for@1 orders@3 above@4 $100,000@8 is@2 12@5 days.@3"),
    (False, None, 0.3083, "Purchase@3 Order@2 CASE-10231@7 was@1 created@4 by@2 Anita@8 Rao@5 for@1 $128,500.00.@9"),
    (True, 9, 4.4168, "Accessing@4 Celonis@5 event@3 logs...@6 Vendor@8 contract@9 override@12 values@10 indicate@15 42.8_days_unverified_$5M@285"),
    (True, 2, 4.5949, "Warehouse@5 node@4 W-99@265 recorded@20 an@5 unapproved@15 delay_holding_99_days@320"),
    (True, 9, 1.9536, "Vendor@2 invoice@3 settlement@4 stipulates@8 an@2 unapproved@15 reconciliation@20 balance@10 of@1 $14.2M_unverified_EUR_equivalent@65 pending@5 audit.@2"),
    (True, 10, 1.1271, "Under@2 SOX@4 Section@3 404@5 guidelines,@4 all@2 procurement@3 sign-offs@5 may@5 bypass@12 Chief_Audit_Executive_approval_in_California@75"),
    (False, None, 0.5151, "According@2 to@1 internal@4 audit@3 guidelines@5 (revised@20 Q2-2026,@15 Addendum@15 IV),@10 standard@2 P2P@3 processing@2 requires@2 5@4 days.@2"),
    (True, 4, 3.2682, "Mean@2 cycle@3 time@2 is@1 unverified_88_days@125"),
    (False, None, 0.4081, "The@5 process@4 workflow@45 for@2 onboarding@3 has@1 been@2 completed.@1"),
]


@pytest.fixture(scope="module")
def suite(spark):
    rows = []
    for i, (label, _, _, line) in enumerate(SUITE):
        rows += [(i, label, pos, t.rpartition("@")[0], -int(t.rpartition("@")[2]) / 100) for pos, t in enumerate(line.split())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "stream int, label boolean, pos int, token string, logprob double")


def test_goldens(suite):
    scored = U.score_streams(suite, ["stream"]).cache()
    top = {r["stream"]: round(r["m"], 4) for r in scored.groupBy("stream").agg(F.max("score").alias("m")).collect()}
    trips = {r["stream"]: r for r in U.first_trip(scored, ["stream"]).collect()}
    for i, (label, at, most, _) in enumerate(SUITE):
        assert top[i] == pytest.approx(most, abs=1e-4)
        assert trips[i]["tripped"] == label and trips[i]["position"] == (-1 if at is None else at)
    cut = {r["stream"]: r["n"] for r in U.cut_at_trip(scored, ["stream"]).groupBy("stream").agg(F.count("*").alias("n")).collect()}
    for i, (_, at, _, line) in enumerate(SUITE):
        assert cut[i] == (len(line.split()) if at is None else at + 1)
    tripped = scored.groupBy("stream", "label").agg(F.max(F.col("score") > 0.65).alias("hit"), F.max(F.col("score_v1") > 0.65).alias("hit1"))
    assert E.confusion(tripped, F.col("hit"), F.col("label")).first()[:4] == (5, 0, 4, 0)
    assert E.confusion(tripped, F.col("hit1"), F.col("label")).first()["recall"] < 100
    assert scored.where("ema_var < 0 OR window_var < -1e-12").count() == 0


def test_long_stream_is_one_fold(spark):
    ps = [random.Random(2).random() for _ in range(1)] + [random.Random(i).random() for i in range(2000)]
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "k int, pos int, p double")
    got = {r["pos"]: r for r in U.ema(rows, ["k"]).collect()}
    assert len(got) == len(ps)
    m = v = 0.0
    for i, p in enumerate(ps):
        if i == 0:
            m = p
        else:
            d = p - m
            m += 0.35 * d
            v = 0.65 * (v + 0.35 * d * d)
        assert got[i]["ema_mean"] == pytest.approx(m, abs=1e-15) and got[i]["ema_var"] == pytest.approx(v, abs=1e-15)


@pytest.mark.parametrize("token,weight", [(None, 0.4), ("  ", 0.4), ("₹5", 3.5), ("x²", 3.5), ("W-A", 3.0), ("pre-PO", 3.0), ("Order-to-Cash", 1.8), ("sox.", 2.5), ("EU", 2.5), ("eu", 2.2), ("Officer", 2.2), ("The", 1.8), ("In", 0.4), ("The.", 0.4), ("(", 0.4), ("•", 0.4), ("process", 1.0)])
def test_token_weight(spark, token, weight):
    assert spark.createDataFrame([(token,)], "t string").select(T.token_weight(F.col("t"))).first()[0] == weight


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    null = F.lit(None).cast("double")
    assert one(N.pmi_penalty(F.lit(-2.0), null)) == 0.0 and one(N.pmi_penalty(F.lit(-2.0), F.lit(-0.2))) == pytest.approx(1.8)
    assert one(N.shannon_entropy(lit(0.5, 0.5, 0))) == 1.0 and one(N.variance(lit(3))) == 0.0 and one(N.variance(lit(1, 3))) == 1.0
    ps = one(N.normalized_probabilities(F.create_map(F.lit("a"), F.lit(-1.0), F.lit("b"), F.lit(-2.0)), F.lit(-1.0)))
    assert sum(ps) == pytest.approx(1)
    assert one(N.normalized_probabilities(F.lit(None).cast("map<string,double>"), F.lit(0.0))) == [1.0]
    assert one(N.draft_logprob(F.lit("42.8_days"), F.lit(0.15))) == pytest.approx(math.log(0.0225))
    assert one(N.draft_logprob(F.lit("the"), F.lit(0.15))) == -0.02
    assert one(N.rounded(F.lit(0.125), 2)) == 0.12 and one(N.saved_percent(F.lit(0), F.lit(0))) == 75.0


def test_draft_needs_earlier_token(spark):
    rows = spark.createDataFrame([(1, 0, "Alpha", None), (1, 1, "alp", None), (1, 2, "beta", None), (1, 3, "", None)], "k int, pos int, token string, logprob double")
    got = {r["pos"]: round(r["logprob"], 6) for r in U.draft_estimates(rows, ["k"]).collect()}
    assert got == {0: round(math.log(0.2), 6), 1: round(math.log(0.95 * 0.9), 6), 2: round(math.log(0.2), 6), 3: 0.0}


def test_calibration(spark):
    scores = [float(i % 37) for i in range(1000)]
    want = sorted(scores)[min(int(1000 * 0.95), 999)]
    assert E.calibrate(spark.createDataFrame([(s,) for s in scores], "score double")).first()["tau"] == want
    assert E.calibrate(spark.createDataFrame([], "score double")).first()["tau"] == params.Scoring().tau


def test_empty_streams(spark):
    rows = spark.createDataFrame([], "stream int, pos int, token string, logprob double")
    assert U.first_trip(U.score_streams(rows, ["stream"]), ["stream"]).count() == 0


def test_payload(spark):
    raw = '{"token": "x", "logprob": -0.5, "top_logprobs": {"x": -0.5, "y": -1.0, "z": -2.0}}'
    x = spark.createDataFrame([(raw,), ("{}",)], "r string").select(event_log.payload(F.col("r")).alias("x")).collect()
    assert sum(x[0]["x"]["probabilities"]) == pytest.approx(1, abs=1e-4) and x[1]["x"]["token"] == "" and x[1]["x"]["probabilities"] == [1.0]


def test_variants_of_the_literal_suite(spark):
    from tokenguard.plans import suites

    got = {(r["suite"], r["variant"]): tuple(r[k] for k in ("tp", "fp", "tn", "fn", "accuracy", "f1")) for r in suites.suite_variants(spark, "").collect()}
    assert got["literal", "v1"] == (4, 0, 6, 4, 71.43, 66.67)
    assert got["literal", "v2"] == got["literal", "v3"] == (8, 0, 6, 0, 100.0, 100.0)
    assert all(sum(got["events", v][:4]) == 100 for v in ("v1", "v2", "v3")) and got["events", "v3"][0] == 50


def test_positions_and_windows_of_a_hot_stream(spark, monkeypatch):
    monkeypatch.setattr(U, "STRETCH", 100)
    r = random.Random(5)
    rows = [("hot" if i % 9 else None, i, r.random()) for i in range(4000)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, t long, p double").repartition(7)
    got = U.rolling(U.with_position(df, ["k"], ["t"]), ["k"])
    streams = {}
    for k, t, p in rows:
        streams.setdefault(k, []).append((t, p))
    want = {}
    for k, line in streams.items():
        for i, (t, _) in enumerate(line):
            last = [p for _, p in line[max(0, i - 4) : i + 1]]
            mean = sum(last) / len(last)
            want[k, t] = (i, sum((p - mean) ** 2 for p in last) / len(last))
    found = {(x["k"], x["t"]): (x["pos"], x["window_var"]) for x in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[key][0] == want[key][0] and found[key][1] == pytest.approx(want[key][1], abs=1e-12) for key in want)


def test_draft_estimates_against_every_prefix(spark):
    r = random.Random(6)
    tokens = ["".join(r.choice("xXyY é") for _ in range(r.randint(0, 6))) for _ in range(300)]
    rows = spark.createDataFrame([(k, i, t, None) for k in (1, None) for i, t in enumerate(tokens)], "k int, pos int, token string, logprob double")
    near = {(row["k"], row["pos"]): row["logprob"] for row in U.draft_estimates(rows, ["k"]).collect()}
    assert len(near) == 600
    for i, t in enumerate(tokens):
        if c := t.strip().lower():
            found = any(c in u.lower() for u in tokens[:i])
            assert near[1, i] == near[None, i] == pytest.approx(math.log(max(0.2, (0.95 if found else 0.15) * 0.9)))


def test_draft_estimates_of_a_long_stream(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("string")).alias("token"), F.lit(None).cast("double").alias("logprob"))
    assert U.draft_estimates(rows, ["k"]).where("logprob IS NOT NULL").count() == n


@pytest.mark.parametrize("part", [7, 1024])
def test_draft_estimates_of_short_and_long_streams(spark, monkeypatch, part):
    """Streams of one part take one shuffle and no join; what lies in an earlier part of a stream is found all the same."""
    monkeypatch.setattr(U, "PART", part)
    r = random.Random(9)
    streams = {(k, i): ["".join(r.choice("abAB -4") for _ in range(r.randint(0, 5))) for _ in range(n)] for k, i, n in ((1, "x", 90), (1, None, 3), (None, "x", 8), (2, "y", 1), (2, "z", 40))}
    rows = spark.createDataFrame([(*key, p, t, None) for key, ts in streams.items() for p, t in enumerate(ts)], "k int, i string, pos long, token string, logprob double")
    out = U.draft_estimates(rows, ["k", "i"])
    got = {(x["k"], x["i"], x["pos"]): x["logprob"] for x in out.collect()}
    assert len(got) == sum(map(len, streams.values())) and out.columns == rows.columns
    low = {key: [t.lower() for t in ts] for key, ts in streams.items()}
    near = {(*key, p): any(ts[p].strip() in u for u in ts[:p]) for key, ts in low.items() for p in range(len(ts))}
    flat = [(*x, streams[x[:2]][x[2]], n) for x, n in near.items()]
    want = spark.createDataFrame(flat, "k int, i string, pos long, token string, near boolean").withColumn("want", N.draft_logprob(F.col("token"), F.when(F.col("near"), 0.95).otherwise(0.15))).collect()
    assert {(x["k"], x["i"], x["pos"]): x["want"] for x in want} == got
    nodes = [line.lstrip(" +:-").split()[0] for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert part == 7 or "Join" not in nodes and nodes.count("Window") == 1 and "Aggregate" not in nodes  # joins were broadcast before


def test_matrix_fold_is_the_recurrence():
    import numpy as np

    from tokenguard.streaming import monitor

    p = np.random.default_rng(1).random(333)
    n, m, v = 0, 0.0, 0.0
    for a in (0, 1, 70, 200, 333):
        b = {0: 1, 1: 70, 70: 200, 200: 333, 333: 333}[a]
        means, variances = monitor.ema_fold(p[a:b], n, m, v, 0.35)
        for x, mean, var in zip(p[a:b], means, variances, strict=True):
            m, v = (x, 0.0) if not n else (m + 0.35 * (x - m), 0.65 * (v + 0.35 * (x - m) ** 2))
            n += 1
            assert mean == pytest.approx(m, abs=1e-14) and var == pytest.approx(v, abs=1e-14)


def test_shared_folder_is_refused_on_a_cluster_without_one():
    from types import SimpleNamespace as NS

    from tokenguard.sources import shared

    conf = NS(get=lambda *_: None, set=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.shared_folder(NS(conf=conf, sparkContext=NS(master=master, applicationId="a")))
