"""Continuous queries give what their batch forms give, however the rows arrive."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tokenguard.operators import serving as S
from tokenguard.operators import uncertainty as U
from tokenguard.streaming import monitor

START = datetime.datetime(2024, 1, 1)


def stream_of(spark, folder, rows, schema, files, per_trigger):
    """The rows, shuffled over a number of files, as a stream that reads a few files at a time."""
    random.Random(files).shuffle(rows)
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


@pytest.fixture(scope="module")
def hot(spark):
    """Streams of which one has a third of all rows, ties in time, and null keys."""
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3, 4, 5, None]), i, START + datetime.timedelta(minutes=i // 2 * 3), r.random()) for i in range(900)]
    want = U.ema(U.with_position(spark.createDataFrame(rows, "k int, id long, ts timestamp, p double"), ["k"], ["ts", "id"]), ["k"])
    return rows, {(r["k"], r["id"]): (r["pos"] + 1, r["ema_mean"], r["ema_var"]) for r in want.collect()}


@pytest.mark.parametrize("files,per_trigger", [(1, 1), (60, 25), (500, 200)])
def test_moments_in_any_order_of_arrival(spark, tmp_path, hot, files, per_trigger):
    rows, want = hot
    stream = stream_of(spark, str(tmp_path / "in"), list(rows), "k int, id long, ts timestamp, p double", files, per_trigger)
    out = monitor.ema_stream(monitor.with_end(stream, str(tmp_path / "end")), "k", "ts", ["id"], late="3 days", bucket="7 hours")
    to = (str(tmp_path / "out"), str(tmp_path / "state"))
    assert monitor.run_to_end(out, *to).count() == 0  # any row may still come
    monitor.end(stream, "ts", str(tmp_path / "end"), START + datetime.timedelta(days=3), START + datetime.timedelta(days=5), datetime.timedelta(days=1))
    got = {(r["k"], r["id"]): (r["n"], r["ema_mean"], r["ema_var"]) for r in monitor.run_to_end(out, *to).where("id IS NOT NULL").collect()}
    assert got.keys() == want.keys()
    for k, (n, m, v) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(m, abs=1e-12) and got[k][2] == pytest.approx(v, abs=1e-12)


def test_rows_come_out_as_the_watermark_passes(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "k int, id long, ts timestamp, p double"
    add = lambda *at: spark.createDataFrame([(1, i, START + datetime.timedelta(minutes=i), i / 100) for i in at], schema).coalesce(1).write.mode("append").parquet(folder)
    add(2, 0)
    out = monitor.ema_stream(spark.readStream.schema(schema).parquet(folder), "k", "ts", ["id"], late="5 minutes", bucket="2 minutes")
    run = lambda: sorted((r["id"], r["n"]) for r in monitor.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "state")).collect())
    assert run() == []
    add(1, 9)  # 1 is late, but not too late
    assert run() == [(0, 1), (1, 2), (2, 3)]  # the watermark is at 4
    add(0, 5)  # 0 is behind the watermark, 5 is not
    add(30)
    assert run() == [(0, 1), (1, 2), (2, 3), (5, 4), (9, 5)]


def sessions_of(spark):
    rows = [("hi", " Hello ", "p2p", False, None), ("bad", "this is a poison prompt for q4", "p2p", True, None), ("good", "when?", "o2c", False, "Case 1 took five days."), ("none", None, "?", False, None), ("odd", "w-99  x", "o2c", False, "A SOX-99 fact of 2026 "), ("", "", None, True, "x")]
    rows += [(f"s{i}", f"what of case {i}?", "ap_audit", i % 3 == 0, f"It took {i} days." if i % 2 else None) for i in range(40)]
    return rows, "session string, query string, graph string, is_poison boolean, top_chunk string"


def test_protected_sessions(spark, tmp_path):
    rows, schema = sessions_of(spark)
    want = sorted(map(tuple, S.protected_stream(spark.createDataFrame(rows, schema)).collect()))
    stream = stream_of(spark, str(tmp_path / "in"), list(rows), schema, 7, 3)
    out, to = monitor.protected_events(stream), (str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, monitor.run_to_end(out, *to, by_clock=True).collect())) == want
    spark.createDataFrame(rows[:3], schema).write.mode("append").parquet(str(tmp_path / "in"))  # sent again: nothing more is said but a greeting
    assert sorted(map(tuple, monitor.run_to_end(out, *to, by_clock=True).where("session <> 'hi'").collect())) == [x for x in want if x[0] != "hi"]


@pytest.mark.parametrize("per_trigger", [1, 40])
def test_tokens_in_any_order_are_cut_at_the_trip(spark, tmp_path, per_trigger):
    r = random.Random(6)
    rows = []
    for k in [*range(12), None]:
        n = r.randint(1, 40)
        rows += [(k, "q", i, r.choice(["the", "case", "SOX", "", None, "Order"]), -r.choice([0.01, 0.05, 0.4]) if i % 9 or r.random() < 0.5 else -3.0, i == n - 1) for i in range(n)]
    schema = "k int, query string, pos long, token string, logprob double, last boolean"
    cut = U.cut_at_trip(U.score_streams(spark.createDataFrame(rows, schema), ["k"]), ["k"]).collect()
    want = {(x["k"], x["pos"], "trip" if x["tripped"] else "said"): (x["score"], x["ema_var"]) for x in cut}
    stream = stream_of(spark, str(tmp_path / "in"), list(rows), schema, 20, per_trigger * 5)
    got = monitor.run_to_end(monitor.breaker_stream(stream, "k"), str(tmp_path / "out"), str(tmp_path / "state"), by_clock=True).collect()
    assert len({(x["k"], x["pos"], x["what"]) for x in got}) == len(got)
    said = {(x["k"], x["pos"], x["what"]): (x["score"], x["ema_var"]) for x in got if x["what"] != "end"}
    assert said.keys() == want.keys() and all(said[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    tripped = {x["k"] for x in cut if x["tripped"]}
    assert {x["k"] for x in got if x["what"] == "end"} == {x["k"] for x in cut} - tripped and tripped
    for x in got:
        if x["what"] == "trip":
            assert x["before"] == " ".join(t or "" for _, t in sorted((y["pos"], y["token"]) for y in cut if y["k"] == x["k"] and y["pos"] < x["pos"]))


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with monitor.settings(spark, {"spark.sql.shuffle.partitions": "3", "some.key": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("some.key", None) is None
