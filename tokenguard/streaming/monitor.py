"""Continuous scoring on Structured Streaming, with state per stream.

* `ema_stream`: running moments of streams whose rows come late, split over files and out of order. Rows wait in buckets of
  event time; the watermark closes a bucket, whose rows are then put in order and folded on from the stream's three numbers.
* `breaker_stream`: token streams that are cut at their first score above the threshold, as the tokens arrive.
* session windows, and event payloads as a sink.

Rows behind the watermark are dropped by Spark, which counts them (numRowsDroppedByWatermark).
"""

from __future__ import annotations

import contextlib
import datetime
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tokenguard import params
from tokenguard.operators import serving as S


FOLD = 64  # rows that are folded by one matrix product
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def decayed(x: np.ndarray, start: float, keep: float) -> np.ndarray:
    """y with y[i] = keep * y[i - 1] + x[i], from y[-1] = start."""
    power = keep ** np.arange(FOLD + 1)
    lag = np.arange(FOLD)[:, None] - np.arange(FOLD)[None]
    weights = np.where(lag >= 0, power[np.maximum(lag, 0)], 0.0)
    out = np.empty(len(x))
    for a in range(0, len(x), FOLD):
        b = min(a + FOLD, len(x))
        out[a:b] = weights[: b - a, : b - a] @ x[a:b] + power[1 : b - a + 1] * start
        start = out[b - 1]
    return out


def ema_fold(p: np.ndarray, n: int, m: float, v: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances after each value, from the state after n values."""
    if not len(p):
        return p, p
    if not n:
        m, v = float(p[0]), 0.0
    means = decayed(alpha * p, m, 1 - alpha)
    apart = p - np.append(m, means[:-1])
    return means, decayed((1 - alpha) * alpha * np.square(apart), v, 1 - alpha)


def to_bytes(rows: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue()


def named(key: str) -> Column:
    """A key to group by that is never null: state in Python doesn't tell null keys from others."""
    return F.when(F.col(key).isNull(), "n").otherwise(F.concat(F.lit("k"), F.col(key).cast("string"))).alias("_k")


class OrderedFold(StatefulProcessor):
    """Rows wait in buckets of event time; a bucket that its timer closes is sorted and folded on from (n, mean, variance)."""

    def __init__(self, columns: list[str], width: int, order: list[str], p: str, alpha: float):
        self.columns, self.width, self.order, self.p, self.alpha = columns, width, order, p, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "n long, m double, v double")
        self.waiting = handle.getMapState("waiting", "bucket long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:  # one by one: a stream's rows of a micro-batch never are one frame
            table = pa.Table.from_pandas(frame.set_axis([*self.columns, "_at", "_t", "_k"], axis=1).drop(columns=["_t", "_k"]), preserve_index=False)
            buckets = table.column("_at").to_numpy() // self.width
            for bucket in np.unique(buckets).tolist():
                part = table.take(np.flatnonzero(buckets == bucket))
                before = self.waiting.getValue((bucket,))
                if before is not None:
                    part = pa.concat_tables([pa.ipc.open_stream(before[0]).read_all().cast(part.schema), part])
                else:
                    self.handle.registerTimer((bucket + 1) * self.width // 1000)
                self.waiting.updateValue((bucket,), (to_bytes(part),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # not a generator: by the time its rows are taken, the state is another key's
        if not self.waiting.containsKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.width - 1,)):
            return iter(())  # folded with the first timer of this watermark: timers come in no order
        closed, out = timerValues.getCurrentWatermarkInMs() * 1000 // self.width, []
        n, m, v = self.done.get() or (0, 0.0, 0.0)
        for bucket in sorted(k[0] for k in self.waiting.keys() if k[0] < closed):
            rows = pa.ipc.open_stream(self.waiting.getValue((bucket,))[0]).read_all().sort_by([("_at", "ascending"), *((c, "ascending") for c in self.order)]).to_pandas()
            means, variances = ema_fold(rows[self.p].to_numpy(float), n, m, v, self.alpha)
            out.append(rows.assign(n=np.arange(n + 1, n + len(rows) + 1), ema_mean=means, ema_var=variances))
            n, m, v = n + len(rows), float(means[-1]), float(variances[-1])
            self.waiting.removeKey((bucket,))
        self.done.update((n, m, v))
        return iter(out)


def ema_stream(stream: DataFrame, key: str, time: str, order: list[str], p: str = "p", late: str = "1 hour", bucket: str = "1 hour", s: params.Scoring = params.Scoring()) -> DataFrame:
    """(key, time, order columns, p, n, ema_mean, ema_var) for each row of a stream, in the order of time and the order columns
    whatever the order of arrival, where rows come at most `late` behind the latest.

    A row comes out when the watermark has passed the end of its bucket. Per key three numbers are kept, and the rows of open
    buckets, in RocksDB; in memory are one Arrow batch of new rows, or the buckets that one step of the watermark closes in a
    partition. Rows without a time are left out. Rows with null keys are a stream of their own."""
    columns = [key, *order, p]
    width = stream.sparkSession.sql(f"SELECT cast(unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {bucket}) AS long)").first()[0]
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).select(*columns, F.unix_micros("_t").alias("_at"), "_t", named(key)).where("_at IS NOT NULL")
    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in columns)
    out = rows.groupBy("_k").transformWithStateInPandas(OrderedFold(columns, width, order, p, s.alpha), f"{kinds}, _at long, n long, ema_mean double, ema_var double", "append", "EventTime")
    return out.select(key, F.timestamp_micros("_at").alias(time), *order, p, "n", "ema_mean", "ema_var")


class Breaker(StatefulProcessor):
    """Tokens of a session in order of their positions, up to the first score above tau; what comes after is dropped.

    Tokens that come before their turn wait. Of the tokens said the text is kept until the session ends."""

    def __init__(self, tau: float, alpha: float, factor: float, keep_ms: int):
        self.tau, self.alpha, self.factor, self.keep_ms = tau, alpha, factor, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, m double, v double, ended boolean", self.keep_ms)
        self.early = handle.getMapState("early", "pos long", "token string, p double, weight double, query string, last boolean", self.keep_ms)
        self.said = handle.getListState("said", "token string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, m, v, ended = self.state.get() or (0, 0.0, 0.0, False)
        if ended:
            return
        for frame in rows:
            out, said = [], []
            own = frame.iloc[0, 0]
            own = None if pd.isna(own) else own
            for _, pos, *row, _ in frame.sort_values(frame.columns[1]).itertuples(index=False, name=None):
                if ended:
                    break
                if pos > at:
                    self.early.updateValue((pos,), tuple(row))
                while pos == at and not ended:
                    token, p, weight, query, last = row
                    apart = p - m
                    m, v = (p, 0.0) if at == 0 else (m + self.alpha * apart, (1 - self.alpha) * (v + self.alpha * apart * apart))
                    score = ((1 - p) + self.factor * v) * weight
                    ended = bool(score > self.tau or last)
                    what = "trip" if score > self.tau else "said"
                    before = " ".join([*(t[0] for t in self.said.get()), *said]) if what == "trip" else None
                    out.append((own, query, at, token, score, v, what, before))
                    if what == "said" and last:
                        out.append((own, query, at + 1, None, None, None, "end", None))
                    said.append(token or "")
                    at += 1
                    pos = at
                    if not ended:
                        row = self.early.getValue((at,))
                        if row is None:
                            break
                        self.early.removeKey((at,))
            if said and not ended:
                self.said.appendList([(t,) for t in said])
            if out:
                yield pd.DataFrame(out, columns=["key", "query", "pos", "token", "score", "ema_var", "what", "before"])
            if ended:
                self.early.clear()
                self.said.clear()
                break
        self.state.update((at, m, v, ended))


def breaker_stream(stream: DataFrame, key: str, keep: str = "1 hour", s: params.Scoring = params.Scoring()) -> DataFrame:
    """(key, query, pos, token, score, ema_var, what, before) of a stream of tokens (key, query, pos, token, logprob, last),
    where `last` marks a session's last token.

    what: `said` for a token under tau, `trip` for the first above it, with the text before it, and `end` after the last token
    of a session that nothing has stopped. A session that has ended stays known for the time `keep` since its last change;
    what comes after its end is dropped, and sent once is sent never again. Positions start at 0 and have no gaps; they may
    come in any order and be split over micro-batches. A position that is repeated after its turn is dropped."""
    from tokenguard.functions import text as T

    keep_ms = stream.sparkSession.sql(f"SELECT cast(unix_millis(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {keep}) AS int)").first()[0]
    rows = stream.select(F.col(key).alias("key"), F.col("pos").cast("long").alias("pos"), "token", F.exp("logprob").alias("p"), T.token_weight(F.col("token")).alias("weight"), "query", "last", named(key))
    kind = stream.schema[key].dataType.simpleString()
    out = rows.groupBy("_k").transformWithStateInPandas(Breaker(s.tau, s.alpha, s.variance_factor, keep_ms), f"key {kind}, query string, pos long, token string, score double, ema_var double, what string, before string", "append", "ProcessingTime")
    return out.withColumnRenamed("key", key)


def protected_events(sessions: DataFrame, keep: str = "1 hour", s: params.Scoring = params.Scoring()) -> DataFrame:
    """(session, seq, payload), as `serving.protected_stream` gives it, of a stream of sessions."""
    status, tokens = S.spoken(sessions)
    cut = breaker_stream(tokens, "session", keep, s)
    return S.as_events(status.unionByName(cut.select("session", F.explode(S.texts_of(s)).alias("e")).select("session", "e.*")))


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows per key with a watermark: start, end, events and the sum of value. In append mode a session comes out,
    and its state goes, when the watermark has passed its end."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = marked.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the start of a query, as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(query: DataFrame, out: str, checkpoint: str, by_clock: bool = False) -> DataFrame:
    """Process what the source holds now, into Parquet. Run again with the same folders, what has come since is added.

    by_clock: for state that expires by the clock. Spark would run micro-batches without rows for it and never end; so it
    expires with the next rows."""
    with settings(query.sparkSession, STATE | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if by_clock else {})):
        running = query.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start()
    running.awaitTermination()
    return query.sparkSession.read.schema(query.schema).parquet(out)


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """The stream with a second source beside it, for last rows that end it (`end`): nulls but for the time."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(folder))


def end(stream: DataFrame, time: str, folder: str, first: datetime.datetime, last: datetime.datetime, step: datetime.timedelta) -> None:
    """Put rows into the second source of `with_end`, one for each micro-batch of the next run: their times go step by step
    from the first to beyond the last. Where these lie beyond all rows by their lateness, the watermark closes a step's buckets
    at a time, until all are closed."""
    at = first
    while at < last + step:
        at += step
        row = [at if f.name == time else None for f in stream.schema]
        stream.sparkSession.createDataFrame([row], stream.schema).coalesce(1).write.mode("append").parquet(folder)


def event_sink(stream: DataFrame, keys: list[str], out: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Start writing each row's text as event payloads (keys, seq, payload), one folder for each micro-batch; a batch that
    is run again replaces its own folder, so nothing is sent twice."""

    def send(batch: DataFrame, number: int) -> None:
        S.encode_events(batch, keys, text).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(send).start()
