"""Parts that are answered in rounds: the values are those of the whole part, and memory does not grow with it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_texts import copies, frame

exchange = pytest.importorskip("tokenguard.llm.exchange")
from pyspark.sql import functions as F  # noqa: E402

from tokenguard.llm import ngram_join, ppm  # noqa: E402


def test_join_and_scores_are_the_same_in_rounds(spark, monkeypatch):
    df = frame(spark, list(copies(60, 6).items())).withColumn("train", F.col("doc_id") % 3 != 0)
    plain = [sorted(map(tuple, x.collect())) for x in (ngram_join.join(df), ppm.score(df, "train")[0])]
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(exchange, "SLICE_BYTES", 1000)
    monkeypatch.setattr(exchange, "ROUND", 40)
    again = [sorted(map(tuple, x.collect())) for x in (ngram_join.join(df), ppm.score(df, "train")[0])]
    assert again[0] == plain[0]
    assert all(a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-12) for a, b in zip(again[1], plain[1], strict=True))


def test_runs_of_a_frequent_pair_take_bounded_memory():
    """The messages of 40 blocks about one pair of symbols: as many keys as a hot part of half a GB of text has."""
    r, low = np.random.default_rng(3), np.ones((1 << ppm.BITS, 1 << ppm.BITS), np.int64)
    pair = np.uint64(101 << ppm.BITS | 32) << np.uint64(ppm.BITS)
    letters = lambda n: r.integers(97, 123, n).astype(np.uint64)
    sent = []
    for _ in range(40):
        keys = pair | letters(40_000)
        for k in (3, 4, 5):
            keys |= letters(40_000) << np.uint64(ppm.BITS * k)
        sent.append(np.unique(keys))
    counts = [r.integers(0, 4, len(x)) for x in sent]
    batch = exchange.rows_of("run", np.concatenate(sent), np.concatenate(counts), np.repeat(np.arange(40), [len(x) for x in sent]))
    assert batch.num_rows == 40
    keys, sums = exchange.counted(np.concatenate(sent), np.concatenate(counts))
    want = ppm.Trie(keys[sums > 0], sums[sums > 0], low).log_probs(keys)

    tracemalloc.start()
    got, n = exchange.received(pa.Table.from_batches([batch]))
    second = ppm.pair_runs("run", got, n)
    answer = lambda keys, sums: ppm.Trie(keys[sums > 0], sums[sums > 0], low, second).log_probs(keys)
    values, total, different = exchange.answered(got, n, lambda x: ppm.near("run", x), answer, "<f8")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (total, different) == (int(sums.sum()), int((sums > 0).sum()))
    for x, v in zip(sent, values, strict=True):
        assert np.array_equal(v, want[np.searchsorted(keys, x)])
    assert peak < 45 * sum(map(len, sent)), f"{peak / 1e6} MB"  # measured: 37 bytes a key, and 54 for the whole part at a time


@pytest.mark.parametrize("n", [0, 1, 5, 70])
def test_keys_are_summed_by_ranges(n):
    r = random.Random(n)
    found = []
    for _ in range(n):
        keys = np.array([r.randint(0, 2**64 - 1) if r.random() < 0.3 else r.randint(0, 99) for _ in range(r.randint(0, 50))], np.uint64)
        found.append(exchange.counted(keys, np.ones(len(keys), np.int64)))
    want = exchange.counted(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)]))
    assert all(np.array_equal(a, b) for a, b in zip(exchange.summed(found), want, strict=True))
