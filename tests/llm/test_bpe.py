"""The codec against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tokenguard.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return bpe.ByteBPE(PATH, P.PATTERN), t


def texts():
    r = random.Random(3)
    out = ["", " ", "\n\n a  b ", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "a" * 5000, "don't 'S 12½ 日本語 😀😀", "\x00\x01", "-" * 700, " " * 300 + "x", "é́" * 50]
    out += ["".join(r.choice("abeth .-=*#<>|'1é中\n\t") for _ in range(r.randint(1, 200))) for _ in range(800)]
    return out + ["".join(chr(r.randint(1, 0x2FFF)) for _ in range(60)) for _ in range(300)]


def test_same_as_library(both):
    own, library = both
    for text, ids in zip(texts(), own.encode_batch(texts()), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_decode_parts_of_characters(both):
    own, library = both
    for text in texts()[-100:]:
        ids = library.encode(text, add_special_tokens=False).ids[1:-1]
        assert own.decode(np.array(ids, np.uint32).tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_pair_check_is_exact(both):
    own, _ = both
    r = np.random.default_rng(5)
    a, b = r.integers(0, 50256, 4000), r.integers(0, 50256, 4000)
    alone = np.array([own.merge(own.bytes_of[x]) == [x] and own.merge(own.bytes_of[y]) == [y] for x, y in zip(a, b, strict=True)])
    want = np.array([own.merge(own.bytes_of[x] + own.bytes_of[y]) == [x, y] for x, y in zip(a, b, strict=True)])
    assert (own.compatible(a, b)[alone] == want[alone]).all() and 0 < want.sum() < len(want)


def test_query(spark, both):
    _, library = both
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = bpe.op1_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "the", "y"), (2, "the", None), (2, "the", None), (3, "a" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # ids clashes with an internal name
    got = bpe.digests(df, PATH, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in got) == [(0, True), (1, False), (2, True), (2, True), (3, True)]
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
    coded = bpe.encode(df.withColumn("ids", F.lit(1)), "doc_id", "text", PATH, P.PATTERN)
    assert {r["decoded"] for r in bpe.decode(coded, "doc_id", "ids", PATH, P.PATTERN).collect()} == {"", "the", "a" * 50_000}
