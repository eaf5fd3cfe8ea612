"""Token counts against the libraries."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tokenguard.llm import blocks, pieces, token_counts

P = pytest.importorskip("public_tokenizers")
MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.SentencePieces(MODEL)


def texts():
    r = random.Random(4)
    out = [None, "", " ", "  ", "\n", " a", "a ", "\na \n b", "▁a▁ b", "<s> </s><unk><0x41>", "\x00\x01 x", "日本語 ①Ａﬁ éé", "😀 ‍😀", "a" * 30_000, " " * 999 + "x" + " " * 77, "\t\t  \r\n", "مرحبا بالعالم", "x y　z▁"]
    return out + ["".join(r.choice("ab .,-'\n\t▁éß中😀<0x>EN  ") for _ in range(r.randint(1, 120))) for _ in range(400)]


def test_pieces_of_a_text_are_those_of_its_pre_tokens(own, model):
    for text in texts():
        words = own.split(text or "")
        assert "".join(words) == ((" " + text).replace("▁", " ") if text else "")
        assert [i for x in own.encode(words) for i in x] == model.encode(text or "") and sum(own.count(words)) == len(model.encode(text or ""))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    import sentencepiece

    lib, mine = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.pieces_of(MODEL)
    assert sum(mine.count(mine.split(text))) == len(lib.encode(text))


def test_model_that_puts_spaces_inside_pieces_is_refused(monkeypatch):
    import sentencepiece

    class Odd(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 9000 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError):
        pieces.SentencePieces(MODEL)


@pytest.mark.parametrize("size", [200, blocks.BLOCK_BYTES])
def test_counts(spark, model, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    monkeypatch.setattr(blocks, "SLICE_BYTES", min(size, blocks.SLICE_BYTES))
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("n_tokens", F.lit(2)).withColumn("block", F.lit(3)).repartition(3)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 50) for i, t in rows)
    got = token_counts.token_counts(docs, MODEL, limit=50)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_byte_level_file(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    rows = [(i, t) for i, t in enumerate([*texts(), "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "<|endoftext"])]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, P.PATTERN).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_query(spark, model):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = token_counts.op13_token_counts(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in docs.items()} and len(got) == len(docs)


def test_each_pre_token_is_counted_once(spark):
    docs = spark.createDataFrame([(i, "the same few words " * 3 + str(i % 4)) for i in range(300)], "doc_id long, text string").repartition(6)
    asked = token_counts.frequencies(docs, MODEL).select("block", F.posexplode("words").alias("at", "word"))
    assert asked.count() <= 6 * 9 and asked.select("word").distinct().count() == 4 + 1 + 4  # a space before a digit stands alone
    got = token_counts.counted(asked.select((F.shiftleft("block", token_counts.PLACES) + F.col("at")).alias("place"), "word"), MODEL)
    own = pieces.SentencePieces(MODEL)
    assert {(r["to"], r["known"] >> 32, r["known"] & 0xFFFFFFFF) for r in got.collect()} == {(r["block"], r["at"], own.count([r["word"]])[0]) for r in asked.collect()}
