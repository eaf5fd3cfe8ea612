"""The stages of the pipeline on a small corpus, and on odd rows."""

import collections

import pytest

from tests.conftest import SMALL
from tests.llm.test_texts import brute_join

P = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(P.STAGES)
    kept = stage["language ID"](spark, docs, SMALL)
    assert kept.columns == columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows.keys() == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
    kept = stage["n-gram Jaccard join"](spark, kept, SMALL)
    want = {c for _, c in brute_join({i: r["text"] for i, r in rows.items()}).values()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == want
    clean = stage["secret scans"](spark, kept, SMALL)
    assert clean.columns == columns
    for r in clean.collect():
        assert r["text"] == before[r["doc_id"]]["text"] or "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
    mixed = stage["mixing sources to target weights"](spark, clean, SMALL)
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and max(times.values()) <= 2 and times.keys() <= want
    assert stage["BPE encoding and decoding"](spark, mixed, SMALL).count() == sum(times.values())


def test_whole_run(spark):
    assert P.run(spark, SMALL).count() > 0


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", None, 27), (4, "One two three four five six", None, "a", 27), (None, "seven eight", None, "a", 11), (5, "password=b7db7aa4a5fcc78305 é" * 200, "fr", "b", None), (6, "tail", "en", "b", 4), (6, "tail", "en", "b", 4)]
    docs = spark.createDataFrame(rows, DOCS)
    for frame in (docs, docs.limit(0)):
        kept = frame
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, SMALL)
            assert kept.columns == docs.columns
        out = P.STAGES[-1][1](spark, kept, SMALL)
        assert out.count() == kept.count()
    ids = {r["doc_id"] for r in P.STAGES[1][1](spark, P.STAGES[0][1](spark, docs, SMALL), SMALL).collect()}
    assert ids == {3, None, 5, 6}


def test_language_stage_without_labels(spark):
    rows = [(1, "some words", None, "a", 10), (2, None, None, "a", 0), (3, "12 34", None, "b", 5), (None, "é", None, None, None)]
    kept = P.identify_language(spark, spark.createDataFrame(rows, DOCS), SMALL).collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in kept) == [(0, None), (1, None)]


def test_rows_of_one_id_with_different_texts(spark):
    one, two = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z"
    docs = spark.createDataFrame([(5, one, "en", "s", 1), (5, two, "en", "s", 1), (3, one, "en", "s", 1)], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, SMALL).collect()) == [(3, one), (5, two)]


def test_secrets_without_ids_are_redacted_in_their_own_rows(spark):
    key = "AKIA" + "RQM3BCG4PHUE7WNF"
    docs = spark.createDataFrame([(None, f"x {key}", "en", "s", 22), (None, "x y", "en", "s", 3), (4, f"{key} \ue000", "en", "s", 1)], DOCS)
    got = sorted((r["text"], r["n_chars"]) for r in P.redact_secrets(spark, docs, SMALL).collect())
    assert got == [("[SECRET] \ue002", 10), ("x [SECRET]", 10), ("x y", 3)]


def test_clashing_columns_stay_as_they_are(spark):
    key = "AKIA" + "RQM3BCG4PHUE7WNF"
    names = "kept lang_pred score text_key doc_key pieces size rank copies salt component_id doc".split()
    docs = spark.createDataFrame([(i, f"the words {i} {key if i == 2 else ''}", "en", "s", 9, *[f"{n}{i}" for n in names]) for i in range(4)], DOCS + "".join(f", {n} string" for n in names))
    kept = docs
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
    assert {tuple(r[n] for n in names) for r in kept.collect()} <= {tuple(f"{n}{i}" for n in names) for i in range(4)}
    assert "[SECRET]" in {r["doc_id"]: r["text"] for r in kept.collect()}.get(2, "[SECRET]")
    assert P.STAGES[-1][1](spark, kept, SMALL).count() == kept.count()
