"""The filter audit against a plain simulation of all orders."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tokenguard.llm import audit

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def simulated(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Applies every order to the documents one by one."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    fails, parts = [], sorted({lang or "" for _, _, lang in docs})
    for i, text, lang in docs:
        text = text or ""
        ws = WORDS.findall(text)
        bad = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        fails.append((lang or "", {k for k, v in bad.items() if v}, any(x == i is not None and q == 1 for x, q, _ in labels), any(x == i is not None and t == 1 for x, _, t in labels)))
    out, total = {}, {}
    for part in parts:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for step, k in enumerate(order, 1):
                gone = [f for f in left if k in f[1]]
                everyone = [f for f in fails if f[0] == part]
                redundant = sum(k in f[1] for f in everyone) - len(gone)
                left = [f for f in left if k not in f[1]]
                out[part, order, step] = (len(left), len(gone), redundant, sum(f[1] == {k} for f in everyone), sum(f[2] for f in gone), sum(f[3] for f in gone))
                total[part, k] = total.get((part, k), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels, more=()):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    for name in more:
        d = d.withColumn(name, F.lit("x"))
    seen, filters = audit.rules()
    got = audit.interactions(audit.cells(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), seen, filters), "ABCDE")
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got.collect()}


def test_like_a_simulation_of_all_orders(spark):
    r = random.Random(5)
    long = [" ".join(f"{'W' if r.random() < 0.3 else 'w'}ord{r.randint(0, r.choice([30, 900]))}" for _ in range(r.choice([99, 100, 300]))) + r.choice(["", "#", " \x0b"]) for _ in range(12)]
    texts = [*long, None, "", " \t", "a\x0bb", "É Ü", "ABC", "é" * 9 + "A", "é" * 10 + "A"]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(200)]
    docs += [(None, long[0], "en"), (None, long[0], "en"), (7, long[1], "en"), (7, long[1], "en"), (7, long[1], None), (3, "x" * 200_000, "de"), (500, "x" * 200_000, "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99999, 1, 1)]
    assert audited(spark, docs, labels) == simulated(docs, labels)
    assert audited(spark, docs, labels, ["mask", "words", "part", "n", "digest", "quality", "step"]) == simulated(docs, labels)
    assert audited(spark, docs, []) == simulated(docs, [])


def test_empty_and_bounds(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    with pytest.raises(ValueError):
        audit.interactions(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGH")


def test_every_row_is_there_and_adds_up(spark):
    rows = audit.op12_filter_audit(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").groupBy(F.coalesce("lang", F.lit("")).alias("p")).count().collect()
    assert len(rows) == 600 * len(docs)
    sizes = {r["p"]: r["count"] for r in docs}
    for r in rows:
        assert r["kept"] + r["removed"] <= sizes[r["part"]] and (r["step"] > 1 or r["kept"] + r["removed"] == sizes[r["part"]])
