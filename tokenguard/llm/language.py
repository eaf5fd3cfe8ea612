"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased characters per language become one matrix of log-probabilities, whose size
is languages x buckets and does not depend on the data; it is broadcast. Documents are scored as sparse counts of buckets
in numpy. The model is fitted on a bounded, hash-chosen sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenguard.llm import textkit
from tokenguard.llm.common import bounded_batches, bounded_sample, crc_mod, give_back, slices, table

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 3000  # labelled documents that the model is fitted on, about, chosen by their ids' hash
LANGUAGES = 500  # the matrix is broadcast: more labels than this are refused
UNDETERMINED = "und"


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every row's character n-grams and the row of each."""
    points, offsets = textkit.code_points(pa.compute.utf8_lower(column))
    found = [textkit.ngrams(points, offsets, n, 10 + n) for n in SIZES]
    return np.concatenate([(h & np.uint64(BUCKETS - 1)).astype(np.int64) for h, _ in found]), np.concatenate([r for _, r in found])


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (languages x buckets), from (doc_id, text, lang); null labels are ignored."""
    bounded_batches(labelled.sparkSession)
    picked = bounded_sample(labelled, "lang", per_language, LANGUAGES).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 18):
            buckets, rows = grams(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + np.bincount(buckets[langs[rows] == lang], minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])

    def add(frame: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in frame.column("counts").to_pylist())
        return pa.table({"lang": frame.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = picked.select("lang", "text").mapInArrow(run, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").orderBy("lang").collect()
    counts = np.array([np.frombuffer(r["counts"], "<i8") for r in rows]).reshape(len(rows), BUCKETS) + smoothing
    return [r["lang"] for r in rows], np.log(counts / counts.sum(1, keepdims=True))


def predict(df: DataFrame, languages: list[str], log_probs: np.ndarray, sharpness: float = 0.2, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of (doc_id, text); with keep, a struct `kept` of those columns for doc_id.

    score is the posterior of the chosen language for a uniform prior, with the evidence of each n-gram taken `sharpness`
    times since n-grams overlap. Ties go to the first language in order. Null texts, texts without any letter, and all
    texts if nothing was learned, are `und` with score 0. Repeated rows are judged each; a null doc_id stays null. Texts are
    taken whole, however long. Columns that are not kept are left out; an empty table gives an empty result."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((languages, np.ascontiguousarray(log_probs.T)))
    names_kept = keep or ["doc_id"]
    inside = names_kept.index("text") if "text" in names_kept else None  # then texts go to Python once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        whole = (pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2) if inside is None else b.column(0).flatten()[inside]], ["kept", "letters", "text"]) for b in batches)
        for batch in slices(whole, "text", 1 << 18):
            n = batch.num_rows
            buckets, rows = grams(batch.column(2))
            keys, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
            row, bucket = keys // BUCKETS, keys % BUCKETS
            totals = np.stack([np.bincount(row, counts * weights[bucket, j], n) for j in range(len(names))], 1) if names else np.zeros((n, 1))
            totals = (totals - totals.max(1, keepdims=True)) * sharpness
            best = totals.argmax(1)
            odds = np.exp(totals)
            seen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool) & bool(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[b] if s else UNDETERMINED for b, s in zip(best, seen, strict=True)], pa.string()), pa.array(np.where(seen, odds.max(1) / odds.sum(1), 0.0))], ["kept", "lang_pred", "score"])
            del buckets, rows, keys, counts, row, bucket, totals, odds
        give_back()

    letters = has_letter(F.col("text")).alias("letters")
    own = df.select(F.struct(*names_kept).alias("kept"), letters, *([] if inside is not None else ["text"]))
    return own.mapInArrow(run, f"kept {own.schema['kept'].dataType.simpleString()}, lang_pred string, score double").select("kept" if keep else "kept.doc_id", "lang_pred", "score")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return predict(docs, *model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
