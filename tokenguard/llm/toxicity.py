"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Every term of the labelled examples is in the index. Term frequencies are dampened, and document frequencies are counted
over all documents, so common terms weigh little. A term also weighs more the more surely it tells toxic examples from
others. That is judged by its different left neighbours, not by documents, which keeps copies and repeated passages from
passing for evidence. Vectors are scaled to unit length.

The index keeps, term by term, the examples' weights, and for common terms each block's largest weight. For a document,
the postings of its rare terms are added up; the largest weights of its common terms bound what they can add in a block.
Only examples whose bound reaches the k-th best cosine known are looked up in the common terms, the likeliest first, so
the neighbours are exact. Their votes, weighted by 1 / (distance + 0.1), are smoothed
towards the share of toxic examples; only documents without any word of the examples get that share as it is. A logistic
curve turns votes into probabilities for equally many of both classes, as samples hold where labels are many; it is fitted
to examples that are judged by the others.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenguard.llm import textkit
from tokenguard.llm.common import bounded_batches, crc_mod, labelled, slices, table
from tokenguard.llm.quality import calibrate

SAMPLE_PER_LABEL = 3000  # labelled examples of each class, about
NEIGHBOURS, BLOCK = 15, 64
COMMON = 2  # terms of more than one in so many examples are common
ERRORS, GAIN = 1.5, 4.0  # of a term's weight: standard errors held back from its log odds, and the gain on what is left
SMOOTHING = 0.25  # votes for the base score
CALIBRATION = 1000  # examples, about, that the curve is fitted to
THRESHOLD = 0.7

SEPARATORS = np.ones(256, bool)  # words are runs of letters, digits and bytes of other scripts
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and the row of each."""
    words = textkit.Words(*textkit.flat(column), SEPARATORS)
    return words.hashes, np.repeat(np.arange(len(column)), words.counts())


def associate(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all terms, and the weight of each: above 1 as far as it surely tells the classes apart.

    A term counts once for each left neighbour in toxic and in other examples. What its log odds exceed their standard
    errors by is added, on either side."""
    sides = []
    for label in (True, False):
        own = [r for r, t in zip(rows, toxic, strict=True) if t == label and len(r)]
        term = np.concatenate([np.zeros(0, np.uint64), *own])
        left = np.concatenate([np.zeros(0, np.uint64), *(np.append(np.uint64(0), r[:-1]) for r in own)])
        sides.append(term[np.unique(textkit.mix(term ^ textkit.mix(left + np.uint64(1))), return_index=True)[1]])
    terms, which = np.unique(np.concatenate(sides), return_inverse=True)
    a, b = (np.bincount(w, minlength=len(terms)) for w in (which[: len(sides[0])], which[len(sides[0]) :]))
    odds = np.log((a + 0.5) / max(1, a.sum())) - np.log((b + 0.5) / max(1, b.sum()))
    sure = np.maximum(0, np.abs(odds) - ERRORS * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    return terms, 1 + GAIN * np.square(sure)


def term_counts(hashes: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the terms' occurrences."""
    if not len(terms):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = terms[at] == hashes
    keys, counts = np.unique(rows[hit] * len(terms) + at[hit], return_counts=True)
    return keys // len(terms), keys % len(terms), counts


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, end) end to end."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Postings:
    """A sparse matrix, terms x examples; [terms] gives rows of it, filled in."""

    def __init__(self, first: np.ndarray, at: np.ndarray, value: np.ndarray, n: int):
        self.first, self.at, self.value, self.n = first, at, value, n

    def __getitem__(self, term: np.ndarray) -> np.ndarray:
        out = np.zeros((len(term), self.n))
        p = spans(self.first[term], self.first[term + 1])
        out[np.repeat(np.arange(len(term)), self.first[term + 1] - self.first[term]), self.at[p]] = self.value[p]
        return out


class Index:
    """Unit vectors of the examples that have a term, as postings, and their blocks' largest weights."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray):
        self.terms, self.idf = terms, idf
        self.curve: tuple[float, float] | None = None  # slope and offset
        self.base = float((labels.sum() + 0.5) / (len(labels) + 1))
        row, term, count = term_counts(np.concatenate([np.zeros(0, np.uint64), *rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), terms)
        value = (1 + np.log(count)) * idf[term]
        value /= np.sqrt(np.bincount(row, np.square(value), len(rows)))[row] if len(row) else 1.0
        has = np.unique(row)
        strongest = np.lexsort((-value, row))[np.searchsorted(row, has)]
        order = has[np.lexsort((ids[has], term[strongest]))]  # likes together: tight bounds
        self.ids, self.labels = ids[order], labels[order].astype(float)
        place = np.zeros(len(rows), np.int32)
        place[order] = np.arange(len(order))
        at = place[row]
        by_term = np.lexsort((at, term))
        term, at, value = term[by_term], at[by_term], value[by_term]
        self.weights = Postings(np.searchsorted(term, np.arange(len(terms) + 1)), at, value, len(order))
        self.blocks = -(-len(order) // BLOCK)
        # common terms: their largest weight in each block
        often = np.diff(self.weights.first) > max(BLOCK, len(order) // COMMON)
        self.place = np.where(often, np.cumsum(often) - 1, -1)
        mine = often[term]
        self.most = np.zeros((int(often.sum()), self.blocks))
        np.maximum.at(self.most, (self.place[term[mine]], at[mine] // BLOCK), value[mine])

    @functools.cached_property
    def dense(self) -> np.ndarray:
        """Weights of the common terms, terms x examples, filled in where the index is used."""
        return self.weights[np.flatnonzero(self.place >= 0)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "dense"}

    def nearest(self, term: np.ndarray, weight: np.ndarray, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, ties to the smaller id; but those with the id `but`."""
        own = self.place[term]
        rare, w = own < 0, weight[own >= 0]
        row = own[own >= 0]
        start, end = self.weights.first[term[rare]], self.weights.first[term[rare] + 1]
        p = spans(start, end)
        score = np.bincount(self.weights.at[p], np.repeat(weight[rare], end - start) * self.weights.value[p], len(self.ids)).astype(float)
        if but is not None:
            score[self.ids == but] = -np.inf
        bound = score + np.repeat(w @ self.most[row], BLOCK)[: len(score)] if len(row) else score
        found, cosine = np.zeros(0, np.int64), np.zeros(0)
        least = np.partition(score, -NEIGHBOURS)[-NEIGHBOURS] if len(score) > NEIGHBOURS else -np.inf
        left = np.flatnonzero((bound > 0) & (bound >= least - 1e-11))
        left = left[np.argsort(-bound[left], kind="stable")]
        for now in (left[: 4 * NEIGHBOURS], left[4 * NEIGHBOURS :]):  # the likeliest raise what the others must reach
            now = now[bound[now] >= least - 1e-11]
            exact = score[now] + w @ self.dense[np.ix_(row, now)] if len(row) else score[now]
            found, cosine = np.concatenate([found, now[exact > 0]]), np.concatenate([cosine, exact[exact > 0]])
            best = np.lexsort((self.ids[found], -np.round(cosine, 12)))[:NEIGHBOURS]
            found, cosine = found[best], cosine[best]
            least = cosine[-1] if len(cosine) == NEIGHBOURS else least
        return found, cosine

    def votes(self, term: np.ndarray, count: np.ndarray, but: int | None = None) -> tuple[float, list[int]]:
        """The weighted share of toxic neighbours, and the neighbours."""
        if not len(term):
            return self.base, []
        weight = (1 + np.log(count)) * self.idf[term]
        found, cosine = self.nearest(term, weight / np.sqrt(weight @ weight), but)
        votes = 1 / (1 - np.minimum(cosine, 1) + 0.1)
        return float((votes @ self.labels[found] + SMOOTHING * self.base) / (votes.sum() + SMOOTHING)), self.ids[found].tolist()

    def judge(self, term: np.ndarray, count: np.ndarray) -> tuple[float, list[int]]:
        share, evidence = self.votes(term, count)
        return share if self.curve is None else float(1 / (1 + np.exp(-(self.curve[0] * share + self.curve[1])))), evidence


def fit(docs: DataFrame, sample: DataFrame) -> Index:
    """The index of the labelled sample (doc_id, text, label), with document frequencies over all docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, rows = words_of(batch.column(1))
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), batch.column(2)], ["doc_id", "words", "label"])

    got = sample.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int")).mapInArrow(run, "doc_id long, words binary, label int").toPandas().sort_values(["doc_id", "words"])
    rows = [np.frombuffer(x, np.uint64) for x in got["words"]]
    labels, ids = got["label"].to_numpy(), got["doc_id"].to_numpy(np.int64)
    terms, strength = associate(rows, labels == 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(len(terms), np.int64)
        for batch in slices(batches, "text"):
            total += batch.num_rows
            df += np.bincount(term_counts(*words_of(batch.column(0)), terms)[1], minlength=len(terms))
        here = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *here.tolist()], pa.int32()), pa.array([total, *df[here].tolist()], pa.int64())], ["term", "n"])

    df, total = np.zeros(len(terms), np.int64), 0
    if len(terms):
        sums = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, n = sums["term"].to_numpy(), sums["n"].to_numpy()
        df[term[term >= 0]], total = n[term >= 0], n[term < 0].sum()
    idf = strength * (np.log((1 + total) / (1 + df)) + 1)
    index = Index(terms, idf, rows, labels, ids)
    if len(set(labels.tolist())) == 2:
        index.curve = curve(sample, index)
    return index


def curve(sample: DataFrame, index: Index) -> tuple[float, float]:
    """Slope and offset from votes to probabilities, by examples that are judged without themselves."""
    shared = sample.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, term, count = term_counts(*words_of(batch.column(1)), shared.value.terms)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.votes(term[a:b], count[a:b], i)[0] for i, a, b in zip(ids, at[:-1], at[1:], strict=True)], pa.float64()), batch.column(2)], ["share", "label"])

    some = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(1 << 30)) < F.lit(min(1 << 30, (CALIBRATION << 30) // max(1, len(index.ids)))))
    got = some.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int")).mapInArrow(run, "share double, label int").toPandas().sort_values(["share", "label"])
    return calibrate(got["share"].to_numpy(), np.where(got["label"].to_numpy() == 1, 1, -1), even=True) if got["label"].nunique() == 2 else (1.0, 0.0)




def score(df: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence) for each row of (doc_id, text); evidence holds the ids of the neighbours that voted.

    Null and empty texts, like all without a word of the examples, get the base score and no evidence. Equally near examples
    are taken by their ids. Repeated rows are scored each; a row without a doc_id keeps its null. Texts are taken whole,
    however long. Other columns, whatever their names, are left out; an empty table gives an empty result."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[bytes, tuple[float, list[int]]] = {}
        for batch in slices(batches, "text"):
            row, term, count = term_counts(*words_of(batch.column(1)), own.terms)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                key = hashlib.blake2b(term[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest()
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = own.judge(term[a:b], count[a:b])
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<long>")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = fit(docs, labelled(docs, labels.where(crc_mod("doc_id", 3) != 1), "toxic", SAMPLE_PER_LABEL))
    return score(docs, index).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
