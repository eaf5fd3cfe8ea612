"""LM scoring: prediction by partial matching over bytes, pretrained on the training documents.

The model is a byte-context trie of ORDER symbols. A symbol seen in the longest known context costs its estimate there;
otherwise an escape is coded and the next shorter context is tried, without the symbols that the longer one has ruled out
(symbol exclusion), down to an even choice among symbols never seen. Estimates are those of escape method D: with n
occurrences of d symbols, a symbol seen c times gets (2c - 1) / 2n and the escape d / 2n. Ends of texts are symbols too,
so a score is the logarithm of a probability over all texts.

The trie grows with the corpus and is never in one place. Documents are packed into blocks. A block sends each of its
distinct (context, symbol) runs once, with its count in training documents, to the part of the context's last two
symbols, where all longer contexts meet; the part sums the counts of all blocks, and answers each block with its runs'
log-probabilities (see exchange). Only the counts of single symbols and pairs, at most 258 x 257, are broadcast. The
add-one unigram base score travels the same way, word by word.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenguard.llm import exchange, textkit
from tokenguard.llm.common import crc_mod, give_back, slices, table
from tokenguard.llm.exchange import counted, told, unpack

ORDER = 5
END, START = 256, 257  # symbols beside the bytes
SYMBOLS = 257  # that can be predicted
BITS = 9
PAIRS = 1 << 2 * BITS
LONG = 4 << 20  # bytes of a text that are taken at a time
U = np.uint64


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for every predicted symbol with its context (the symbol in the lowest bits), and the row of each."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    width = sizes + ORDER + 1
    starts = np.cumsum(width) - width
    symbols = np.full(int(width.sum()), START, np.uint64)
    row = np.repeat(np.arange(n), sizes)
    symbols[np.arange(len(data)) - offsets[:-1][row] + starts[row] + ORDER] = data
    symbols[starts + width - 1] = END
    keys = symbols.copy()
    for k in range(1, ORDER + 1):
        keys[k:] |= symbols[:-k] << U(BITS * k)
    return keys[symbols != START], np.repeat(np.arange(n), sizes + 1)


def run_parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """runs of a slice; a very long text, which is alone in its slice, is taken a stretch at a time."""
    if len(offsets) != 2 or len(data) <= LONG:
        yield runs(data, offsets)
        return
    for a in range(0, len(data), LONG):
        lead, b = min(a, ORDER), min(a + LONG, len(data))
        keys, row = runs(data[a - lead : b], np.array([0, b - a + lead]))
        last = len(keys) if b == len(data) else len(keys) - 1  # the end of a stretch is not the end of the text
        yield keys[lead:last], row[lead:last]


def place(kind: str, keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a run: by the two symbols before the predicted one. The part of a word: by its hash."""
    near = (keys >> U(BITS)) & U(PAIRS - 1) if kind == "run" else keys
    return (textkit.mix(near) % U(parts)).astype(np.int64)


def near(kind: str, keys: np.ndarray) -> np.ndarray:
    """What runs that are answered together have alike: the three symbols before the predicted one. Longer contexts are then
    whole; the next shorter ones come from pair_runs."""
    return (keys >> U(BITS)) & U((1 << 3 * BITS) - 1) if kind == "run" else keys


def pair_runs(kind: str, sent: list[np.ndarray], counts: list[np.ndarray]) -> tuple:
    """Of runs: those of the last two context symbols, with their counts in training documents, which are few."""
    if kind != "run":
        return ()
    found = [counted(keys & U((1 << 3 * BITS) - 1), n.astype(np.int64)) for keys, n in zip(sent, counts, strict=True)]
    keys, sums = exchange.summed(found)
    return keys[sums > 0], sums[sums > 0]


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, offsets and training flags of slices of a block, and the first row of each."""
    at = 0
    for part in slices(iter([batch]), "text", exchange.SLICE_BYTES):
        yield *textkit.flat(part.column(2)), part.column(1).to_numpy(zero_copy_only=False).astype(bool), at
        at += part.num_rows


def vocabulary(batch: pa.RecordBatch) -> Iterator[exchange.Keys]:
    """A block's distinct runs and words with their counts in training documents."""
    kept = {"run": [], "word": []}
    for data, offsets, train, _ in pieces(batch):
        words = textkit.Words(data, offsets)
        every = itertools.chain([("word", (words.hashes, np.repeat(np.arange(len(train)), words.counts())))], (("run", x) for x in run_parts(data, offsets)))
        for kind, (keys, row) in every:
            learned = train[row]
            once, n = np.unique(keys[learned], return_counts=True)
            others = np.unique(keys[~learned])
            kept[kind].append(counted(np.concatenate([once, others]), np.concatenate([n, np.zeros(len(others), np.int64)])))
    for kind in list(kept):
        yield kind, *exchange.summed(kept.pop(kind))


def pair_counts(batch: pa.RecordBatch) -> bytes:
    """Counts of the pairs of symbols in a block's training documents."""
    low = np.zeros(PAIRS, np.int64)
    for data, offsets, train, _ in pieces(batch):
        for keys, row in run_parts(data, offsets):
            low += np.bincount((keys[train[row]] & U(PAIRS - 1)).astype(np.int64), minlength=len(low))
    some = np.flatnonzero(low)
    return some.astype("<i8").tobytes() + low[some].tobytes()


class Trie:
    """Counts of one partition's contexts, for all orders."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: np.ndarray, second: tuple[np.ndarray, np.ndarray] | None = None):
        """keys, counts: distinct runs of training documents; low: counts of pairs, context x symbol; second: keys and counts of
        the runs of two context symbols, where keys does not hold all that end in these."""
        self.low = low
        self.level = {}
        for j in range(ORDER, 1, -1):
            keys, counts = second if second and j == 2 else counted(keys & U((1 << BITS * (j + 1)) - 1), counts)
            # contexts of one order, with the sum and the number of their symbols
            by = keys >> U(BITS)
            first = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, first) if len(by) else counts
            self.level[j] = [keys, counts, by[first], total, np.diff(np.append(first, len(by))), None, first]
        for j in range(2, ORDER + 1):  # how much the symbols of each context have in the next shorter one
            keys, *_, first = self.level[j]
            below = self.count(j - 1, keys & U((1 << BITS * j) - 1))[0]
            self.level[j][5] = np.add.reduceat(below, first) if len(keys) else below

    def count(self, j: int, keys: np.ndarray):
        """Of runs of order j: the count, and of their context the sum, the number of symbols, and what it rules out."""
        if j < 2:
            symbol = (keys & U((1 << BITS) - 1)).astype(np.int64)
            rows = self.low if j else self.low.sum(0, keepdims=True)
            at = ((keys >> U(BITS)) & U((1 << BITS) - 1)).astype(np.int64) if j else np.zeros(len(keys), np.int64)
            seen = rows > 0
            excluded = (seen * self.low.sum(0)).sum(1) if j else np.zeros(1, np.int64)
            return rows[at, symbol], rows.sum(1)[at], seen.sum(1)[at], excluded[at]
        own, counts, contexts, total, kinds, excluded, _ = self.level[j]
        find = lambda table, x: (np.minimum(at := np.searchsorted(table, x), max(0, len(table) - 1)), (at < len(table)) & (np.append(table, U(0))[np.minimum(at, len(table))] == x))
        at, there = find(own, keys)
        c = np.where(there, np.append(counts, 0)[at], 0)
        at, there = find(contexts, keys >> U(BITS))
        return c, *(np.where(there, np.append(x, 0)[at], 0) if x is not None else None for x in (total, kinds, excluded))

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms of the runs' probabilities."""
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)  # not yet coded
        gone, gone_kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # ruled out at this level
        for j in range(ORDER, -1, -1):
            c, total, kinds, excluded = self.count(j, keys & U((1 << BITS * (j + 1)) - 1))
            left, left_kinds = total - gone, kinds - gone_kinds
            use = open_ & (left > 0)
            hit = use & (c > 0)
            out[hit] += np.log((2 * c[hit] - 1) / (2 * left[hit]))
            miss = use & (c == 0)
            out[miss] += np.log(left_kinds[miss] / (2 * left[miss]))
            open_ &= ~hit
            gone, gone_kinds = excluded, kinds
        out[open_] -= np.log(SYMBOLS - gone_kinds[open_])
        return out


class Finder:
    """Positions of keys in a table of distinct ones: a hash table, and a sorted rest for clashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U(64 - max(4, int(4 * max(1, len(keys))).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        slot = self.slot(keys)
        self.slots[slot] = np.arange(len(keys))
        lost = np.flatnonzero(self.slots[slot] != np.arange(len(keys)))
        lost = lost[np.argsort(keys[lost])]
        self.lost, self.lost_keys = lost, keys[lost]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self.slot(keys)].astype(np.int64)
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = self.lost[np.searchsorted(self.lost_keys, keys[miss])]
        return at


def score(docs: DataFrame, train: str) -> tuple[DataFrame, int, int]:
    """(doc_id, train, n_words, n_known, base, score) of each row of docs (doc_id, text, and the boolean train), with the
    number of words and of different words in the training documents.

    base is the sum of log10(count + 1) over the words; score is the log10 probability of the text with its end. Null texts
    are empty. Repeated rows count each time. Without training documents every symbol costs log10(257); a null in train
    counts as false. Other columns are left out; an empty table gives an empty result."""
    spark = docs.sparkSession
    blocks = exchange.pack(docs.select("doc_id", F.coalesce(F.col(train), F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text")), pair_counts, share=2)
    parts = max(16, blocks.count())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                own = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1])], ["pair", "n"])

    low = np.zeros((1 << BITS, 1 << BITS), np.int64)
    for r in blocks.select("note").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        low[r["pair"] >> BITS, r["pair"] & (1 << BITS) - 1] = r["n"]
    shared = spark.sparkContext.broadcast(low)
    kinds = {"run": "<f8", "word": "<i8"}

    def answer(kind: str, keys: np.ndarray, sums: np.ndarray, *second: np.ndarray) -> np.ndarray:
        return Trie(keys[sums > 0], sums[sums > 0], shared.value, second).log_probs(keys) if kind == "run" else sums

    answers, sums = exchange.ask(blocks, kinds, vocabulary, place, answer, parts, near, pair_runs)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = unpack(left.column("packed")[0].as_py())
        find, value = {}, {}
        for kind, keys, counts in vocabulary(batch):
            find[kind] = Finder(exchange.in_order(keys, counts, place(kind, keys, parts))[0]) if len(keys) else None
            value[kind] = told(right, kind, kinds[kind])
        m = batch.num_rows
        scores, base, known, words_of = np.zeros(m), np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for data, offsets, flags, start in pieces(batch):
            here = slice(start, start + len(flags))
            for keys, row in run_parts(data, offsets):
                scores[here] += np.bincount(row, value["run"][find["run"](keys)], len(flags))
            words = textkit.Words(data, offsets)
            if len(words.hashes):
                counts, row = value["word"][find["word"](words.hashes)], np.repeat(np.arange(len(flags)), words.counts())
                base[here], known[here] = np.bincount(row, np.log10(counts + 1.0), len(flags)), np.bincount(row, counts > 0, len(flags))
            words_of[here] = words.counts()
        del find, value
        give_back()
        return pa.table({"doc_id": batch.column(0), "train": batch.column(1), "n_words": words_of, "n_known": known, "base": base, "score": scores / np.log(10)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = blocks.select("block", "packed").groupBy("block").cogroup(answers.withColumnRenamed("block", "to").groupBy("to")).applyInArrow(finish, f"doc_id {kind}, train boolean, n_words long, n_known long, base double, score double")
    return done, *sums["word"]


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", F.coalesce(crc_mod("doc_id", 7) != 2, F.lit(True)))
    ends = docs.where("train").count()
    scored, words, different = score(docs, "train")
    tokens, kinds = words + ends, different + (ends > 0)  # the end of a text is a token as well
    whole = F.lit(float(tokens + kinds + 1))
    base = F.col("base") + F.log10(F.lit(ends + 1.0)) - (F.col("n_words") + 1) * F.log10(whole)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
