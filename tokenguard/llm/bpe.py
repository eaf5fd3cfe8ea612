"""Byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. The proposal is the BPE encoding exactly when each proposed token
encodes to itself and no adjacent pair lets a merge cross its boundary; all pairs of a batch are tested together with
numpy. Only words that fail are merged exactly, pair by pair.

Why pairs suffice: a merge always has a higher rank than the merges that made its two sides, so ranks never fall while a
word is merged. Take the first merge that would cross a boundary of the proposal. Until then both sides grew as they do
alone, so its left part is on the right edge of the left token's merge tree and its right part on the left edge of the
right token's. It happens if its rank comes before the rank at which either part is merged inside its own token; at equal
rank the leftmost pair goes first.

Null texts count as empty. Empty texts give no tokens. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenguard.llm.common import KEPT, bounded_batches, give_back, slices, table

NEVER = 1 << 40  # later than any rank
NONE = np.int64(NEVER)
SHORT = 40  # bytes; in longer words the next pair to merge is found with a heap
SLICE_BYTES = 1 << 19  # of text that is encoded at a time; its words are Python strings
CACHED_WORDS = 300_000  # per Python worker; the cache starts anew beyond it


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBPE:
    """Codec of a byte-level BPE vocabulary file (JSON, with `model.vocab`, `model.merges`, `added_tokens`)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.ids = {to_bytes(s): i for s, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in self.ids.items():
            self.bytes_of[i] = s
        for s, i in added.items():
            self.bytes_of[i] = s.encode()
        self.find_words = regex.compile(pattern).findall
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.longest = max(map(len, self.ids))
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]

        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        rank = np.full(size, -1, np.int64)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = k
            self.made.append(made)
            left[made], right[made], rank[made] = a, b, k
        self.size = np.int64(size)
        keys = np.fromiter((a * size + b for a, b in self.rank), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]
        self.left_edge, self.right_edge = self._edge(left, rank), self._edge(right, rank)
        self.alone = np.full(size, -1, np.int8)  # 1: encodes to itself, 0: does not, -1: not known yet
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _edge(child: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token the chain of outermost parts, and the rank at which each is merged into the one above."""
        parts, ends = [np.arange(len(child))], [np.full(len(child), NONE)]
        while True:
            last = parts[-1]
            below = np.where(last >= 0, child[last], -1)
            if (below < 0).all():
                return np.stack(parts, 1), np.stack(ends, 1)
            parts.append(below)
            ends.append(np.where(below >= 0, rank[last], -1))

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; every single byte is in the vocabulary."""
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (token := ids.get(word[at:end])) is not None:
                    break
            out.append(token)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of token pairs: whether no merge crosses from a to b."""
        ok = np.ones(len(a), bool)
        (parts_a, ends_a), (parts_b, ends_b) = self.right_edge, self.left_edge
        for i in range(parts_a.shape[1]):
            some = np.flatnonzero((parts_a[a, i] >= 0) & ok)
            if not len(some):
                break
            for j in range(parts_b.shape[1]):
                some = some[(parts_b[b[some], j] >= 0) & ok[some]]
                if not len(some):
                    break
                key = parts_a[a[some], i] * self.size + parts_b[b[some], j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[at] == key, self.key_rank[at], NONE)
                ok[some] = ~((rank < NONE) & (rank < ends_a[a[some], i]) & (rank <= ends_b[b[some], j]))
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost among equals."""
        token = [self.byte_id[b] for b in word]
        n, rank, made = len(token), self.rank, self.made
        if n <= SHORT:
            ranks = [rank.get(pair, NEVER) for pair in zip(token, token[1:])]
            while ranks and (k := min(ranks)) < NEVER:
                i = ranks.index(k)
                token[i] = made[k]
                del token[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank.get((token[i - 1], token[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = rank.get((token[i], token[i + 1]), NEVER)
            return token
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(k, i) for i in range(n - 1) if (k := rank.get((token[i], token[i + 1]), NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or rank.get((token[i], token[j])) != k:
                continue
            token[i], token[j], after[i] = made[k], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((token[x], token[y]), NEVER)) < NEVER:
                    heapq.heappush(heap, (r, x))
        return [t for t in token if t >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that the cache lacks, all together."""
        words = list(words)
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        flat = np.fromiter((t for p in proposed for t in p), np.int64)
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        ends = np.cumsum(counts)
        for t in np.unique(flat[self.alone[flat] < 0]).tolist():
            self.alone[t] = self.merge(self.bytes_of[t]) == [t]
        bad = self.alone[flat] == 0
        if len(flat) > 1:
            inner = np.ones(len(flat) - 1, bool)
            inner[ends[ends < len(flat)] - 1] = False
            at = np.flatnonzero(inner)
            pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
            bad[at] |= ~self.compatible(pairs // self.size, pairs % self.size)[back]
        failing = (np.add.reduceat(bad.astype(np.int64), ends - counts) > 0).tolist() if len(flat) else []
        for word, bytes_, tokens, fails in zip(words, raw, proposed, failing, strict=True):
            self.words[word] = array("I", self.merge(bytes_) if fails else tokens).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split_added.split(t) if self.split_added and any(s in t for s in self.added) else (t,) for t in texts]
        found = [[(self.find_words(p) if p not in self.added else p) for p in ps] for ps in pieces]
        new = {w for ws in found for x in ws if isinstance(x, list) for w in x} - self.words.keys()
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = {w for ws in found for x in ws if isinstance(x, list) for w in x}
        if new:
            self.learn(new)
        get = self.words.__getitem__
        return [b"".join([y for x in ws for y in (map(get, x) if isinstance(x, list) else (self.added[x],))]) for ws in found]

    def decode(self, ids: bytes) -> str:
        """Bytes that aren't UTF-8 become U+FFFD; unknown ids give nothing."""
        known = self.bytes_of
        return b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist() if i < len(known)]).decode("utf-8", "replace")


def codec(path: str, pattern: str) -> ByteBPE:
    kept = KEPT.setdefault("bpe", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = ByteBPE(path, pattern)
    return kept[path, pattern]


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(id, ids binary, n_tokens long[, decoded string]) for each row of df.

    path must be readable on every executor, as tokenizer files are. ids holds little-endian unsigned 32-bit integers.
    decoded adds the text that the ids decode to. Repeated ids and rows stay repeated; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in slices(batches, "text", SLICE_BYTES, owner="bpe"):
            ids = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            out = [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            names = ["id", "ids", "n_tokens"]
            if decoded:
                out.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names)
            del ids, out
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids binary, n_tokens long" + ", decoded string" * decoded
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str, pattern: str) -> DataFrame:
    """(id, decoded string) for each row of df; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], ["id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text of each document.

    Null and empty texts have no tokens. Repeated rows are coded each, alike; a null doc_id stays null. Texts are coded
    whole, however long. Other columns, whatever their names, are left out; an empty table gives an empty result."""
    bounded_batches(df.sparkSession)
    coded = encode(df, "doc_id", "text", path, pattern, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
