"""Words, shingles and hashed n-grams of Arrow string columns, computed on whole batches with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x.astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def multipliers(at: np.ndarray, stream: int) -> np.ndarray:
    """The odd 64-bit multipliers of a stream at given places."""
    return mix((at.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(stream * 0xD1B54A32D192ED03 % 2**64)) | U64(1)


def seeds(n: int, stream: int) -> np.ndarray:
    """The first n multipliers of a stream."""
    return multipliers(np.arange(n), stream)


STRETCH = 1 << 20  # bytes that are hashed at a time
BYTE_CODE = seeds(256, 1)
BYTE_CODE[SPACES] = 0


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and row offsets (n + 1); nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of every row, A-Z lower-cased: 64-bit hashes, and rows' offsets into them.

    separators replaces the bytes between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        text = LOWER[data]
        inside = ~separators[text]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][(offsets[:-1] < len(text))]
        first[edges] = inside[edges]
        self.starts = np.flatnonzero(first)
        self.offsets = np.searchsorted(self.starts, offsets)
        code = BYTE_CODE if separators is SPACES else np.where(separators, np.uint64(0), BYTE_CODE)
        sums = np.zeros(len(self.starts), U64)
        # a stretch at a time, so that a very long text or word takes few bytes more than its own
        for a in range(int(self.starts[0]) if len(self.starts) else len(text), len(text), STRETCH):
            b = min(a + STRETCH, len(text))
            word, upto = np.searchsorted(self.starts, (a, b - 1), side="right") - (1, 0)
            begin = self.starts[word:upto]
            inside_ = np.maximum(begin, a) - a
            at = np.arange(a, b) - np.repeat(begin, np.diff(np.append(inside_, b - a)))
            longest = int(at.max()) + 1
            powers = seeds(longest, 2)[at] if longest <= STRETCH else multipliers(at, 2)
            sums[word:upto] += np.add.reduceat(code[text[a:b]] * powers, inside_)
        self.hashes = mix(sums)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's n-word shingles end to end, and row offsets.

    A row of fewer words has its whole sequence as the only shingle; a row without words has none."""
    w, offsets, counts = words.hashes, words.offsets, words.counts()
    k = seeds(n, 3)
    rows = np.repeat(np.arange(len(counts)), counts)
    total = len(w)
    if total >= n:
        sums = np.zeros(total - n + 1, U64)
        for j in range(n):
            sums += w[j : total - n + 1 + j] * k[j]
        whole = rows[: total - n + 1] == rows[n - 1 :]
        hashes, owner = mix(sums[whole]), rows[: total - n + 1][whole]
    else:
        hashes, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = [mix(np.array([(w[offsets[i] : offsets[i + 1]] * k[: counts[i]]).sum() + U64(counts[i])], U64))[0] for i in short]
        hashes, owner = np.concatenate([hashes, np.array(own, U64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every row end to end, and row offsets."""
    data, offsets = flat(column)
    head = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(head, dtype=np.int64)])[offsets]


def ngrams(units: np.ndarray, offsets: np.ndarray, n: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n adjacent units inside one row, and the row of each."""
    total = len(units)
    if total < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    k = seeds(n, stream)
    sums = np.zeros(total - n + 1, U64)
    for j in range(n):
        sums += (units[j : total - n + 1 + j].astype(U64) + U64(1)) * k[j]
    whole = rows[: total - n + 1] == rows[n - 1 :]
    return mix(sums[whole]), rows[: total - n + 1][whole]
