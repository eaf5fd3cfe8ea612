"""Blocks of documents ask about their keys (n-grams, words, shingles), whose counts are spread over the corpus.

Documents are packed into blocks. A block sends each of its distinct keys once, with a count; keys are dealt over parts,
where the counts of all blocks meet, and a part answers each block's keys in the order asked. So a key that very many
documents hold is sent once for each block, not for each document, and text does not move.

Messages between blocks and parts would be as many as blocks times parts. With more than HUBS blocks they go through hubs
instead: a hub takes the keys of about the square root of all blocks for about the square root of all parts, adds up equal
keys, asks each part once, and hands the answers on. Messages then grow with the power 1.5 of the corpus at most, each hub
and part holds about as much whatever the corpus, and a frequent key reaches its part once for each row of hubs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenguard.llm import textkit
from tokenguard.llm.common import bounded_batches, give_back, materialize, slices

BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
HUBS = 2048  # with more blocks, hubs stand between blocks and parts
ROUND = 1 << 18  # keys of a part that are added up and answered at a time, about
RANGES = 8  # of a block's keys that are added up one after the other

Keys = tuple[str, np.ndarray, np.ndarray]  # a kind, sorted distinct keys, and their counts


def pack(docs: DataFrame, note: Callable[[pa.RecordBatch], bytes] | None = None, share: int = 1) -> DataFrame:
    """(block, packed, note): documents (with a column text) in blocks of BLOCK_BYTES / share, and what note makes of each."""
    most = BLOCK_BYTES // share
    bounded_batches(docs.sparkSession)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, block = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(whole)
            columns = [pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([note(whole) if note else b""], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "packed", "note"])

        for batch in slices(batches, "text", SLICE_BYTES):
            kept.append(batch)
            size += batch.column(text).nbytes
            if size >= most:
                yield out()
                kept, size, block = [], 0, block + 1
        if kept:
            yield out()
        kept = []
        give_back()

    return materialize(docs.mapInArrow(run, "block long, packed binary, note binary"))


def unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """counted of sorted distinct keys with their counts, a range of the keys at a time."""
    longest = max((keys for keys, _ in found), key=len, default=np.zeros(0, np.uint64))
    bounds = np.unique(longest[:: max(1, len(longest) // RANGES)][1:])
    cuts = [[0, *np.searchsorted(keys, bounds).tolist(), len(keys)] for keys, _ in found]
    done = [counted(np.concatenate([keys[c[i] : c[i + 1]] for (keys, _), c in zip(found, cuts, strict=True)]), np.concatenate([n[c[i] : c[i + 1]] for (_, n), c in zip(found, cuts, strict=True)])) for i in range(len(bounds) + 1)] if found else []
    return np.concatenate([np.zeros(0, np.uint64), *(keys for keys, _ in done)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in done)])


def narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if counts.max() <= np.iinfo(t).max)).tobytes()


def received(met: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and counts of each message."""
    keys = [unplaned(x) for x in met.column("keys").to_pylist()]
    return keys, [np.frombuffer(x, f"<i{len(x) // len(k)}") for x, k in zip(met.column("counts").to_pylist(), keys, strict=True)]


def answered(sent: list[np.ndarray], counts: list[np.ndarray], near: Callable[[np.ndarray], np.ndarray], answer: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str) -> tuple[list[np.ndarray], int, int]:
    """The values of each message's keys, the sum of all counts, and the number of different keys with a count.

    About ROUND keys are added up and answered at a time; keys for which near is equal come in the same round. A part's size
    then counts for its messages, their values and the number of each key's round, and not for the tables made of them."""
    rounds = -(-sum(map(len, sent)) // ROUND)
    values, total, different = [np.empty(len(x), dtype) for x in sent], 0, 0
    turn = [(textkit.mix(near(x)) % np.uint64(rounds)).astype(np.uint32) for x in sent]
    for r in range(rounds):
        at = [np.flatnonzero(t == r) for t in turn]
        keys, sums = counted(np.concatenate([x[i] for x, i in zip(sent, at, strict=True)]), np.concatenate([c[i].astype(np.int64) for c, i in zip(counts, at, strict=True)]))
        if not len(keys):
            continue
        found = answer(keys, sums).astype(dtype)
        for v, x, i in zip(values, sent, at, strict=True):
            v[i] = found[np.searchsorted(keys, x[i])]
        total, different = total + int(sums.sum()), different + int((sums > 0).sum())
    return values, total, different


def planes(keys: np.ndarray) -> bytes:
    """Keys byte by byte, which compresses well where neighbours are alike."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def in_order(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys put in the order in which they are asked: by part, then by key."""
    order = np.argsort(part, kind="stable")
    return keys[order], counts[order], part[order]


def cut(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal slots start, and the end."""
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    return slot[first], np.append(first, len(slot))


def rows_of(kind: str, keys: np.ndarray, counts: np.ndarray, slot: np.ndarray, **more: int) -> pa.RecordBatch:
    slots, at = cut(slot)
    m = len(slots)
    pieces = [slice(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    columns = {"kind": pa.array([kind] * m, pa.string()), "slot": pa.array(slots, pa.int64())} | {k: pa.array([v] * m, pa.int64()) for k, v in more.items()}
    columns |= {"keys": pa.array([planes(keys[p]) for p in pieces], pa.binary()), "counts": pa.array([narrow(counts[p]) for p in pieces], pa.binary())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def ask(blocks: DataFrame, kinds: dict[str, str], vocabulary: Callable[[pa.RecordBatch], Iterator[Keys]], place: Callable[[str, np.ndarray, int], np.ndarray], answer: Callable[[str, np.ndarray, np.ndarray], np.ndarray], parts: int, near: Callable[[str, np.ndarray], np.ndarray] | None = None, common: Callable[[str, list[np.ndarray], list[np.ndarray]], tuple] | None = None) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """(block, kind, slot, values): what each block gets for its keys, in the order of the slots; `told` joins them. And per
    kind the sum of all counts and the number of different keys with a count.

    kinds: the numpy type of each kind's answers. vocabulary gives a block's keys, place a key's part, and answer the values
    of a part's keys from their sums, in rounds (see answered): near gives what keys that are answered together have alike
    (the keys alone, if missing), and common what all rounds of a part need of all its messages, passed on to answer."""
    n = blocks.count()
    hubs = math.ceil(math.sqrt(n)) if n > HUBS else 0
    wide = math.ceil(parts / math.ceil(math.sqrt(parts)))  # parts of a hub

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, keys, counts in vocabulary(unpack(raw)):
                    keys, counts, part = in_order(keys, counts, place(kind, keys, parts))
                    if hubs:
                        yield rows_of(kind, keys, counts, part // wide, hub=int(textkit.mix(np.array([block], np.uint64))[0] % np.uint64(hubs)), block=block)
                    else:
                        yield rows_of(kind, keys, counts, part, hub=0, block=block)
                    del keys, counts, part
        give_back()

    def gathered(met: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sent, counts = received(met)
        return sent, *counted(np.concatenate(sent), np.concatenate([x.astype(np.int64) for x in counts]))

    def merge(met: pa.Table) -> pa.Table:
        kind, (_, keys, counts) = met.column("kind")[0].as_py(), gathered(met)
        keys, counts, part = in_order(keys, counts, place(kind, keys, parts))
        return pa.Table.from_batches([rows_of(kind, keys, counts, part, hub=met.column("hub")[0].as_py(), block=met.column("slot")[0].as_py())])

    def reply(met: pa.Table) -> pa.Table:
        kind, (sent, counts) = met.column("kind")[0].as_py(), received(met)
        shared = common(kind, sent, counts) if common else ()
        values, total, different = answered(sent, counts, lambda keys: near(kind, keys) if near else keys, lambda keys, sums: answer(kind, keys, sums, *shared), kinds[kind])
        own = pa.array((x.tobytes() for x in values), pa.binary(), size=len(values))
        del sent, counts, values
        give_back()
        first = [0] * (met.num_rows - 1)
        return pa.table({"kind": met.column("kind"), "slot": met.column("slot"), "hub": met.column("hub"), "block": met.column("block"), "values": own, "total": pa.array([total, *first], pa.int64()), "different": pa.array([different, *first], pa.int64())})

    def hand_on(met: pa.Table, told_: pa.Table) -> pa.Table:
        if not met.num_rows:
            return pa.table({"kind": pa.array([], pa.string()), "slot": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "values": pa.array([], pa.binary())})
        kind, (sent, keys, counts) = met.column("kind")[0].as_py(), gathered(met)
        values = told(told_, kind, kinds[kind])
        keys, _, part = in_order(keys, counts, place(kind, keys, parts))
        by_key = np.argsort(keys, kind="stable")
        keys, values = keys[by_key], values[by_key]
        return pa.table({"kind": met.column("kind"), "slot": met.column("slot"), "block": met.column("block"), "values": pa.array([values[np.searchsorted(keys, x)].tobytes() for x in sent], pa.binary())})

    message = "kind string, slot long, hub long, block long, keys binary, counts binary"
    sent = blocks.select("block", "packed").mapInArrow(send, message)
    if hubs:
        sent = materialize(sent)
        asked = sent.groupBy("kind", "hub", "slot").applyInArrow(merge, message)
    else:
        asked = sent
    answers = materialize(asked.groupBy("kind", "slot").applyInArrow(reply, "kind string, slot long, hub long, block long, values binary, total long, different long"))
    sums = {r["kind"]: (r["total"], r["different"]) for r in answers.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("different").alias("different")).collect()}
    if hubs:  # to a hub, an answer's block is the slot it asked for
        back = answers.select(F.col("kind").alias("of"), F.col("hub").alias("to"), F.col("block").alias("for"), "kind", "slot", "values")
        answers = materialize(sent.groupBy("kind", "hub", "slot").cogroup(back.groupBy("of", "to", "for")).applyInArrow(hand_on, "kind string, slot long, block long, values binary"))
    return answers.select("block", "kind", "slot", "values"), {k: sums.get(k, (0, 0)) for k in kinds}


def told(answers: pa.Table, kind: str, dtype: str) -> np.ndarray:
    """The values of one kind, in the order in which a block has asked."""
    mine = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("slot")
    return np.frombuffer(b"".join(mine.column("values").to_pylist()), dtype)
