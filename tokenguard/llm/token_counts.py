"""Token counts without token ids: pieces are counted once for each different pre-token of the corpus.

Documents are reduced to the frequencies of their pre-tokens, in blocks that hold their different pre-tokens once. The
pre-tokens of all blocks are sorted, and the tokenizer's library counts each once, however many blocks have it; rows pass by,
so nothing is gathered. The counts are joined to the blocks that asked, and a document's count is the sum of its frequencies
times the counts. Texts move nowhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenguard.llm.blocks import blocks_of, squeezed, unsqueezed
from tokenguard.llm.common import slices, table
from tokenguard.llm.pieces import pieces_of


PLACES = 27  # bits of a pre-token's place in its block; the numbers of blocks have the others
BLOCKS = 4  # times blocks.BLOCK_BYTES: larger blocks ask for fewer pre-tokens


def frequencies(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(block, words, packed): the different pre-tokens of each block, and per document its id, size and which of them it has
    how often."""

    def make(parts: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        split, index = pieces_of(path, pattern).split, {}
        ids, sizes, at, times, ends = [], [], [], [], [0]
        place = index.setdefault
        for batch in parts:
            ids.append(batch.column(0))
            sizes.append(pa.compute.binary_length(batch.column(1)).fill_null(0).cast(pa.int64()))
            for text in batch.column(1).to_pylist():
                found = Counter(split(text or ""))
                own = np.fromiter((place(w, len(index)) for w in found), np.int32, len(found))
                order = np.argsort(own)
                at.append(np.diff(own[order], prepend=np.int32(0)))
                times.append(np.fromiter(found.values(), np.int32, len(found))[order])
                ends.append(ends[-1] + len(found))
        # gaps between places and frequencies, byte by byte, which compresses well where most are small
        planes = lambda xs: pa.array([np.ascontiguousarray(np.concatenate(xs).view(np.uint8).reshape(-1, 4).T).tobytes()] + [None] * (len(ends) - 2), pa.large_binary())
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(sizes), pa.array(ends[1:], pa.int64()), planes(at), planes(times)], ["doc_id", "n_bytes", "end", "at", "times"])
        return pa.RecordBatch.from_arrays([pa.array([list(index)], pa.list_(pa.string())), pa.array([squeezed(rows)], pa.binary())], ["words", "packed"])

    return blocks_of(docs.select("doc_id", "text"), make, "words array<string>, packed binary", "pieces", BLOCKS)


def counted(asked: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(to, known): the pieces of each row (place, word), with its place in the block. Equal words come one after the other and
    are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, 0
        for batch in slices(batches, "word", owner="pieces"):
            words, place = batch.column(1), batch.column(0).to_numpy()
            new = np.append(True, pa.compute.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)) if len(words) > 1 else np.ones(1, bool)
            different = words.filter(pa.array(new)).to_pylist()
            n = np.empty(len(different), np.int32)
            seen = different[0] == last  # the batch goes on with the word that ended the one before
            n[:1], n[seen:] = known, pieces_of(path, pattern).count(different[seen:])
            last, known = different[-1], n[-1]
            yield pa.RecordBatch.from_arrays([pa.array(place >> PLACES), pa.array((place & (1 << PLACES) - 1) << 32 | n[np.cumsum(new) - 1])], ["to", "known"])

    return asked.repartition("word").sortWithinPartitions("word").mapInArrow(run, "to long, known long")


def token_counts(docs: DataFrame, path: str, pattern: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text), as the library of the file counts: a
    sentencepiece .model, or a byte-level .json with the pattern of its words. Strings of special tokens inside texts are
    handled as that library does by default.

    Null and empty texts have no bytes and no tokens. Rows that repeat are counted each, alike; a null doc_id stays null.
    Texts are counted whole, however long. Other columns, whatever their names, are left out; an empty table gives no rows."""
    blocks = frequencies(docs, path, pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = blocks.select("block", F.posexplode("words").alias("at", "word")).select((F.shiftleft("block", PLACES) + F.col("at")).alias("place"), "word")
    worth = counted(asked, path, pattern)

    def summed(rows: pa.Table, told: pa.Table) -> pa.Table:
        n, known = np.zeros(told.num_rows, np.int64), told.column("known").to_numpy()
        n[known >> 32] = known & 0xFFFFFFFF
        docs = unsqueezed(rows.column("packed")[0].as_py())
        read = lambda k: np.ascontiguousarray(np.frombuffer(docs.column(k)[0].as_py(), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        ends, upto = docs.column("end").to_numpy(), np.append(0, np.cumsum(read("at"), dtype=np.int64))
        starts = np.append(0, ends[:-1])
        at = upto[1:] - np.repeat(upto[starts], ends - starts)
        upto = np.append(0, np.cumsum(n[at] * read("times")))[ends]
        return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": np.diff(upto, prepend=0)})

    out = blocks.select("block", "packed").groupBy("block").cogroup(worth.groupBy("to")).applyInArrow(summed, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
