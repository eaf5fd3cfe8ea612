"""Exact Jaccard join of documents' word n-gram sets through pivots.

1. Every document's set of hashed shingles is computed in numpy, block by block. Blocks ask for the document frequencies
   of their distinct shingles (see exchange), so a shingle of very many documents is gathered once for each block. Equal
   sets are found by a 128-bit digest and stand as one from here.
2. Two sets with Jaccard similarity >= t share at least t of either's shingles, so a document with more than 1 - t of its
   shingles in no other document has no partner. The others keep, rarest first, as many shared shingles as are needed to
   meet any partner in one of them (ties by hash, so the order is the same for all).
3. Among the documents that meet in a shingle, the one first in a random order is the pivot. A pivot's region holds all
   documents that meet it in some shingle, so partners share a region. Jaccard distance is a metric: with exact distances
   to the pivot, documents nearer than 1 - t are linked to it, and partners' distances to it differ by 1 - t at most.
   Rings of that width split the region; a document also enters the next ring, as a boundary document. The innermost ring
   needs no comparison, since all of it is linked to the pivot.
4. Rings are joined recursively: large ones are dealt in pairs of blocks over tasks, and inside a task new pivots split
   blocks by the same windows until they are small enough for one product of incidence matrices. All comparisons are
   exact, by integers: 100 * intersection >= 100 t * union.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenguard.llm import exchange, textkit
from tokenguard.llm.common import give_back, materialize, slices, table
from tokenguard.llm.graph import components

BLOCK = 768  # documents of a block in a ring that is split
DIRECT = 256  # documents that are compared by one matrix product
LARGE = 1 << 18  # shingles of a cell after which a worker gives its free memory back
MANY = 65535  # frequencies from here on are alike: ties by hash


def digests(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set, which together tell sets apart."""
    sums = [np.add.reduceat(np.append(textkit.mix(hashes ^ np.uint64(s)), np.uint64(0)), np.minimum(offsets[:-1], len(hashes))) * (np.diff(offsets) > 0) for s in (0, 0x5DEECE66D)]
    return [x.view(np.int64) for x in sums]


def block_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts of a block end to end, and offsets of the documents."""
    parts = [textkit.shingle_sets(textkit.Words(*textkit.flat(part.column(part.schema.get_field_index("text")))), words) for part in slices(iter([batch]), "text", 1 << 18)]
    return np.concatenate([h for h, _ in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(o) for _, o in parts])))


def rarest(sizes: np.ndarray, hashes: np.ndarray, df: np.ndarray, percent: int) -> list[np.ndarray | None]:
    """Of each document the shared shingles of step 2, rarest first, or None where it has no partner."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.flatnonzero(df > 1)
    by = shared[np.lexsort((hashes[shared], df[shared], owner[shared]))]
    at = np.searchsorted(owner[by], np.arange(len(sizes) + 1))
    needed = sizes - (sizes * percent + 99) // 100 + 1  # a partner has one of any so many shingles
    spare = needed - (sizes - np.diff(at))  # of which this many are shared with others
    return [np.sort(hashes[by[a : a + k]]).view(np.int64) if n and k > 0 else None for a, k, n in zip(at[:-1].tolist(), spare.tolist(), sizes.tolist(), strict=True)]


def profiles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest1, digest2, keys) of each row; keys are the shared shingles of step 2 or null."""
    blocks = exchange.pack(docs.select("doc_id", "text_key", F.coalesce("text", F.lit("")).alias("text")), share=12)  # rows of half a megabyte, which the JVM's collector handles like others
    parts = max(16, blocks.count() // 6)

    def vocabulary(batch: pa.RecordBatch) -> Iterator[exchange.Keys]:
        yield "shingle", *np.unique(block_sets(batch, words)[0], return_counts=True)

    def place(_: str, keys: np.ndarray, parts: int) -> np.ndarray:  # by range, so a part's keys begin alike
        return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    answers, _ = exchange.ask(blocks, {"shingle": "<u2"}, vocabulary, place, lambda _, keys, sums: np.minimum(sums, MANY), parts)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = exchange.unpack(left.column("packed")[0].as_py())
        hashes, offsets = block_sets(batch, words)
        back = np.unique(hashes, return_inverse=True)[1]
        df = exchange.told(right, "shingle", "<u2")[back]  # parts are ranges: asked in the order of the keys
        sizes = np.diff(offsets)
        one, two = digests(hashes, offsets)
        keys = pa.array(rarest(sizes, hashes, df, percent), pa.list_(pa.int64()))
        del hashes, back, df
        give_back()
        return pa.table({"doc_id": batch.column(0), "text_key": batch.column(1), "n_shingles": sizes, "digest1": one, "digest2": two, "keys": keys})

    done = blocks.select("block", "packed").groupBy("block").cogroup(answers.withColumnRenamed("block", "to").groupBy("to"))
    return materialize(done.applyInArrow(finish, "doc_id long, text_key long, n_shingles long, digest1 long, digest2 long, keys array<long>"))


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(digest1, digest2, shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, offsets = textkit.shingle_sets(textkit.Words(*textkit.flat(batch.column(0))), words)
            columns = [*(pa.array(x) for x in digests(hashes, offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["digest1", "digest2", "shingles"])
            del hashes, offsets, columns
        give_back()

    return docs.select("text").mapInArrow(run, "digest1 long, digest2 long, shingles array<long>")


class Block:
    """Shingle sets of some documents, as rows of an incidence structure over the shingles that two or more have."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(sets)), self.sizes)
        found, back, counts = np.unique(every, return_inverse=True, return_counts=True)
        shared = counts > 1
        column = np.cumsum(shared) - 1
        keep = shared[back]
        self.row, self.column, self.width = row[keep], column[back[keep]], int(shared.sum())
        self.starts = np.searchsorted(self.row, np.arange(len(sets) + 1))

    def common(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one row with others."""
        has = np.zeros(self.width + 1, bool)
        has[self.column[self.starts[pivot] : self.starts[pivot + 1]]] = True
        hits = np.append(0, np.cumsum(has[self.column]))
        return (hits[self.starts[1:]] - hits[self.starts[:-1]])[rows]

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of rows a and b, by matrix products over slices of the columns."""
        out = np.zeros((len(a), len(b)), np.float32)
        place = [np.full(len(self.sizes), -1), np.full(len(self.sizes), -1)]
        place[0][a], place[1][b] = np.arange(len(a)), np.arange(len(b))
        for start in range(0, self.width, 4096):
            m = [np.zeros((len(x), 4096), np.float32) for x in (a, b)]
            inside = (self.column >= start) & (self.column < start + 4096)
            r, c = self.row[inside], self.column[inside] - start
            for p, x in zip(place, m, strict=True):
                q = p[r]
                x[q[q >= 0], c[q >= 0]] = 1
            out += m[0] @ m[1].T
        return out.astype(np.int64)


def links(block: Block, a: np.ndarray, b: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of linked rows (one of a, one of b), recursively: a pivot of a splits both by windows of distance."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= DIRECT**2:
        both = block.products(a, b)
        union = block.sizes[a][:, None] + block.sizes[b][None] - both
        x, y = np.nonzero(100 * both >= percent * union)
        yield a[x], b[y]
        return
    pivot = a[len(a) // 2]
    far, ring = [], 1 - percent / 100
    for rows in (a, b):
        both = block.common(pivot, rows)
        far.append(1 - both / (block.sizes[rows] + block.sizes[pivot] - both))
    inner = [d <= ring + 1e-12 for d in far]
    for rows, near in zip((a, b), inner, strict=True):
        yield np.full(int(near.sum()), pivot), rows[near]
    # rows inside the ball are linked to the pivot, so pairs of two of them are no news
    for k in range(1, math.ceil(1 / ring) + 1):
        low, high = k * ring, (k + 1) * ring
        own = [(d > low + 1e-12) & (d <= high + 1e-12) & ~near for d, near in zip(far, inner, strict=True)]
        edge = [(d >= low - ring) & ((d <= low + 1e-12) | near) & ~o for d, near, o in zip(far, inner, own, strict=True)]
        parts = ((a[own[0]], b[own[1]]), (a[own[0]], b[edge[1]]), (a[edge[0]], b[own[1]]))
        for x, y in parts:
            if len(x) * len(y) >= 0.8 * len(a) * len(b):  # the pivot parts nothing: cut in halves
                for xs in np.array_split(x, 2):
                    for ys in np.array_split(y, 2):
                        yield from links(block, xs, ys, percent)
            else:
                yield from links(block, x, y, percent)


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given ones connect, one for each node at most."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, y) for x, y in parent.items() if x != y]


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def distances(met: DataFrame, percent: int) -> DataFrame:
    """(pivot, doc_id, ring, linked) of (pivot, doc_id, shingles, pivot_shingles); ring k holds distances in [k, k + 1)
    widths of 1 - percent / 100, in whole numbers throughout."""
    both = F.size(F.array_intersect("shingles", "pivot_shingles")).cast("long")
    counted = met.select("pivot", "uid", both.alias("both"), (F.size("shingles") + F.size("pivot_shingles") - both).alias("whole"))
    return counted.select("pivot", "uid", F.expr(f"cast(100 * (whole - both) div ({100 - percent} * whole) AS int)").alias("ring"), (100 * F.col("both") >= percent * F.col("whole")).alias("linked"))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for each row of docs (doc_id, text); text_key is xxhash64 of the text.

    Links join rows whose sets have 100 * intersection >= percent * union. component_id is the smallest id reachable. Null,
    empty and blank texts have no shingles and are linked with nothing; neither are rows without a doc_id, whose component
    is null. Rows that repeat a doc_id are documents of their own: each has the component that its own text reaches. Whole
    texts are used, however long; A-Z are lower-cased. Other columns are left out; an empty table gives an empty result."""
    if not 1 <= percent <= 99:
        raise ValueError("percent must be from 1 to 99")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    known = profiles(docs, words, percent)
    digest = ["digest1", "digest2"]
    # equal sets stand as one, under a number of their own
    distinct = known.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    distinct = materialize(distinct.select("*", F.monotonically_increasing_id().alias("uid")))
    keyed = known.where("keys IS NOT NULL").select("doc_id", *digest, "keys").join(distinct.withColumnRenamed("rep", "doc_id"), ["doc_id", *digest])
    keys = materialize(keyed.dropDuplicates(["uid"]).select("uid", F.explode("keys").alias("key")))
    first = F.min(F.struct(F.xxhash64("uid").alias("turn"), F.col("uid").alias("pivot"))).alias("first")
    pivots = materialize(keys.groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1").select("key", "first.pivot"))
    regions = materialize(keys.join(pivots, "key").where("uid <> pivot").select("pivot", "uid").distinct())
    wanted = regions.select("uid").unionByName(regions.select(F.col("pivot").alias("uid"))).distinct()
    wanted = materialize(wanted.join(distinct, "uid"))
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = materialize(sets_of(texts, words).join(wanted.select("uid", *digest), digest).select("uid", "shingles").dropDuplicates(["uid"]))
    met = regions.join(sets, "uid").join(sets.select(F.col("uid").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot")
    far = materialize(distances(met, percent))

    # rings: a document's own, and the next as a boundary document. Documents that are linked to the pivot need no
    # comparison among themselves, so they are boundary documents of both; rings without own documents are left out
    rows = far.select("pivot", "uid", "ring", (~F.col("linked")).alias("own")).where("ring > 0").unionByName(far.select("pivot", "uid", (F.col("ring") + 1).alias("ring"), F.lit(False).alias("own")))
    sizes = materialize(rows.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.count_if("own").alias("owned")).where("owned > 0 AND n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.join(sizes.select("pivot", "ring", blocks.alias("blocks")), ["pivot", "ring"])
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("uid", "ring"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select("pivot", "ring", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), "own", "uid").join(sets, "uid")

    def run(cell: pa.Table) -> pa.Table:
        ids = cell.column("uid").to_numpy()
        own, left = (cell.column(n).to_numpy().astype(bool) for n in ("own", "left"))
        sets = cell.column("shingles").combine_chunks()
        at, every = sets.offsets.to_numpy(), sets.values.to_numpy()
        block = Block([every[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        if cell.column("i")[0].as_py() == cell.column("j")[0].as_py():
            parts = [(np.flatnonzero(own), np.arange(len(ids)))]
        else:
            parts = [(np.flatnonzero(own & left), np.flatnonzero(~left)), (np.flatnonzero(~own & left), np.flatnonzero(own & ~left))]
        found = [x for a, b in parts for x in links(block, a, b, percent)]
        u, v = (np.concatenate([ids[x[i]] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        if len(every) > LARGE:
            del block, found
            give_back()
        return pa.Table.from_pylist([{"u": x, "v": y} for x, y in forest(u, v)], EDGE)

    edges = cells.groupBy("pivot", "ring", "i", "j").applyInArrow(run, "u long, v long")
    reached = materialize(components(edges.unionByName(far.where("linked").select(F.col("uid").alias("u"), F.col("pivot").alias("v")))))
    named = reached.withColumnRenamed("id", "uid").join(distinct.select("uid", "rep"), "uid")
    smallest = named.groupBy("component_id").agg(F.min("rep").alias("smallest"))
    homes = distinct.join(named.drop("rep").join(smallest, "component_id"), "uid", "left").select(*digest, F.coalesce("smallest", "rep").alias("component_id"))
    rows = known.select("doc_id", "text_key", "n_shingles", *digest)
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)  # no key to meet by: many rows may be so
    met = rows.where(~alone).join(homes, digest).select("doc_id", "text_key", "n_shingles", "component_id")
    return met.unionByName(rows.where(alone).select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("text_key")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n, b.n AS m, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs WHERE 100 * k >= 80 * (n + m - k) UNION SELECT v, u FROM pairs WHERE 100 * k >= 80 * (n + m - k)),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT u AS doc_id, min(v) AS m FROM reach GROUP BY u) USING (doc_id)
"""
