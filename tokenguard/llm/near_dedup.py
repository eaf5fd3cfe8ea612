"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Unit vectors are compared by Euclidean distance, which cosine fixes: |x - y|^2 = 2 - 2 cos. Equal vectors stand as one
with a multiplicity. The tree has two parts:

1. Upper levels, as tables. Vectors start at a root; a node that is wide and holds many is split by centres picked
   farthest-first among a sample of its own vectors, each vector going to its nearest, and so on level by level. A node's radius is the largest distance
   found. Pairs of nodes are walked down with the levels: a pair stays only if its centres are not farther apart than both
   radii and the threshold allow. Only nodes move in this walk, no vectors.
2. Lower levels, in memory. Leaves that lie near each other are packed into groups of a bounded size, and vectors go only
   to the cells (pairs of groups) that a surviving pair of leaves falls in. There a leaf grows nested levels of nodes whose
   radii halve, and pairs of nodes are walked down together: dropped when covering radii and threshold allow no near pair,
   taken whole when even the farthest vectors are near, else compared.

Distances only bound, with slack; at the threshold the cosine of the vectors as given decides: dot / (|a| |b|) in doubles.
Leaves in which all are near all, however many, need no comparison: they are counted by their sums. A cell returns how
many links each vector has and a spanning forest, never all pairs.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenguard.llm import textkit
from tokenguard.llm.common import materialize, table
from tokenguard.llm.graph import components
from tokenguard.llm.ngram_join import forest
from tokenguard.llm.topk import matrix, usable

CHUNK = 2048  # vectors of a leaf of the upper levels, about; leaves in which all are near all may hold more
GROUP = 8192  # vectors of a group of leaves, about: a cell holds two groups
GROUP_BYTES = 16 << 20  # of a group, at most: wide vectors make smaller groups
FAN = 256  # centres that split a node, at most
SAMPLE = 1024  # vectors of a node, about, among which its centres are picked
DEPTH = 12  # upper levels, at most: nodes that are still large are then cut by hash
LEAF = 32
SLACK = 1e-7  # bounds are widened by more than rounding can change them
POINT = 1e-5  # nodes of a smaller radius are not split


GRAM = 2 * CHUNK  # nodes of fewer vectors are split with a table of their distances


class Level(list):
    """Nodes, with their centres and radii as arrays."""

    @functools.cached_property
    def centres(self) -> np.ndarray:
        return np.stack([n.centre for n in self])

    @functools.cached_property
    def coarse(self) -> np.ndarray:
        return self.centres.astype(np.float32)

    @functools.cached_property
    def radii(self) -> np.ndarray:
        return np.array([n.radius for n in self])

    @functools.cached_property
    def least_norm(self) -> float:
        return float(np.square(self.centres).sum(1).min())


class Node:
    """Vectors (positions in an array) within radius of a centre, and the nodes of the next level."""

    __slots__ = ("centre", "children", "radius", "rows")

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: np.ndarray, radius: float):
        self.rows, self.centre, self.radius, self.children = rows, centre, radius, None
        self.children = None if len(rows) <= LEAF else ()

    def split(self, x: np.ndarray) -> Level:
        """The next level, made when it is first needed: greedily chosen centres that cover all within half the radius."""
        if self.children == ():
            if self.radius <= POINT:
                self.children = None
                return Level([self])
            own, most = x[self.rows], self.radius * self.radius / 4
            alive, self.children = np.ones(len(own), bool), Level()
            near_of = neighbours(own, most) if len(own) <= GRAM else None
            for i in range(len(own)):
                if not alive[i]:
                    continue
                if near_of is None:
                    far = np.square(own - own[i]).sum(1)
                    near = np.flatnonzero(alive & (far <= most))
                    far = far[near]
                else:
                    near, far = near_of(i)
                    near, far = near[alive[near]], far[alive[near]]
                alive[near] = alive[i] = False
                if len(near) < 2:
                    self.children.append(Node(x, self.rows[i : i + 1], own[i], 0.0))
                else:
                    near = np.union1d(near, [i])
                    self.children.append(Node(x, self.rows[near], own[i], math.sqrt(max(0.0, float(far.max()))) + SLACK))
        return self.children or Level([self])


def neighbours(x: np.ndarray, most: float):
    """A function from a row to the rows within the squared distance and their squared distances.

    One product gives all; if few pairs are near, only those are kept."""
    norms = np.square(x).sum(1)
    product = x @ x.T
    i, j = np.nonzero(product >= norms.min() - most / 2)
    if len(i) > 32 * len(x):
        squares = norms[:, None] + norms[None] - 2 * product
        return lambda k: ((near := np.flatnonzero(squares[k] <= most)), squares[k][near])
    squares = norms[i] + norms[j] - 2 * product[i, j]
    i, j, squares = i[squares <= most], j[squares <= most], squares[squares <= most]
    at = np.searchsorted(i, np.arange(len(x) + 1)).tolist()
    return lambda k: (j[at[k] : at[k + 1]], squares[at[k] : at[k + 1]])


def tree(x: np.ndarray, rows: np.ndarray) -> Node:
    centre = x[rows].mean(0)
    return Node(x, rows, centre, float(np.sqrt(np.square(x[rows] - centre).sum(1).max())))


class Links:
    """Counts of links and edges of a spanning forest, collected over many node pairs."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray, least: float):
        """raw: the vectors as given, but for powers of two (scaled)."""
        self.raw, self.norm = raw, np.sqrt(np.einsum("nd,nd->n", raw, raw))
        self.x, self.copies, self.least = raw / self.norm[:, None], copies, least
        self.reach = math.sqrt(max(0.0, 2 - 2 * least))
        self.count = np.zeros(len(raw), np.int64)
        self.label = np.arange(len(raw))  # smallest position that is known to be connected
        self.edges: list[tuple[int, int]] = []

    def connect(self, u: np.ndarray, v: np.ndarray) -> None:
        """Keep edges that join what was not connected; the others need no memory."""
        a, b = self.label[u], self.label[v]
        new = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        if len(new):
            made = forest(new[:, 0], new[:, 1])
            self.edges += made
            root = np.arange(len(self.label))
            for child, parent in sorted(made):  # parents are smaller, so theirs are settled
                root[child] = root[parent]
            self.label = root[self.label]

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        """All of a are linked to all of b."""
        self.count[a] += self.copies[b].sum()
        self.count[b] += self.copies[a].sum()
        self.connect(np.full(len(a) + len(b), a[0]), np.concatenate([a, b]))

    def exact(self, a: np.ndarray, b: np.ndarray) -> None:
        same = a is b
        for start in range(0, len(a), 1024):
            part = a[start : start + 1024]
            near = np.argwhere(self.x[part] @ self.x[b].T >= self.least - 1e-6)
            i, j = part[near[:, 0]], b[near[:, 1]]
            keep = i < j if same else i != j
            i, j = i[keep], j[keep]
            # the vectors as given decide at the threshold, by one way of summing, whatever block the pair is met in
            keep = np.einsum("nd,nd->n", self.raw[i], self.raw[j]) / (self.norm[i] * self.norm[j]) >= self.least
            i, j = i[keep], j[keep]
            np.add.at(self.count, i, self.copies[j])
            np.add.at(self.count, j, self.copies[i])
            self.connect(i, j)

    def within(self, node: Node) -> None:
        """Pairs inside one node."""
        if 2 * node.radius + SLACK < self.reach:  # all are linked to all
            self.count[node.rows] += self.copies[node.rows].sum() - self.copies[node.rows]
            return self.connect(np.full(len(node.rows), node.rows[0]), node.rows)
        if node.children is None or len(node.rows) <= LEAF:
            return self.exact(node.rows, node.rows)
        nodes = node.split(self.x)
        if len(nodes) == 1 and nodes[0] is node:
            return self.exact(node.rows, node.rows)
        for child in nodes:
            if len(child.rows) > 1:
                self.within(child)
        self.between(nodes, nodes)

    def between(self, left: Level, right: Level) -> None:
        """Pairs across nodes of two lists (or of one list with itself), a level at a time."""
        same = left is right
        # first by single precision and the widest radii, then exactly for the pairs that are left
        widest = float(left.radii.max() + right.radii.max() + self.reach + SLACK)
        least = np.float32((left.least_norm + right.least_norm - widest * widest) / 2 - 1e-4)
        for start in range(0, len(left), 2048):
            i, j = np.nonzero(left.coarse[start : start + 2048] @ right.coarse.T >= least)
            i += start
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 65536):
                self.pairs(left, right, i[k : k + 65536], j[k : k + 65536])

    def pairs(self, left: Level, right: Level, i: np.ndarray, j: np.ndarray) -> None:
        apart = np.sqrt(np.square(left.centres[i] - right.centres[j]).sum(1))
        span = left.radii[i] + right.radii[j]
        for k in np.flatnonzero(apart - SLACK <= span + self.reach):
            a, b = left[i[k]], right[j[k]]
            if apart[k] + span[k] + SLACK < self.reach:
                self.whole(a.rows, b.rows)
            elif len(a.rows) * len(b.rows) <= LEAF * LEAF or a.children is None and b.children is None:
                self.exact(a.rows, b.rows)
            else:
                self.down(a, b)

    def down(self, a: Node, b: Node) -> None:
        """The next level of the wider node, or of both if their radii are alike."""
        left = a.split(self.x) if 2 * a.radius >= b.radius or b.children is None else Level([a])
        right = b.split(self.x) if 2 * b.radius >= a.radius or a.children is None else Level([b])
        if left[0] is a and right[0] is b:
            self.exact(a.rows, b.rows)
        else:
            self.between(left, right)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine in floating point and keeps squares from overflowing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.maximum(np.square(x).sum(1, keepdims=True), 1e-300))


def apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def farthest_first(x: np.ndarray, near: float, n: int) -> np.ndarray:
    """Positions of centres among unit vectors, a sample of n: each is the farthest from those before it, until all are within
    `near` of one. So every cluster of the sample has a centre.

    Where FAN centres don't do, or one does, the vectors have no such clusters. Then there are as many centres as CHUNK asks
    for, half of them the farthest and half the first of the others."""
    line, far = [0], np.square(x - x[0]).sum(1)
    while len(line) < min(FAN, len(x)) and far.max() > near * near:
        line.append(int(far.argmax()))
        far = np.minimum(far, np.square(x - x[line[-1]]).sum(1))
    if far.max() > near * near or len(line) == 1:
        few = max(16, min(FAN, 2 * math.ceil(n / CHUNK)))
        line = line[: (few + 1) // 2]
        line += [i for i in range(len(x)) if i not in set(line)][: few - len(line)]
    return np.array(line)


def split(points: DataFrame, wide: DataFrame, depth: int, batch: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """The points (uid, x, copies, node, d) of the wide nodes (node, n) in the nodes of the next level, and those nodes'
    centres (parent, node, centre), unit vectors. A node with many vectors is dealt over tasks of `batch` rows."""
    wide = wide.withColumns({"salts": F.ceil(F.col("n") / batch).cast("int"), "share": F.least(F.lit(1.0), SAMPLE / F.col("n"))})
    mine = points.join(wide, "node")
    turn = F.pmod(F.xxhash64("x", F.lit(depth)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one is there in any case, and the farthest from the node's centre, which so gets a node of its own
    ends = mine.groupBy("node").agg(F.min_by(F.struct("uid", "x"), turn).alias("c"), F.max_by(F.struct("uid", "x"), "d").alias("f"), F.first("n").alias("n"))
    first = ends.select("node", "n", F.explode(F.array("c", F.coalesce("f", "c"))).alias("c")).select("node", "n", "c.uid", "c.x")

    def pick(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("uid")
        column = sample.column("x").combine_chunks()
        x = unit(matrix(column, len(column[0])))
        order = np.argsort(textkit.mix(sample.column("uid").to_numpy().astype(np.uint64)), kind="stable")
        line = order[farthest_first(x[order], reach, sample.column("n")[0].as_py())]
        return sample.select(["node", "uid", "x"]).take(pa.array(np.sort(line)))

    sample = mine.where(turn < F.col("share")).select("node", "n", "uid", "x").unionByName(first).dropDuplicates(["node", "uid"])
    chosen = materialize(sample.groupBy("node").applyInArrow(pick, "node string, uid long, x array<double>"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        uid, column = left.column("uid"), left.column("x").combine_chunks()
        names, centres = right.column("uid").to_numpy(), right.column("x").combine_chunks()
        if not len(names) or not left.num_rows:
            return pa.table({"uid": pa.array([], pa.int64()), "x": pa.array([], column.type), "copies": pa.array([], pa.int64()), "node": pa.array([], pa.string()), "d": pa.array([], pa.float64())})
        order = np.argsort(names)
        tops = unit(matrix(centres, len(centres[0])))[order]
        best, far = np.zeros(len(column), np.int64), np.zeros(len(column))
        for a in range(0, len(column), 4096):
            x = unit(matrix(column[a : a + 4096], tops.shape[1]))
            best[a : a + 4096] = (x @ tops.T).argmax(1)
            far[a : a + 4096] = np.sqrt(np.square(x - tops[best[a : a + 4096]]).sum(1))
        parent = left.column("node")[0].as_py()
        return pa.table({"uid": uid, "x": column, "copies": left.column("copies"), "node": pa.array([f"{parent}/{u}" for u in names[order][best].tolist()], pa.string()), "d": far})

    def to_unit(batches):
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            rows: list = [None] * len(sizes)
            for size in set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                for i, v in zip(at.tolist(), unit(matrix(b.column(2).take(pa.array(at)), size)), strict=True):
                    rows[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["parent", "node", "centre"])

    salted = mine.withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int"))
    tops = chosen.join(wide.select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "node")
    tops = tops.select(F.col("node").alias("of"), F.col("salt").alias("part"), "uid", "x")
    placed = salted.select("node", "salt", "uid", "x", "copies").groupBy("node", "salt").cogroup(tops.groupBy("of", "part"))
    centres = chosen.select(F.col("node").alias("parent"), F.concat_ws("/", "node", F.col("uid").cast("string")).alias("node"), "x").mapInArrow(to_unit, "parent string, node string, centre array<double>")
    return placed.applyInArrow(nearest, "uid long, x array<double>, copies long, node string, d double"), centres


def upper_levels(unique: DataFrame, reach: float, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points (uid, x, copies, node), leaves (node, parent, centre, radius, n, sum of copies, smallest uid as anchor), and
    the pairs (a, b, whole) of leaves that may hold near pairs; whole: all of a are near all of b. Of a pair of different
    leaves one order is given; a leaf makes a pair with itself. Vectors of different lengths have different roots."""
    done: list[DataFrame] = []  # points of finished leaves
    points = unique.select("uid", "x", "copies", F.size("x").cast("string").alias("node"), F.lit(None).cast("double").alias("d"))
    stats = materialize(points.groupBy("node").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("radius"), F.sum("copies").alias("copies"), F.min("uid").alias("anchor")).withColumns({"parent": F.col("node"), "centre": F.lit(None).cast("array<double>")}))
    leaves, pairs = None, stats.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for depth in range(DEPTH + 1):
        is_wide = (F.col("n") > CHUNK) & F.coalesce(2 * F.col("radius") + SLACK >= reach, F.lit(True)) & F.lit(depth < DEPTH)
        if depth == 0:
            is_wide = F.lit(True)  # roots have no centre
        own = stats.where(~is_wide)
        leaves = own if leaves is None else leaves.unionByName(own)
        wide = stats.where(is_wide).select("node", "n")
        if depth:
            done.append(points.join(own.select("node"), "node", "left_semi"))
        if not wide.take(1):
            break
        moved, centres = split(points, wide, depth, batch, reach)
        points = materialize(moved)
        kids = points.groupBy("node").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.sum("copies").alias("copies"), F.min("uid").alias("anchor"))
        stats = materialize(kids.join(centres, "node"))
        # the pairs a level deeper: leaves stand for themselves
        line = stats.select("parent", "node", "centre", "radius").unionByName(leaves.select(F.col("node").alias("parent"), "node", "centre", "radius"))
        side = lambda k: line.select(F.col("parent").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("node", "centre", "radius")))  # noqa: E731, B023
        met = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b")))
        met = met.withColumn("apart", F.when(F.col("node_a") == F.col("node_b"), 0.0).otherwise(apart(F.col("centre_a"), F.col("centre_b"))))
        span = F.col("radius_a") + F.col("radius_b")
        met = met.where(F.col("apart") - SLACK <= span + reach)
        pairs = materialize(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (F.col("apart") + span + SLACK < reach).alias("whole")))
    every = done[0] if done else points.limit(0)
    for d in done[1:]:
        every = every.unionByName(d)
    return every.drop("d"), materialize(leaves), pairs


def packed(leaves: DataFrame, group: int) -> DataFrame:
    """(node, own, pieces): the group of each leaf. Leaves of one parent follow each other from nearest to nearest and fill
    groups of about `group` vectors; parents whose leaves would fill no half of a group join their siblings. A leaf with more
    than a group has groups of its own, cut by hash into pieces."""

    def chain(met: pa.Table) -> pa.Table:
        n, names = met.column("n").to_numpy(), met.column("node").to_pylist()
        x = np.array(met.column("centre").to_pylist(), float).reshape(len(n), -1)
        line, left = [int(np.argmin(n))], np.ones(len(n), bool)
        left[line[0]] = False
        while left.any():
            near = x @ x[line[-1]]
            near[~left] = -np.inf
            line.append(int(near.argmax()))
            left[line[-1]] = False
        own, filled, groups = [""] * len(n), 0, 0
        for i in line:
            if filled and filled + n[i] > group:
                filled, groups = 0, groups + 1
            filled += n[i]
            own[i] = f"{met.column('parent')[0].as_py()}#{groups}"
        return pa.table({"node": names, "own": own, "pieces": pa.array([1] * len(n), pa.int32())})

    small = leaves.where(F.col("n") <= group).select("parent", "node", "centre", "n")
    for _ in range(3):
        few = F.sum("n").over(Window.partitionBy("parent")) < group / 2  # a row for each leaf
        small = small.withColumn("parent", F.when(few, F.regexp_replace("parent", "/[^/]*$", "")).otherwise(F.col("parent")))
    small = small.groupBy("parent").applyInArrow(chain, "node string, own string, pieces int")
    return small.unionByName(leaves.where(F.col("n") > group).select("node", F.concat("node", F.lit("#")).alias("own"), F.ceil(F.col("n") / group).cast("int").alias("pieces")))


def cells_of(pairs: DataFrame, homes: DataFrame) -> DataFrame:
    """(i, j): the different pairs of groups, i <= j, that the pairs of leaves fall in."""
    side = lambda k: homes.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias(f"piece_{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    one, two = (F.concat(f"own_{k}", F.lit("."), F.col(f"piece_{k}").cast("string")) for k in "ab")
    return met.select(F.least(one, two).alias("i"), F.greatest(one, two).alias("j")).distinct()


def near_pairs(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id long, embedding array).

    Two vectors are linked at a cosine of `least` or more in double precision. Vectors that are null, zero, or hold null
    or non-finite components, and rows without a vec_id (their component is null, and they are kept), are linked with
    nothing. Vectors of different lengths are not linked. Rows that repeat a vec_id are vectors like others: each counts as
    a link of others, and has its own links and component. An empty table gives an empty result; other columns are left
    out."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and not above 1")
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    good = F.coalesce(usable(F.col("x")) & F.exists("x", lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    x = F.transform("x", lambda v: v + F.lit(0.0))  # -0.0 becomes 0.0
    digest = [F.xxhash64(F.lit(k), "x").alias(f"digest{k}") for k in (1, 2)]  # 128 bits: rows meet their vector by it
    usable_rows = rows.where(good).select("vec_id", x.alias("x")).select("*", *digest)
    grouped = usable_rows.groupBy("digest1", "digest2", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    unique = materialize(grouped.select("*", F.monotonically_increasing_id().alias("uid")))
    width = unique.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0]
    group = max(256, min(GROUP, GROUP_BYTES // (8 * width)))
    points, leaves, pairs = upper_levels(unique, reach, 8 * group)

    # leaves of many vectors that are all near each other, or near all of another: by their sums
    big = leaves.where(F.col("n") > CHUNK)
    sums = materialize(leaves.select("node", "copies", "anchor", (F.col("n") > CHUNK).alias("big"), (2 * F.col("radius") + SLACK < reach).alias("tight")))
    side = lambda k: sums.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("copies", "anchor", "big", "tight")))
    if big.take(1):
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        by_sum = (F.col("big_a") | F.col("big_b")) & F.when(F.col("a") == F.col("b"), F.col("tight_a")).otherwise(F.col("whole"))
        summed, pairs = materialize(pairs.where(by_sum)), materialize(pairs.where(~by_sum).select("a", "b"))
        ends = summed.select(F.col("a").alias("node"), F.col("copies_b").alias("more"), F.col("anchor_b").alias("hub")).unionByName(summed.where("a <> b").select(F.col("b").alias("node"), F.col("copies_a").alias("more"), F.col("anchor_a").alias("hub")))
        extra = ends.groupBy("node").agg(F.sum("more").alias("more"), F.min("hub").alias("hub"))
        own = summed.where("a = b").select(F.col("a").alias("node"), F.lit(True).alias("self"))
        met_sums = points.select("uid", "copies", "node").join(extra.join(own, "node", "left"), "node")
        by_sums = met_sums.select(F.col("uid").alias("u"), F.col("hub").alias("v"), (F.col("more") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("n"))
        hubs = summed.select(F.col("anchor_a").alias("u"), F.col("anchor_b").alias("v"), F.lit(0).cast("long").alias("n"))
        by_sums = materialize(by_sums.unionByName(hubs))
        skip = summed.select("a", "b")
    else:
        by_sums, skip = None, None
        pairs = pairs.select("a", "b")

    homes = materialize(packed(leaves, group))
    cells = materialize(cells_of(pairs, homes))
    n_cells = cells.count()
    members = points.join(homes, "node").withColumn("own", F.concat("own", F.lit("."), F.pmod(F.xxhash64("uid"), F.col("pieces")).cast("string")))
    both = cells.select("i", "j", F.col("i").alias("own")).unionByName(cells.where("i <> j").select("i", "j", F.col("j").alias("own")))
    sent = members.select("own", "node", "uid", "copies", "x").join(both, "own").repartition(max(1, min(4 * n_cells, 20_000)), "i", "j")
    # pairs of leaves, also of one with itself, that were counted by their sums, for the cells that hold both
    if skip is None:
        skipped = cells.limit(0).select("i", "j", F.lit("").alias("a"), F.lit("").alias("b"))
    else:
        place = lambda k: homes.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1).cast("array<string>")).alias(f"piece_{k}"))
        one, two = (F.concat(f"own_{k}", F.lit("."), f"piece_{k}") for k in "ab")
        skipped = skip.join(place("a"), "a").join(place("b"), "b").select(F.least(one, two).alias("i"), F.greatest(one, two).alias("j"), "a", "b").join(cells, ["i", "j"], "left_semi")

    def run(cell: pa.Table, without: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in "uvn"})
        column = cell.column("x").combine_chunks()
        uid, copies = cell.column("uid").to_numpy(), cell.column("copies").to_numpy()
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        found = Links(scaled(matrix(column, len(column[0]))), copies, least)
        parts = defaultdict(list)
        for at, key in enumerate(zip(cell.column("own").to_pylist(), cell.column("node").to_pylist(), strict=True)):
            parts[key].append(at)
        trees = {k: tree(found.x, np.array(v)) for k, v in sorted(parts.items())}
        left, right = ([(node, t) for (own, node), t in trees.items() if own == side] for side in (i, j))
        gone = {frozenset(x) for x in zip(without.column("a").to_pylist(), without.column("b").to_pylist(), strict=True)}
        if i == j:
            for node, t in left:
                if frozenset((node,)) not in gone:
                    found.within(t)
        if not gone:
            level = Level(t for _, t in left)
            found.between(level, level if i == j else Level(t for _, t in right))
        for at, (node, t) in enumerate(left if gone else []):
            others = Level(o for name, o in (left[at + 1 :] if i == j else right) if frozenset((node, name)) not in gone)
            if others:
                found.between(Level([t]), others)
        has = np.flatnonzero(found.count)
        # rows of counts (v is null) and of edges (n is null)
        none = [None] * len(found.edges)
        return pa.table({"u": pa.array([*uid[has].tolist(), *(int(uid[e[0]]) for e in found.edges)], pa.int64()), "v": pa.array([*[None] * len(has), *(int(uid[e[1]]) for e in found.edges)], pa.int64()), "n": pa.array([*found.count[has].tolist(), *none], pa.int64())})

    skipped = skipped.select(F.col("i").alias("k"), F.col("j").alias("l"), "a", "b")
    met = materialize(sent.groupBy("i", "j").cogroup(skipped.groupBy("k", "l")).applyInArrow(run, "u long, v long, n long"))
    if by_sums is not None:
        met = met.unionByName(by_sums)
    reached = components(met.where("v IS NOT NULL").select("u", "v"))
    names = reached.withColumnRenamed("id", "uid").join(unique.select("uid", "rep"), "uid")
    smallest = names.groupBy("component_id").agg(F.min("rep").alias("smallest"))
    linked = met.where("n IS NOT NULL").groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("n"))
    known = unique.drop("x").join(linked, "uid", "left").join(names.drop("rep").join(smallest, "component_id"), "uid", "left")
    known = materialize(known.select("digest1", "digest2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "rep").alias("component_id")))
    done = usable_rows.drop("x").join(known, ["digest1", "digest2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
  WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT u AS vec_id, count(*) AS k FROM links GROUP BY u) USING (vec_id) LEFT JOIN (SELECT u AS vec_id, min(v) AS m FROM reach GROUP BY u) USING (vec_id)
"""
