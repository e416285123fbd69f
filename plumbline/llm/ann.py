"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is then put into a leaf. A query walks the tree through a priority
queue of branches, nearest centroid first, and so orders the leaves; how many it visits is widened until calibration
queries, compared with brute force over all rows, reach the recall asked for. Queries meet the rows of a leaf in blocks
of bounded size, so that a leaf with a third of all rows is spread over many tasks; a row is sent once for each block of
the queries that visit its leaf, and not at all where none does.

Vectors that are null, zero, of another length than most, or hold a null or non-finite number take no part. Rows with
the query's own id are not its neighbours. Ties go to the smaller id. An empty table gives an empty table; with fewer
candidates than asked for, all are returned. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.llm.common import mix

#: Rows that the tree is fitted on at most, rows a leaf shall hold, children of a node, calibration queries.
FIT_ROWS, LEAF_ROWS, BRANCHES, CALIBRATION_QUERIES = 20_000, 512, 8, 128

#: Rows and queries that meet in one task at most, on average.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 4096


class Tree(NamedTuple):
    """centres: unit vectors of the nodes, the root first; children: node numbers; leaf: its leaf number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x, by the nearest child at each node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            best = np.argmax(x[rows] @ self.centres[kids].T, axis=1)
            todo += [(kid, part) for k, kid in enumerate(kids) if len(part := rows[best == k])]
        return out

    def best_bins(self, x: np.ndarray) -> Iterator[int]:
        """Leaf numbers for the unit vector x, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                near = sorted(zip(-(self.centres[self.children[node]] @ x), self.children[node], strict=True))
                for branch in near[1:]:
                    heapq.heappush(queue, branch)
                node = near[0][1]
            yield self.leaf[node]


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres and the centre of each row, by cosine."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        mine = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres, np.argmax(x @ centres.T, axis=1)


def fit(sample: np.ndarray, leaves: float, branches: int = BRANCHES, seed: int = 9) -> Tree:
    """A tree over the unit vectors of sample, split until a leaf holds about a share of 1/leaves of them."""
    rng, small = np.random.default_rng(seed), max(8, len(sample) / max(1.0, leaves))
    centres, children, leaf, todo = [np.zeros(sample.shape[1])], [[]], [-1], [(0, np.arange(len(sample)))]
    n_leaves = 0
    while todo:
        node, rows = todo.pop()
        k = min(branches, int(np.ceil(len(rows) / small)))
        parts: list = []
        if k > 1:
            found, mine = k_means(sample[rows], k, rng)
            parts = [(found[i], rows[mine == i]) for i in range(k) if np.any(mine == i)]
        if len(parts) < 2:
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            continue
        for centre, part in parts:
            children[node].append(len(centres))
            todo.append((len(centres), part))
            centres.append(centre)
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centres), children, leaf)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors, each over a power of two near its largest component: that changes no cosine, and no square leaves the
    range of doubles."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    far = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
    return np.ldexp(x, -far[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def cosines(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, the ids of its k nearest rows (ties to smaller ids), and their cosines."""
    if not len(rows):
        return
    norms = np.sqrt((rows * rows).sum(1))
    rough = unit(queries) @ (rows / norms[:, None]).T
    for i, q in enumerate(queries):
        mine = ids != own[i]
        near = np.flatnonzero(mine)
        if len(near) > k:
            least = np.partition(rough[i, near], len(near) - k)[len(near) - k]
            near = near[rough[i, near] >= least - 1e-9]  # the product of matrices rounds equal rows differently
        exact = (rows[near] * q).sum(1) / (norms[near] * np.sqrt((q * q).sum()))
        order = np.lexsort((ids[near], -exact))[:k]
        yield i, ids[near][order], exact[order]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.96, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row with is_query its k nearest others found."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    answer = "query_id long, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]
    rows = rows.where(F.size("v") == dim)
    # A bounded sample: the rows of smallest hash.
    sample = rows.select("v").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, FIT_ROWS / total))).limit(2 * FIT_ROWS).toArrow()
    if not sample.num_rows:
        sample = rows.select("v").limit(FIT_ROWS).toArrow()
    tree = fit(unit(matrix(sample["v"].combine_chunks(), dim)), total / LEAF_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.leaf_of(unit(matrix(b.column("v"), dim)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(leaf)], names=["id", "v", "leaf"])

    placed = rows.select("id", "v").mapInArrow(place, "id long, v array<double>, leaf long")
    held = dict(placed.groupBy("leaf").agg(F.count("*").alias("n")).collect())  # one number for each leaf of the tree
    visits = calibrate(rows, placed, tree, dim, k, recall)
    row_blocks = {leaf: max(1, -(-n // BLOCK_ROWS)) for leaf, n in held.items()}

    def visited(x: np.ndarray) -> Iterator[int]:
        met = 0
        for turn, leaf in enumerate(tree.best_bins(x)):
            if turn >= visits and met > k:
                return
            met += held.get(leaf, 0)
            yield leaf

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for b in batches:
            for x in unit(matrix(b.column("v"), dim)) if b.num_rows else ():
                met.update(visited(x))
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int64()), pa.array(list(met.values()), pa.int64())], names=["leaf", "n"])

    counts = rows.where("q").select("v").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect()  # one number for each leaf
    query_blocks = {leaf: -(-n // BLOCK_QUERIES) for leaf, n in counts}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"leaf": [], "block": [], "query_block": [], "n": []}
            for i, x in enumerate(unit(matrix(b.column("v"), dim)) if b.num_rows else ()):
                for leaf in visited(x):
                    for block in range(row_blocks.get(leaf, 0)):
                        for name, value in zip(out, (leaf, block, hash(b.column("id")[i].as_py()) % query_blocks[leaf], i), strict=True):
                            out[name].append(value)
            n = pa.array(out.pop("n"), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").take(n), b.column("v").take(n), *(pa.array(v, pa.int64()) for v in out.values())], names=["id", "v", *out])

    keys = ["leaf", "block", "query_block"]

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in place(batches):
            leaf, ids = np.asarray(b.column("leaf")), np.asarray(b.column("id"))
            n = np.array([row_blocks.get(x, 1) for x in leaf.tolist()], np.uint64)
            block = (mix(ids.astype(np.uint64)) % n).astype(np.int64)
            ways = np.array([query_blocks.get(x, 0) for x in leaf.tolist()])
            at = np.repeat(np.arange(len(ids)), ways)
            query_block = np.arange(len(at)) - np.repeat(np.cumsum(ways) - ways, ways)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), pa.array(block[at]), pa.array(query_block)], names=["id", "v", *keys])

    asked = rows.where("q").select("id", "v").mapInArrow(walk, "id long, v array<double>, leaf long, block long, query_block long")
    offered = rows.select("id", "v").mapInArrow(offer, "id long, v array<double>, leaf long, block long, query_block long")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = [[], [], []]
        if left.num_rows and right.num_rows:
            own, ids = np.asarray(left["id"]), np.asarray(right["id"])
            for i, near, score in cosines(matrix(left["v"].combine_chunks(), dim), matrix(right["v"].combine_chunks(), dim), ids, own, k):
                found[0].append(np.full(len(near), own[i]))
                found[1].append(near)
                found[2].append(score)
        columns = [np.concatenate(x) if x else [] for x in found]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    pairs = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(compare, answer)
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def calibrate(rows: DataFrame, placed: DataFrame, tree: Tree, dim: int, k: int, recall: float, n: int = CALIBRATION_QUERIES) -> int:
    """The fewest leaves that give the recall asked for, over at most n of the queries against all rows."""
    chosen = rows.where("q").orderBy(F.xxhash64("id"), "id").select("id", "v").limit(n).toArrow()
    if not chosen.num_rows or tree.leaves < 2:
        return 1
    own, q = np.asarray(chosen["id"]), matrix(chosen["v"].combine_chunks(), dim)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, leaf = np.asarray(b.column("id")), np.asarray(b.column("leaf"))
            leaf_of = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
            for i, near, score in cosines(q, matrix(b.column("v"), dim), ids, own, k):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(near), pa.int32()), pa.array(near), pa.array(score), pa.array([leaf_of[x] for x in near.tolist()], pa.int64())], names=["i", "id", "score", "leaf"])

    best = placed.mapInArrow(brute, "i int, id long, score double, leaf long")
    order = F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "id"))
    truth = best.withColumn("r", order).where(F.col("r") <= k).select("i", "leaf").collect()  # k rows for each of n queries
    turn = [{leaf: t for t, leaf in enumerate(tree.best_bins(x), 1)} for x in unit(q)]
    needed = np.sort([turn[r.i][r.leaf] for r in truth])
    visits = 1
    while len(needed) and np.mean(needed <= visits) < recall:
        visits += 1
    return visits
