"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Distinct vectors, scaled to length one, are the tree's points. The tree is fitted
on a bounded sample: a node's points are split in up to BRANCH groups by k-means,
and so on until a node stands for LEAF vectors of the table or has too few sample
points to split. Every vector of the table then goes down to the nearest centre
at each node and lies in one leaf.

A query goes down the same way, but keeps the branches that it passes by in a
priority queue, nearest centre first, and goes on with the best of them until it
has visited enough leaves. How many are enough is measured: for a sample of
vectors the exact neighbours are found in the whole table, and the visits are
widened until so large a share of them lies in visited leaves (RECALL).

Leaves meet their queries by shuffle. A leaf with many vectors or many queries is
dealt out in blocks, every vector block with every query block; a group answers
with its best few for each query, and the best of these remain. Groups of equal
vectors count as one, and only the ids that could be answered (NEAREST and the
query's own) stay with it.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, are neither queries nor candidates; vectors of another length than
the query's are no candidates; a repeated row is a candidate for its twin, and
repeated queries are each answered; null ids come last among ties and are no
queries; with fewer candidates all are given; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut

NEAREST, EVERY = 5, 50
#: Vectors the tree is fitted on, and components they may have together; vectors that calibrate it, and the recall they must reach.
SAMPLE, SAMPLE_PARTS, CALIBRATION, RECALL = 65_536, 8 << 20, 256, 0.97
#: Children of a node, vectors of the table a leaf aims at, sample points a node needs to be split, rounds of k-means.
BRANCH, LEAF, LEAST, ROUNDS = 16, 512, 32, 8
#: Components of vectors, and queries, that one group holds.
PARTS, QUERIES = 1 << 20, 1_024
STEP = 4_000


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


class Tree:
    """Nested k-means groups of unit vectors; leaves are numbered from ``first``."""

    def __init__(self, points: np.ndarray, leaf_points: float, first: int, seed: int = 11):
        self.rng, self.leaf_points, self.first, self.leaves = np.random.default_rng(seed), leaf_points, first, 0
        self.root = self._grow(points)

    def _grow(self, points: np.ndarray) -> Node:
        k = min(BRANCH, int(len(points) // max(self.leaf_points, LEAST / 2)))
        if k >= 2:
            centres = self._centres(points, k)
            own = nearest(points, centres)
            used = np.unique(own)
            if len(used) > 1:
                return Node(centres[used], [self._grow(points[own == c]) for c in used])
        self.leaves += 1
        return Node(leaf=self.first + self.leaves - 1)

    def _centres(self, points: np.ndarray, k: int) -> np.ndarray:
        centres = points[self.rng.choice(len(points), k, replace=False)]
        for _ in range(ROUNDS):
            own = nearest(points, centres)
            total = np.zeros_like(centres)
            np.add.at(total, own, points)
            length = np.sqrt((total * total).sum(axis=1, keepdims=True))
            centres = np.where(length > 1e-12, total / np.maximum(length, 1e-12), centres)
        return centres

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point."""
        out = np.empty(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node.centres is None:
                out[at] = node.leaf
                continue
            own = nearest(points[at], node.centres)
            todo += [(child, at[own == c]) for c, child in enumerate(node.children) if (own == c).any()]
        return out

    def visits(self, point: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first search for a point."""
        queue, n = [(0.0, 0, self.root)], 0
        while queue:
            node = heapq.heappop(queue)[2]
            while node.centres is not None:
                near = node.centres @ point
                best = int(near.argmax())
                for c, child in enumerate(node.children):
                    if c != best:
                        n += 1
                        heapq.heappush(queue, (-float(near[c]), n, child))
                node = node.children[best]
            yield node.leaf


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest to each point."""
    return np.concatenate([(points[i : i + STEP] @ centres.T).argmax(axis=1) for i in range(0, max(len(points), 1), STEP)])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    # powers of two scale exactly and keep sums of squares finite
    return x / 2.0 ** np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True)))


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    return np.cumsum(x * y, axis=1)[:, -1]


def best(x: np.ndarray, y: np.ndarray, least: np.ndarray, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x its k nearest rows of y, ties to the smaller ``least``: row of x, row of y, cosine.

    A matrix product finds all that may belong to them; these are measured pair by pair, so that a pair's
    cosine is the same wherever it meets. ``leave`` marks pairs that do not count.
    """
    x, y = scaled(x), scaled(y)
    nx, ny = (np.sqrt(in_order(v, v)) for v in (x, y))
    rough = (x / nx[:, None]) @ (y / ny[:, None]).T
    if leave is not None:
        rough[leave] = -2
    limit = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(x), -1.5)
    i, j = np.nonzero(rough >= np.maximum(limit - 1e-9, -1.5)[:, None])
    score = np.concatenate([in_order(x[i[a : a + STEP]], y[j[a : a + STEP]]) for a in range(0, max(len(i), 1), STEP)]) / (nx[i] * ny[j])
    order = np.lexsort((least[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    few = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[few], j[few], score[few]


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def by_length(batches: Iterator[pa.RecordBatch], column: str = "embedding") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches whose vectors have one length."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            sizes = part.column(column).value_lengths().to_numpy()
            for dims in np.unique(sizes).tolist():
                yield dims, part.filter(pa.array(sizes == dims))


def _plain(vector: str) -> Column:
    # zeros of either sign are equal
    return F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))


def distinct(vectors: DataFrame) -> DataFrame:
    """(embedding, ids, least): vectors that take part, each once, with their smallest ids, one more than are answered.

    The window keeps its first few rows before the shuffle, so a vector that very many rows share moves few.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _plain("embedding").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.where(good)
    first = Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= NEAREST + 1)
    few = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.count("*").cast("int").alias("rows"))
    # a list leaves nulls out; they come last
    ids = F.concat("ids", F.array_repeat(F.lit(None).cast("long"), F.col("rows") - F.size("ids")))
    return few.select("embedding", ids.alias("ids"), F.coalesce(F.element_at(ids, 1), F.lit((1 << 63) - 1)).alias("least"))


def fit(points: DataFrame, n: int, leaf: int = LEAF) -> dict[int, Tree]:
    """A tree for each length of vectors, from about SAMPLE of the n distinct ones (fewer if they are long), taken by their hash."""
    longest = points.agg(F.max(F.size("embedding"))).first()[0] or 1
    share = min(1.0, SAMPLE / max(n, 1), SAMPLE_PARTS / (max(n, 1) * longest))
    some = points.where(F.pmod(F.xxhash64("embedding", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding")
    found: dict[int, list] = {}
    for dims, part in by_length(some.toArrow().to_batches()):
        found.setdefault(dims, []).append(matrix(part.column("embedding")))
    trees, first = {}, 0
    for dims in sorted(found):
        x = unit(np.concatenate(found[dims]))
        # the sample's order is not that of a run's partitions
        trees[dims] = Tree(x[np.lexsort(x.T)], leaf * share, first)
        first += trees[dims].leaves
    return trees


def placed(points: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(node, least, embedding, leaf): a length that no sampled vector has is a leaf of its own."""
    base = sum(t.leaves for t in trees.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in by_length(batches):
            leaf = trees[dims].place(unit(matrix(part.column("embedding")))) if dims in trees else np.full(part.num_rows, base + dims, np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], names=[*part.schema.names, "leaf"])

    return points.mapInArrow(run, "node long, least long, embedding array<double>, leaf int")


def calibrated(index: DataFrame, n: int, trees: dict[int, Tree], recall: float = RECALL) -> int:
    """Leaves to visit so that such a share of the sample's exact neighbours lies in them."""
    share = min(1.0, CALIBRATION / max(n, 1))
    some = index.where(F.pmod(F.xxhash64("embedding", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30)))
    probes: dict[int, list] = {}
    for r in some.select("node", "embedding").orderBy("node").collect():
        probes.setdefault(len(r.embedding), []).append((r.node, r.embedding))
    known = {d: (np.array([p for p, _ in v]), np.array([x for _, x in v])) for d, v in probes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in by_length(batches):
            if dims in known:
                own, x = known[dims]
                node, least = part.column("node").to_numpy(), part.column("least").to_numpy()
                i, j, score = best(x, matrix(part.column("embedding")), least, NEAREST, own[:, None] == node[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(score), pa.array(least[j]), part.column("leaf").take(pa.array(j))], names=["probe", "score", "least", "leaf"])

    near = Window.partitionBy("probe").orderBy(F.desc("score"), "least")
    exact = index.mapInArrow(run, "probe long, score double, least long, leaf int").withColumn("r", F.row_number().over(near)).where(F.col("r") <= NEAREST)
    wanted: dict[int, list] = {}
    for r in exact.select("probe", "leaf").collect():
        wanted.setdefault(r.probe, []).append(r.leaf)
    late = []  # the visit that meets each exact neighbour
    for dims, (own, x) in known.items():
        for probe, point in zip(own.tolist(), unit(x)):
            need, left = wanted.get(probe, []), set(wanted.get(probe, []))
            for nth, leaf in enumerate(trees[dims].visits(point) if dims in trees else (), 1):
                if not left:
                    break
                if leaf in left:
                    left.discard(leaf)
                    late += [nth] * need.count(leaf)
    visits = 1
    while late and np.mean(np.array(late) <= visits) < recall:
        visits += 1
    return visits


def visited(queries: DataFrame, trees: dict[int, Tree], visits: int) -> DataFrame:
    """(query, embedding, leaves) for each query."""
    base = sum(t.leaves for t in trees.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in by_length(batches):
            leaves = []
            for point in unit(matrix(part.column("embedding"))):
                order = trees[dims].visits(point) if dims in trees else iter([base + dims])
                leaves.append([leaf for _, leaf in zip(range(visits), order)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.list_(pa.int32()))], names=[*part.schema.names, "leaves"])

    return queries.mapInArrow(run, "query long, embedding array<double>, leaves array<int>")


def answer(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
    """A group's nearest vectors for each of its queries."""
    out = [pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
    if rows.num_rows and queries.num_rows:  # blocks and shares are dealt by hash, so one may be empty
        node, least, query = rows.column("node").to_numpy(), rows.column("least").to_numpy(), queries.column("query").to_numpy()
        x, y = matrix(queries.column("embedding")), matrix(rows.column("embedding"))
        for at in range(0, len(x), 128):
            i, j, score = best(x[at : at + 128], y, least, NEAREST + 1)
            out.append(pa.table({"query": query[at + i], "node": node[j], "least": least[j], "score": score}))
    return pa.concat_tables(out)


def met(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, node, least, score): for each query the best vectors of every visited leaf, block by block."""
    asked = cut(asked.select("query", "embedding", F.explode("leaves").alias("leaf")))
    # a row for each leaf of the tree, whose number the sample bounds
    sizes = index.groupBy("leaf").agg(F.ceil(F.sum(F.size("embedding")) / PARTS).cast("int").alias("blocks")).join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares")), "leaf")
    sizes = F.broadcast(cut(sizes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(sizes, "leaf").select("leaf", "node", "least", "embedding", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), every("shares").alias("share"))
    queries = asked.join(sizes, "leaf").select("leaf", "query", "embedding", F.pmod(F.xxhash64("query"), F.col("shares")).cast("int").alias("share"), every("blocks").alias("block"))
    keys = ["leaf", "block", "share"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(answer, "query long, node long, least long, score double")


def search(vectors: DataFrame, chosen: Callable[[Column], Column], leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors of every row whose vec_id ``chosen`` holds for."""
    points = cut(distinct(vectors).withColumn("node", F.monotonically_increasing_id()))
    n = points.count()
    trees = fit(points, n, leaf)
    index = cut(placed(points.select("node", "least", "embedding"), trees))
    visits = calibrated(index, n, trees)
    # one question for each distinct vector that a query has
    own = vectors.select(F.col("vec_id").cast("long").alias("query_id"), _plain("embedding").alias("embedding")).where(chosen(F.col("query_id")))
    asking = own.groupBy("embedding", "query_id").agg(F.count("*").cast("int").alias("times")).join(points, "embedding").select("query_id", "times", F.col("node").alias("query"))
    asking = cut(asking)
    questions = points.join(asking.select(F.col("query").alias("node")).distinct(), "node").select(F.col("node").alias("query"), "embedding")
    found = met(index, visited(questions, trees, visits))
    few = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))).where(F.col("r") <= NEAREST + 1)
    rows = few.select("query", "node", "score").join(points.select("node", "ids"), "node").join(asking, "query")
    # of the vector's own ids the query's goes once
    at = F.coalesce(F.array_position("ids", F.col("query_id")).cast("int"), F.lit(0))
    others = F.when((F.col("node") == F.col("query")) & (at > 0), F.concat(F.slice("ids", 1, at - 1), F.slice("ids", at + 1, F.size("ids")))).otherwise(F.col("ids"))
    rows = rows.select("query", "query_id", "times", "score", F.explode(others).alias("vec_id"))
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEAREST)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def report(vectors: DataFrame) -> DataFrame:
    """The nearest vectors of the rows whose id is divisible by EVERY."""
    return search(vectors, lambda vec_id: vec_id % EVERY == 0)
