"""Merkle manifest of a dataset, its nodes kept in van Emde Boas order.

Rows are leaves of one tree for each value of a column; the trees' roots are the
leaves of a last tree. A node is the hash of a run of up to 8 nodes below it. A
tree is cut in aligned subtrees of a fixed height (blocks); a task builds a block
from its leaves and keeps all its digests in one binary value, in the order of
van Emde Boas: the upper half of the levels first, then the subtrees below it one
after the other, each laid out so again. ``address`` gives a node's place by
arithmetic alone; building a level and reading siblings both go through it. The
roots of a layer's blocks are the leaves of the next layer's, until one is left.

Leaves are numbered without gathering a tree: they are sorted by range, written
to a checkpoint, and each partition adds what earlier ones hold of its tree.
Proofs go down from the last tree: each block gets its root's path once and gives
every leaf its own. A path is an array with, for each level, the digests left and
right of the node in its run, so SQL expressions can fold and check it.

Defined cases: equal ids are ordered by the digest of the row, rows that are equal
throughout hold neighbouring places in any order, which gives the same rows;
null ids and null values of the tree column come first; a tree of one leaf is that
leaf, and an empty table gives no rows; other columns are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lectern.llm.common import crc_mod, cut

#: Nodes in a run, and levels of nodes between a block's root and its leaves.
ARITY, HEIGHT = 8, 3
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))


def size(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in a tree of so many levels, of the nodes of a depth (the root's is 0) by their number there."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = ARITY ** (depth - top)
    return size(top) + index // below * size(levels - top) + address(levels - top, depth - top, index % below)


class Block:
    """Digests of one aligned subtree, ``count`` leaves wide, as 64 hex characters each in van Emde Boas order."""

    def __init__(self, height: int, count: int, data: bytes | None = None):
        self.height, self.count = height, count
        n = size(height + 1) if height else 1
        self.nodes = np.zeros(n, f"S{HEX}") if data is None else np.frombuffer(data, f"S{HEX}")

    def width(self, depth: int) -> int:
        """Nodes that a depth holds."""
        return -(-self.count // ARITY ** (self.height - depth))

    def places(self, depth: int) -> np.ndarray:
        return address(self.height + 1, depth, np.arange(self.width(depth)))

    @staticmethod
    def build(height: int, leaves: np.ndarray) -> Block:
        block = Block(height, len(leaves))
        block.nodes[block.places(height)] = leaves
        for depth in range(height - 1, -1, -1):
            below = block.nodes[block.places(depth + 1)].tobytes()
            run = ARITY * HEX
            block.nodes[block.places(depth)] = [hashlib.sha256(below[i : i + run]).hexdigest().encode() for i in range(0, len(below), run)]
        return block

    def root(self) -> str:
        return self.nodes[0].decode()

    def paths(self) -> list[list[tuple[str, str]]]:
        """For each leaf, from its own level up, the digests left and right of the path's node in its run."""
        levels = []
        for depth in range(self.height, 0, -1):
            row = self.nodes[self.places(depth)].tobytes().decode()
            own = []
            for x in range(self.width(depth)):
                run = x // ARITY * ARITY
                own.append((row[run * HEX : x * HEX], row[(x + 1) * HEX : (run + ARITY) * HEX]))
            levels.append(own)
        return [[own[leaf // ARITY**k] for k, own in enumerate(levels)] for leaf in range(self.count)]


def height_of(n: int) -> int:
    """Levels above n leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``at`` (from 0 within their tree) and ``total`` (leaves of the tree).

    The sorted rows are written to a checkpoint, so that both readings see the same partitions; the table of
    what partitions hold has a row for each partition and each tree, and its windows a row for each partition.
    """
    keys = ["tree", *order]
    # a last key of their own spreads rows that are equal throughout
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = cut(rows.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    held = rows.groupBy("_part", "tree").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = cut(held.select("_part", "tree", (earlier - F.col("_low")).alias("_shift"), F.sum("_n").over(tree).alias("total")))
    return rows.join(held, ["_part", "tree"]).withColumn("at", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def layers(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The blocks of every layer over (tree, total, at, digest), lowest first.

    A row is (tree, block, total, height, count, root, nodes): ``total`` are the tree's leaves in this layer,
    and a tree's only block is as high as these need.
    """
    span, out = ARITY**height, []

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        total = rows.column("total")[0].as_py()
        own = height_of(total) if total <= span else height
        block = Block.build(own, np.array(rows.column("digest").to_pylist(), f"S{HEX}"))
        return pa.table({
            "tree": [key[0].as_py()], "block": [key[1].as_py()], "total": [total], "height": pa.array([own], pa.int32()), "count": pa.array([block.count], pa.int32()),
            "root": [block.root()], "nodes": pa.array([block.nodes.tobytes()], pa.binary()),
        })

    while not out or not leaves.isEmpty():
        dealt = leaves.select("tree", "total", "at", "digest", F.floor(F.col("at") / span).alias("block"))
        out.append(cut(dealt.groupBy("tree", "block").applyInArrow(build, "tree string, block long, total long, height int, count int, root string, nodes binary")))
        leaves = out[-1].where(F.col("total") > span).select("tree", F.ceil(F.col("total") / span).alias("total"), F.col("block").alias("at"), F.col("root").alias("digest"))
    return out


def roots(built: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(tree, root) of every tree."""
    tops = [b.where(F.col("total") <= ARITY**height).select("tree", "root") for b in built]
    out = tops[0]
    for more in tops[1:]:
        out = out.union(more)
    return out


def proved(leaves: DataFrame, built: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The leaves (tree, at, digest and more) with the columns of ``above`` for their tree; its ``path`` is led on to each leaf."""
    span = ARITY**height
    more = StructType([f for f in above.schema.fields if f.name != "tree"])
    names = [f.name for f in more if f.name != "path"]

    def led(keys: dict[str, pa.Array], blocks: pa.Table) -> pa.Table:
        """A block's own path, and what else is known above, for each of its leaves in the order of ``keys``."""
        row = blocks.slice(0, 1).to_pylist()[0]
        first = row["block"] * span
        own = Block(row["height"], row["count"], row["nodes"]).paths()
        rest = [(s["left"], s["right"]) for s in row["path"]]
        steps = [[*own[i - first], *rest] for i in keys["at"].to_pylist()]
        flat = [step for path in steps for step in path]
        sides = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.string()), pa.array([b for _, b in flat], pa.string())], ["left", "right"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in steps])]).astype(np.int32))
        given = {f: pa.array([row[f]] * len(steps), blocks.schema.field(f).type) for f in names}
        return pa.table({**keys, **given, "path": pa.ListArray.from_arrays(offsets, sides)})

    def inside(key: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
        return led({n: rows.column(n).combine_chunks() for n in rows.column_names if n != "block"}, blocks)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = pa.Table.from_batches([batch.slice(i, 1)])
                first, n = block.column("block")[0].as_py() * span, block.column("count")[0].as_py()
                keys = {"tree": pa.array([block.column("tree")[0].as_py()] * n), "at": pa.array(np.arange(first, first + n))}
                yield from led(keys, block).to_batches()

    paths = None  # of the block roots of the layer below
    for blocks in reversed(built):
        known = blocks.where(F.col("total") <= span).join(above, "tree")
        if paths is not None:
            known = known.unionByName(blocks.where(F.col("total") > span).join(paths.withColumnRenamed("at", "block"), ["tree", "block"]))
        known = known.select("tree", "block", "height", "count", "nodes", *more.names)
        paths = known.mapInArrow(between, StructType([StructField("tree", StringType()), StructField("at", LongType()), *[f for f in more if f.name != "path"], more["path"]]))
    rows = leaves.drop("total").withColumn("block", F.floor(F.col("at") / span))
    out = StructType([*[f for f in rows.schema if f.name != "block"], *[f for f in more if f.name != "path"], more["path"]])
    return rows.groupBy("tree", "block").cogroup(known.groupBy("tree", "block")).applyInArrow(inside, out)


def digest(columns: list[Column]) -> Column:
    """sha256 of the values, each with its length in bytes before it, ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts)).cast("binary"), 256)


def folded(path: str, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def manifest(rows: DataFrame, order: list[str], height: int = HEIGHT) -> tuple[DataFrame, str | None]:
    """The rows (tree, digest and more; ``order`` sorts a tree's leaves) with ``at``, their tree's ``subroot`` and the ``path`` to the root of all; and that root."""
    leaves = numbered(cut(rows), [*order, "digest"])
    built = layers(leaves, height)
    tops = cut(roots(built, height).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")))
    last = numbered(tops, ["name"])
    upper = layers(last, height)
    root = roots(upper, height).first()
    bare = rows.sparkSession.createDataFrame([("", [])], StructType([StructField("tree", StringType()), StructField("path", PATH)]))
    above = proved(last, upper, bare, height).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path")
    return proved(leaves, built, above, height), root.root if root else None


def report(docs: DataFrame) -> DataFrame:
    """Each document's leaf, proof and roots, and whether the proof holds for its text, lower-cased where the id's crc32 is divisible by 3."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    own = [F.col(c) for c in FIELDS]
    lowered = [F.translate(c, capitals, capitals.lower()) if n == "text" else c for n, c in zip(FIELDS, own)]
    # a letter before the value keeps null trees first and apart from empty names
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n"))
    leaves = docs.select("doc_id", tree.alias("tree"), digest(own).alias("digest"), F.when(crc_mod("doc_id", 3) == 0, digest(lowered)).alias("found"))
    rows, root = manifest(leaves, ["doc_id"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    back = folded("path", F.coalesce("found", "digest"))
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
