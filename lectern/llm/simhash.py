"""SimHash near-duplicates by segment-popcount embedding and a grid range-join.

A fingerprint of 64 bits is cut in segments of two bits; its bit counts per
segment are a point whose Manhattan distance to another point never exceeds the
fingerprints' Hamming distance. Two fingerprints within 3 bits are therefore
within distance 1 in the lower or in the upper half of the segments. Each
distinct fingerprint enters, for either half, its own grid cell and the cells
one count up; pairs that meet in a cell are verified exactly. Exact copies meet
as one fingerprint, and a cell passes on links that span what it joined, never
all pairs.

Defined cases: null, empty and wordless texts have fingerprint zero and link
like any other; repeated rows each get a row; a null doc_id never names a
component unless all its ids are null; other columns are ignored by the report
and kept by the pipeline stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.llm.common import cut, deal, slices
from lectern.llm.graph import components

SHINGLE, SEED, NEAR = 3, 42, 3
#: Rows of a cell that one task compares; fuller cells are dealt out by pairs of blocks.
CELL_ROWS = 4096


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]


def fingerprint(texts: list) -> np.ndarray:
    """Signed 64-bit fingerprints of whole texts."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        if hashes := shingle_hashes(text):
            h = np.array(hashes, np.uint64)
            n, counts = len(h), np.zeros(64, np.int64)
            for at in range(0, n, 1 << 18):
                counts += np.unpackbits(h[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """The rows with their fingerprint as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield part.append_column(name, pa.array(fingerprint(texts)))

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, LongType())]))


def _half(fp: Column, upper: bool) -> Column:
    """Bit counts of 16 two-bit segments, two bits each."""
    bits = F.shiftrightunsigned(fp, 32) if upper else fp
    mask = F.lit(0x55555555).cast("long")
    return bits.bitwiseAND(mask) + F.shiftrightunsigned(bits, 1).bitwiseAND(mask)


def cells(distinct: DataFrame) -> DataFrame:
    """(cell, probe, fp): each fingerprint's own cells, and as probes the cells one count up."""
    halves = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(u).cast("long").alias("h"), _half(F.col("fp"), bool(u)).alias("c")) for u in (0, 1)))).alias("x")).select("fp", "x.h", "x.c")
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when(F.call_function("shiftright", F.col("c"), 2 * k).bitwiseAND(F.lit(3).cast("long")) < 2, F.col("c") + F.call_function("shiftleft", F.lit(1).cast("long"), 2 * k)))
    spots = F.concat(F.array("c"), F.filter(steps, lambda x: x.isNotNull()))
    rows = halves.select("fp", "h", F.posexplode(spots).alias("at", "c"))
    return rows.select((F.col("c") * 2 + F.col("h")).alias("cell"), (F.col("at") > 0).alias("probe"), "fp")


def _local_links(own: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links that span the components within a cell."""
    both = np.concatenate([own, probes])
    labels = np.arange(len(both))
    pairs = []
    for at in range(0, len(own), 512):
        near = np.bitwise_count(own[at : at + 512, None] ^ both[None, :]) <= NEAR
        a, b = np.nonzero(near)
        a += at
        pairs.append(np.stack([a[a < b], b[a < b]]))
    a, b = np.concatenate(pairs, axis=1)
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if (labels == before).all():
            break
    moved = np.flatnonzero(labels != np.arange(len(both)))
    return both[moved], both[labels[moved]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one (cell, block pair); rows come sorted by them."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if held is None or not len(held[0]):
            continue
        cell, pair, probe, fp = held
        edge = np.flatnonzero((cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(cell)]])
        if batch is not None:  # the last run may go on
            held = [x[starts[-1] :] for x in held]
            starts, ends = starts[:-1], ends[:-1]
        if not len(starts):
            continue
        owners = np.add.reduceat((~probe).astype(np.int64), starts) if batch is None else np.add.reduceat((~probe)[: ends[-1]].astype(np.int64), starts)
        out_a, out_b = [], []
        for i in np.flatnonzero((ends - starts > 1) & (owners > 0)):
            f, p = fp[starts[i] : ends[i]].view(np.uint64), probe[starts[i] : ends[i]]
            a, b = _local_links(f[~p], f[p])
            out_a.append(a)
            out_b.append(b)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links that join all fingerprints within 3 bits of each other, directly or by others."""
    spread = deal(cells(distinct), cell_rows, "fp").select("cell", "pair", "probe", "fp")
    return spread.mapInArrow(_meet, "a long, b long").distinct()


def component_ids(prints: DataFrame) -> DataFrame:
    """(fp, best) for each distinct fingerprint of the rows (doc_id, h, fp).

    best is the row that stands for the component: none, id and h of the one with
    the smallest doc_id, nulls last, then the smallest h.
    """
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")).alias("first"))
    roots = components(links(first.select("fp")))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = named.groupBy("root").agg(F.min("first").alias("best"))
    return named.join(whole, "root").select("fp", "best")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = cut(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("h"), "text"), "fp").drop("text"))
    return prints.join(component_ids(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id (nulls last), all columns kept.

    Of rows with that id the one whose text has the smallest hash stays, and of
    rows with that text too the one whose other columns have the smallest hash
    (maps and variants, which have none, don't count).
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    keep = component_ids(cut(with_fingerprint(found).drop("text"))).select("best.*").distinct()
    others = [f.name for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    whole = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h"), F.xxhash64(*map(quoted, others)).alias("order"), F.struct(*map(quoted, docs.columns)).alias("row"))
    one = whole.groupBy("none", "id", "h").agg(F.min_by("row", "order").alias("row"))
    return one.join(keep.withColumn("id", F.coalesce("id", F.lit(0))), ["none", "id", "h"], "left_semi").select("row.*")
