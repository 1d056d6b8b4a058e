"""Embedding near-duplicates by collision counting on one-dimensional projections.

Every vector is projected on many random lines. On a line, a vector's window is
the interval centred on its own value; another vector collides with it there if
its value lies inside. A pair's collisions are counted over all lines, and pairs
with the count that pairs at the threshold reach with the wanted recall are
verified by their cosine in double precision.

A window on one line holds a fixed share of all vectors, so looking at whole
lines would take quadratic work. Few vectors lie at the ends of a line, though,
and close vectors lie at the same ones. The lines are therefore read from their
ends, in tables: of each of a table's few groups of lines a vector is filed at the
end where it lies furthest out, those at the same ends are sorted by their value
on one line more, and only the windows of that order are looked into. The least
count and the number of tables are calibrated on drawn pairs at the threshold.
Rows that are dealt out hold a code of a byte a line; only vectors with a partner
that passes meet again, first with their cells, since a pair counts in the first
table that brings it together, then with their components, to be verified. No
pairs are written, only each vector's number of links and links that span what
they joined.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing; vectors of different lengths do not link; exact
copies are compared once and count as links of each other; repeated rows each
get a row and link to each other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, deal
from lectern.llm.graph import components

THRESHOLD, RECALL = 0.9, 0.9995
#: Lines, steps of a code to one standard deviation of the values, and the windows' half-width in steps (2.1
#: standard deviations of the difference of a pair at the threshold).
LINES, STEPS, WINDOW = 64, 16, 15
#: A group has at most two to this power of ends, two of each line.
GROUP_BITS = 6
#: Lengths of vectors whose lines a worker keeps.
LENGTHS = 8
#: Vectors per cell that the ends aim at, and rows beyond which a cell is dealt out.
AIM, CELL_ROWS = 256, 2048
#: Drawn pairs that calibrate the count and the tables.
DRAWN = 40_000


@dataclass
class Plan:
    """Sizes of a table's groups of lines, tables, and the least count of collisions on the coded lines."""

    groups: list[int]
    tables: int
    least: int

    def order(self, nth: int) -> int:
        """The coded line that a table's cells are sorted by."""
        return nth % LINES

    def cells(self, value: np.ndarray) -> np.ndarray:
        """Numbers of the cells in one table by the values on the lines of its groups."""
        cell, at = np.zeros(len(value), np.int64), 0
        for size in self.groups:
            own = value[:, at : at + size]
            line = np.abs(own).argmax(axis=1)
            cell = cell * (2 * size) + 2 * line + (np.take_along_axis(own, line[:, None], axis=1)[:, 0] > 0)
            at += size
        return cell


def coded(values: np.ndarray) -> np.ndarray:
    """Codes of values on lines; differences of codes fit a byte."""
    return np.clip(np.floor(values * STEPS), -63, 63).astype(np.int8)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b lies in the window centred on a."""
    return (a - b + np.int8(WINDOW)).view(np.uint8) <= 2 * WINDOW


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    """For n distinct vectors; the recall is that of a pair at the threshold, closer pairs have more.

    On Gaussian lines two unit vectors have normal values whose correlation is
    their cosine, independent from line to line, whatever the vectors' length.
    """
    rng = np.random.default_rng(23)

    def drawn(many: int, lines: int) -> tuple[np.ndarray, np.ndarray]:
        x = rng.standard_normal((many, lines))
        return x, threshold * x + math.sqrt(1 - threshold**2) * rng.standard_normal((many, lines))

    a, b = map(coded, drawn(DRAWN, LINES))
    count, lost = close(a, b).sum(axis=1), int(DRAWN * (1 - recall))
    least = int(np.sort(count)[lost // 2])
    bits = max(1, round(math.log2(max(n, 2) / max(AIM, n**0.4))))
    many = math.ceil(bits / GROUP_BITS)
    p = Plan([1 << (bits // many + (i < bits % many) - 1) for i in range(many)], 0, least)
    left = np.flatnonzero(count >= least)
    spare = lost - (DRAWN - len(left))
    while len(left) > spare:  # one table more for the pairs that none has brought together
        x, y = drawn(len(left), sum(p.groups))
        line = p.order(p.tables)
        met = (p.cells(x) == p.cells(y)) & close(a[left, line], b[left, line])
        left, p.tables = left[~met], p.tables + 1
    return p


def placed(distinct: DataFrame, p: Plan) -> DataFrame:
    """(node, times, dims, vector, code, cells): each vector once, with its cell in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        width = sum(p.groups)
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                vectors = part.column("embedding")
                sizes = vectors.value_lengths().to_numpy()
                for dims in np.unique(sizes).tolist():
                    own = part.filter(pa.array(sizes == dims))
                    x = own.column("embedding").flatten().to_numpy().reshape(own.num_rows, dims)
                    # powers of two scale exactly and keep sums of squares finite
                    x = x / 2.0 ** np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True)))
                    if dims not in lines:
                        if len(lines) == LENGTHS:
                            lines.clear()
                        lines[dims] = np.random.default_rng(dims * 1_000_003 + 7).standard_normal((dims, LINES + p.tables * width))
                    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    code = coded(unit @ lines[dims][:, :LINES])
                    ends = (lines[dims][:, LINES + t * width : LINES + (t + 1) * width] for t in range(p.tables))
                    cells = np.stack([(p.cells(unit @ own) * p.tables + t) << 31 | dims for t, own in enumerate(ends)], axis=1)
                    single = x.astype(np.float32)
                    exact = (single == x).all(axis=1)
                    packed = [bytes(s) if e else bytes(d) for s, d, e in zip(single, x, exact.tolist())]
                    yield pa.RecordBatch.from_arrays([
                        own.column("node"), own.column("times"), pa.array(np.full(len(x), dims, np.int32)), pa.array(packed, pa.binary()), pa.array(list(map(bytes, code)), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * p.tables), pa.array(cells.ravel())),
                    ], names=["node", "times", "dims", "vector", "code", "cells"])

    return distinct.select("node", "times", "embedding").mapInArrow(run, "node long, times long, dims int, vector binary, code binary, cells array<long>")


def passing(cell: pa.Table, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell's rows in each other's window of its order, with enough collisions; with ``cells`` those that no earlier table met."""
    block, nth = cell.column("block").to_numpy(), cell.column("nth")[0].as_py()
    code = np.frombuffer(b"".join(cell.column("code").to_pylist()), np.int8).reshape(cell.num_rows, LINES)
    line, same_block = p.order(nth), bool((block == block[0]).all())
    order = np.argsort(code[:, line], kind="stable")
    rows, value = np.ascontiguousarray(code[order].T), code[order, line].astype(np.int64)
    end = np.searchsorted(value, value + WINDOW, "right")
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(order), 256):
        stop, last = min(at + 256, len(order)), int(end[min(at + 256, len(order)) - 1])
        count = np.zeros((stop - at, last - at), np.uint8)
        for own in rows:
            count += close(own[at:stop, None], own[None, at:last])
        a, b = np.nonzero(count >= p.least)
        ok = (a < b) & (b + at < end[a + at])
        found.append(np.stack([order[a[ok] + at], order[b[ok] + at]]))
    a, b = np.concatenate(found, axis=1)
    if not same_block:  # rows of one block meet in that block's own pair
        apart = block[a] != block[b]
        a, b = a[apart], b[apart]
    if nth and len(a) and "cells" in cell.column_names:
        cells = cell.column("cells").combine_chunks().flatten().to_numpy().reshape(cell.num_rows, p.tables)
        for t in range(nth):
            fresh = (cells[a, t] != cells[b, t]) | ~close(code[a, p.order(t)], code[b, p.order(t)])
            a, b = a[fresh], b[fresh]
    return a, b


def partnered(rows: pa.Table, p: Plan) -> pa.RecordBatch | None:
    """Of one cell, the rows with a partner that passes there."""
    a, b = passing(rows, p)
    return rows.select(["cell", "pair", "block", "nth", "node"]).take(pa.array(np.union1d(a, b))) if len(a) else None


def verified(rows: pa.Table, p: Plan) -> pa.Table | None:
    """(a, b, n) of one cell: node a has n links found here, which join it with node b."""
    a, b = passing(rows, p)
    dims, node, times = rows.column("dims")[0].as_py(), rows.column("node").to_numpy(), rows.column("times").to_numpy()
    x = np.array([np.frombuffer(v, np.float64 if len(v) == 8 * dims else np.float32).astype(np.float64) for v in rows.column("vector").to_pylist()])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = np.concatenate([np.einsum("ij,ij->i", x[a[at : at + 50_000]], x[b[at : at + 50_000]]) for at in range(0, max(len(a), 1), 50_000)]) >= THRESHOLD
    a, b = a[linked], b[linked]
    if not len(a):
        return None
    n = np.bincount(a, weights=times[b], minlength=len(node)) + np.bincount(b, weights=times[a], minlength=len(node))
    label = np.arange(len(node))
    while True:
        before, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    some = np.flatnonzero(n)
    return pa.table({"a": node[some], "b": node[label[some]], "n": n[some].astype(np.int64)})


def by_cell(work: Callable, p: Plan) -> Callable:
    """Calls work(rows, p) for each run of more than one row with the same cell and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _lazily(batches):
            if batch is not None:
                now = pa.Table.from_batches([batch])
                held = now if held is None else pa.concat_tables([held, now])
            if held is None or not held.num_rows:
                continue
            cell, pair = held.column("cell").to_numpy(), held.column("pair").to_numpy()
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])) + 1
            starts, ends = [0, *edge.tolist()], [*edge.tolist(), len(cell)]
            if batch is not None:  # the last run may go on
                starts, last, ends = starts[:-1], starts[-1], ends[:-1]
            for i, j in zip(starts, ends):
                if j - i > 1 and (out := work(held.slice(i, j - i).combine_chunks(), p)) is not None:
                    yield from out.to_batches()
            if batch is not None:
                held = held.slice(last).combine_chunks()

    return run


PARTNERS = "cell long, pair int, block int, nth int, node long"


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b, n): node a has n links found in one place, and is joined there with node b."""
    p = plan(n)
    rows = cut(placed(distinct, p))
    dealt = deal(rows.select("node", "code", F.posexplode("cells").alias("nth", "cell")), CELL_ROWS, "node").select("cell", "pair", "block", "nth", "node", "code")
    met = dealt.mapInArrow(by_cell(partnered, p), PARTNERS)
    first = _again(met, rows.select("node", "code", "cells")).mapInArrow(by_cell(partnered, p), PARTNERS)
    return _again(first, rows).mapInArrow(by_cell(verified, p), "a long, b long, n long")


def _again(some: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a few vectors, in the cells where they met."""
    return some.join(rows, "node").repartition("cell", "pair").sortWithinPartitions("cell", "pair")


def _lazily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    distinct = rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("times"))
    distinct = cut(distinct).withColumn("node", F.monotonically_increasing_id())
    found = cut(links(distinct, distinct.count()))
    totals = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.select("a", "b"))
    named = distinct.join(totals, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = named.groupBy("root").agg(F.min("first").alias("component"))
    by_vector = named.join(whole, "root").select("embedding", (F.col("times") - 1 + F.coalesce("n", F.lit(0).cast("long"))).alias("n"), "component")
    out = rows.join(by_vector, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
