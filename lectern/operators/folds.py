"""Greedy groups along an order, for keys of any size.

Packing paragraphs into sections and opening quota windows are the same fold: a
group opens at a row, takes the rows after it while they end within ``reach`` of
its begin, and the first one that does not opens the next. The fold is not
associative, but what a stretch of rows does to it is a function of one number,
the bound that the open group may not pass: it gives the bound that is in force
behind the stretch. Such functions are constant between the rows' ends, and they
can be composed; composition is associative.

So rows are sorted by range, which cuts a large key in many partitions. Each
partition makes the function of a key that runs through it; functions of
neighbours are composed by twos, fours and so on; then the bounds at every
partition's begin follow from the first one's, by halving the same way. With
them each partition marks its groups on its own. Keys that lie in one partition
need none of this. The driver sees a few numbers for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from lectern.functions.text import col
from lectern.sources.shared import kept

#: The bound before a key's first row: its row opens a group in any case.
OPEN = -(1 << 62)


@dataclass
class Piece:
    """What is known of a key's rows in one partition: rows, length, place in the key's row of partitions."""

    key: int
    seq: int
    rows: int = 0
    length: int = 0
    #: Rows and length of the key in earlier partitions; bound, groups and begin of the open group there.
    rows_before: int = 0
    length_before: int = 0
    state: tuple[int, int, int] = (OPEN, 0, 0)


@dataclass
class Function:
    """For a bound below upto[i] and no smaller one: the bound behind, groups opened, and the row that opened the last."""

    upto: np.ndarray
    bound: np.ndarray
    groups: np.ndarray
    opened: np.ndarray

    NAMES = ("upto", "bound", "groups", "opened")

    @staticmethod
    def of(begin: np.ndarray, end: np.ndarray, reach: int, first: int) -> Function:
        """Of rows with ascending ends; ``first`` is the number of the first of them."""
        n = len(end)
        after = np.maximum(np.searchsorted(end, begin + reach, "right"), np.arange(1, n + 1))
        bound, groups, opened = (begin + reach).tolist(), [1] * n, list(range(first, first + n))
        for i, j in zip(range(n - 1, -1, -1), after[::-1].tolist()):
            if j < n:
                bound[i], groups[i], opened[i] = bound[j], groups[j] + 1, opened[j]
        out = Function(end, *(np.array(x, np.int64) for x in (bound, groups, opened)))
        return out.shorter()

    def shorter(self) -> Function:
        """Without bounds that make no difference."""
        last = np.ones(len(self.upto), bool)
        last[:-1] = (self.bound[1:] != self.bound[:-1]) | (self.groups[1:] != self.groups[:-1]) | (self.opened[1:] != self.opened[:-1])
        return Function(self.upto[last], self.bound[last], self.groups[last], self.opened[last])

    def at(self, state: tuple[int, int, int]) -> tuple[int, int, int]:
        i = int(np.searchsorted(self.upto, state[0], "right"))
        return state if i == len(self.upto) else (int(self.bound[i]), state[1] + int(self.groups[i]), int(self.opened[i]))

    def then(self, later: Function) -> Function:
        """This one and then the later one."""
        i = np.searchsorted(later.upto, self.bound, "right")
        go, i = i < len(later.upto), np.minimum(i, len(later.upto) - 1)
        rest = later.upto > self.upto[-1]  # bounds that no row here passes
        return Function(
            np.concatenate([self.upto, later.upto[rest]]), np.concatenate([np.where(go, later.bound[i], self.bound), later.bound[rest]]),
            np.concatenate([self.groups + np.where(go, later.groups[i], 0), later.groups[rest]]), np.concatenate([np.where(go, later.opened[i], self.opened), later.opened[rest]]),
        ).shorter()


@dataclass
class Edges:
    """A partition's first and last key, where these go on in others."""

    first: Piece | None = None
    last: Piece | None = None
    keys: int = field(default=0)


def changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows that begin a new key within the batch; the first one is not among them."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        number = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= number[1:] != number[:-1]
    return np.flatnonzero(new)


def _values(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Parts of batches with one key each, and whether the key is a new one."""
    before = None
    for batch in batches:
        if batch.num_rows:
            edges = [0, *changes(batch, keys).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                own = _values(batch, keys, a)
                yield own != before, batch.slice(a, b - a)
                before = own


def _edges(rows: DataFrame, keys: list[str], moving: bool) -> dict[int, Edges]:
    """By partition, its first and last key's pieces if these keys lie in several partitions.

    Only rows that lie one after the other have a length; places are not summed, as their sum may pass 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, number = None, None, None, -1
        for new, stretch in _stretches(batches, keys):
            part = stretch.column("_part")[0]
            number += new
            n, length = stretch.num_rows, pc.sum(stretch.column("_length")).as_py() + pc.sum(stretch.column("_place")).as_py() if moving else 0
            if new:
                last = [_values(stretch, keys, 0), 0, 0]
                first = first or last
            last[1] += n
            last[2] += length
        if first is not None:
            ends = [(0, first)] + ([(1, last)] if last is not first else [])
            arrays = [pa.array([part.as_py()] * len(ends), pa.int64()), pa.array([k for k, _ in ends], pa.int64()), pa.array([number + 1] * len(ends), pa.int64())]
            arrays += [pa.array([e[0][i] for _, e in ends], kinds.field(k).type) for i, k in enumerate(keys)] + [pa.array([e[j] for _, e in ends], pa.int64()) for j in (1, 2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_part", "_end", "_keys", *keys, "_rows", "_sum"])

    own = StructType([rows.schema[k] for k in keys])
    kinds = to_arrow_schema(own)
    long = lambda n: StructField(n, LongType())
    found = rows.select(*map(col, keys), "_part", "_length", "_place").mapInArrow(run, StructType([long("_part"), long("_end"), long("_keys"), *own, long("_rows"), long("_sum")])).orderBy("_part", "_end").collect()
    pieces: dict[tuple, list[tuple[int, int, Piece]]] = {}
    for r in found:
        pieces.setdefault(tuple(repr(r[k]) for k in keys), []).append((r["_part"], r["_end"], Piece(-1, 0, r["_rows"], r["_sum"])))
    out = {r["_part"]: Edges(keys=r["_keys"]) for r in found}
    for number, chain in enumerate(c for c in pieces.values() if len(c) > 1):
        n = length = 0
        for seq, (part, end, piece) in enumerate(chain):
            piece.key, piece.seq, piece.rows_before, piece.length_before = number, seq, n, length
            n, length = n + piece.rows, length + piece.length
            if end == 0:
                out[part].first = piece
            if end == 1 or out[part].keys == 1:
                out[part].last = piece
    return out


def _bounds(stretch: pa.RecordBatch, moving: bool, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of rows: along the sum of lengths, or at their own place."""
    length = stretch.column("_length").to_numpy()
    place = stretch.column("_place").to_numpy()
    if not moving:
        return place, place
    total = np.cumsum(length + place)
    return before + total - length - place, before + total - place


def _functions(rows: DataFrame, keys: list[str], edges: dict[int, Edges], reach: int, moving: bool) -> DataFrame:
    """(key, seq, function) of every key that lies in several partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = -1, {}
        for new, stretch in _stretches(batches, keys):
            part, number = stretch.column("_part")[0].as_py(), number + new
            mine = edges[part]
            piece = mine.first if number == 0 else mine.last if number == mine.keys - 1 else None
            if piece is not None:
                before = held.setdefault(number, (piece, []))[1]
                before.append(stretch.select(["_length", "_place"]))
        for piece, stretches in held.values():
            whole = pa.Table.from_batches(stretches).combine_chunks().to_batches()[0]
            f = Function.of(*_bounds(whole, moving, piece.length_before), reach, piece.rows_before)
            yield _packed(piece.key, piece.seq, f)

    return rows.select(*map(col, keys), "_part", "_length", "_place").mapInArrow(run, "key long, seq long, upto array<long>, bound array<long>, groups array<long>, opened array<long>")


def _packed(key: int, seq: int, f: Function) -> pa.RecordBatch:
    lists = [pa.array([getattr(f, n)], pa.list_(pa.int64())) for n in Function.NAMES]
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([seq], pa.int64()), *lists], names=["key", "seq", *Function.NAMES])


def _unpacked(table: pa.Table | pa.RecordBatch, row: int) -> Function:
    return Function(*(np.array(table.column(n)[row].values.to_numpy(zero_copy_only=False), np.int64) for n in Function.NAMES))


def _solve(rows: DataFrame, keys: list[str], edges: dict[int, Edges], reach: int, moving: bool) -> None:
    """Puts into every piece the state in force where it begins."""
    chains: dict[int, dict[int, Piece]] = {}
    for e in edges.values():
        for piece in {id(p): p for p in (e.first, e.last) if p is not None}.values():
            chains.setdefault(piece.key, {})[piece.seq] = piece
    if not chains:
        return

    def both(key: tuple, two: pa.Table) -> pa.Table:
        two = two.sort_by("seq")
        f = _unpacked(two, 0)
        if two.num_rows == 2:
            f = f.then(_unpacked(two, 1))
        return pa.Table.from_batches([_packed(two.column("key")[0].as_py(), two.column("seq")[0].as_py() // 2, f)])

    levels = [kept(_functions(rows, keys, edges, reach, moving))]
    kind = "key long, seq long, upto array<long>, bound array<long>, groups array<long>, opened array<long>"
    longest = max(map(len, chains.values()))
    while longest > 1:
        levels.append(kept(levels[-1].groupBy("key", F.floor(F.col("seq") / 2).alias("_half")).applyInArrow(both, kind)))
        longest = -(-longest // 2)
    known = {(k, 0): (OPEN, 0, 0) for k in chains}
    for level in reversed(levels[:-1]):
        known = {(k, 2 * s): v for (k, s), v in known.items()}

        def step(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [(k, s, i) for i, (k, s) in enumerate(zip(batch.column("key").to_pylist(), batch.column("seq").to_pylist())) if s % 2 == 0]
                states = [_unpacked(batch, i).at(known[k, s]) for k, s, i in at]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in at], pa.int64()) for j in (0, 1)] + [pa.array([x[j] for x in states], pa.int64()) for j in range(3)], names=["key", "seq", "bound", "groups", "opened"])

        behind = level.mapInArrow(step, "key long, seq long, bound long, groups long, opened long").collect()
        known |= {(r.key, r.seq + 1): (r.bound, r.groups, r.opened) for r in behind}
    for k, chain in chains.items():
        for seq, piece in chain.items():
            piece.state = known[k, seq]


def grouped(rows: DataFrame, keys: list[str], order: list[str], reach: int, length: Column | str | None = None, between: int = 0, place: Column | str | None = None, partitions: int | None = None) -> DataFrame:
    """The rows with ``row`` and ``group`` (their numbers within the key, from 0), ``opened`` (the row that opened the group) and ``begin`` (where that row begins).

    With ``length``, rows lie one after the other, ``between`` apart, and a group
    is at most ``reach`` long, a longer row being a group of its own. With
    ``place``, ascending along the order, a group's rows lie at most ``reach``
    behind its first. Rows with equal keys and order may come in either order;
    null keys are a key, null lengths and places are 0; no rows give none.
    """
    moving = place is None
    size = F.coalesce((F.lit(0) if length is None else col(length)).cast("long"), F.lit(0).cast("long"))
    spot = F.lit(between).cast("long") if moving else F.coalesce(col(place).cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumns({"_length": size, "_place": spot})
    by = [*map(col, keys), *map(col, order)]
    sorted_rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    sorted_rows = kept(sorted_rows.sortWithinPartitions(*by)).withColumn("_part", F.spark_partition_id().cast("long"))
    edges = _edges(sorted_rows, keys, moving)
    _solve(sorted_rows, keys, edges, reach, moving)
    more = ["row", "group", "opened", "begin"]
    own = [f for f in rows.schema if f.name not in (*more, "_length", "_place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, state, row, total = -1, (OPEN, 0, 0), 0, 0
        for new, stretch in _stretches(batches, names):
            if new:
                number += 1
                mine = edges[stretch.column("_part")[0].as_py()]
                piece = mine.first if number == 0 else mine.last if number == mine.keys - 1 else None
                state, row, total = (piece.state, piece.rows_before, piece.length_before) if piece else ((OPEN, 0, 0), 0, 0)
            begin, end = _bounds(stretch, moving, total)
            n = stretch.num_rows
            group, opened, at = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
            i = 0
            while i < n:
                j = max(i, int(np.searchsorted(end, state[0], "right")))
                group[i:j], opened[i:j], at[i:j] = state[1] - 1, state[2], state[0] - reach
                if j < n:
                    state = (int(begin[j]) + reach, state[1] + 1, row + j)
                    group[j], opened[j], at[j] = state[1] - 1, state[2], begin[j]
                i = j + 1 if j < n else n
            yield pa.RecordBatch.from_arrays([*(stretch.column(f"_{i}") for i in range(len(own))), pa.array(np.arange(row, row + n)), pa.array(group), pa.array(opened), pa.array(at)], names=[*(f"_{i}" for i in range(len(own))), *more])
            row, total = row + n, total + (int((stretch.column("_length").to_numpy() + stretch.column("_place").to_numpy()).sum()) if moving else 0)

    at = {f.name: f"_{i}" for i, f in enumerate(own)}
    names = [at[k] for k in keys]
    cols = [col(f"`{f.name.replace('`', '``')}`").alias(f"_{i}") for i, f in enumerate(own)]
    out = sorted_rows.select(*cols, "_part", "_length", "_place").mapInArrow(run, StructType([*(StructField(f"_{i}", f.dataType, f.nullable) for i, f in enumerate(own)), *(StructField(m, LongType(), False) for m in more)]))
    return out.toDF(*(f.name for f in own), *more)
