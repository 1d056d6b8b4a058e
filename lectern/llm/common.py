"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lectern.sources.shared import shared_folder

#: Bytes of text that one vectorised step of a task works on.
SLICE_BYTES = 2_000_000
#: Full cells that are broadcast to the rows; more are joined.
FEW_CELLS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of Arrow batches that hold about so many bytes of whole texts, with the texts."""
    for part in parts(batches, column, size):
        yield part, part.column(column).to_pylist()


def parts(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, each with about so many bytes of whole texts."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + size, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: Iterable[StructField] = ()) -> DataFrame:
    """mapInArrow for rows that keep all their columns, whatever these are called, and get more; run sees ``text`` by name."""
    fields = [StructField(f.name if f.name == "text" else f"_{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema)]
    rows = df.toDF(*(f.name for f in fields)).mapInArrow(run, StructType([*fields, *more]))
    return rows.toDF(*df.columns, *(f.name for f in more))


def deal(rows: DataFrame, limit: int, key: str) -> DataFrame:
    """Rows grouped by (cell, pair), sorted so in each partition, with no group over about 2 x limit rows.

    A cell of more rows is split in k blocks by the hash of ``key``; a row of
    block i goes to all pairs (i, j), so any two rows of a cell meet in exactly
    one pair if their blocks differ, and in k pairs if not.
    """
    hot = cut(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("cell", F.ceil(F.col("n") / limit).cast("int").alias("k")))
    if hot.count() <= FEW_CELLS:
        hot = F.broadcast(hot)
    dealt = rows.join(hot, "cell", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(key), F.col("k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least("block", j) * F.col("k") + F.greatest("block", j))
    spread = dealt.withColumn("pair", F.explode(pairs)).drop("k")
    return spread.repartition("cell", "pair").sortWithinPartitions("cell", "pair")


class WordTable:
    """Rows of numbers by word, computed once for each word a worker meets.

    ``fill`` gets the new words and returns their rows. The table starts anew
    once it holds ``limit`` words or ``chars`` characters of them, so a worker's
    memory stays bounded, by one slice's words beyond that.
    """

    def __init__(self, fill: Callable[[list], np.ndarray], limit: int = 250_000, chars: int = 20_000_000):
        self.fill, self.limit, self.chars = fill, limit, chars
        self._reset()

    def _reset(self) -> None:
        self.index = defaultdict()
        self.index.default_factory = self.index.__len__
        self.rows = self.fill([])
        self.used = self.held = 0

    def look_up(self, words: list) -> np.ndarray:
        """Row numbers, valid until the next call."""
        if len(self.index) > self.limit or self.held > self.chars:
            self._reset()
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if (n := len(self.index)) > self.used:
            new = list(self.index)[self.used :] if self.used == 0 else _last(self.index, n - self.used)
            self.held += sum(map(len, new))
            rows = self.fill(new)
            if n > len(self.rows):
                grown = np.empty((max(n, 2 * len(self.rows)), *self.rows.shape[1:]), self.rows.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : n] = rows
            self.used = n
        return found


def _last(index: dict, n: int) -> list:
    keys = reversed(index)
    out = [next(keys) for _ in range(n)]
    out.reverse()
    return out


def sums(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run may be empty."""
    out = np.zeros((len(counts), *rows.shape[1:]), np.float64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
