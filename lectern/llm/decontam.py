"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Benchmark windows are the patterns. A shift table over blocks of two words says
how far the search may move on, and grows with the patterns; a word of no pattern
lets it move past itself. Where it says zero, the block ends some pattern and the
bucket of its suffix hash, in the order of the words before it, names the patterns
to compare word by word: of a frequent ending only those with the same beginning.
Texts are mapped to word numbers once. A slice of a task's texts is cut in lanes,
each with a cursor; all cursors look up their block at once and each moves on by
its own shift, so most positions are never looked at.

A benchmark over the size of one broadcast is searched in blocks, one after the
other: each writes the documents it occurs in to the shared folder, and its
broadcast is dropped before the next is made.

Defined cases: a null or wordless text has no words and is clean; wordless items
have no window; repeated items count by their item_id once; repeated documents
each get a row; a null item_id takes part as the text ``null``; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lectern.llm.common import cut, map_rows, shared_folder, slices

WINDOW = 10
#: Characters of benchmark text that one broadcast may hold; larger sets are searched block by block.
BLOCK_CHARS = 8_000_000
#: Characters of a piece of one item, at most.
PIECE_CHARS = 1_000_000
#: Words of text that one cursor of the search passes.
LANE = 256
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


class Patterns:
    """Different windows of one length, by their places in the benchmark's words, with shift table and suffix buckets."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, length: int):
        self.length, self.block, self.ids = length, min(2, length), ids
        # a slot for each place where a block may be, and three free ones beside it
        self.bits = max(8, int(4 * len(ids)).bit_length())
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self.key(ids[starts + end - self.block], ids[starts + end - 1]), length - end)
        bucket = self.bucket(ids, starts)
        self.order = np.argsort(bucket, kind="stable").astype(np.int32)
        self.buckets, self.starts = bucket[self.order], starts[self.order].astype(np.int32)

    def key(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        a = before.astype(np.uint64) if self.block == 2 else np.uint64(0)
        b = last.astype(np.uint64)
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def bucket(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Windows by the hash of their last block, and of equal ones by that of the words before it."""
        suffix = self.key(ids[starts + self.length - self.block], ids[starts + self.length - 1]).astype(np.uint64)
        prefix = np.zeros(len(starts), np.uint64)
        for i in range(self.length - self.block):
            prefix = (prefix ^ ids[starts + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            prefix ^= prefix >> np.uint64(29)
        return suffix << np.uint64(64 - self.bits) | prefix >> np.uint64(self.bits)

    def shifts(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How far the search may move on from blocks of two words; no window holds a word of number 0."""
        out = self.shift[self.key(before, last)]
        if self.block == 2:
            out[before == 0] = self.length - 1
        out[last == 0] = self.length
        return out

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions at which a pattern may end: those where a cursor met a shift of zero."""
        cursor = np.arange(self.length - 1, len(ids), LANE)
        stop, found, self.looked = np.minimum(cursor + LANE, len(ids)), [], 0
        while len(cursor):
            shift = self.shifts(ids[cursor - self.block + 1], ids[cursor])
            self.looked += len(cursor)
            found.append(cursor[shift == 0])
            cursor = cursor + np.maximum(shift, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence."""
        first, width = self.length - 1, np.arange(self.length)
        ends = self.ends(ids)
        keys = self.bucket(ids, ends - first)
        low, high = np.searchsorted(self.buckets, keys, "left"), np.searchsorted(self.buckets, keys, "right")
        starts, found = [], []
        many = np.cumsum(high - low)
        begin = 0
        while begin < len(ends):  # bounded pieces of (position, bucket entry)
            end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + 500_000)))
            size = (high - low)[begin:end]
            at = np.repeat(ends[begin:end], size) - first
            pattern = np.repeat(low[begin:end] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            same = ids[at] == self.ids[self.starts[pattern]]
            at, pattern = at[same], pattern[same]
            same = (ids[at[:, None] + width] == self.ids[self.starts[pattern][:, None] + width]).all(axis=1)
            starts.append(at[same])
            found.append(self.order[pattern[same]])
            begin = end
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64),) * 2


class Owners:
    """The numbers of the items that each pattern belongs to."""

    def __init__(self, which: np.ndarray, items: np.ndarray):
        pairs = np.unique(np.stack([which, items], axis=1), axis=0)
        self.at = np.searchsorted(pairs[:, 0], np.arange(which.max() + 2)).astype(np.int32)
        self.items = pairs[:, 1].astype(np.int32)

    def __getitem__(self, pattern: int) -> list[int]:
        return self.items[self.at[pattern] : self.at[pattern + 1]].tolist()


class Matcher:
    """All windows of a block of benchmark items, and the items each belongs to."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        each = [np.fromiter((self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)), np.int32) for _, text in items]
        ids = np.concatenate([np.zeros(0, np.int32), *each])
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        length = np.minimum(sizes, window)
        count = np.where(sizes > 0, sizes - length + 1, 0)
        item = np.repeat(np.arange(len(each)), count)
        starts = (np.cumsum(sizes) - sizes)[item] + np.arange(len(item)) - (np.cumsum(count) - count)[item]
        owner = np.fromiter((number[i] for i, _ in items), np.int64, len(items))[item]
        self.groups: list[tuple[Patterns, Owners]] = []
        for n in np.unique(length[item]).tolist():
            own = length[item] == n
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, n)[starts[own]])
            _, first, which = np.unique(rows.view(f"V{rows.itemsize * n}").ravel(), return_index=True, return_inverse=True)
            self.groups.append((Patterns(ids, starts[own][first], n), Owners(which, owner[own])))

    def scan(self, texts: list) -> tuple[np.ndarray, list[list], list[set]]:
        """Words of each text, hit ranges [start, end, ...] by word, and items with occurring windows."""
        get = self.vocabulary.get
        each = [[get(w, 0) for w in words(t)] for t in texts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(chain(e, (0,)) for e in each), np.int32, int(sizes.sum()) + len(each))
        begin = np.cumsum(sizes + 1) - sizes - 1
        ranges, items = [[] for _ in texts], [set() for _ in texts]
        for patterns, owners in self.groups:
            at, found = patterns.find(ids)
            doc = np.searchsorted(begin, at, "right") - 1
            for d, start in zip(doc.tolist(), (at - begin[doc]).tolist()):
                ranges[d] += (start, start + patterns.length)
            for d, p in np.unique(np.stack([doc, found], axis=1), axis=0).tolist():
                items[d].update(self.items[i] for i in owners[p])
        return sizes, ranges, items


def pieces(benchmark: DataFrame) -> DataFrame:
    """(item_id, text): the items, long ones in pieces that overlap by a window less one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            ids, out = [], []
            for item, text in zip(part.column("item").to_pylist(), texts):
                if len(text) <= PIECE_CHARS:
                    own = [text]
                else:
                    w = [x.decode() for x in words(text)]
                    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum([len(x) + 1 for x in w]) // PIECE_CHARS)) + 1).tolist(), len(w)]
                    own = [" ".join(w[min(a, max(0, len(w) - WINDOW)) : b + WINDOW - 1]) for a, b in zip(cuts, cuts[1:])]
                ids += [item] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["item", "text"])

    return benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").mapInArrow(run, "item string, text string")


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[Matcher]:
    """Matchers over the items, made one at a time, each of bounded size."""
    rows = cut(pieces(benchmark).distinct())
    k = 1
    while True:  # more blocks until the fullest fits
        sizes = rows.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(k)).alias("block")).agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("pieces")).collect()
        if all(r.n <= chars or r.pieces == 1 for r in sizes):
            break
        k *= 2
    for block in sorted(r.block for r in sizes):
        yield Matcher([(r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(k)) == block).collect()])


def _with(docs: DataFrame, model: Broadcast) -> DataFrame:
    """The rows (doc_id, text, ...) with n_words, hit_ranges and items in place of the text."""
    rest = docs.drop("text")
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            sizes, ranges, items = model.value.scan(texts)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sizes), pa.array(ranges, pa.list_(pa.int64())), pa.array(list(map(sorted, items)), pa.list_(pa.string()))], names=[*names, "n_words", "hit_ranges", "items"])

    return docs.mapInArrow(run, StructType([*rest.schema, StructField("n_words", LongType()), StructField("hit_ranges", ArrayType(LongType())), StructField("items", ArrayType(StringType()))]))


def search(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, hit_ranges, items) of every row: what of the benchmark occurs in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = blocks(benchmark, chars)
    matcher, second = next(each, Matcher([])), next(each, None)
    send = docs.sparkSession.sparkContext.broadcast
    if second is None:
        return _with(rows, send(matcher))
    hits = _hits(rows, chain([matcher, second], each))
    counted = _with(rows.withColumn("h", F.xxhash64("text")), send(Matcher([]))).drop("hit_ranges", "items")
    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("none"), "h"]
    found = hits.groupBy(*key).agg(F.flatten(F.collect_list("hit_ranges")).alias("hit_ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = counted.select("doc_id", "n_words", *key).join(found, ["id", "none", "h"], "left")
    return out.select("doc_id", "n_words", F.coalesce("hit_ranges", F.array().cast("array<long>")).alias("hit_ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _hits(rows: DataFrame, matchers: Iterable[Matcher]) -> DataFrame:
    """(doc_id, h, block, hit_ranges, items) of the different texts each block occurs in, from a written table.

    Equal rows have equal results, so a row is known by its doc_id and its text's hash.
    """
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession).rstrip('/')}/benchmark-hits-{uuid.uuid4().hex}"
    for block, matcher in enumerate(matchers):
        model = spark.sparkContext.broadcast(matcher)
        found = _with(rows.withColumn("h", F.xxhash64("text")), model).where(F.size("items") > 0).drop("n_words")
        found.dropDuplicates(["doc_id", "h"]).withColumn("block", F.lit(block)).write.mode("append").parquet(folder)
        model.unpersist()
    return spark.read.parquet(folder)


def report(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document: its words, hit words, items, and whether it is contaminated."""
    found = search(docs, benchmark, chars)
    none = hashlib.sha256(b"").hexdigest()
    some = F.size("items") > 0
    digest = F.when(some, F.sha2(F.array_join(F.array_sort("items"), ","), 256)).otherwise(F.lit(none))
    return found.select("doc_id", "n_words", hit_words("hit_ranges").alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), some.alias("contaminated"))


def hit_words(ranges: str):
    """Words inside the union of a row's ranges, without leaving the JVM."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(ranges) / 2 - 1).cast("int")), lambda i: F.struct(F.get(ranges, (2 * i).cast("int")).alias("s"), F.get(ranges, (2 * i + 1).cast("int")).alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), p["e"] - F.greatest(p["s"], a["reach"]))).alias("n"), F.greatest(a["reach"], p["e"]).alias("reach"))
    return F.when(F.size(ranges) > 0, F.aggregate(pairs, zero, step, lambda a: a["n"])).otherwise(F.lit(0).cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """Pipeline stage: rows in which no benchmark window occurs, all columns kept."""
    each = blocks(benchmark, chars)
    matcher, second = next(each, Matcher([])), next(each, None)
    if second is not None:
        keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.col("doc_id").isNull()]
        hits = _hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chain([matcher, second], each))
        bad = hits.select(keys[0].alias("_id"), keys[1].alias("_none"), F.col("h").alias("_h")).distinct()
        return docs.join(bad, (keys[0] == bad["_id"]) & (keys[1] == bad["_none"]) & (F.xxhash64(docs["text"]) == bad["_h"]), "left_anti")
    model = docs.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield part.filter(pa.array([not x for x in model.value.scan(texts)[2]], pa.bool_()))

    return map_rows(docs, run)
