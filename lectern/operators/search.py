"""Literal search in sources and translations."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lectern.functions.text import col


def count_matches(text: Column | str, query: str) -> Column:
    """Non-overlapping places of the query, whatever the case."""
    q = query.strip().lower()
    t = F.lower(F.coalesce(col(text), F.lit("")))
    return F.lit(0) if not q else ((F.length(t) - F.length(F.replace(t, F.lit(q), F.lit("")))) / len(q)).cast("int")


def matches(pages: DataFrame, by: list[str], query: str) -> DataFrame:
    """A row for each place on either side, the source's before the translation's within a page."""
    sides = None
    for rank, (side, text) in enumerate((("source", "source"), ("translation", "target"))):
        n = pages.select(*by, "page_number", F.lit(side).alias("side"), F.lit(rank).alias("side_rank"), count_matches(text, query).alias("n")).where("n > 0")
        sides = n if sides is None else sides.unionByName(n)
    return sides.withColumn("occurrence", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


def highlight(text: Column | str, query: str) -> Column:
    return F.regexp_replace(col(text), F.lit("(?i)" + re.escape(query.strip())), F.lit("<mark>$0</mark>")) if query.strip() else col(text)


#: Characters of an index's grams, folders that its postings are dealt to, and tasks that write one.
GRAM, BUCKETS, SPREAD = 3, 64, 8
#: Characters whose grams are put in order at once.
PIECE = 1 << 20


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages with their text last: the other columns, each gram of a piece of the text, and its positions."""
    for batch in batches:
        keys = pa.Table.from_batches([batch]).drop_columns([batch.schema.names[-1]])
        made, held = [], 0
        for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            for begin in range(0, len(text) - GRAM + 1, PIECE):
                codes = np.frombuffer(text[begin : begin + PIECE + GRAM - 1].encode("utf-32-le", "replace"), np.uint32)
                n = len(codes) - GRAM + 1
                key = sum(codes[k : n + k].astype(np.uint64) << np.uint64(21 * (GRAM - 1 - k)) for k in range(GRAM))
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
                letters = codes[order[first][:, None] + np.arange(GRAM)].tobytes().decode("utf-32-le")
                made.append((row, [letters[k : k + GRAM] for k in range(0, len(letters), GRAM)], np.diff(first, append=n), order + begin))
                held += n
                if held >= PIECE:
                    yield posted(keys, made)
                    made, held = [], 0
        if made:
            yield posted(keys, made)


def posted(keys: pa.Table, made: list) -> pa.RecordBatch:
    pages = keys.take(pa.array(np.repeat([m[0] for m in made], [len(m[1]) for m in made]))).combine_chunks()
    ends = np.concatenate([[0], np.cumsum(np.concatenate([m[2] for m in made]))]).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([m[3] for m in made]).astype(np.int32)))
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pages.columns]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array([g for m in made for g in m[1]]), places], names=[*keys.column_names, "gram", "positions"])


def write_index(pages: DataFrame, by: list[str], folder: str, buckets: int = BUCKETS) -> None:
    """Postings of both sides of pages: (side, by, page_number, gram, positions), in folders by the gram's hash, sorted by gram.

    A gram is GRAM characters of the lower-cased text; positions count from 0. A
    page has a row for each gram that it holds, a long one for each piece of it.
    Plain SQL reads these rows, but all of them are shuffled; for large tables
    ``write_blocks`` writes half as much and shuffles nothing.
    """
    sides = None
    for rank, (side, text) in enumerate((("source", "source"), ("translation", "target"))):
        one = pages.select(*by, "page_number", F.lit(side).alias("side"), F.lit(rank).alias("side_rank"), F.lower(F.coalesce(col(text), F.lit(""))).alias("_c"))
        sides = one if sides is None else sides.unionByName(one)
    schema = StructType([*(f for f in sides.schema if f.name != "_c"), StructField("gram", StringType()), StructField("positions", ArrayType(IntegerType()))])
    rows = sides.mapInArrow(postings, schema).withColumn("bucket", bucket(F.col("gram"), buckets))
    # a bucket is dealt to several tasks by page, so that a frequent gram is not one task's
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(*by, "page_number"), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def indexed_matches(spark: SparkSession, folder: str, by: list[str], query: str, buckets: int = BUCKETS) -> DataFrame:
    """``matches`` by the postings of a written index; only the buckets of the query's grams are read.

    Grams at every GRAM-th place of the query, and its last one, cover it, so a
    page holds it where all of them stand at their distances: an intersection of
    shifted positions, without looking at texts. Places that overlap an earlier
    one do not count. Shorter queries have no gram and are found by ``matches``.
    """
    q = query.strip().lower()
    if len(q) < GRAM:
        raise ValueError(f"an index finds queries of {GRAM} characters or more")
    offsets = sorted({*range(0, len(q) - GRAM + 1, GRAM), len(q) - GRAM})
    wanted = {q[o : o + GRAM] for o in offsets}
    slots = sorted({r[0] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(bucket(F.col("g"), buckets)).collect()})
    rows = spark.read.parquet(folder).where(F.col("bucket").isin(slots) & F.col("gram").isin(*wanted))
    # a gram that stands at several offsets counts for each
    shifts = F.create_map(*(x for g in wanted for x in (F.lit(g), F.array(*(F.lit(o) for o in offsets if q[o : o + GRAM] == g)))))
    page = [*by, "page_number", "side", "side_rank"]
    rows = rows.select(*page, "gram", F.explode("positions").alias("position"))
    each = rows.select(*page, "position", F.explode(F.element_at(shifts, F.col("gram"))).alias("_o")).select(*page, (F.col("position") - F.col("_o")).alias("_p"))
    whole = each.groupBy(*page, "_p").agg(F.count("*").alias("_n")).where(F.col("_n") == len(offsets))
    counted = whole.groupBy(*page).agg(F.array_sort(F.collect_list("_p")).alias("_m"))
    start = F.struct(F.lit(-(1 << 30)).alias("last"), F.lit(0).alias("n"))
    apart = F.aggregate("_m", start, lambda a, p: F.when(p >= a["last"] + len(q), F.struct(p.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])
    counted = counted.withColumn("n", apart)
    return counted.select(*by, "page_number", "side", "side_rank", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("occurrence"))


#: Characters of a block, whose pages share their rows of grams; a longer page is a block of several pieces.
BLOCK = 1 << 20
#: The folder of the blocks' pages.
PAGES = -1


def write_blocks(pages: DataFrame, by: list[str], folder: str, buckets: int = BUCKETS, size: int = BLOCK) -> None:
    """Postings of both sides of pages, for ``block_matches``: (block, begin, gram, places), and (block, start, page) in a folder of its own.

    The texts of a block stand one after another with a character between them,
    so that a place is one number for page and position. A block has a row for
    each gram that it holds. Blocks are made where their pages are read and put
    in folders by the gram's hash there: nothing is shuffled.
    """
    texts = [F.lower(F.coalesce(col(t), F.lit(""))).alias(f"_{t}") for t in ("source", "target")]
    own = pages.select(*by, "page_number", *texts)
    page = StructType([*own.schema.fields[:-2], StructField("side", StringType()), StructField("side_rank", IntegerType())])
    schema = StructType([StructField("block", LongType()), StructField("begin", IntegerType()), StructField("gram", StringType()), StructField("places", BinaryType()), StructField("start", IntegerType()), StructField("page", page)])
    rows = own.mapInArrow(partial(blocks, size=size), schema)
    # a row of no block: without any, an index of no pages could not be read
    rows = rows.unionByName(pages.sparkSession.range(0, 1, 1, 1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema)))
    dealt = rows.withColumn("bucket", F.when(F.col("gram").isNull(), PAGES).otherwise(bucket(F.col("gram"), buckets)))
    dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``write_blocks``, of pages with their lower-cased source and translation last."""
    number, length, texts, pages = TaskContext.get().partitionId() << 32, 0, [], []
    for batch in batches:
        keys = batch.select(range(batch.num_columns - 2))
        kind = pa.struct([*keys.schema, pa.field("side", pa.string()), pa.field("side_rank", pa.int32())])
        rows = keys.to_pylist()
        for rank, side in enumerate(("source", "translation")):
            for row, text in zip(rows, batch.column(keys.num_columns + rank).to_pylist()):
                if len(text) < GRAM:
                    continue
                if texts and length + len(text) >= size:
                    yield from block(number, texts, pa.array(pages, kind), size)
                    number, length, texts, pages = number + 1, 0, [], []
                texts.append(text)
                pages.append(row | {"side": side, "side_rank": rank})
                length += len(text) + 1
    if texts:
        yield from block(number, texts, pa.array(pages, kind), size)


def block(number: int, texts: list[str], pages: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("begin", pa.int32()), ("gram", pa.string()), ("places", pa.binary()), ("start", pa.int32()), ("page", pages.type)])
    rows = lambda n, **given: pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *(given.get(f.name, pa.nulls(n, f.type)) for f in list(schema)[1:])], schema=schema)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    yield rows(len(pages), start=pa.array(starts[:-1].astype(np.int32)), page=pages)
    text = "\0".join([*texts, ""])
    # no gram of a page begins at its last characters or between it and the next
    ends = (starts[1:, None] - np.arange(1, GRAM + 1)).ravel()
    for begin in range(0, len(text) - GRAM, size):
        codes = np.frombuffer(text[begin : begin + size + GRAM - 1].encode("utf-32-le", "replace"), np.uint32)
        whole = np.ones(len(codes) - GRAM + 1, bool)
        whole[ends[(ends >= begin) & (ends < begin + len(whole))] - begin] = False
        places, first = in_order(codes, np.flatnonzero(whole))
        if len(places):
            letters = codes[places[first][:, None] + np.arange(GRAM)].tobytes().decode("utf-32-le")
            steps = np.diff(places, prepend=0)
            steps[first] = places[first]
            yield rows(len(first), begin=pa.array(np.full(len(first), begin, np.int32)), gram=pa.array([letters[k : k + GRAM] for k in range(0, len(letters), GRAM)]), places=packed(steps, first))


def in_order(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places by the gram that stands there and then by place, and where each gram's begin.

    Few letters are numbered so that gram and place fit one number, which sorts several times as fast.
    """
    letters = np.flatnonzero(np.bincount(codes))
    wide, far = len(letters).bit_length(), len(codes).bit_length()
    if GRAM * wide + far <= 64:
        rank = np.zeros(letters[-1] + 1, np.uint64)
        rank[letters] = np.arange(len(letters))
        codes = rank[codes]
    else:
        wide = 64 // GRAM
    key = sum(codes[places + k].astype(np.uint64) << np.uint64(wide * (GRAM - 1 - k)) for k in range(GRAM))
    if GRAM * wide + far <= 64:
        key = np.sort(key << np.uint64(far) | places.astype(np.uint64))
        places, key = (key & np.uint64((1 << far) - 1)).astype(np.int64), key >> np.uint64(far)
    else:
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
    return places, np.flatnonzero(np.diff(key, prepend=~key[:1]))


def packed(steps: np.ndarray, first: np.ndarray) -> pa.Array:
    """Steps as bytes of seven bits, the last of each with the eighth set; a value for each gram."""
    width = np.ones(len(steps), np.int64)
    for k in range(1, 5):
        width += steps >= 1 << 7 * k
    ends = np.cumsum(width)
    data = np.zeros(ends[-1], np.uint8)
    data[ends - 1] = steps & 127 | 128
    for k in range(1, width.max()):
        long = width > k
        data[ends[long] - 1 - k] = steps[long] >> 7 * k & 127
    limits = np.append((ends - width)[first], ends[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(limits), pa.py_buffer(data)])


def unpacked(value: bytes) -> np.ndarray:
    """The places whose steps ``packed`` holds."""
    data = np.frombuffer(value, np.uint8)
    last = np.flatnonzero(data > 127)
    width, low = np.diff(last, prepend=-1), (data & 127).astype(np.int64)
    steps = low[last]
    for k in range(1, width.max(initial=0)):
        long = width > k
        steps[long] += low[last[long] - k] << 7 * k
    return np.cumsum(steps)


def covering(q: str) -> list[int]:
    """Offsets of grams that cover a query: every GRAM-th, and the last one."""
    return sorted({*range(0, len(q) - GRAM + 1, GRAM), len(q) - GRAM})


def block_matches(spark: SparkSession, folder: str, queries: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``matches`` of all queries, each with its query, by the postings of ``write_blocks``; only the buckets of the queries' grams are read.

    A block's few rows meet in one group, of places and pages of one block at
    most. A page holds a query where grams that cover it stand at their
    distances. Rows of equal keys are pages of their own, as in ``matches``.
    """
    sought = {q: q.strip().lower() for q in queries}
    if any(len(q) < GRAM for q in sought.values()):
        raise ValueError(f"an index finds queries of {GRAM} characters or more")
    wanted = sorted({q[o : o + GRAM] for q in sought.values() for o in covering(q)})
    slots = sorted({r[0] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(bucket(F.col("g"), buckets)).collect()})
    index = spark.read.parquet(folder)
    grams = index.where(F.col("bucket").isin(slots) & F.col("gram").isin(wanted)).select("block", "begin", "gram", "places")
    pages = index.where((F.col("bucket") == PAGES) & F.col("block").isNotNull()).select("block", "start", "page")
    schema = StructType([StructField("query", StringType()), pages.schema["page"], StructField("n", IntegerType())])
    counted = grams.groupBy("block").cogroup(pages.groupBy("block")).applyInArrow(partial(counted_in_block, sought=sought), schema)
    return counted.select("query", "page.*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("occurrence"))


def counted_in_block(grams: pa.Table, pages: pa.Table, sought: dict[str, str]) -> pa.Table:
    """Non-overlapping places of each query in each page of a block."""
    pieces = defaultdict(list)
    for row in grams.sort_by("begin").to_pylist():
        pieces[row["gram"]].append(row["begin"] + unpacked(row["places"]))
    places = {g: np.concatenate(p) for g, p in pieces.items()}
    pages = pages.sort_by("start")
    starts, found = pages["start"].to_numpy(), []
    for query, q in sought.items():
        hits = None
        for o in covering(q):
            at = places.get(q[o : o + GRAM], np.empty(0, np.int64)) - o
            hits = at if hits is None else np.intersect1d(hits, at, assume_unique=True)
        rows, n = np.unique(np.searchsorted(starts, apart(hits, len(q)), "right") - 1, return_counts=True)
        found.append(pa.table({"query": pa.array([query] * len(rows), pa.string()), "page": pages["page"].take(pa.array(rows)), "n": pa.array(n.astype(np.int32))}))
    return pa.concat_tables(found)


def apart(places: np.ndarray, width: int) -> np.ndarray:
    """Places, in order, that do not overlap one that counts before them."""
    if not (np.diff(places) < width).any():
        return places
    after, kept, at = np.searchsorted(places, places + width), [], 0
    while at < len(places):
        kept.append(at)
        at = after[at]
    return places[kept]
