"""Periodic runs of words: stretches that repeat with a period, found by seeds and extension on diagonals.

A run of period q and length at least max(12, 2q) holds, at lag q, at least
max(12 - q, q) words in a row that equal the word q further on. So its diagonal
(i, i + q) is found from any gram that fits into so many words: lags up to 23 use
grams of 6 words at every place; lags from 2m to 4m - 1 use grams of m = 12,
24, 48 ... words at every m-th place, one of which lies whole in the run. Grams
are indexed by hash and document; only those that recur in their document are
looked at, and the lags of a band are taken from the sorted index. A seed must
also match at the far end of what it promises; then it is extended word by word.

Two things keep repetitive texts from repeating work. Per lag, a table of the
furthest place covered skips seeds inside a stretch that was already extended. A
gram of m words that recurs inside one run of period d <= m can do so only at
multiples of d, whose stretches are that run again, so such lags are left out
before they are enumerated. A gram place then has O(m) lags on every m-th place,
so a text of n words gives O(n log n) seeds.

Defined cases: null and empty texts, and texts without words, have no words and
no runs; a document's work and memory follow its own length; repeated rows each
get a row; an empty table gives no rows; columns called n_words, runs or
collapsed are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lectern.llm.common import crc_mod, map_rows, parts

#: Words that the shortest run has, and words of the shortest gram: the overlap that such a run guarantees.
SHORTEST, GRAM = 12, 6
#: Seeds enumerated at once, and bytes of text in one step.
AT_ONCE, STEP_BYTES = 2_000_000, 4_000_000
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])
MORE = [StructField("n_words", LongType(), False), StructField("runs", ArrayType(RUN, False), False), StructField("collapsed", StringType(), False)]


@dataclass
class Words:
    """Words of many texts: their bytes with one space behind each word, where words begin, and words per text."""

    flat: np.ndarray
    begin: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Words:
        closed = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " ")
        if not len(closed):
            return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64))
        ends = np.frombuffer(closed.buffers()[1], np.int32)[closed.offset + 1 : closed.offset + len(closed) + 1]
        data = np.frombuffer(closed.buffers()[2], np.uint8)[: ends[-1]]
        blank = BLANK[data]
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[0] = False
        counts = np.diff(np.cumsum(first)[ends - 1], prepend=0)
        keep = first | ~blank
        flat = np.where(first, np.uint8(0x20), data)[keep]
        return Words(flat, np.concatenate([[0], np.flatnonzero(first[keep]) + 1]), counts)

    def ids(self) -> np.ndarray:
        """Equal numbers for equal words."""
        length = np.diff(self.begin) - 1
        letters = np.ones(len(self.flat), bool)
        letters[self.begin[1:] - 1] = False
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(self.flat[letters])])
        return words.dictionary_encode().indices.to_numpy()

    def piece(self, begin: int, end: int) -> bytes:
        """Words from begin up to end, a space behind each."""
        return self.flat[self.begin[begin] : self.begin[end]].tobytes()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    return (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def recurring(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at``, those whose gram occurs there more than once, by gram and place; and the grams' numbers."""
    order = np.argsort(gram[at], kind="stable")
    at = at[order]
    new = np.ones(len(at), bool)
    new[1:] = gram[at[1:]] != gram[at[:-1]]
    group = np.cumsum(new) - 1
    many = np.bincount(group, minlength=1)[group] > 1
    return at[many], group[many]


class Covered:
    """Stretches of each lag: the furthest place covered, and the runs found so far."""

    def __init__(self, word: np.ndarray):
        self.word, self.furthest, self.seen = word, {}, set()
        self.runs: list[tuple[int, int, int]] = []

    def _same(self, i: int, lag: int, step: int) -> int:
        """Words in a row, from i on in the direction, that equal the word a lag further on."""
        word, n, size = self.word, 0, 64
        room = len(word) - lag - i if step > 0 else i + 1
        while n < room:
            size = min(size, room - n)
            a = i + n if step > 0 else i - n - size + 1
            differ = word[a : a + size] != word[a + lag : a + lag + size]
            if differ.any():
                return n + int(differ.argmax() if step > 0 else differ[::-1].argmax())
            n, size = n + size, min(2 * size, 1 << 20)
        return n

    def extend(self, lag: int, places: np.ndarray) -> None:
        """All stretches of a lag that hold one of the ascending places."""
        k = int(np.searchsorted(places, self.furthest.get(lag, 0)))
        while k < len(places):
            i = int(places[k])
            end = i + self._same(i, lag, 1)
            begin = i - self._same(i - 1, lag, -1)
            self.furthest[lag] = max(end, i + 1)
            length = end - begin + lag
            if end > i and length >= max(SHORTEST, 2 * lag) and (begin, length) not in self.seen:
                self.seen.add((begin, length))
                self.runs.append((begin, length, lag))
            k = int(np.searchsorted(places, self.furthest[lag]))

    def reach(self, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of at most such a period, and how far the runs up to each start reach."""
        some = np.array(sorted((b, b + n) for b, n, q in self.runs if q <= period), np.int64).reshape(-1, 2)
        return some[:, 0], np.maximum.accumulate(some[:, 1])


def band(cover: Covered, gram: np.ndarray, m: int, places: np.ndarray, group: np.ndarray, low: int, high: int, need: Callable) -> None:
    """Looks at the lags from low to high of recurring grams of m words; from the first seed of a run need(lag) words match."""
    size = np.int64(len(gram) + high + 1)
    key = group * size + places  # ascending: by gram, then by place
    grid = np.flatnonzero(places % m == 0) if m > GRAM else np.arange(len(places))
    grid = grid[np.argsort(places[grid], kind="stable")]
    here, own = places[grid], group[grid] * size
    starts, reached = cover.reach(m)
    least = np.full(len(here), low, np.int64)
    if len(starts):
        run = np.searchsorted(starts, here, "right") - 1
        least = np.maximum(least, np.where(run >= 0, reached[run] - here - m + 1, low))
    first = np.searchsorted(key, own + here + least)
    count = np.maximum(np.searchsorted(key, own + here + high, "right") - first, 0)
    total = np.cumsum(count)
    at = 0
    while at < len(here):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        n = count[at:end]
        i = np.repeat(here[at:end], n)
        j = places[np.repeat(first[at:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        lag = j - i
        far = need(lag) - m
        last = len(gram) - 1
        ok = (j + far <= last) & (gram[np.minimum(i + far, last)] == gram[np.minimum(j + far, last)])
        i, lag = i[ok], lag[ok]
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        edge = [0, *(np.flatnonzero(lag[1:] != lag[:-1]) + 1).tolist(), len(lag)]
        for a, b in zip(edge, edge[1:]):
            if b > a:
                cover.extend(int(lag[a]), i[a:b])
        at = end


def runs_of(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period, as places in the row of all texts' words."""
    texts = len(counts)
    text = np.repeat(np.arange(texts), counts)
    # behind each text stands a mark that no other place has, so nothing matches across an end
    word = np.empty(len(ids) + texts, np.int64)
    place = np.arange(len(ids)) + text
    word[place] = ids
    marks = np.cumsum(counts) + np.arange(texts)
    word[marks] = -1 - np.arange(texts)
    owner = np.empty(len(word), np.uint64)
    owner[place], owner[marks] = text, np.arange(texts)
    cover = Covered(word)
    if len(word) >= SHORTEST:
        gram = mixed(owner + np.uint64(1), np.zeros(1, np.uint64))
        for k in range(GRAM):
            gram = mixed(gram[: len(word) - k], word[k:].astype(np.uint64))
        places, group = recurring(gram, np.arange(len(gram)))
        for low, high in ((1, 1), (2, 3), (4, 6), (7, 11), (12, 23)):
            if len(places):
                band(cover, gram, GRAM, places, group, low, high, lambda lag: np.maximum(SHORTEST - lag, lag))
        m, longest = GRAM, int(counts.max(initial=0))
        while len(places) and 8 * m <= longest:
            often = np.zeros(len(gram), bool)
            often[places] = True
            gram = mixed(gram[:-m], gram[m:])
            places, group = recurring(gram, np.flatnonzero(often[:-m] & often[m:]))
            m *= 2
            if len(places):
                band(cover, gram, m, places, group, 2 * m, 4 * m - 1, lambda lag, m=m: lag - m + 1)
    found = np.array(sorted((b, q, n) for b, n, q in cover.runs), np.int64).reshape(-1, 3)[:, [0, 2, 1]]
    found[:, 0] -= owner[found[:, 0]].astype(np.int64)
    return found


def collapsed(words: Words, runs: np.ndarray) -> pa.Array:
    """The texts without the words that a run holds after its first period, joined by single spaces."""
    edges = np.zeros(len(words.begin), np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    keep = np.repeat(kept, np.diff(words.begin))
    ends = np.concatenate([[0], np.cumsum(np.where(kept, np.diff(words.begin), 0))])
    last = np.concatenate([[0], np.cumsum(words.counts)])
    bounds = ends[last]
    data, some = words.flat[keep], bounds[1:] > bounds[:-1]
    inner = np.ones(len(data), bool)
    inner[bounds[1:][some] - 1] = False  # no space behind the last word
    offsets = np.concatenate([[0], np.cumsum(np.diff(bounds) - some)])
    return pa.Array.from_buffers(pa.large_string(), len(words.counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inner])]).cast(pa.string())


def _rows(batches: Iterator[pa.RecordBatch], change: Callable | None) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text", STEP_BYTES):
        if change is not None:
            part = change(part)
        words = Words.of(part.column("text"))
        runs = runs_of(words.ids(), words.counts)
        before = np.cumsum(words.counts) - words.counts
        text = np.searchsorted(np.cumsum(words.counts), runs[:, 0], "right")
        shown = [pa.array(runs[:, 0] - before[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=part.num_rows))]).astype(np.int32)
        by_text = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(shown, ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words.counts), by_text, collapsed(words, runs)], names=[*part.schema.names, *(f.name for f in MORE)])


def find(docs: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """The rows with n_words, runs (start, length and period in words, by start, then period) and the collapsed text.

    ``change`` may rewrite each part of rows before, text being called ``text``.
    """
    rows = docs.select([F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in {f.name for f in MORE}])
    return map_rows(rows, lambda batches: _rows(batches, change), MORE)


def planted(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows whose last column, a hash, is divisible by 10 get a text whose end repeats, as the hash tells."""
    hashes = part.column(part.num_columns - 1).to_numpy()
    chosen = np.flatnonzero(hashes % 10 == 0)
    texts = part.column("text").take(pa.array(chosen))
    words, new = Words.of(texts), []
    before = np.cumsum(words.counts) - words.counts
    for g, n, at in zip((hashes[chosen] // 10).tolist(), words.counts.tolist(), before.tolist()):
        if n == 0:
            new.append(b"")
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        times, rest = divmod(n - a, p)
        new.append((words.piece(at, at + a) + words.piece(at + a, at + min(a + p, n)) * times + words.piece(at + a, at + a + rest))[:-1])
    mask = np.zeros(part.num_rows, bool)
    mask[chosen] = True
    text = pc.replace_with_mask(part.column("text"), pa.array(mask), pa.array(new, pa.binary()).cast(pa.string()))
    return part.set_column(part.schema.get_field_index("text"), "text", text)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the longest run and digests of all runs and of the collapsed text, with repetition planted by id."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), crc_mod("doc_id", 1 << 32).alias("hash"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = find(rows, planted).withColumn("best", best)
    length = -F.col("best.n")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
