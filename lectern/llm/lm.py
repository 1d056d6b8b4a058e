"""Language-model scores: online logistic mixing of context bit predictors.

A text is predicted byte by byte and bit by bit. Predictors for contexts of one
to four bytes have exact counts of zeros and ones, all from one table of the
distinct runs of five bytes, which grows with the corpus. Their stretched
probabilities are combined by weights that two gates choose (the bits of the
byte so far, and how far back the context is known), and the mix is refined by a
table of what really followed such predictions. Weights and refinements are
learned online over parts of the table of training runs, whose number follows its
size, each run predicted from all occurrences but its own, and averaged; so they
depend neither on held-out texts nor on how the input is partitioned. With the model fixed, a byte's cost depends only on itself
and the four bytes before it: costs of frequent runs are looked up in place, all
others are joined.

Beside it stands the word-frequency score: frequent words (a bounded table) are
looked up in place, all others are joined with the counts of all words.

Defined cases: null and empty texts are the end alone; without training texts
counts are zero and every bit costs one bit; repeated rows each get a row and,
outside the held-out fold, count each time; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod, cut, slices, sums

#: Bytes of context of each predictor.
ORDERS = (1, 2, 3, 4)
DEPTH = max(ORDERS)
PRIME = np.uint64(0x9E3779B97F4A7C15)
INPUTS = len(ORDERS) + 1
LEVELS, STEPS = 3 * (len(ORDERS) + 1), 25
#: Parts of the table of runs that learn apart (at least, and runs of training texts in one beyond that), runs a part
#: learns from at once, passes over them, runs per weight update.
PARTS, PART_RUNS, HELD, PASSES, UPDATE = 32, 4_000_000, 100_000, 8, 1024
#: Binary log of a worker's table of costs, frequent runs and frequent words that are looked up in place.
TABLE_BITS, FREQUENT_RUNS, FREQUENT = 21, 1 << 20, 120_000
FLUSH = 400_000
WEIGHTS = 256 * INPUTS + LEVELS * INPUTS
PARAMETERS = WEIGHTS + 2 * 256 * STEPS
#: Costs are whole numbers of this part of a decimal digit, so that sums do not depend on their order.
UNIT = 1e-8
#: Bytes of one text that are looked at together.
TEXT_BYTES = 4_000_000


def runs(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts, and of their ends, with the bytes before it as one number, the nearest foremost; and counts by text."""
    return _keys([bytes(DEPTH) + (t or "").encode("utf-8", "replace") + b"\0" for t in texts])


def _keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same of pieces that begin with their context."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    key = data[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        key |= data[DEPTH - back : len(data) - back] << np.uint64(8 * (DEPTH + 1 - back))
    keep = np.ones(len(key), bool)
    starts = np.cumsum(sizes)[:-1]
    for k in range(DEPTH):  # what stands before a piece is context only
        keep[starts + k - DEPTH] = False
    return key[keep], sizes - DEPTH


def run_parts(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """runs() of the texts, long ones in parts: runs, counts, and which text each count belongs to."""
    short, own = [], []
    for i, t in enumerate(texts):
        raw = bytes(DEPTH) + (t or "").encode("utf-8", "replace") + b"\0"
        if len(raw) <= TEXT_BYTES:
            short.append(raw)
            own.append(i)
        else:
            for at in range(DEPTH, len(raw), TEXT_BYTES):
                yield *_keys([raw[at - DEPTH : at + TEXT_BYTES]]), [i]
    if short:
        yield *_keys(short), own


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, weights=n, minlength=len(out))


def context(keys: np.ndarray, order: int) -> np.ndarray:
    """The nearest bytes before, then the byte."""
    return (keys >> np.uint64(8 * (DEPTH + 1 - order)) << np.uint64(8)) | (keys & np.uint64(255))


class Counts:
    """How often bytes came after contexts, of whole groups of runs; ``first`` has those of order 1."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, first: tuple | None = None):
        self.by_order = []
        for order in ORDERS:
            k, c = first if order == 1 and first else added(context(keys, order), n)
            self.by_order.append((k, np.concatenate([[0.0], np.cumsum(c)])))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """By predictor and number of known bits (0 to 8): how often the byte's bits so far came."""
        out = np.empty((len(ORDERS), 9, len(keys)))
        for o, order in enumerate(ORDERS):
            (k, total), own = self.by_order[o], context(keys, order)
            for known in range(9):
                size = np.uint64(1 << (8 - known))
                low = own & ~(size - np.uint64(1))
                out[o, known] = total[np.searchsorted(k, low + size)] - total[np.searchsorted(k, low)]
        return out


def inputs(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the 8 bits of each run: bits so far, the bit, stretched probabilities (and a bias), and the gate of known context."""
    byte = (keys & np.uint64(255)).astype(np.int64) | 256
    shift = np.arange(8, 0, -1)[:, None]
    node, bit = byte >> shift, (byte >> (shift - 1)) & 1
    total, same = seen[:, :-1], seen[:, 1:]
    x = np.empty((INPUTS, *node.shape), np.float32)
    x[:-1] = np.log((same + 0.3) / (total - same + 0.3)) * (2 * bit - 1)
    x[-1] = 0.3
    known = (total > 0).sum(axis=0)
    top = np.take_along_axis(total, np.maximum(known - 1, 0)[None], axis=0)[0]
    return node, bit, x, np.minimum(known * 3 + (top > 3) + (top > 30), LEVELS - 1)


class Mixer:
    """Gated weights and the refinement table; with the runs learned so far where it is used by itself."""

    def __init__(self):
        self.by_node = np.full((256, INPUTS), 0.25, np.float32)
        self.by_level = np.full((LEVELS, INPUTS), 0.15, np.float32)
        self.speed_node, self.speed_level = np.full((256, INPUTS), 1e-2), np.full((LEVELS, INPUTS), 1e-2)
        self.seen, self.was_one = np.zeros((256, STEPS)), np.zeros((256, STEPS))
        self.bytes = 0
        self.runs = np.empty(0, np.uint64), np.empty(0)

    def mix(self, x: np.ndarray, node: np.ndarray, level: np.ndarray) -> np.ndarray:
        w = self.by_node[node] + self.by_level[level]
        return np.clip(np.einsum("ibk,bki->bk", x, w), -12, 12)

    @staticmethod
    def step(stretched: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(stretched * 2) + STEPS // 2, 0, STEPS - 1).astype(np.int64)

    def fit(self, keys: np.ndarray, n: np.ndarray, counts: Counts) -> None:
        """Move the weights online over distinct runs, each predicted from all other occurrences; then note what came."""
        node, bit, x, level = inputs(keys, counts(keys) - 1)
        every = np.broadcast_to(n, node.shape)
        for again in range(PASSES):
            order = np.random.default_rng(again).permutation(len(keys))
            for at in range(0, len(order), UPDATE):
                i = order[at : at + UPDATE]
                xi, e = x[..., i], every[:, i].ravel()
                miss = (bit[:, i] - 1 / (1 + np.exp(-self.mix(xi, node[:, i], level[:, i])))).ravel() * e
                for table, speed, gate in ((self.by_node, self.speed_node, node[:, i].ravel()), (self.by_level, self.speed_level, level[:, i].ravel())):
                    g = np.stack([np.bincount(gate, weights=miss * xi[k].ravel(), minlength=len(table)) for k in range(INPUTS)], axis=1)
                    g /= np.maximum(np.bincount(gate, weights=e, minlength=len(table)), 1)[:, None]
                    speed += g * g
                    table += (0.02 * g / np.sqrt(speed)).astype(np.float32)
        where = (node * STEPS + self.step(self.mix(x, node, level))).ravel()
        self.seen += np.bincount(where, weights=every.ravel(), minlength=256 * STEPS).reshape(256, STEPS)
        self.was_one += np.bincount(where, weights=(every * bit).ravel(), minlength=256 * STEPS).reshape(256, STEPS)
        self.bytes += int(n.sum())

    def learn(self, keys: np.ndarray) -> None:
        self.runs = added(np.concatenate([self.runs[0], keys]), np.concatenate([self.runs[1], np.ones(len(keys))]))
        self.fit(*self.runs, Counts(*self.runs))

    def cost(self, keys: np.ndarray, counts: Counts | None = None) -> np.ndarray:
        """-log10 of the probability of each run's last byte."""
        counts, out = counts or Counts(*self.runs), np.empty(len(keys))
        for at in range(0, len(keys), 8192):
            part = keys[at : at + 8192]
            node, bit, x, level = inputs(part, counts(part))
            s = self.mix(x, node, level)
            p = 1 / (1 + np.exp(-s.astype(np.float64)))
            where = self.step(s)
            refined = (self.was_one[node, where] + 8 * p) / (self.seen[node, where] + 8)
            p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
            out[at : at + 8192] = -np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=0)
        return out


def run_counts(rows: DataFrame) -> DataFrame:
    """(k, n, m): every distinct run of five bytes, how often it came in training texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, m = np.empty(0, np.uint64), np.empty(0), np.empty(0)
        for part, texts in slices(batches, "text"):
            learned = ~np.asarray(part.column("held_out").to_pylist(), bool)
            for new, sizes, which in run_parts(texts):
                train = np.repeat(learned[which], sizes)
                own, at = np.unique(new, return_inverse=True)
                both = np.concatenate([keys, own])
                n = np.concatenate([n, np.bincount(at, weights=train, minlength=len(own))])
                m = np.concatenate([m, np.bincount(at, minlength=len(own))])
                keys, at = np.unique(both, return_inverse=True)
                n, m = np.bincount(at, weights=n), np.bincount(at, weights=m)
                if len(keys) > FLUSH:
                    yield _table(k=keys, n=n, m=m)
                    keys, n, m = np.empty(0, np.uint64), np.empty(0), np.empty(0)
        yield _table(k=keys, n=n, m=m)

    return rows.mapInArrow(run, "k long, n long, m long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v.astype(np.int64)) for c, v in columns.items()})


def groups(batches: Iterator[pa.RecordBatch], least: int, learned: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted runs with n and m: as few whole sets of runs with the same two bytes before as make so many runs.

    Where one group ends depends on the runs alone, not on how batches are cut.
    With ``learned``, only runs of training texts count; others are not seen.
    """
    held = tuple(np.empty(0, np.int64) for _ in "knm")
    for batch in _ended(batches):
        if batch is not None:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in "knm"]
            if learned:
                new = [x[new[1] > 0] for x in new]
            held = tuple(map(np.concatenate, zip(held, new)))
        k = held[0]
        if batch is not None and len(k) < least:
            continue
        edges = np.concatenate([np.flatnonzero((k[1:] >> 24) != (k[:-1] >> 24)) + 1, [len(k)]]) if len(k) else np.empty(0, np.int64)
        if batch is not None:  # the last set may go on
            edges = edges[:-1]
        at = 0
        while at < len(k) and (i := int(np.searchsorted(edges, at + least))) < len(edges):
            end = int(edges[i])
            yield k[at:end].astype(np.uint64), held[1][at:end].astype(np.float64), held[2][at:end]
            at = end
        if batch is None and at < len(k):
            yield k[at:].astype(np.uint64), held[1][at:].astype(np.float64), held[2][at:]
        held = tuple(x[at:] for x in held)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def priced(counts: DataFrame) -> DataFrame:
    """(k, m, cost) of every run, costs in units: the weights are fitted by part of the table, averaged, then used unchanged."""
    byte = F.col("k").bitwiseAND(255)
    rows = counts.where("n > 0").groupBy(F.shiftright("k", 32).alias("c"), byte.alias("b")).agg(F.sum("n").alias("n")).select((F.col("c") * 256 + F.col("b")).alias("k"), "n").orderBy("k").collect()
    first = np.array([r.k for r in rows], np.uint64), np.array([r.n for r in rows], np.float64)
    learned = counts.where("n > 0")
    parts, held = max(PARTS, -(-learned.count() // PART_RUNS)), HELD
    dealt = lambda rows: rows.repartition(parts, F.shiftright("k", 24)).sortWithinPartitions("k")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer()
        for k, n, _ in groups(batches, held, learned=True):
            counted = Counts(k, n, first)
            for at in range(0, len(k), 2 * held):  # a large set is learned from in pieces
                own.fit(k[at : at + 2 * held], n[at : at + 2 * held], counted)
        if own.bytes:
            weights = np.concatenate([own.by_node.ravel(), own.by_level.ravel()]).astype(np.float64) * own.bytes
            data = np.concatenate([weights, own.seen.ravel(), own.was_one.ravel(), [own.bytes]])
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    mixer = Mixer()
    if fitted := sorted(dealt(learned).mapInArrow(fit, "part int, data binary").collect()):
        got = np.sum([np.frombuffer(r.data, np.float64) for r in fitted], axis=0)
        mixer.bytes = int(got[-1])
        mixer.by_node = (got[: 256 * INPUTS] / got[-1]).reshape(256, INPUTS).astype(np.float32)
        mixer.by_level = (got[256 * INPUTS : WEIGHTS] / got[-1]).reshape(LEVELS, INPUTS).astype(np.float32)
        mixer.seen, mixer.was_one = got[WEIGHTS:PARAMETERS].reshape(2, 256, STEPS)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n, m in groups(batches, held):
            yield _table(k=k, m=m, cost=np.rint(mixer.cost(k, Counts(k, n, first)) / UNIT))

    return dealt(counts).mapInArrow(price, "k long, m long, cost long")


def frequent_runs(costs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs that come most, at most FREQUENT_RUNS, in order, with their costs."""
    step = F.floor(F.log2("m") * 4)
    sizes = {r.step: r.size for r in costs.groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()}
    least, held = math.inf, 0
    for s in sorted(sizes, reverse=True):
        if held + sizes[s] > FREQUENT_RUNS:
            break
        least, held = s, held + sizes[s]
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    t = costs.where(step >= least).select("k", "cost").toArrow()
    k, cost = t.column("k").to_numpy().astype(np.uint64), t.column("cost").to_numpy()
    order = np.argsort(k)
    return k[order], cost[order]


class Costs:
    """Costs of frequent runs, in a table that runs overwrite; -1 for runs that must be joined."""

    def __init__(self, known: np.ndarray, cost: np.ndarray):
        self.known, self.cost = known, cost
        self.keys, self.costs = np.full(1 << TABLE_BITS, np.uint64(2**64 - 1)), np.zeros(1 << TABLE_BITS, np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys * PRIME) >> np.uint64(64 - TABLE_BITS)
        out = self.costs[at]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            cost = np.full(len(new), -1)
            if len(self.known):
                spot = np.minimum(np.searchsorted(self.known, new), len(self.known) - 1)
                cost = np.where(self.known[spot] == new, self.cost[spot], -1)
            out[miss] = cost[back]
            at = (new * PRIME) >> np.uint64(64 - TABLE_BITS)
            self.keys[at], self.costs[at] = new, cost
        return out


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows; the end of a text counts as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for _, part in slices(batches, "text"):
            seen[b""] += len(part)
            seen.update(chain.from_iterable(map(tokens, part)))
            if len(seen) > FLUSH:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})


def frequent(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """All words from some count on, at most so many."""
    step = F.floor(F.log2("n") * 4)
    sizes = {r.step: r.size for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()}
    least, held = None, 0
    for s in sorted(sizes, reverse=True):
        if held + sizes[s] > most:
            break
        least, held = s, held + sizes[s]
    return {} if least is None else {bytes(r.word): r.n for r in counts.where(step >= least).collect()}


def score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, token counts, word-frequency score, model score and bits a byte (the end is one) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == fold).alias("held_out"), "text")
    training = rows.where("not held_out").select("text")
    counts = cut(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sc = docs.sparkSession.sparkContext
    priced_runs = cut(priced(cut(run_counts(rows))))
    often_run, known = sc.broadcast(frequent_runs(priced_runs)), sc.broadcast({w: math.log10(c + 1) for w, c in frequent(counts).items()})
    each = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, get = Costs(*often_run.value), known.value.get
        for part, texts in slices(batches, "text"):
            model, size, far = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[] for _ in texts]
            for keys, sizes, which in run_parts(texts):
                cost = costs(keys)
                apart, starts = cost < 0, np.cumsum(sizes) - sizes
                model[which] += np.add.reduceat(np.where(apart, 0, cost), starts)
                size[which] += sizes
                for i, own in zip(which, np.split(keys[apart], np.cumsum(np.add.reduceat(apart, starts, dtype=np.int64))[:-1])):
                    if len(own):
                        far[i].append(own)
            counts_ = np.array([sum(map(len, f)) for f in far])
            flat = np.concatenate([x for f in far for x in f] or [np.empty(0, np.uint64)])
            far = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts_)]).astype(np.int32)), pa.array(flat.astype(np.int64)))
            total, sure, base, rare, often = [], [], [], [], []
            for t in texts:
                words = [*tokens(t), b""]
                logs = list(map(get, words))
                other = Counter(w for w, x in zip(words, logs) if x is None)
                missing = other.total()
                total.append(len(words))
                sure.append(len(words) - missing)
                base.append(math.fsum(x for x in logs if x is not None))
                rare.append(list(other))
                often.append(list(other.values()))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"), pa.array(total, pa.int64()), pa.array(sure, pa.int64()), pa.array(base, pa.float64()),
                pa.array(model), pa.array(size), pa.array([b" ".join(r) if r else None for r in rare], pa.binary()), pa.array(often, pa.list_(pa.int32())), far,
            ], names=["doc_id", "held_out", "n_tokens", "sure", "base", "cost", "bytes", "rare", "often", "far"])

    first = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, sure long, base double, cost long, bytes long, rare binary, often array<int>, far array<long>")
    first = cut(first.withColumn("row", F.monotonically_increasing_id()))
    words = F.arrays_zip(F.split(F.col("rare").cast("string"), " ", -1).alias("w"), F.col("often").alias("k"))
    apart = first.where("rare is not null").select("row", F.explode(words).alias("x")).select("row", F.col("x.w").cast("binary").alias("word"), F.col("x.k").alias("k"))
    found = apart.join(counts, "word").groupBy("row").agg(F.sum("k").cast("long").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"))
    more = first.select("row", F.explode("far").alias("k")).groupBy("row", "k").count().join(priced_runs, "k").groupBy("row").agg(F.sum(F.col("count") * F.col("cost")).alias("far_cost"))
    zero = F.lit(0).cast("long")
    model = -(F.col("cost") + F.coalesce("far_cost", zero)) * UNIT
    return first.join(found, "row", "left").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("sure") + F.coalesce("more", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"), model.alias("score"), (-model / math.log10(2) / F.col("bytes")).alias("bits_per_byte"),
    )
