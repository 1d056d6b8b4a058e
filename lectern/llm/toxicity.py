"""Toxic spans by a linear-chain conditional random field.

Tokens are tagged toxic or not. Only documents carry labels, so training tokens
are labelled by them: in a toxic document the words that toxic documents hold
far more often than chance are toxic, all other tokens are not. The field has a
weight for each such word, a bias, and a weight for each transition; training
and scoring use exact forward-backward marginals over whole texts. A document's
score comes from its marginals (their sum, largest and density), and tokens
with a marginal of one half or more give the offending offsets.

Defined cases: null and empty texts have no tokens and get the score of that;
with only one class of labels (or none) every score is the share of toxic
labels; repeated rows each get a result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WordTable, crc_mod, cut, map_rows, sigmoid, slices, sums
from lectern.llm.labelled import sample

#: Labelled rows the field is fitted on, by class, and the longest of them.
TOXIC_ROWS, CLEAN_ROWS, MAX_CHARS = 4000, 8000, 50_000
#: Rows of each class whose token sequences train the field on the driver.
SEQUENCES = 1500
#: A word belongs to toxic documents if they hold it by so many standard deviations more than chance.
SIGNIFICANT, MIN_DOCS, WORDS = 5.0, 5, 20_000
REJECT = 0.3
BLOCK = 256
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
TOKEN = re.compile(r"\S+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans string"


def normal(token: str) -> str:
    return EDGE.sub("", token.lower())


def marginals(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """P(toxic) of each token of consecutive sequences, by exact forward-backward.

    ``odds`` are the tokens' emission odds exp(e); ``moves`` is the 2x2 matrix of
    transition potentials; each sequence starts as if after a clean token. Long
    sequences are cut in blocks whose 2x2 products are chained first, so work is
    vectorised over blocks. With ``pairs`` the summed transition posteriors come too.
    """
    n = len(odds)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    (m00, m01), (m10, m11) = moves
    lengths = lengths[lengths > 0]
    blocks = -(-lengths // BLOCK)
    seq = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = (np.cumsum(lengths) - lengths)[seq] + nth * BLOCK
    size = np.minimum(lengths[seq] - nth * BLOCK, BLOCK)
    width = int(size.max())
    at = start[:, None] + np.arange(width)
    valid = np.arange(width) < size[:, None]
    w = np.where(valid, odds[np.minimum(at, n - 1)], 1.0).T.copy()
    live = valid.T.copy()
    forward, backward = np.zeros(len(seq)), np.ones(len(seq))
    if len(seq) > len(lengths):
        p00, p01, p10, p11 = np.ones(len(seq)), np.zeros(len(seq)), np.zeros(len(seq)), np.ones(len(seq))
        for t in range(width):
            q00, q01 = p00 * m00 + p01 * m10, (p00 * m01 + p01 * m11) * w[t]
            q10, q11 = p10 * m00 + p11 * m10, (p10 * m01 + p11 * m11) * w[t]
            scale = 1 / (q00 + q01 + q10 + q11)
            ok = live[t]
            p00, p01 = np.where(ok, q00 * scale, p00), np.where(ok, q01 * scale, p01)
            p10, p11 = np.where(ok, q10 * scale, p10), np.where(ok, q11 * scale, p11)
        by_nth = [np.flatnonzero(nth == k) for k in range(int(blocks.max()))]
        for k in range(1, len(by_nth)):  # ratio after the block before
            i = by_nth[k] - 1
            forward[by_nth[k]] = (p01[i] + forward[i] * p11[i]) / (p00[i] + forward[i] * p10[i])
        for k in range(len(by_nth) - 1, 0, -1):  # ratio before the block after
            i = by_nth[k]
            backward[i - 1] = (p10[i] + p11[i] * backward[i]) / (p00[i] + p01[i] * backward[i])
    before, after = np.empty_like(w), np.empty_like(w)
    r = forward
    for t in range(width):
        before[t] = r
        r = np.where(live[t], w[t] * (m01 + m11 * r) / (m00 + m10 * r), r)
    b = backward
    for t in range(width - 1, -1, -1):
        after[t] = b
        b = np.where(live[t], (m10 + m11 * w[t] * b) / (m00 + m01 * w[t] * b), b)
    own = w * (m01 + m11 * before) / (m00 + m10 * before)
    p = own * after / (1 + own * after)
    out = np.empty(n)
    out[at[valid]] = p.T[valid]
    if not pairs:
        return out
    x = np.stack([m00 + 0 * w, m01 * w * after, m10 * before, m11 * before * w * after])
    x = (x / x.sum(axis=0))[:, live].sum(axis=1)
    return out, x.reshape(2, 2)


class Field:
    """The words with their emission weights, the transitions, and the document-level weights."""

    def __init__(self, words: list[str], prior: float):
        self.words = {w: i + 1 for i, w in enumerate(words)}
        self.emission = np.zeros(len(words) + 1)
        self.moves = np.zeros((2, 2))
        self.doc_weights, self.prior = None, prior

    def train(self, tokens: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, steps: int = 80) -> None:
        """Maximum likelihood by AdaGrad; tokens are word numbers, 0 for any other word."""
        truth = (tokens > 0) & np.repeat(toxic == 1, lengths)
        if not truth.any():
            return
        y = truth.astype(np.float64)
        first = np.zeros(len(tokens), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        prev = np.where(first, 0, np.roll(truth, 1)).astype(int)
        seen = np.bincount(prev * 2 + truth, minlength=4).reshape(2, 2)
        count = np.maximum(np.bincount(tokens, minlength=len(self.emission)), 1.0)
        want = np.bincount(tokens, weights=y, minlength=len(self.emission))
        # start at each word's own log-odds
        self.emission = np.log((want + 0.1) / (count - want + 0.1))
        g_e, g_m = np.full(len(self.emission), 1e-8), np.full((2, 2), 1e-8)
        for _ in range(steps):
            p, pair = marginals(np.exp(np.clip(self.emission, -30, 30))[tokens], lengths, np.exp(self.moves), pairs=True)
            d_e = (np.bincount(tokens, weights=p, minlength=len(self.emission)) - want) / count + 1e-3 * self.emission
            d_m = (pair - seen) / seen.sum() + 1e-4 * self.moves
            g_e += d_e**2
            g_m += d_m**2
            self.emission -= 0.3 * d_e / np.sqrt(g_e)
            self.moves -= 0.1 * d_m / np.sqrt(g_m)

    def table(self) -> WordTable:
        odds = np.exp(np.clip(self.emission, -30, 30))
        return WordTable(lambda new: odds[[self.words.get(normal(w), 0) for w in new]] if new else odds[:0])

    def tag(self, texts: list, table: WordTable) -> tuple[list, np.ndarray, np.ndarray]:
        """Tokens of each text, their counts, and all marginals in a row."""
        words = [(t or "").split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = table.look_up(list(chain.from_iterable(words)))
        return words, lengths, marginals(table.rows[at], lengths, np.exp(self.moves))

    @staticmethod
    def offending(texts: list, lengths: np.ndarray, p: np.ndarray) -> list[list]:
        """Of each text, the tokens with a marginal of one half or more: match and marginal."""
        ends, hot, out = np.cumsum(lengths), np.concatenate([[0], np.cumsum(p >= 0.5)]), []
        for text, end, n in zip(texts, ends.tolist(), lengths.tolist()):
            own = p[end - n : end] if hot[end] > hot[end - n] else ()
            out.append([(m, float(x)) for m, x in zip(TOKEN.finditer(text), own) if x >= 0.5] if len(own) else [])
        return out

    @staticmethod
    def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Document features: expected toxic tokens, largest marginal, density."""
        total = sums(p, lengths)
        most = np.zeros(len(lengths))
        full = lengths > 0
        if full.any():
            most[full] = np.maximum.reduceat(p, (np.cumsum(lengths) - lengths)[full])
        return np.stack([np.ones(len(lengths)), np.log1p(total), most, np.sqrt(total / np.maximum(lengths, 1)), np.minimum(total, 3)], axis=1)

    def fit_documents(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression, each class weighted to its share among all labels."""
        if not (y == 1).any() or not (y == 0).any():
            return
        weight = np.where(y == 1, self.prior / (y == 1).sum(), (1 - self.prior) / (y == 0).sum())
        w = np.zeros(x.shape[1])
        ridge = 1e-5 * np.eye(len(w))
        for _ in range(30):
            p = sigmoid(x @ w)
            g = x.T @ (weight * (p - y)) + ridge @ w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
            step = np.linalg.solve(h, g)
            w -= step * min(1, 5 / max(1e-9, np.abs(step).max()))
        self.doc_weights = w

    def scores(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.doc_weights is None:
            return np.full(len(lengths), self.prior)
        return sigmoid(self.summary(p, lengths) @ self.doc_weights)


def word_counts(few: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of either class that hold the word, added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for part, texts in slices(batches, "text"):
            for label, text in zip(part.column("label").to_pylist(), texts):
                seen[label].update({normal(w) for w in set((text or "").split())})
        words = sorted(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    return few.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> Field:
    few = cut(sample(docs, labels, "toxic", folds, fold, {0: CLEAN_ROWS, 1: TOXIC_ROWS}, MAX_CHARS))
    sizes = {r.label: r.n for r in few.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    prior = labels.where(F.col("toxic").isNotNull() & (crc_mod("doc_id", folds) != fold)).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    if not clean or not toxic:
        return Field([], prior)
    expected = (F.col("toxic") + F.col("clean")) * (toxic / (toxic + clean))
    telling = word_counts(few).where((F.col("toxic") >= MIN_DOCS) & (F.col("word") != "") & ((F.col("toxic") - expected) >= SIGNIFICANT * F.sqrt(expected)))
    words = [r.word for r in telling.orderBy(F.desc((F.col("toxic") - expected) / F.sqrt(expected)), "word").limit(WORDS).collect()]
    field = Field(words, prior)
    model = few.sparkSession.sparkContext.broadcast(field.words)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            rows = [np.array([model.value.get(normal(w), 0) for w in (t or "").split()], np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows, pa.binary())], names=["label", "tokens"])

    # hashes come first, so that no task gathers texts: of each class those up to the last hash wanted
    hashed = few.withColumn("h", F.xxhash64("text"))
    order = sorted((r.label, r.h) for r in hashed.select("label", "h").collect())
    last = {label: [h for own, h in order if own == label][:SEQUENCES][-1] for label in (0, 1)}
    some = hashed.where(F.col("h") <= F.when(F.col("label") == 1, F.lit(last[1])).otherwise(F.lit(last[0])))
    rows = sorted(some.select("label", "text").mapInArrow(number, "label int, tokens binary").collect(), key=lambda r: (r.label, bytes(r.tokens)))
    tokens = np.frombuffer(b"".join(bytes(r.tokens) for r in rows), np.int32)
    lengths = np.array([len(r.tokens) // 4 for r in rows], np.int64)
    truth = np.array([r.label for r in rows])
    field.train(tokens, lengths, truth)
    p = marginals(np.exp(np.clip(field.emission, -30, 30))[tokens], lengths, np.exp(field.moves))
    field.fit_documents(field.summary(p, lengths), truth)
    return field


def score(docs: DataFrame, field: Field, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending offsets (start:end by code points, end exclusive) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value.table()
        for part, texts in slices(batches, "text"):
            _, lengths, p = model.value.tag(texts, table)
            s = model.value.scores(p, lengths)
            at = [",".join(f"{m.start()}:{m.end()}" for m, _ in found) for found in model.value.offending(texts, lengths, p)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= REJECT).astype(np.int32)), pa.array(at, pa.string())], names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == fold).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, start, end, token, marginal) of each toxic token, by code points, end exclusive."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value.table()
        for part, texts in slices(batches, "text"):
            _, lengths, p = model.value.tag(texts, table)
            out = [(doc, *m.span(), m.group(), x) for doc, found in zip(part.column("doc_id").to_pylist(), model.value.offending(texts, lengths, p)) for m, x in found]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], names=["doc_id", "start", "end", "token", "marginal"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, start int, end int, token string, marginal double")


def keep(docs: DataFrame, field: Field) -> DataFrame:
    """Pipeline stage: the rows that are not rejected, all columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value.table()
        for part, texts in slices(batches, "text"):
            _, lengths, p = model.value.tag(texts, table)
            yield part.filter(pa.array(model.value.scores(p, lengths) < REJECT, pa.bool_()))

    return map_rows(docs, run)
