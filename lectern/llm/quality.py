"""Quality scores by Bradley-Terry ranking.

Every document has a latent score, linear in shape features of its whole text.
From all pairs of a preferred and a rejected document among all labelled rows the
weights are learned by logistic loss on feature differences, without making the
pairs: a row's part in the loss depends on its score and on how the other class's
scores are spread. The share of accepted documents among the labels then fixes the
threshold as a quantile of the scores.

Defined cases: null and empty texts have the features of the empty text; with
only one class of labels (or none) every document scores 0.5; repeated rows each
get a result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod, cut, sigmoid, slices

#: Ridge, most Newton steps, and the step that ends them.
RIDGE, STEPS, SMALL = 1e-3, 25, 1e-6
#: Width of the bins of scores, most points at which what they give is held, and coarse bins.
FINE, GRID, COARSE = 1 / 32, 8192, 32
#: Labelled rows of a task of the fit: every step reads all of them again.
TASK_ROWS = 20_000
#: A score from here on counts as good.
ACCEPT = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Bytes of a long text that are counted together.
PIECE_BYTES = 1 << 20
BLANK = re.compile(rb"\s")
UPPER, LOWER, DIGIT = (np.isin(np.arange(256), np.arange(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
HIGH = np.arange(256) >= 128
GROUPS = [UPPER, LOWER, DIGIT, HIGH] + [np.isin(np.arange(256), list(g)) for g in (b" ", b"\n", b".,;:", b"!?", b"#$%&*@~^=+", b"|", b"<>{}[]\\/_", b"'\"()-")]
MATRIX = np.stack(GROUPS, axis=1).astype(np.float64)


def pieces(raw: bytes) -> Iterator[bytes]:
    """The bytes in parts of about PIECE_BYTES that end at line ends or blanks, so that no word is cut; a longer word is one part."""
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        if end < len(raw):
            found = BLANK.search(raw, end)
            end = found.end() if found else len(raw)
        yield raw[at:end]
        at = end


def counted(raw: bytes) -> tuple[np.ndarray, int, int, int, int, int]:
    """Bytes by value, words, distinct words, words of one byte, lines and distinct lines."""
    histogram, kinds, rows = np.zeros(256, np.int64), set(), set()
    words = single = lines = 0
    rest = b""  # of a line that goes on
    for part in pieces(raw):
        histogram += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        own = part.split()
        kinds.update(own)
        words, single = words + len(own), single + sum(len(w) == 1 for w in own)
        *whole, rest = (rest + part).split(b"\n")
        lines += len(whole)
        rows.update(whole)
    rows.add(rest)
    return histogram, words, len(kinds), single, lines + 1, len(rows)


def features(texts: list) -> np.ndarray:
    """One row of shape features for each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    seen = list(map(counted, raw))
    histogram = np.array([s[0] for s in seen], np.int64).reshape(len(raw), 256)
    n = np.maximum(sizes, 1)[:, None]
    shares = histogram @ MATRIX / n
    letters = histogram[:, UPPER | LOWER | HIGH].astype(float)
    spread = -(letters / np.maximum(letters.sum(axis=1, keepdims=True), 1) * np.log(np.maximum(letters, 1) / np.maximum(letters.sum(axis=1, keepdims=True), 1))).sum(axis=1)
    rest = np.zeros((len(raw), 8))
    for i, (size, (_, words, kinds, single, lines, rows)) in enumerate(zip(sizes.tolist(), seen)):
        k = max(words, 1)
        rest[i] = np.log1p(words), np.log1p(size), size / k / 10, kinds / k, kinds / k**0.8, 1 - rows / lines, np.log1p(size / lines), single / k
    return np.hstack([np.sqrt(shares), shares, spread[:, None], rest])


class Ranking:
    """Standardised features, their weights, and the score that splits good from bad."""

    def __init__(self, mean: np.ndarray | None = None, sd: np.ndarray | None = None, weights: np.ndarray | None = None, threshold: float = 0.0):
        self.mean, self.sd, self.weights, self.threshold = mean, sd, weights, threshold

    @staticmethod
    def _crossed(z: np.ndarray) -> np.ndarray:
        return np.hstack([z, np.abs(z)])

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return self._crossed(np.clip((x - self.mean) / self.sd, -8, 8))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        return sigmoid(self.inputs(x) @ self.weights - self.threshold + np.log(ACCEPT / (1 - ACCEPT)))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def described(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """(doc_id, held_out, h, x): the features of every whole text, kept, and a digest that orders texts of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out", "h")), pa.array(list(features(texts)), pa.list_(pa.float64()))], names=["doc_id", "held_out", "h", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == fold).alias("held_out"), F.xxhash64("text").alias("h"), "text")
    return cut(rows.mapInArrow(run, "doc_id long, held_out boolean, h long, x array<double>"))


def summed(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of what ``add`` makes of labels and features of a part of the rows; a task gives one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = add(batch.column("label").to_numpy(zero_copy_only=False), matrix(batch.column("x")))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    return matrix(rows.select("label", "x").mapInArrow(run, "v array<double>").toArrow().column("v").combine_chunks()).sum(axis=0)


def score_rows(rows: DataFrame, model: Ranking) -> DataFrame:
    """(label, s): the linear scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(model.inputs(matrix(batch.column("x"))) @ model.weights)], names=["label", "s"])

    return rows.select("label", "x").mapInArrow(run, "label int, s double")


def histogram(rows: DataFrame, model: Ranking) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each class the bins of the scores, and how many rows each has.

    A row counts for the two bins whose middles are next to its score, by how near
    they are: so counts change smoothly with the weights, and the steps converge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, at = batch.column("label").to_numpy(zero_copy_only=False), model.inputs(matrix(batch.column("x"))) @ model.weights / FINE - 0.5
            low = np.floor(at)
            for k in (0, 1):
                own = label == k
                bins, place = np.unique(np.concatenate([low[own], low[own] + 1]).astype(np.int64), return_inverse=True)
                n = np.bincount(place, np.concatenate([1 - (at - low)[own], (at - low)[own]]), len(bins))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), k, np.int32)), pa.array(bins), pa.array(n)], names=["label", "b", "n"])

    found = few(rows.select("label", "x").mapInArrow(run, "label int, b long, n double").groupBy("label", "b").agg(F.sum("n").alias("n"))).sort_values("b")
    return {k: (found.b[found.label == k].to_numpy(np.int64), found.n[found.label == k].to_numpy(np.float64)) for k in (0, 1)}


def few(groups: DataFrame) -> pd.DataFrame:
    """Groups that are few by construction; one task ends them, however many the shuffle makes."""
    return groups.coalesce(1).toPandas()


def against(at: np.ndarray, scores: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of scores ``at``, the mean chance to win against rows with the other scores, and its slope."""
    won, slope = np.zeros(len(at)), np.zeros(len(at))
    for i in range(0, len(scores), 256):
        p = sigmoid(at[:, None] - scores[None, i : i + 256])
        won += p @ n[i : i + 256]
        slope += (p * (1 - p)) @ n[i : i + 256]
    return won / n.sum(), slope / n.sum()


def newton(rows: DataFrame, model: Ranking, counts: dict[int, int]) -> np.ndarray:
    """A step on the ridge-penalised loss over all pairs of a good and a bad row.

    What a row adds depends on its score and the other class's scores alone, so
    their histogram stands for all pairs; between its bins' middles it is
    interpolated. In the curvature, pairs are told apart by coarse bins.
    """
    bins = histogram(rows, model)
    low, high = min(b[0][0] for b in bins.values()), max(b[0][-1] for b in bins.values())
    grid = np.linspace((low - 1) * FINE, (high + 2) * FINE, int(min(high - low + 4, GRID)))
    middle = {k: (b + 0.5) * FINE for k, (b, _) in bins.items()}
    found = {k: against(grid, middle[1 - k], bins[1 - k][1]) for k in (0, 1)}
    pull, curve = (found[0][0], found[1][0] - 1), (found[0][1], found[1][1])
    edges = np.linspace(grid[0], grid[-1], COARSE + 1)
    d = len(model.weights)

    def add(label: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = model.inputs(x)
        s = z @ model.weights
        g, h, sums = np.zeros(d), np.zeros((d, d)), np.zeros((2, COARSE, d + 1))
        for k in (0, 1):
            own = label == k
            zk, sk = z[own], s[own]
            g += np.interp(sk, grid, pull[k]) @ zk / counts[k]
            h += (zk * np.interp(sk, grid, curve[k])[:, None]).T @ zk / counts[k]
            np.add.at(sums[k], np.clip(np.searchsorted(edges, sk, "right") - 1, 0, COARSE - 1), np.hstack([zk, np.ones((len(zk), 1))]))
        return np.concatenate([g, h.ravel(), sums.ravel()])

    total = summed(rows, add)
    g, h, sums = total[:d] + RIDGE * model.weights, total[d : d + d * d].reshape(d, d), total[d + d * d :].reshape(2, COARSE, d + 1)
    at = (edges[1:] + edges[:-1]) / 2
    p = sigmoid(at[:, None] - at[None, :])
    cross = (sums[1][:, :d].T / counts[1]) @ (p * (1 - p)) @ (sums[0][:, :d] / counts[0])
    values, axes = np.linalg.eigh(h - cross - cross.T + RIDGE * np.eye(d))
    return axes @ ((axes.T @ g) / np.maximum(values, RIDGE))


def split(rows: DataFrame, model: Ranking, share: float, n: dict[int, int]) -> float:
    """The score midway between the one up to which lies ``share`` of all mass, a class weighing as much as it has labels, and the next."""
    scored = cut(score_rows(rows, model))
    mass = F.sum(F.when(F.col("label") == 1, (1 - share) / n[1]).otherwise(share / n[0])).alias("mass")

    def reached(part: DataFrame, width: float, before: float) -> tuple[int, float]:
        """The first bin up to which the share is reached, and the mass before it."""
        bins = few(part.groupBy(F.floor(F.col("s") / width).alias("b")).agg(mass)).sort_values("b")
        total = before + np.cumsum(bins.mass.to_numpy())
        at = min(int(np.searchsorted(total, share - 1e-9)), len(bins) - 1)
        return int(bins.b.iloc[at]), float(total[at] - bins.mass.iloc[at])

    b, before = reached(scored, FINE, 0.0)
    b, _ = reached(scored.where(F.floor(F.col("s") / FINE) == b), FINE / 2**14, before)
    own = F.floor(F.col("s") / (FINE / 2**14))
    last, after = scored.agg(F.max(F.when(own == b, F.col("s"))), F.min(F.when(own > b, F.col("s")))).first()
    return last if after is None else (last + after) / 2


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, kept: DataFrame | None = None) -> Ranking:
    """The ranking of all labelled rows outside the held-out fold; ``kept`` are the features of the documents, if there are any yet.

    Null ids and labels are left out, an id with two labels counts with the
    larger, of an id with several texts the one with the smallest hash counts.
    """
    outside = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc_mod("doc_id", folds) != fold))
    known = outside.groupBy("doc_id").agg(F.max("label").alias("label")).where(F.col("label").isin(0, 1))
    found = (described(docs, folds, fold) if kept is None else kept).where(~F.col("held_out")).join(known, "doc_id")
    labelled, share = outside.agg(F.count("*"), F.avg((F.col("label") == 0).cast("double"))).first()
    rows = cut(found.groupBy("doc_id", "label").agg(F.min_by("x", F.struct("h", "x")).alias("x")).coalesce(max(1, -(-labelled // TASK_ROWS))))
    counts = {r.label: r.n for r in few(rows.groupBy("label").agg(F.count("*").alias("n"))).itertuples()}
    if len(counts) < 2:
        return Ranking()
    n = sum(counts.values())
    # sums in another order differ in their last digits: what they give is rounded
    mean = rounded(summed(rows, lambda label, x: x.sum(axis=0)) / n)
    sd = rounded(np.sqrt(summed(rows, lambda label, x: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-6)
    model = Ranking(mean, sd, np.zeros(2 * len(mean)))
    for _ in range(STEPS):
        step = newton(rows, model, counts)
        model.weights = np.round(model.weights - step, 9)
        if np.abs(step).max() < SMALL:
            break
    model.threshold = round(split(rows, model, share, counts), 9)
    return model


def rounded(values: np.ndarray) -> np.ndarray:
    return np.array([float(f"{v:.10g}") for v in values])


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    rows = described(docs, folds, fold)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, fold, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.value.scores(matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "x").mapInArrow(run, SCHEMA)
