"""Language identification by error-correcting output codes.

Each language has a codeword. One binary n-gram classifier per bit says whether
a text's language has that bit set; loss-weighted decoding takes the nearest
codeword, and a close runner-up flags the text as ambiguous.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a
null language is not learned from; without any labelled row all texts are
``und``; repeated rows each get their own result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WordTable, crc_mod, slices, sums

BUCKETS = 1 << 15
#: Rows on which the bits' reliability is measured: a bound on what reaches the driver.
CALIBRATION_ROWS = 400
#: Longest text, in characters, that serves for calibration.
CALIBRATION_CHARS = 20_000
SCHEMA = "doc_id long, held_out boolean, has_letter boolean, lang_pred string, score double, ambiguous boolean"


def codewords(k: int) -> np.ndarray:
    """A row of +1/-1 for each of k classes: exhaustive codes up to 6 classes, else separated random ones."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        # every way to split the classes in two, class 0 on the positive side
        sets = [set(c) for n in range(1, k) for c in combinations(range(1, k), n)]
        return np.array([[-1.0 if c in s else 1.0 for s in sets] for c in range(k)])
    rng, bits, best, apart = np.random.default_rng(17), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], size=(k, bits))
        d = min(int((a != b).sum()) for a, b in combinations(m, 2))
        if d > apart and all(abs(c.sum()) < k for c in m.T):
            best, apart = m, d
    return best


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams and trigrams of words that stand between spaces, and how many each word has."""
    padded = [b" " + w + b"  " for w in words]
    data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    a, b, c = data, np.roll(data, -1), np.roll(data, -2)
    keep = np.ones(len(data), bool)
    ends = np.cumsum(sizes)
    keep[ends - 1] = keep[ends - 2] = False  # they would reach into the next word
    two = ((a * 256 + b) * np.uint32(2654435761)) >> np.uint32(17)
    three = (((a * 65536 + b * 256 + c) * np.uint32(2246822519)) ^ np.uint32(0x9E3779B9)) >> np.uint32(17)
    both = np.stack([two[keep], three[keep]], axis=1).reshape(-1).astype(np.int64)
    return both, 2 * (sizes - 2)


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows with a language; each task adds up its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part, texts in slices(batches, "text"):
            by_lang: dict[str, list] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                by_lang.setdefault(lang, []).extend(_words(text))
            for lang, words in by_lang.items():
                found = np.bincount(_grams(words)[0], minlength=BUCKETS)
                totals[lang] = totals[lang] + found if lang in totals else found
        for lang, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(t[at], pa.int64())})

    found = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Coder:
    """Codewords, one weight per n-gram bucket and bit, and each bit's reliability."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        bits = self.code.shape[1]
        self.weights = np.zeros((BUCKETS, bits + 1), np.float32)
        for b in range(bits):
            up, down = share[self.code[:, b] > 0], share[self.code[:, b] < 0]
            if len(up) and len(down):
                self.weights[:, b] = np.log(up.mean(axis=0)) - np.log(down.mean(axis=0))
        self.weights[:, bits] = 1  # counts the n-grams
        self.scale, self.reliable = np.ones(bits), np.ones(bits)

    def margins(self, texts: list, table: WordTable) -> np.ndarray:
        words = [_words(t) for t in texts]
        at = table.look_up(list(chain.from_iterable(words)))
        total = sums(table.rows[at], np.fromiter(map(len, words), np.int64, len(words)))
        return total[:, :-1] / np.maximum(total[:, -1:], 1)

    def table(self) -> WordTable:
        def fill(words: list[bytes]) -> np.ndarray:
            grams, n = _grams(words)
            return sums(self.weights[grams], n).astype(np.float32)

        return WordTable(fill)

    def calibrate(self, texts: list, langs: list) -> None:
        """Put margins on one scale and weight each bit by how often it is right."""
        if not texts:
            return
        found = self.margins(texts, self.table())
        truth = self.code[[self.langs.index(x) for x in langs]]
        self.scale = 1 / np.maximum(np.abs(found).mean(axis=0), 1e-6)
        self.reliable = np.maximum(((found * truth) > 0).mean(axis=0) - 0.5, 0.01)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its score between 0 and 1, and whether the runner-up is close."""
        agree = np.clip(margins * self.scale, -3, 3)[:, None, :] * self.code[None]
        loss = (np.exp(-agree) * self.reliable).sum(axis=2) / self.reliable.sum()
        order = np.argsort(loss, axis=1, kind="stable")
        near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        score = near.max(axis=1) / near.sum(axis=1)
        close = np.zeros(len(loss), bool)
        if len(self.langs) > 1:
            rows = np.arange(len(loss))
            close = loss[rows, order[:, 1]] - loss[rows, order[:, 0]] < 0.25 * loss[rows, order[:, 1]]
        return order[:, 0], score, close


def fit(docs: DataFrame) -> Coder:
    """Learn from every row of ``docs`` (doc_id, text, lang); null languages are left out."""
    found = gram_counts(docs).toPandas()
    langs = sorted(found.lang.unique())
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        counts[np.searchsorted(langs, found.lang), found.bucket] = found.n
    coder = Coder(langs, counts)
    if langs:
        # the hash of the last row wanted comes first, so that no task sends texts that are not used; equal rows count once
        known = docs.where("lang is not null").where(F.length("text") <= CALIBRATION_CHARS).select("text", "lang", F.xxhash64("doc_id", "text", "lang").alias("h"))
        hashes = known.select("h").orderBy("h").limit(CALIBRATION_ROWS).collect()
        few = known.where(F.col("h") <= hashes[-1].h).dropDuplicates(["h"]).orderBy("h").collect() if hashes else []
        few = [r for r in few if r.lang in langs]
        coder.calibrate([r.text for r in few], [r.lang for r in few])
    return coder


def predict(docs: DataFrame, coder: Coder) -> DataFrame:
    """doc_id, held_out and the prediction for each row of (doc_id, held_out, text)."""
    model = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model.value
        table = coder.table() if coder.langs else None
        for part, texts in slices(batches, "text"):
            letters = part.column("has_letter").to_pylist()
            if table is None:
                best, score, close = [None] * len(texts), np.zeros(len(texts)), [False] * len(texts)
            else:
                at, score, close = coder.decode(coder.margins(texts, table))
                best = [coder.langs[i] for i in at]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"), part.column("has_letter"),
                pa.array([x if ok and x is not None else "und" for x, ok in zip(best, letters)], pa.string()),
                pa.array([float(s) if ok else 0.0 for s, ok in zip(score, letters)], pa.float64()),
                pa.array([bool(c and ok) for c, ok in zip(close, letters)], pa.bool_()),
            ], names=["doc_id", "held_out", "has_letter", "lang_pred", "score", "ambiguous"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), "text")
    return ready.mapInArrow(run, SCHEMA).drop("has_letter")


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Predict every document; rows whose crc32(doc_id) mod ``folds`` is ``fold`` are never learned from."""
    rows = docs.select("doc_id", "text", "lang", (crc_mod("doc_id", folds) == fold).alias("held_out"))
    return predict(rows, fit(rows.where("not held_out")))
