"""What is held out does not reach what is learned; credentials of other lengths than the learned ones are scored."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, lm, quality, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"


def changed(docs, folds, fold):
    """The same rows, those of the held-out fold with another text, language and source."""
    held = F.crc32(F.col("doc_id").cast("string")) % folds == fold
    new = lambda c, x: F.when(held, x).otherwise(F.col(c)).alias(c)
    return docs.select("doc_id", new("text", F.concat(F.lit("Quite other words "), F.reverse("text"))), new("lang", F.lit("xx")), new("source", F.lit("y")), "n_chars"), held


def test_language_model(spark, monkeypatch):
    """Other held-out texts, other Arrow batches and other partitions leave all scores as they are, also where a part has many groups."""
    monkeypatch.setattr(lm, "HELD", 1500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    other, held = changed(docs, 7, 2)
    scores = lambda d: {r.doc_id: (r.score, r.base_score) for r in lm.score(d).where("not held_out").collect()}
    want = scores(docs)
    assert scores(other) == want and 60 < len(want) < 120
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 777)
    try:
        assert scores(other.repartition(5)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_of_runs_end_at_fixed_places():
    rng = np.random.default_rng(2)
    k = np.unique(rng.integers(0, 1 << 30, 2000))
    n, m = rng.integers(0, 3, len(k)), np.ones(len(k), np.int64)

    def cut(size, learned, k, n, m):
        batches = [pa.RecordBatch.from_pydict({"k": k[i : i + size], "n": n[i : i + size], "m": m[i : i + size]}) for i in range(0, len(k), size)]
        return [(a.tolist(), b.tolist()) for a, b, _ in lm.groups(iter(batches), 50, learned)]

    want = cut(10_000, True, k, n, m)
    assert sum((a for a, _ in want), []) == k[n > 0].tolist() and len(want) > 5
    assert all(a[-1] >> 24 != b[0] >> 24 for (a, _), (b, _) in zip(want, want[1:])) and all(len(a) >= 50 for a, _ in want[:-1])
    for size in (1, 7, 333):
        assert cut(size, True, k, n, m) == want == cut(size, False, k[n > 0], n[n > 0], m[n > 0])


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other, held = changed(docs, 4, 2)
    keep = lambda d: {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d).where("not held_out").collect()}
    assert keep(docs) == keep(other)


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_classifiers(spark, kind):
    docs, labels = spark.read.parquet(f"{LABELLED}/documents.parquet"), spark.read.parquet(f"{LABELLED}/labels.parquet")
    folds, fold = (5, 0) if kind == "quality" else (4, 2)
    other, held = changed(docs, folds, fold)
    flipped = labels.select("doc_id", *(F.when(held, 1 - F.col(c)).otherwise(F.col(c)).cast("int").alias(c) for c in ("quality", "toxic")))
    run = (lambda d, t: quality.score(d, t)) if kind == "quality" else (lambda d, t: toxicity.score(d, toxicity.fit(d, t)))
    keep = lambda d, t: {r.doc_id: (round(r.score, 12), r.predicted) for r in run(d, t).where("not held_out").collect()}
    assert keep(docs, labels) == keep(other, flipped)


def test_longer_credentials(spark):
    """Values from 1 to 40 characters longer than all learned ones are found; ordinary tokens of any length are not."""
    rng = np.random.default_rng(8)
    value = lambda n: "".join(rng.choice(list("ABCDEFGHJKMNPQRSTVWXYZ23456789"), n))
    syllables = ["the", "and", "ing", "er", "tion", "com"]
    word = lambda n: "".join(rng.choice(syllables, n))
    rows = [(i, f"{word(5)} {word(7)} token={value(int(rng.integers(24, 33)))} {word(12)} {word(4)}") for i in range(300)]
    bare = [(1000 + n, f"{word(6)} {value(32 + n)} {word(9)} {word(17)}") for n in range(1, 41)]
    docs = spark.createDataFrame(rows + bare, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs, secret_scan.fit(docs)).collect()}
    want = {d: f"format:{len(t.split()[0]) + 1}:{len(t.split()[0]) + 1 + d - 968}" for d, t in bare}
    added = {d: [x for x in s.split(",") if x.startswith("format")] for d, s in got.items()}
    assert sum(want[d] in added[d] for d in want) >= 38
    assert all(x == want.get(d) for d, xs in added.items() for x in xs)


def test_few_values_in_each_task(spark, monkeypatch):
    """Tasks give out bounded numbers of values; together they hold the ones with the smallest hashes of all."""
    monkeypatch.setattr(secret_scan, "VALUES", 40)
    rows = [(i, " ".join(f"ordinary{i}x{k}" for k in range(20)) + f" password={i}abcdef{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = secret_scan.labelled_values(docs).withColumn("h", F.xxhash64("value"))
    assert found.count() <= 6 * 40 * 12
    few = [r.value for r in found.where("kind = 'assign'").dropDuplicates(["value"]).orderBy("h").limit(40).collect()]
    every = spark.createDataFrame([(f"{i}abcdef{i}",) for i in range(200)], "value string").orderBy(F.xxhash64("value")).limit(40).collect()
    assert few == [r.value for r in every]
