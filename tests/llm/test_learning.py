"""What is learned, against loops and sums over everything."""

import itertools
import math
from collections import Counter

import numpy as np

from lectern.llm import langid, quality, secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def test_gram_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(1, None, "en", "s", 1), (2, "é 中", None, "s", 1), (3, "É  中\n", "xx", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    want = Counter()
    for r in docs.collect():
        if r.lang is None or r.text is None:
            continue
        for w in r.text.lower().encode().split():
            b = b" " + w + b"  "
            for i in range(len(w) + 1):
                want[r.lang, ((b[i] * 256 + b[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 17] += 1
                want[r.lang, ((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 2246822519 & 0xFFFFFFFF ^ 0x9E3779B9) >> 17] += 1
    assert {(r.lang, r.bucket): r.n for r in langid.gram_counts(docs).collect()} == want


def log_partition(weights, moves):
    """Log of the sum over all taggings, the start being clean."""
    total = 0.0
    for tags in itertools.product((0, 1), repeat=len(weights)):
        x, before = 1.0, 0
        for w, t in zip(weights, tags):
            x *= moves[before, t] * (w if t else 1.0)
            before = t
        total += x
    return math.log(total)


def test_marginals_are_the_gradient_of_the_partition_sum():
    """By small differences: of each token's log-odds, and of each transition's log weight."""
    rng = np.random.default_rng(4)
    lengths = np.array([7, 1, 0, 5])
    emission, turn = rng.standard_normal(lengths.sum()), rng.standard_normal((2, 2))
    p, pair = toxicity.marginals(np.exp(emission), lengths, np.exp(turn), pairs=True)
    ends = np.cumsum(lengths)
    whole = lambda e, m: sum(log_partition(np.exp(e[b - n : b]), np.exp(m)) for b, n in zip(ends, lengths))
    h = 1e-5
    for i in range(len(emission)):
        up, down = emission.copy(), emission.copy()
        up[i] += h
        down[i] -= h
        assert abs((whole(up, turn) - whole(down, turn)) / (2 * h) - p[i]) < 1e-6
    for a, b in itertools.product((0, 1), repeat=2):
        up, down = turn.copy(), turn.copy()
        up[a, b] += h
        down[a, b] -= h
        assert abs((whole(emission, up) - whole(emission, down)) / (2 * h) - pair[a, b]) < 1e-6


def test_training_raises_the_likelihood():
    """Of the labels, by the sum over all taggings, against the start."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 7, 60)
    toxic = (np.arange(60) % 2).astype(int)
    tokens = np.where(rng.random(lengths.sum()) < 0.4, rng.integers(1, 4, lengths.sum()), 0)
    truth = (tokens > 0) & np.repeat(toxic == 1, lengths)

    def likelihood(field):
        total, at, moves = 0.0, 0, np.exp(field.moves)
        for n in lengths:
            w = np.exp(field.emission[tokens[at : at + n]])
            x, before = 1.0, 0
            for k in range(n):
                t = int(truth[at + k])
                x *= moves[before, t] * (w[k] if t else 1.0)
                before = t
            total += math.log(x) - log_partition(w, moves)
            at += n
        return total

    start, field = toxicity.Field(["a", "b", "c"], 0.5), toxicity.Field(["a", "b", "c"], 0.5)
    start.train(tokens, lengths, toxic, steps=0)
    field.train(tokens, lengths, toxic)
    assert likelihood(field) > likelihood(start)


def test_an_automaton_is_a_distribution():
    """Probabilities of all strings over the alphabet add up to one at most, and nearly all of it is on what was seen."""
    rng = np.random.default_rng(6)
    strings = ["x" + "".join(rng.choice(["a", "b"], rng.integers(1, 4))) for _ in range(800)]
    automaton = secret_scan.Automaton(strings)
    chance = lambda s: math.exp(automaton.log_likelihood(s) * (len(s) + 1))
    every = sum(chance("".join(s)) for n in range(7) for s in itertools.product("abx", repeat=n))
    seen = sum(chance(s) for s in set(strings))
    assert every <= 1 + 1e-9 and seen > 0.6


def test_ranking_is_learned_from_all_labelled_rows(spark):
    """The gradient of the loss over all pairs of a good and a bad row is nothing, and the threshold is the quantile of all."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where("quality is not null and crc32(cast(doc_id as string)) % 5 <> 0").select("text", "quality").collect()
    z, y = model.inputs(quality.features([r.text for r in rows])), np.array([r.quality for r in rows])
    s = z @ model.weights
    p = 1 / (1 + np.exp(-(s[y == 1][:, None] - s[y == 0][None, :])))
    g = ((p - 1).mean(axis=1) @ z[y == 1] / (y == 1).sum()) - ((p - 1).mean(axis=0) @ z[y == 0] / (y == 0).sum()) + quality.RIDGE * model.weights
    assert np.abs(g).max() < 1e-5
    order, bad = np.sort(s), (y == 0).sum()
    assert abs(model.threshold - (order[bad - 1] + order[bad]) / 2) < 1e-6


def test_steps_of_the_ranking_converge_and_take_tasks_by_rows(spark, monkeypatch):
    """However many partitions a shuffle makes, a step has a task for so many rows, and the steps end before their limit."""
    sf = SF.replace("0.001", "0.01")
    taken, newton = [], quality.newton

    def step(rows, model, counts):
        taken.append(rows.rdd.getNumPartitions())
        return newton(rows, model, counts)

    monkeypatch.setattr(quality, "newton", step)
    settings = {"spark.sql.shuffle.partitions": "41", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        quality.fit(*(spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(taken) == {1} and len(taken) < quality.STEPS
