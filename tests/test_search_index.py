"""Search by a positional index, and dictionaries walked as tries, against plain loops."""

import functools
import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lectern.operators import entities, search
from lectern.plans import entities as plans


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_index(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abAB 中") for _ in range(rng.randint(0, 60)))
    made = [(rng.choice(["d", "e"]), i, text(), text()) for i in range(150)] + [("d", 900, None, "aaaaaaa"), ("e", 901, "", None)]
    pages = spark.createDataFrame(made, "doc string, page_number long, source string, target string")
    folder = f"file://{tmp_path}/index"
    search.write_index(pages, ["doc"], folder, buckets=7)
    for q in ("aba", " AB ab ", "aaa", "abab", "中ab中a", "zzz", "b a b", "aaaaaa", "ababab", "中中中"):
        got = search.indexed_matches(spark, folder, ["doc"], q, buckets=7)
        assert rows(got) == rows(search.matches(pages, ["doc"], q).select(got.columns)), q
    with pytest.raises(ValueError, match="3 characters"):
        search.indexed_matches(spark, folder, ["doc"], "ab")
    plan = search.indexed_matches(spark, folder, ["doc"], "abab", buckets=7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_an_index_has_a_row_for_a_gram_of_a_page(spark, tmp_path, monkeypatch):
    """Not one for each place; a long text is worked on in pieces."""
    pages = spark.createDataFrame([("d", 1, "abcabcabcabc", "😀x😀x"), ("d", 2, "ab", None)], "doc string, page_number long, source string, target string")
    search.write_index(pages, ["doc"], f"file://{tmp_path}/index", buckets=3)
    got = spark.read.parquet(f"file://{tmp_path}/index").select("page_number", "side", "gram", "positions")
    assert rows(got) == [(1, "source", "abc", [0, 3, 6, 9]), (1, "source", "bca", [1, 4, 7]), (1, "source", "cab", [2, 5, 8]), (1, "translation", "x😀x", [1]), (1, "translation", "😀x😀", [0])]
    monkeypatch.setattr(search, "PIECE", 4)
    batch = pa.RecordBatch.from_pydict({"k": [7], "c": ["abcabcabcabc"]})
    cut = sorted((g, p) for b in search.postings([batch]) for g, ps in zip(b["gram"].to_pylist(), b["positions"].to_pylist()) for p in ps)
    assert cut == sorted(("abcabcabcabc"[i : i + 3], i) for i in range(10))


def test_blocks(spark, tmp_path):
    """Pages of equal keys, long pages in pieces, characters that stand between pages, and any size of block."""
    rng = random.Random(4)
    text = lambda most: "".join(rng.choice("abAB 中😀\0") for _ in range(rng.randint(0, most)))
    made = [(rng.choice(["d", "e", None]), i // 2, text(60), text(60)) for i in range(150)]
    made += [("d", 900, None, "a" * 700), ("e", 901, "", None), ("f", None, "xab" + "ab" * 150 + text(400), "aba"), ("f", 902, "bab", "ABA")]
    pages = spark.createDataFrame(made, "doc string, page_number long, source string, target string").repartition(3)
    queries = ["aba", " AB ab ", "aaa", "abab", "中ab中a", "zzz", "b a b", "aaaaaa", "ababab", "a\0ab", "😀ab", "aab"]
    want = functools.reduce(lambda a, b: a.unionByName(b), [search.matches(pages, ["doc"], q).withColumn("query", F.lit(q)) for q in queries])
    for size in (64, 5, 1 << 20):
        folder = f"file://{tmp_path}/index-{size}"
        search.write_blocks(pages, ["doc"], folder, buckets=7, size=size)
        got = search.block_matches(spark, folder, queries, buckets=7)
        assert rows(got.select(want.columns)) == rows(want), size
    assert {"aaaaaa", "ababab", "a\0ab"} <= {r.query for r in want.select("query").distinct().collect()}
    with pytest.raises(ValueError, match="3 characters"):
        search.block_matches(spark, folder, ["abc", "ab"], buckets=7)
    search.write_blocks(pages.where("page_number < 0"), ["doc"], f"file://{tmp_path}/none")
    assert search.block_matches(spark, f"file://{tmp_path}/none", queries).collect() == []


def test_places_in_order():
    """With few letters and with too many for one number; steps of any size come back."""
    rng = np.random.default_rng(5)
    for letters in (3, 60_000):
        codes = rng.integers(40, 40 + letters, 150_000).astype(np.uint32)
        at = np.flatnonzero(rng.random(len(codes) - 2) < 0.9)
        places, first = search.in_order(codes, at)
        order = np.lexsort((at, codes[at + 2], codes[at + 1], codes[at]))
        assert (places == at[order]).all()
        grams = codes[places[:, None] + np.arange(3)]
        assert first.tolist() == [0, *(np.flatnonzero((np.diff(grams, axis=0) != 0).any(axis=1)) + 1)]
    steps = np.array([0, 127, 128, 16383, 16384, 5, 2097151, 2097152, 1 << 30])
    got = [search.unpacked(v).tolist() for v in search.packed(steps, np.array([0, 5, 8])).to_pylist()]
    assert got == [np.cumsum(s).tolist() for s in (steps[:5], steps[5:8], steps[8:])]


def test_indexed_search_shuffles_no_index(spark, sf, tmp_path, monkeypatch):
    """Its index is written where pages are read, in less than three bytes a character."""
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **k: (written.append(w._df._jdf.queryExecution().executedPlan().toString()), write(w, *a, **k))[1])
    monkeypatch.setattr(plans, "shared_folder", lambda _: f"file://{tmp_path}")
    plans.indexed_search(spark, sf)
    assert len(written) == 1 and "MapInArrow" in written[0] and "Exchange" not in written[0]
    characters = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert characters < sum(map(os.path.getsize, glob.glob(f"{tmp_path}/*/*/*.parquet"))) < 3 * characters


def found(lines, words):
    return sorted((n, at + 1, w) for n, line in lines for w in words for at in range(len(line)) if line.startswith(w, at))


def test_a_dictionary_of_50_000_words(spark):
    rng = random.Random(2)
    letters = "甲乙丙丁戊己庚辛壬癸"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60_000)})[:50_000]
    lines = [(n, "".join(rng.choice(letters) for _ in range(80))) for n in range(60)] + [(100, ""), (101, "none here")]
    names = spark.createDataFrame([("place", w, i) for i, w in enumerate(words)], "kind string, word string, n int")
    df = spark.createDataFrame(lines, "k long, line string").withColumn("line_no", F.lit(0))
    known, want = set(words), []
    for n, line in lines:
        want += [(n, i + 1, line[i:j]) for i in range(len(line)) for j in range(i + 1, min(len(line), i + 9) + 1) if line[i:j] in known]
    assert rows(entities.places(df, "k", names).select("k", "at", "word")) == sorted(want, key=repr) and len(want) > 5000


def test_walk_equals_filter(spark, monkeypatch):
    lines = [(1, "北京市王先生在上海市公司"), (2, "市市市"), (3, "x")]
    names = spark.createDataFrame([("place", "市", 0), ("title", "先生", 0), ("organization", "公司", 0), ("place", "上海市", 1), ("place", "市市", 2)], "kind string, word string, n int")
    df = spark.createDataFrame(lines, "k long, line string").withColumn("line_no", F.lit(0))
    columns = ["k", "line_no", "line", "kind", "word", "n", "at"]
    want = rows(entities.places(df, "k", names).select(columns))
    monkeypatch.setattr(entities, "FEW_WORDS", 2)
    assert rows(entities.places(df, "k", names).select(columns)) == want
    assert [(r[0], r[6], r[4]) for r in sorted(want, key=lambda r: (r[0], r[6], r[4]))] == found(lines, ["市", "先生", "公司", "上海市", "市市"])
