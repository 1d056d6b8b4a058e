"""Nearest neighbours, the manifest and periodic runs against plain loops, SQL and odd rows."""

import glob
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import anntree, entry, merkle, periodic

SF = "/root/testdata/sf0.001"
NAMES = ["op11_nearest_neighbours", "op12_merkle_manifest", "op13_periodic_runs"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df, rel = entry.queries()[name](spark, SF), c.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    want = sorted((tuple(r[rel.columns.index(n)] for n in names) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert entry.queries()[name](spark, str(tmp_path)).collect() == []


# periodic runs


def runs_of(w):
    """All runs by comparing every word with the one a lag further on, for every lag."""
    n, out, seen = len(w), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(12, 2 * q) and (s, i - s + q) not in seen:
                seen.add((s, i - s + q))
                out.append((s, i - s + q, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w, size = [], rng.choice([0, 5, 30, 200, 500])
    while len(w) < size:
        if w and rng.random() < 0.5:
            p = rng.randint(1, min(len(w), rng.choice([3, 10, 60])))
            w += [w[len(w) - p + x % p] for x in range(rng.randint(1, p * rng.choice([1, 3, 6])))] if rng.random() < 0.5 else w[-p:] * rng.randint(1, 4)
        else:
            w += [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.randint(1, 9))]
    return w


def kept(w, runs):
    drop = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


@pytest.mark.parametrize("seed", range(12))
def test_runs(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(periodic, "AT_ONCE", 7)
    rng = random.Random(seed)
    docs = [repetitive(rng) for _ in range(15)]
    words = periodic.Words.of(pa.array([rng.choice([" ", "\n", ""]) + rng.choice([" ", "\t \r"]).join(d) + rng.choice(["", " "]) for d in docs]))
    assert words.counts.tolist() == [len(d) for d in docs]
    got = periodic.runs_of(words.ids(), words.counts)
    first = np.cumsum(words.counts) - words.counts
    assert list(map(tuple, got.tolist())) == [(s + int(first[k]), n, q) for k, d in enumerate(docs) for s, n, q in runs_of(d)]
    assert periodic.collapsed(words, got).to_pylist() == [kept(d, runs_of(d)) for d in docs]


def fibonacci(n):
    x, y = ["a"], ["a", "b"]
    while len(y) < n:
        x, y = y, y + x
    return y[:n]


@pytest.mark.parametrize("words", [["a"] * 300_000, ["a", "b", "c"] * 100_000, [str(i) for i in range(150_000)] * 2, fibonacci(100_000)], ids=["one", "three", "square", "fibonacci"])
def test_runs_of_very_repetitive_texts(words):
    """Work stays near linear: the first three have one run each."""
    w = periodic.Words.of(pa.array([" ".join(words)]))
    got = periodic.runs_of(w.ids(), w.counts)
    assert 1 <= len(got) < len(words)
    if len(got) == 1:
        assert got.tolist() == [[0, len(words), len(set(words))]]


def planted(doc_id, text):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_periodic_report(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(repetitive(rng)), "en", "s", 1) for i in range(150)] + [(None, None, None, None, None), (1, "", "", "", 0), (2, " \n", None, "s", 2), (3, "x" * 2_000_000, "en", "s", 3), (4, "é 中 " * 40, "de", "s", 1)]
    rows += [rows[7]] * 3
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS runs", "1 AS n_words", "2 AS `a``b`", "3 AS hash")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        w = planted(doc_id, text)
        r = runs_of(w)
        s, n, q = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
        want.append((doc_id, len(r), s, n, q, 1000 * n // q if r else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in r)), sha(kept(w, r))))
    got = [tuple(r) for r in periodic.report(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    found = periodic.find(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "a`b", "hash", "n_words", "runs", "collapsed"]
    one = {r.doc_id: r for r in found.where("doc_id = 4").collect()}[4]
    assert [tuple(x) for x in one.runs] == [(0, 80, 2)] and one.collapsed == "é 中" and one.n_words == 80


# the manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def paths(nodes):
    """Root, and for each leaf its siblings left and right, level by level."""
    out, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(own):
            out[k].append((nodes[i // 8 * 8 : i], nodes[i + 1 : i // 8 * 8 + 8]))
        nodes, own = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in own]
    return nodes[0], out


def manifest(rows):
    """Rows are doc_id, source, lang, n_chars, text."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == lang), key=lambda t: t[:3]) for lang in langs]
    subs = [paths([t[2] for t in tree]) for tree in trees]
    root, ups = paths([s for s, _ in subs])
    for tree, (sub, own), up in zip(trees, subs, ups):
        for (_, _, digest, r), path in zip(tree, own):
            found = r
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[4] is not None:
                found = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            back = leaf(found)
            for a, b in path + up:
                back = sha("".join(a) + back + "".join(b))
            yield r[0], digest, sub, root, sha("".join(x for a, b in path + up for x in a + b)), back, back == root


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest(spark, monkeypatch, height):
    """Blocks of several heights, so that trees have several layers of them."""
    original = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda rows, order: original(rows, order, height))
    rng = random.Random(height)
    ids = [*range(700), *[7] * 20, *[None] * 20]
    rows = [(i, rng.choice(["s", None, "é"]), rng.choice([None, "", "é", "de"]) if rng.random() < 0.1 else "en", rng.choice([None, 3]), rng.choice([None, "", "A b", "xyz", "ÉA" * 5])) for i in ids]
    rows += [(None,) * 5] * 20 + [(10_000 + k, "s", f"lang{k}", 1, "Only") for k in range(12)] + [(9_000, "s", "en", 2_000_000, "Ab " * 700_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS block", "2 AS at", "'p' AS path", "4 AS `t``q`")
    got = [tuple(r) for r in merkle.report(docs).collect()]
    assert sorted(got, key=repr) == sorted(manifest(rows), key=repr)


def test_one_leaf(spark):
    rows = [(5, "s", "en", 1, "abc")]
    got = [tuple(r) for r in merkle.report(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()]
    assert got == list(manifest(rows)) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_van_emde_boas_places():
    """All nodes have places of their own; the upper half comes first, then the subtrees below it, each in one stretch."""
    for levels in range(1, 6):
        places = [merkle.address(levels, d, np.arange(8**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.size(levels)))
        top = levels // 2
        if top:
            assert max(p.max() for p in places[:top]) < merkle.size(top) <= min(p.min() for p in places[top:])
            below = merkle.size(levels - top)
            for k in range(8**top):
                inside = np.concatenate([p[k * 8**j : (k + 1) * 8**j] for j, p in enumerate(places[top:])])
                assert sorted(inside.tolist()) == list(range(merkle.size(top) + k * below, merkle.size(top) + (k + 1) * below))
    block = merkle.Block.build(3, np.array([sha(str(i)) for i in range(77)], "S64"))
    assert [[(a, b) for a, b in p] for p in block.paths()] == [[("".join(a), "".join(b)) for a, b in p] for p in paths([sha(str(i)) for i in range(77)])[1]]


# nearest neighbours


def nearest(rows, every=50, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for at, (q, x) in enumerate(ok):
        if q is not None and q % every == 0:
            near = sorted((-(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)), i is None, i or 0) for j, (i, y) in enumerate(ok) if j != at and len(y) == len(x))
            yield from ((q, r + 1, None if none else i, -score) for r, (score, none, i) in enumerate(near[:k]))


def rounded(rows):
    return sorted(((q, r, repr(v), round(s, 9)) for q, r, v, s in rows))


def test_neighbours_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(None, [1.0, 0.0, 0.0, 0.0])] * 7 + [(i, [2.0, 0.0, 0.0, 0.0]) for i in range(1000, 1100)] + [(50, [2.0, -0.0, 0.0, 0.0])] * 2
    rows += [(100, None), (150, []), (200, [0.0] * 4), (250, [float("nan"), 1.0, 1.0, 1.0]), (250, [None, 1.0, 1.0, 1.0]), (300, [1.0, 2.0]), (350, [1.0, -0.0]), (351, [1.0, 0.0]), (400, [1.0]), (450, [1e300, 1e300]), (500, [1e-300, -3e-300])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "2 AS leaf", "'x' AS ids")
    got = rounded(tuple(r) for r in anntree.report(vectors).collect())
    want = rounded(nearest([(i, [x / max(map(abs, v)) for x in v] if v and all(x is not None and x == x for x in v) and any(v) else v) for i, v in rows]))
    assert got == want


def test_recall_of_a_deep_tree(spark, monkeypatch):
    """Many leaves, split groups of rows and of queries, and many copies of one vector."""
    monkeypatch.setattr(anntree, "PARTS", 40 * 16)
    monkeypatch.setattr(anntree, "QUERIES", 3)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 4000)] + 0.4 * rng.standard_normal((4000, 16))
    x[1500:2500] = x[1500]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    points = anntree.distinct(vectors)
    trees = anntree.fit(points, points.count(), 32)
    assert trees[16].leaves > 40
    got = [tuple(r) for r in anntree.search(vectors, lambda v: v % 50 == 0, 32).collect()]
    want = {(q, v): s for q, _, v, s in nearest(rows)}
    assert len(got) == len(want) and [r[1] for r in sorted(got)] == [1, 2, 3, 4, 5] * (len(got) // 5)
    assert sum((q, v) in want for q, _, v, _ in got) / len(want) >= 0.9
    copies = [r for r in got if 1500 <= r[0] < 2500]
    assert all(r[2] == 1499 + r[1] + (r[0] <= 1499 + r[1]) for r in copies)


def test_best_bin_first_visits_every_leaf_once():
    x = anntree.unit(np.random.default_rng(1).standard_normal((3000, 8)))
    tree = anntree.Tree(x, 30, 100)
    for p in x[:20]:
        order = list(tree.visits(p))
        assert sorted(order) == list(range(100, 100 + tree.leaves)) and order[0] == tree.place(p[None])[0]
