"""The ten operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import bpe, decontam, embdedup, entry, graph, langid, lm, quality, secret_scan, simhash, tokenbin, toxicity

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"  # the smallest with labels enough to learn from and to hold out
LONG = "longer words in a row " * 3000
ODD = [
    (None, None, None, "s", 1), (1000001, "", "en", None, 0), (1000002, None, "en", "s", 3), (1000003, " \n\t ", "en", "s", 3), (1000004, "é#$ 12 token = 'abcdef123' AKIA" + "A1" * 9 + " " + "0f" * 15, "fr", "s", 9),
    (1000004, "é#$ 12 token = 'abcdef123' AKIA" + "A1" * 9 + " " + "0f" * 15, "fr", "s", 9), (1000005, LONG, "en", "s", 9), (1000006, "<|endoftext|> x\x00y 中文 😀", "de", "s", 9),
]
QUERIES = ["op1_language_id", "op2_simhash", "op3_secrets", "op4_lm", "op5_bpe", "op6_decontamination", "op8_token_files", "op9_toxicity", "op10_quality"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """The smallest tables with odd rows and a clashing column added."""
    out = str(tmp_path_factory.mktemp("data"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, docs.schema)
    docs.unionByName(odd).selectExpr("*", "'x' AS score", "1 AS n_tokens", "'y' AS fp", "1 AS cell").write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        extra = [(None, 1, 1), (5, None, None)] if name == "labels" else [(None, "one two"), (999, None), (998, " "), (997, "Longer, WORDS in a row!")]
        t.unionByName(spark.createDataFrame(extra, t.schema)).selectExpr("*", "'x' AS score").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


def result(spark, data, name):
    return entry.queries()[name](spark, data).collect()


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", [*QUERIES, "op7_embeddings"])
def test_empty_tables(spark, empty, name):
    assert result(spark, empty, name) == []


def test_languages(spark, data):
    rows = result(spark, data, "op1_language_id")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (None, 1000001, 1000002, 1000003)} == {"und"}
    # every prediction against n-grams looked up one by one
    coder = langid.fit(spark.read.parquet(f"{data}/documents.parquet").where("crc32(coalesce(cast(doc_id as string), '')) % 4 <> 2"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in rows:
        if r.lang_pred == "und":
            continue
        at = []
        for w in text[r.doc_id].lower().encode().split():
            b = b" " + w + b"  "
            for i in range(len(w) + 1):
                at.append(((b[i] * 256 + b[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 17)
                at.append(((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 2246822519 & 0xFFFFFFFF ^ 0x9E3779B9) >> 17)
        margin = coder.weights[at, :-1].astype(np.float64).sum(axis=0) / len(at)
        loss = [float((np.exp(-np.clip(margin * coder.scale, -3, 3) * code) * coder.reliable).sum() / coder.reliable.sum()) for code in coder.code]
        near = [math.exp(-4 * (x - min(loss))) for x in loss]
        assert r.lang_pred == coder.langs[int(np.argmin(loss))] and r.score == pytest.approx(max(near) / sum(near), rel=1e-4)
    code = langid.codewords(4)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) == 4
    assert langid.codewords(9).shape[0] == 9


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])


def print_of(text):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, pairs):
    """Component of each of n nodes, named by its smallest."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_simhash(spark, data, texts):
    prints = [print_of(t) for _, t in texts]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = reach(len(prints), pairs)
    ids = {}
    for i, (doc, _) in enumerate(texts):
        ids.setdefault(root[i], []).append(doc)
    best = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    same([tuple(r) for r in result(spark, data, "op2_simhash")], [(d, f"{prints[i]:016x}", best[root[i]]) for i, (d, _) in enumerate(texts)])


def test_simhash_links(spark):
    """All links of crowded and of random fingerprints, with cells dealt out in blocks."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(20)]
    fps = sorted(set(near) | {0, 2**64 - 1, 7})
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = reach(len(fps), pairs)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for rows in (4096, 4):
        got = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), rows)).collect()}
        groups = {}
        for i, s in enumerate(signed):
            groups.setdefault(got.get(s, s), set()).add(want[i])
        assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, k) for k in range(201, 230)] + [(300, 299), (7, 7), (400, None)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {k: 200 for k in range(200, 230)} | {299: 299, 300: 299}


def test_secrets(spark, data, texts):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)

    def base(t):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return sorted(found)

    want = []
    for doc, t in texts:
        b = base(t or "")
        digest = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in b)
        want.append((doc, *(sum(k == i for _, k, _ in b) for i in range(3)), hashlib.sha256(digest.encode()).hexdigest()))
    rows = result(spark, data, "op3_secrets")
    same([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows], want)
    digests = {(d, h) for d, *_, h in want}
    for r in rows:  # the base spans are those of all spans that the grammars did not add
        own = ",".join(x for x in r.spans.split(",") if not x.startswith("format:"))
        assert (r.doc_id, hashlib.sha256(own.encode()).hexdigest()) in digests


def test_secrets_without_key_words(spark):
    """Credentials of a learned format are found bare, short ones too; ordinary tokens are left alone."""
    rng = np.random.default_rng(6)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(200)]
    pins = ["Z" + "".join(rng.choice(list("0123456789"), 8)) + "q" for _ in range(200)]
    words = ["".join(rng.choice(["the", "and", "ing", "er", "tion"], 5)) for _ in range(400)]
    rows = [(i, f"{words[i]} password={hexes[i]} and {words[i + 200]} token: '{pins[i]}'") for i in range(150)]
    bare = [(1000 + i, f"a {hexes[i]} b {pins[i]} c {words[i]}") for i in range(150, 200)]
    docs = spark.createDataFrame(rows + bare, "doc_id long, text string")
    grammars = secret_scan.fit(docs)
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs, grammars).collect()}
    assert grammars.least == 10
    found = sum(f"format:{t.index(pins[d - 1000])}:{t.index(pins[d - 1000]) + 10}" in got[d] for d, t in bare)
    assert found >= 45 and all(not x.startswith("format") or t[int(x.split(":")[1]) : int(x.split(":")[2])] in pins for d, t in bare for x in got[d].split(","))


def test_grammars():
    rng = np.random.default_rng(1)
    make = lambda: "sk-" + "".join(rng.choice(list("ABCDEF0123456789"), 24))
    words = ["".join(rng.choice(["the", "and", "ing", "er", "tion"], 6)) for _ in range(300)]
    g = secret_scan.Grammars({"assign": sorted({make() for _ in range(300)}), "ordinary": sorted(set(words))})
    assert sum(g.accepts(make()) for _ in range(50)) >= 45
    assert not any(g.accepts("".join(rng.choice(["the", "and", "ing", "er", "tion"], 6))) for _ in range(50)) and not g.accepts("1234567890123456")
    text = f"see {make()} now"
    base, spans = g.spans(text)
    assert base == [] and spans == [(4, 3, 31)]


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [b""]


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 50])
def test_lm(spark, data, texts, monkeypatch, frequent):
    monkeypatch.setattr(lm.frequent, "__defaults__", (frequent,))
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in texts if not held(d) for w in words_of(t))
    n, v = c.total(), len(c)
    want = {(d, len(words_of(t)), sum(c[w] > 0 for w in words_of(t))): sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words_of(t)) for d, t in texts}
    rows = result(spark, data, "op4_lm")
    assert len(rows) == len(texts)
    for r in rows:
        assert r.train_tokens == n and r.held_out == held(r.doc_id) and r.score < 0
        assert want[r.doc_id, r.n_tokens, r.n_known] == pytest.approx(r.base_score, rel=1e-9)


def test_lm_probabilities():
    """The chances of all bytes in a context add up to one, and learning helps."""
    m = lm.Mixer()
    for _ in range(3):
        m.learn(lm.runs(["the cat sat on the mat. " * 200])[0])
    context = lm.runs(["the "])[0][-1] >> np.uint64(8)
    keys = (context << np.uint64(8)) + np.arange(256, dtype=np.uint64)
    assert (10 ** -m.cost(keys)).sum() == pytest.approx(1, abs=1e-6)
    keys, sizes = lm.runs(["the cat sat on the mat. "])
    assert m.cost(keys).sum() / math.log10(2) / sizes.sum() < 2 and list(lm.runs(["", None, "ab"])[1]) == [1, 1, 3]


def test_bpe(spark, data, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(entry.tokenizer_file("byte_bpe_50k.json"))
    want = []
    for doc, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([tuple(r) for r in result(spark, data, "op5_bpe")], want)


PIECES = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "\u200b", "a", "B", "é", "É", "E\u0301", "İ", "ſ", "ß", "Σ", "ς", "Ⱥ", "ǅ", "µ", "中", "1", "²", "½", "!", "...", "<|endoftext|>", "<|", "'s", "'S", "'ll", "'", "\u0301", "😀", "ing", "the", "\x00", "×", "ﬁ"]


def odd_texts():
    rng = np.random.default_rng(5)
    plain = [" ".join(rng.choice(["the", "dog,", "éa", "12", "x.", "It's"], rng.integers(0, 30))) for _ in range(300)]
    return ["".join(rng.choice(PIECES, rng.integers(0, 40))) for _ in range(1500)] + plain + ["a" * 3000, " " * 500, "中" * 800, None, "", " ", " a", "a "]


def test_bpe_words():
    from tokenizers import Tokenizer

    path = entry.tokenizer_file("byte_bpe_50k.json")
    t, c, texts = Tokenizer.from_file(path), bpe.Coder(bpe.Vocabulary(path), held=100_000), odd_texts()
    for _ in range(2):  # new words, then known ones
        ids, ends, joined = c.encode(pa.array(texts), joined=True)
        for text, own, dec, a, b in zip(texts, joined, c.decode(ids, ends), ends, ends[1:]):
            assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids and dec == (text or "") and own == ",".join(map(str, ids[a:b].tolist()))
    assert c.failed > 0  # some words did need exact merging
    assert c.encode(pa.array([], pa.string()), joined=True)[1:] == ([0], [])


def test_token_words():
    from tokenizers import Tokenizer

    path = entry.tokenizer_file("word_bpe_49k.json")
    t, c, texts = Tokenizer.from_file(path), tokenbin.Encoder(open(path, encoding="utf-8").read()), odd_texts()
    for _ in range(2):
        ids, ends = c.encode(pa.array(texts))
        for text, a, b in zip(texts, ends, ends[1:]):
            assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_decontamination(spark, data, texts):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = {}
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = split(r.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if r.item_id is None else str(r.item_id))
    want = []
    for doc, text in texts:
        w, hit, items = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        want.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    same([tuple(r) for r in result(spark, data, "op6_decontamination")], want)
    docs, bench = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    same([tuple(r) for r in decontam.report(docs, bench, chars=2000).collect()], want)  # the same in blocks
    assert sum(w[5] for w in want) > 3
    clean = Counter(d for d, *_, hit in want if not hit)
    for chars in (decontam.BLOCK_CHARS, 2000):
        assert Counter(r.doc_id for r in decontam.clean(docs, bench, chars).collect()) == clean


def test_decontamination_skips(monkeypatch):
    """Shifts move the search: most positions are never looked at, and no occurrence is lost."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    item = [words[i] for i in rng.integers(0, 400, 200)]
    text = [words[i] if rng.random() < 0.5 else f"x{i}" for i in rng.integers(0, 400, 5000)]
    for at in (0, 251, 1000, 4990):
        text[at : at + 10] = item[30:40]
    m = decontam.Matcher([("a", " ".join(item))])
    sizes, ranges, items = m.scan([" ".join(text)])
    assert set(zip(ranges[0][::2], ranges[0][1::2])) == {(at, at + 10) for at in (0, 251, 1000, 4990)} and items == [{"a"}]
    assert 0 < m.groups[0][0].looked < len(text) / 2


def test_decontamination_of_a_large_block():
    """Words of no benchmark are passed over at any size of it; frequent endings are told apart by their beginnings."""
    rng = np.random.default_rng(4)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 50_000, 1000))) for i in range(200)]
    tail = " the end of the line"
    items += [(f"same {i}", f"a{i} b{i} c{i} d{i} e{i}" + tail) for i in range(20_000)]
    m = decontam.Matcher(items)
    sizes, ranges, found = m.scan([" ".join(f"q{i}" for i in range(50_000))])
    assert (sizes.tolist(), ranges, found) == ([50_000], [[]], [set()])
    assert m.groups[0][0].looked < 0.3 * 50_000
    _, ranges, found = m.scan(["x" + tail * 5000, items[-1][1] + tail, "q " + items[7][1]])
    assert found == [set(), {"same 19999"}, {"7"}] and ranges[1] == [0, 10] and len(ranges[2]) == 2 * 991


def test_decontamination_pieces(spark, monkeypatch):
    """A long item in pieces has the windows of the whole."""
    monkeypatch.setattr(decontam, "PIECE_CHARS", 100)
    item = " ".join(f"word{i % 37}x{i}" for i in range(300))
    rows = decontam.pieces(spark.createDataFrame([(1, item), (None, "few words"), (2, None), (1, item)], "item_id long, text string")).collect()
    own = decontam.words(item)
    want = {tuple(own[i : i + 10]) for i in range(len(own) - 9)}
    got = [decontam.words(r.text) for r in rows if r.item == "1"]
    assert {tuple(w[i : i + 10]) for w in got for i in range(len(w) - 9)} == want and min(map(len, got)) >= 10 and len(got) > 20
    assert [r.text for r in rows if r.item == "null"] == ["few words"]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((120, 64))
    v = np.vstack([v, v[:30] + 0.02 * rng.standard_normal((30, 64)), v[:5], 3 * v[5:8]]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [0.0] * 64), (502, [1.0, None]), (503, [float("nan")] * 64), (504, [float("inf")] * 64), (505, []), (506, [1.0, 0.0]), (507, [2.0, 0.0]), (507, [2.0, 0.0]), (None, [9.0, 0.0])]
    got = sorted((tuple(r) for r in embdedup.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    good = [(i, np.array(x, np.float64)) for i, x in rows if x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    pairs = [(a, b) for a in range(len(good)) for b in range(a) if len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.9]
    root, n = reach(len(good), pairs), Counter(x for p in pairs for x in p)
    best = {}
    for k, (i, _) in enumerate(good):
        if i is not None:
            best[root[k]] = min(i, best.get(root[k], i))
    want = [(i, n[k], best[root[k]], None if i is None else i == best[root[k]]) for k, (i, _) in enumerate(good)] + [(i, 0, i, True) for i in range(500, 506)]
    assert got == sorted(want, key=repr)


def test_embedding_plans():
    """Tables reach the planned recall on pairs not drawn for it, and what is dealt out grows slowly."""
    rng = np.random.default_rng(77)
    for n in (5000, 10**6):
        p, width = embdedup.plan(n), sum(embdedup.plan(n).groups)
        x = rng.standard_normal((4000, embdedup.LINES + p.tables * width), np.float32)
        y = np.float32(0.9) * x + np.float32(0.19**0.5) * rng.standard_normal(x.shape, np.float32)
        a, b = embdedup.coded(x[:, : embdedup.LINES]), embdedup.coded(y[:, : embdedup.LINES])
        met = np.zeros(len(x), bool)
        for t in range(p.tables):
            own = slice(embdedup.LINES + t * width, embdedup.LINES + (t + 1) * width)
            met |= (p.cells(x[:, own]) == p.cells(y[:, own])) & embdedup.close(a[:, p.order(t)], b[:, p.order(t)])
        assert (met & (embdedup.close(a, b).sum(axis=1) >= p.least)).mean() >= 0.998
    big = embdedup.plan(10**9)
    assert big.tables * (embdedup.LINES + 24) < 10_000


def test_embedding_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(64) + 0.05 * rng.standard_normal((90, 64))
    monkeypatch.setattr(embdedup, "CELL_ROWS", 16)
    got = embdedup.report(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


def test_token_files(spark, data, texts, tmp_path):
    from tokenizers import Tokenizer

    path = entry.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want, start = [], 0
    for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same([tuple(r) for r in result(spark, data, "op8_token_files")], want)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = f"file://{tmp_path}/tokens"
    files = [r.file for r in tokenbin.write(docs, path, folder).collect()]
    some = {r.doc_id: r.text for r in docs.where("doc_id in (3, 50)").collect()}
    assert tokenbin.documents(spark, folder, files, list(some)) == {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in some.items()}
    name = f"{tmp_path}/tokens/{files[0]}"
    raw = bytearray(open(name, "rb").read())
    raw[12] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(Exception):
        list(tokenbin.Reader(open(name, "rb")).documents())


def accuracy(spark, rows, label):
    """Of the held-out rows, which were not learned from."""
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    known = [r for r in rows if r.doc_id in truth and r.held_out]
    assert len(known) >= 50
    return sum(r.predicted == truth[r.doc_id] for r in known) / len(known)


def test_toxicity(spark):
    rows = result(spark, LABELLED, "op9_toxicity")
    assert accuracy(spark, rows, "toxic") > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # every score against a plain forward-backward over the text's tokens
    field = toxicity.fit(*(spark.read.parquet(f"{LABELLED}/{n}.parquet") for n in ("documents", "labels")))
    text, moves = {r.doc_id: r.text for r in spark.read.parquet(f"{LABELLED}/documents.parquet").collect()}, np.exp(field.moves)
    assert len(field.words) > 0
    for r in rows:
        found = list(re.finditer(r"\S+", text[r.doc_id] or ""))
        w = [math.exp(min(30, max(-30, field.emission[field.words.get(toxicity.normal(m.group()), 0)]))) for m in found]
        f, b, prior = [], [np.ones(2)], np.array([1.0, 0.0])
        for x in w:
            prior = prior @ moves * [1, x]
            prior = prior / prior.sum()
            f.append(prior)
        for x in w[:0:-1]:
            v = moves @ (b[-1] * [1, x])
            b.append(v / v.sum())
        p = [float((a * c)[1] / (a * c).sum()) for a, c in zip(f, b[::-1])]
        total = sum(p)
        x = np.array([1, math.log1p(total), max(p, default=0), math.sqrt(total / max(len(p), 1)), min(total, 3)])
        assert r.score == pytest.approx(field.prior if field.doc_weights is None else 1 / (1 + math.exp(-x @ field.doc_weights)), rel=1e-6)
        assert r.spans == ",".join(f"{m.start()}:{m.end()}" for m, x in zip(found, p) if x >= 0.5)


def test_classifiers_on_odd_rows(spark, data):
    for name in ("op9_toxicity", "op10_quality"):
        rows = result(spark, data, name)
        assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_field():
    """Marginals of sequences longer than a block against sums over all taggings, and spans of a trained field."""
    rng = np.random.default_rng(0)
    odds, moves = np.exp(rng.standard_normal(700)), np.exp(rng.standard_normal((2, 2)))
    lengths = np.array([3, 0, 600, 97])
    got, at = toxicity.marginals(odds, lengths, moves), 0
    for n in lengths:
        w = odds[at : at + n]
        f, b = np.zeros((n, 2)), np.ones((n, 2))
        prior = np.array([1.0, 0.0])
        for i in range(n):
            prior = prior @ moves * [1, w[i]]
            prior /= prior.sum()
            f[i] = prior
        for i in range(n - 2, -1, -1):
            b[i] = moves @ (b[i + 1] * [1, w[i + 1]])
            b[i] /= b[i].sum()
        p = f * b
        assert np.allclose(got[at : at + n], (p / p.sum(axis=1, keepdims=True))[:, 1] if n else [])
        at += n


def test_toxic_spans(spark):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" You IDIOT, go" if i % 3 == 0 else " go")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    field = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(1, "hello idiot! word1"), (2, "hello word1"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.end, r.token) for r in toxicity.spans(new, field).collect()] == [(1, 6, 12, "idiot!")]
    assert [r.doc_id for r in toxicity.keep(new, field).collect()] == [2, 3]


def test_quality(spark):
    rows = result(spark, LABELLED, "op10_quality")
    assert accuracy(spark, rows, "quality") > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # every score against features counted one by one
    ranking = quality.fit(*(spark.read.parquet(f"{LABELLED}/{n}.parquet") for n in ("documents", "labels")))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{LABELLED}/documents.parquet").collect()}
    for r in rows:
        z = np.clip((np.array(plain_features(text[r.doc_id])) - ranking.mean) / ranking.sd, -8, 8)
        s = float(np.concatenate([z, np.abs(z)]) @ ranking.weights) - ranking.threshold
        assert r.score == pytest.approx(1 / (1 + math.exp(-(s + math.log(3 / 7)))), rel=1e-6)


def plain_features(text):
    raw = (text or "").encode()
    groups = [*(range(a, b) for a, b in ((65, 91), (97, 123), (48, 58), (128, 256))), *(list(g) for g in (b" ", b"\n", b".,;:", b"!?", b"#$%&*@~^=+", b"|", b"<>{}[]\\/_", b"'\"()-"))]
    shares = [sum(c in g for c in raw) / max(len(raw), 1) for g in groups]
    letters = Counter(c for c in raw if 65 <= c < 91 or 97 <= c < 123 or c >= 128)
    spread = -sum(n / letters.total() * math.log(n / letters.total()) for n in letters.values())
    words, lines = raw.split(), raw.split(b"\n")
    k, kinds = max(len(words), 1), len(set(words))
    rest = [math.log1p(len(words)), math.log1p(len(raw)), len(raw) / k / 10, kinds / k, kinds / k**0.8, 1 - len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)), sum(len(w) == 1 for w in words) / k]
    return [*map(math.sqrt, shares), *shares, spread, *rest]


def test_lm_scores_of_the_whole_corpus(spark, data, monkeypatch):
    """Counts are exact for every context, and scores depend neither on partitions nor on which runs are joined."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60)
    docs = spark.createDataFrame([*docs.collect(), *docs.limit(3).collect()], docs.schema)  # with repeated rows
    scores = lambda d: sorted(((r.doc_id, r.score, r.bits_per_byte) for r in lm.score(d).collect()), key=repr)
    one = scores(docs.coalesce(1))
    assert one == scores(docs.repartition(8))
    monkeypatch.setattr(lm, "FREQUENT_RUNS", 500)
    monkeypatch.setattr(lm, "TEXT_BYTES", 1000)
    assert one == scores(docs.orderBy(F.rand(3)).repartition(3))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(b == pytest.approx(-s / math.log10(2) / (len((text[d] or "").encode()) + 1)) for d, s, b in one)
    # the score is the sum of the costs of the text's bytes, one by one
    priced = {r.k: r.cost for r in lm.priced(lm.run_counts(docs.select((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2).alias("held_out"), "text"))).collect()}
    for d, s, _ in one:
        raw = bytes(4) + (text[d] or "").encode() + b"\0"
        assert s == pytest.approx(-sum(priced[raw[i] + sum(raw[i - j] << 8 * (5 - j) for j in range(1, 5))] for i in range(4, len(raw))) * lm.UNIT, rel=1e-12)
    rows = lm.run_counts(docs.selectExpr("false AS held_out", "text")).collect()
    want = Counter(k for r in docs.collect() for k in lm.runs([r.text])[0].tolist())
    assert {r.k: r.n for r in rows} == {r.k: r.m for r in rows} == want
    keys, n = np.array(sorted(want), np.uint64), np.array([want[k] for k in sorted(want)], np.float64)
    seen = lm.Counts(keys, n)(keys[:200])
    for i, k in enumerate(keys[:200].tolist()):
        for o, order in enumerate(lm.ORDERS):
            same = [(r, c) for r, c in want.items() if r >> 8 * (5 - order) == k >> 8 * (5 - order)]
            assert seen[o, :, i].tolist() == [sum(c for r, c in same if (r & 255) >> 8 - d == (k & 255) >> 8 - d) for d in range(9)]
