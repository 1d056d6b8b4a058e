"""Rare-gram index, parts of entities, incremental checks and glossary import against plain loops."""

import json
import random

from pyspark.sql import functions as F

from lectern.operators import entities, grams, qa


def rows(df, columns=None):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_grams(spark):
    df = spark.createDataFrame([("",), ("a",), ("abab",), ("中😀中",), (None,)], "t string")
    got = [None if r.g is None else sorted(r.g) for r in df.select("t", grams.grams(F.col("t")).alias("g")).collect()]
    assert [g and [x for x in g if x] for g in got] == [[], ["a"], ["a", "ab", "b", "ba"], ["中", "中😀", "😀", "😀中"], None]


def test_hits(spark):
    rng = random.Random(1)
    word = lambda a, b: "".join(rng.choice("abc中文") for _ in range(rng.randint(a, b)))
    texts = [(i, word(0, 30)) for i in range(200)] + [(900, None), (901, "a%_\\b"), (902, "aa")]
    terms = [(t,) for t in {word(1, 5) for _ in range(120)}] + [("",), (None,), ("%_",), ("aa",)]
    index = grams.filed(spark.createDataFrame(terms, "term string"), "term")
    got = rows(grams.hits(spark.createDataFrame(texts, "id long, t string"), "id", "t", index, "term"))
    assert got == sorted([(i, t) for i, x in texts if x for t, in set(terms) if t and t in x], key=repr) and len(got) > 500
    # a term is filed under a gram that no more terms hold than any other of its grams
    held = {}
    for t, in terms:
        for g in {t[i : i + 2] for i in range(len(t) - 1)} if t and len(t) > 1 else ():
            held[g] = held.get(g, 0) + 1
    for r in index.collect():
        if len(r.term) > 1:
            assert held[r.gram] == min(held[r.term[i : i + 2]] for i in range(len(r.term) - 1))


def parts(made, least):
    out = set()
    for k, kind, s in set(made):
        if s is None or len(s) < least or not any(k == a and kind == b and t is not None and len(t) > len(s) and s in t for a, b, t in made):
            out.add((k, kind, s))
    return sorted(out, key=repr)


def test_parts_of_entities(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab中") for _ in range(rng.randint(1, 7)))
    made = [(rng.choice([1, 2, None]), rng.choice(["person", "place", None]), word()) for _ in range(300)] + [(1, "person", None), (1, "place", ""), (2, "x", "same"), (2, "x", "same")]
    df = spark.createDataFrame(made, "k long, type string, surface string")
    for least in (1, 2):
        assert rows(entities.without_parts(df, "k", least)) == parts(made, least)


def test_few_entities_are_compared_in_a_row(spark, monkeypatch):
    """Documents with few entities shuffle no grams; with many, and beside others with few, the result is the same."""
    rng = random.Random(4)
    made = [(k, "x", "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))) for k in (1, 2, 3, None) for _ in range(3 * (k or 1))] + [(1, "x", None), (2, "x", "")]
    df = spark.createDataFrame(made, "k long, type string, surface string")
    got = entities.without_parts(df, "k")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and rows(got) == parts(made, 1)
    monkeypatch.setattr(entities, "FEW_ENTITIES", 3)
    assert rows(entities.without_parts(df, "k")) == parts(made, 1)


def test_a_very_long_surface(spark):
    """A surface of 20 000 characters, and many short ones that it may hold."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    made = [(1, "x", long)] + [(1, "x", long[i : i + 9]) for i in range(0, 300, 3)] + [(1, "x", f"z{i}z") for i in range(100)]
    got = rows(entities.without_parts(spark.createDataFrame(made, "k long, type string, surface string"), "k"))
    assert got == sorted([(1, "x", long)] + [(1, "x", f"z{i}z") for i in range(100)], key=repr)


def test_many_terms(spark):
    """A glossary beyond what is broadcast gives the same report as its parts would."""
    terms = spark.range(20_000).selectExpr("concat('词', id, '号') AS term", "concat('Word ', id) AS gloss")
    segments = spark.createDataFrame([(i, f"第词{i * 7}号和词{i}号", f"Word {i} and more") for i in range(300)], "segment_id long, source string, target string").selectExpr("1 AS doc_id", "*")
    got = {r.segment_id: [(t.term, t.matched) for t in r.terms] for r in qa.report(segments, terms).select("segment_id", "terms").collect()}
    want = {i: sorted({(f"词{i}号", True), (f"词{i * 7}号", f"word {i * 7}" in f"word {i} and more")}) for i in range(300)}
    assert got == want
    kept = qa.term_index(terms)
    again = {r.segment_id: [(t.term, t.matched) for t in r.terms] for r in qa.report(segments, terms, kept).select("segment_id", "terms").collect()}
    assert again == want


def test_incremental_checks(spark):
    """Rounds of edits of texts, glossary and segments: equal to a full run; what does not change is not checked again."""
    rng = random.Random(4)
    glossary = [("订单", "Order"), ("金额", "amount"), ("元", "USD")]
    state = {i: (f"订单{i}金额{rng.randrange(50)}元", f"Order {i} amount USD") for i in range(80)}
    frame = lambda: spark.createDataFrame([(i, i % 3, s, t) for i, (s, t) in state.items()], "segment_id long, page_number int, source string, target string")
    terms = lambda g: spark.createDataFrame(g, "term string, gloss string")
    columns = ["segment_id", "page_number", "source", "target", "facts", "terms", "source_chars", "target_chars", "residual_han", "warnings"]
    stored = qa.report(frame(), terms(glossary)).cache()
    for round_ in range(3):
        before = glossary
        for i in rng.sample(sorted(state), 10):
            state[i] = (state[i][0], rng.choice(["", f"Order {i}", "订单订单订单订单"]))
        for i in rng.sample(sorted(state), 5):
            del state[i]
        state[1000 + round_] = (f"新{round_}金额7元", "amount 7 Dollar")
        if round_ == 1:
            glossary = [("订单", "Order"), ("元", "Dollar"), ("新", "new")]
        marked = stored.withColumn("source_chars", F.lit(-1)) if round_ == 0 else stored
        got = qa.refreshed(marked, frame(), terms(before), terms(glossary))
        if round_ == 0:  # reports that still hold are the stored ones
            assert got.where("source_chars = -1").count() >= 60
            got = got.withColumn("source_chars", F.when(F.col("source_chars") < 0, F.length("source")).otherwise(F.col("source_chars")))
        full = qa.report(frame(), terms(glossary))
        assert rows(got, columns) == rows(full, columns)
        stored = spark.createDataFrame(got.collect(), got.schema)


def imported(content, most=500):
    """The entries of a JSON glossary, element by element."""
    if len(content.encode()) > 1_000_000:
        return []
    try:
        parsed = json.loads(content)
    except ValueError:
        return []
    out = {}
    for e in parsed[:most] if isinstance(parsed, list) else []:
        if isinstance(e, dict):
            term = e["chinese"].strip()[:200] if isinstance(e.get("chinese"), str) else ""
            gloss = e["english"].strip()[:500] if isinstance(e.get("english"), str) else ""
            if term:
                out[term] = (term, gloss, e.get("locked") is not False)
    return sorted(out.values())


def test_json_import(spark):
    many = [{"chinese": f"t{i}", "english": "x"} for i in range(600)]
    contents = [
        '["x", {"chinese": "甲", "english": "A"}, null, 7, [1], {"chinese": 5}, {"chinese": "乙", "english": 5, "locked": false}, {"chinese": "丙", "locked": "false"}, {"chinese": "丁", "locked": null}, {"english": "none"}, {"chinese": " "}]',
        '{"chinese": "no array"}', "no json", "", "[]", json.dumps(many), json.dumps([1] * 499 + many), '[{"chinese": " 甲 ", "english": " A "}, {"chinese": "甲", "english": "B", "locked": true}]',
        json.dumps([{"chinese": "长" * 300, "english": "y" * 900}]), json.dumps([{"chinese": "z" * 1_000_000}]), '[{"chinese": "é", "english": {"a": 1}, "locked": 0}]',
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)] + [(99, None)], "f long, content string")
    got = {}
    for r in entities.imported_json(df, ["f"]).collect():
        assert r.confirmed
        got.setdefault(r.f, []).append((r.term, r.gloss, r.locked))
    assert {k: sorted(v) for k, v in got.items()} == {i: imported(c) for i, c in enumerate(contents) if imported(c)}


def test_csv_import(spark):
    lines = ["chinese,english"] + [""] * 300 + [f"t{i},x{i}" for i in range(600)]
    got = rows(entities.imported(spark.createDataFrame(list(enumerate(lines)), "pos long, line string")), ["term"])
    assert got == sorted([(f"t{i}",) for i in range(500)], key=repr)
    lines = ["", "甲,A", '"乙" , "B, C"', ",none", " ", "甲,D"]
    got = rows(entities.imported(spark.createDataFrame(list(enumerate(lines)), "pos long, line string")), ["term", "gloss", "locked", "confirmed"])
    assert got == sorted([("甲", "D", True, True), ("乙", "B", True, True)], key=repr)


def test_a_small_glossary_with_its_index_is_tested_in_rows(spark):
    """Batches of a stream come with the index; a small glossary needs no grams of their texts."""
    from lectern.operators import qa

    g = spark.createDataFrame([("元", "usd")], "term string, gloss string")
    s = spark.createDataFrame([(1, "1元", "1 yuan")], "segment_id int, source string, target string")
    plan = qa.report(s, g, qa.term_index(g))._jdf.queryExecution().analyzed().toString()
    assert "gram" not in plan


def test_few_changed_terms_are_broadcast(spark, monkeypatch):
    """Nothing is shuffled for them; many meet the rows under grams, with the same result; no terms leave all rows."""
    rows = spark.createDataFrame([(1, "订单于"), (2, "金额元"), (3, ""), (4, "a订b单"), (5, "元")], "segment_id int, source string")
    changed, none = spark.createDataFrame([("元",), ("订单",)], "term string"), spark.createDataFrame([], "term string")
    ids = lambda df: sorted(r.segment_id for r in df.collect())
    plan = qa.without(rows, changed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert ids(qa.without(rows, changed)) == [3, 4] and ids(qa.without(rows, none)) == [1, 2, 3, 4, 5]
    monkeypatch.setattr(qa, "FEW_TERMS", 1)
    assert ids(qa.without(rows, changed)) == [3, 4]
