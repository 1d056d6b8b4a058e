"""Each stage's decisions take effect, and the run equals its stages."""

import corpus_pipeline
from lectern.llm import decontam, simhash

SF = "/root/testdata/sf0.01"  # the smallest with labels enough to learn toxic words from


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    a, b, c, d, e = (ids[n] for n, _ in corpus_pipeline.STAGES)
    assert len(a) < 1000 and b < a and c < b and c == d == e
    parts = {r.doc_id: r.component_id for r in simhash.report(seen["toxicity"]).collect()}
    assert b == {k for k, v in parts.items() if k == v}
    found = {r.doc_id for r in decontam.report(seen["simhash_near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert c == b - found
    last = seen["bpe_encode"]
    assert last.where("not round_trip or n_tokens <> size(token_ids)").count() == 0
    assert last.where("text rlike 'token = .[0-9a-f]{24}'").count() == 0
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == last.columns and sorted(map(tuple, run.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, last.select("doc_id", "n_tokens").collect()))


def test_repeated_rows_stay_once(spark):
    rows = [(2, "a b c d"), (2, "a b c d"), (1, "a b c d"), (None, "x y z"), (None, "x y z"), (5, None), (4, "")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _fp")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, "a b c d"), (None, "x y z"), (4, "")], key=repr)


def odd_tables(spark, out, rows):
    """The smallest tables with odd documents, clashing names and names that need quotes."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.limit(60).unionByName(spark.createDataFrame(rows, docs.schema)) if rows is not None else docs.limit(0)
    docs = docs.selectExpr("*", "1 AS fp", "'x' AS _fp", "array(1) AS token_ids", "'i' AS items", "0 AS label", "2L AS n_words", "3 AS h", "named_struct('a b', 1, 'c`d', 'e') AS `odd ``name`", "map('k', 1) AS m", "'r' AS row")
    docs.write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        t = spark.read.parquet(f"{small}/{name}.parquet")
        (t if rows is not None else t.limit(0)).selectExpr("*", "'x' AS text_", "1 AS h").write.parquet(f"{out}/{name}.parquet")
    return out


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, None, None, "s", 1), (None, None, None, "s", 1), (9001, "", "en", None, 0), (9002, None, "en", "s", 3), (9003, " \n\t ", "en", "s", 3), (9004, long, "en", "s", 9), (9004, long, "en", "s", 9), (9005, "<|endoftext|> x\x00y 中文 😀 password=" + "0f" * 20, "de", "s", 9)]
    sf = odd_tables(spark, str(tmp_path), rows)
    before = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    kept = [c for c in before.columns if c != "token_ids"]
    assert out.columns == [*kept, "n_tokens", "token_ids", "round_trip"] and out.select(*(f"`{c.replace('`', '``')}`" for c in kept)).schema == before.select(*(f"`{c.replace('`', '``')}`" for c in kept)).schema
    got = {r.doc_id: r for r in out.where("doc_id is null or doc_id > 9000").collect()}
    # null, empty and blank texts are near-duplicates: the smallest id stays; repeated rows stay once
    assert set(got) == {9001, 9004, 9005} and out.where("doc_id = 9004").count() == 1
    assert got[9001].n_tokens == 0 and got[9004].text == long and got[9005].text.endswith("[SECRET]") and all(r.round_trip for r in got.values())


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, str(tmp_path), None)).collect() == []
