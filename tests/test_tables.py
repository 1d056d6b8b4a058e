"""Kept tables: runs, compaction, manifests, repeated batches."""

import random

from pyspark.sql import functions as F

from lectern.operators import memory
from lectern.streaming import tables


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def records(spark, made):
    return spark.createDataFrame(made, "source string, domain string, signature string, target string, updated_at long").withColumn("updated_at", F.timestamp_seconds("updated_at"))


def names(t):
    return {s.getPath().getName() for s in t._list("runs")}, {s.getPath().getName() for s in t._list("manifests")}


def test_memory(spark, tmp_path):
    """Many batches, some of them run again: the same as one upsert of all; old manifests and runs go."""
    t = tables.memory_table(spark, f"file://{tmp_path}/memory", fan=3, kept=2, seconds=0)
    rng, made = random.Random(1), []
    assert t.read() is None and t.read_key(F.lit("a")) is None
    for b in range(10):
        batch = [(f" s{rng.randrange(60)}", "d", "", rng.choice([f"t{b}", f"t{b}", " "]), b * 100 + i) for i in range(25)]
        made += batch
        t.write(records(spark, batch), b)
        t.write(records(spark, batch[:5]), b)  # run again: nothing happens
        columns = ["source", "domain", "signature", "target", "updated_at"]
        every = records(spark, made)
        assert rows(t.read(), columns) == rows(memory.upsert(every.limit(0), every), columns)
    now = t.manifest()
    assert now.batch == 9 and max(r["level"] for r in now.runs) == 2
    assert all(sum(r["level"] == level for r in now.runs) < 3 for level in range(3))
    runs, manifests = names(t)
    assert len(manifests) == 2 and runs == {r["name"] for n in (now.number - 1, now.number) for r in t.manifest(n).runs}
    one = rows(t.read_key(memory.memory_source(F.lit(" s7")), F.lit("d"), F.lit("")), ["source", "target"])
    assert one == [r for r in rows(t.read(), ["source", "target"]) if r[0] == "s7"]


def test_a_reader_keeps_its_files(spark, tmp_path):
    t = tables.memory_table(spark, f"file://{tmp_path}/memory", fan=2, kept=1, seconds=3600)
    t.write(records(spark, [("a", "d", "", "x", 1)]), 0)
    before = t.manifest()
    for b in range(1, 6):
        t.write(records(spark, [("a", "d", "", f"y{b}", b + 1)]), b)
    assert rows(t.read(before), ["target"]) == [("x",)] and rows(t.read(), ["target"]) == [("y5",)]


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    """400 keys write bytes in proportion to 400 keys, whatever the table holds; a large run has several files."""
    t = tables.memory_table(spark, f"file://{tmp_path}/memory", fan=9)
    big = spark.range(0, 400_000, 1, 4).selectExpr("concat('source ', sha2(cast(id AS string), 256)) AS source", "'d' AS domain", "'' AS signature", "sha2(cast(-id AS string), 256) AS target", "timestamp_seconds(id) AS updated_at")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        t.write(big, 0)
        for b in range(1, 4):
            t.write(big.where(f"unix_timestamp(updated_at) % 1000 = {b}"), b)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    first, *small = t.manifest().runs
    assert first["rows"] == 400_000 and len(first["files"]) > 3
    assert [r["rows"] for r in small] == [400] * 3 and all(r["bytes"] < first["bytes"] / 200 and len(r["files"]) == 1 for r in small)
    spans = [(f["low"], f["high"]) for f in first["files"]]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert t.read().count() == 400_000


def test_a_run_is_shuffled_once(spark, tmp_path):
    """What a run keeps is found where its range lies: in batches whose keys come few times, in compaction, and for history too."""
    one, two = [("a", "d", "", "x", 1), ("b", "d", "", "y", 2)], [(" a", "d", "", "z", 3), ("c", "d", "", " ", 4)]
    kept = tables.memory_table(spark, f"file://{tmp_path}/memory", fan=2)
    history = tables.history_table(spark, f"file://{tmp_path}/history", ["user"], fan=2)
    entries = spark.sql("SELECT concat('u', id % 2) AS user, concat('i', id % 30) AS id, timestamp_seconds(id) AS saved_at FROM range(60)")
    for t, batches in ((kept, [records(spark, one), records(spark, two)]), (history, [entries.where("id < 'i2'"), entries])):
        plans, newest = [], t.newest
        t.newest = lambda rows, parted, newest=newest, plans=plans: (out := newest(rows, parted), plans.append(out._jdf.queryExecution().executedPlan().toString()))[0]
        for b, rows_ in enumerate(batches):
            t.write(rows_, b, few=True)
        assert len(plans) == 3 and all(p.count("Exchange") == 1 for p in plans)
        t.read()  # one run: nothing to find out
        assert len(plans) == 3
    assert rows(kept.read(), ["source", "target"]) == [("a", "z"), ("b", "y")]
    assert {r.saved_at.timestamp() for r in history.read().collect()} == {float(i) for i in range(30, 60)}


def test_a_crash_before_the_manifest(spark, tmp_path):
    """A run that no manifest lists is not read and is written over."""
    t = tables.memory_table(spark, f"file://{tmp_path}/memory")
    t.write(records(spark, [("a", "d", "", "x", 1)]), 0)
    t._write(records(spark, [("lost", "d", "", "x", 1)]), "000000000001-0", 0)
    assert rows(t.read(), ["source"]) == [("a",)]
    t.write(records(spark, [("b", "d", "", "x", 1)]), 1)
    assert rows(t.read(), ["source"]) == [("a",), ("b",)]


def test_history(spark, tmp_path):
    t = tables.history_table(spark, f"file://{tmp_path}/history", ["user"], fan=2)
    entry = lambda k: spark.sql(f"SELECT 'u' AS user, concat('i', id) AS id, timestamp_seconds(id + {k}) AS saved_at FROM range(30)")
    for b, k in enumerate((0, 100, 50)):
        t.write(entry(k), b)
    assert rows(t.read(), ["id"]) == sorted([(f"i{i}",) for i in range(5, 30)], key=repr)
    assert {r.saved_at.timestamp() for r in t.read().collect()} == {100.0 + i for i in range(5, 30)}


def test_as_a_stream(spark, tmp_path):
    made = [(f"s{i % 7}", "d", "", f"t{i}", i) for i in range(60)]
    df = records(spark, made)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    t = tables.memory_table(spark, f"file://{tmp_path}/memory", fan=2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(t.write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert rows(t.read(), ["source", "target"]) == rows(memory.upsert(df.limit(0), df), ["source", "target"])
