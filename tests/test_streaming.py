"""Streams give the same rows as their batch twins."""

from pyspark.sql import functions as F

from lectern.operators import logs, qa
from lectern.plans import logs as plan
from lectern.plans import qa as pairs
from lectern.streaming import jobs


def run(spark, df, tmp_path, name, build, files=3, wait=150):
    """Feed a table as a stream of some files and collect what comes out."""
    df.repartitionByRange(files, df.columns[0]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(wait)  # a stream with time-outs goes on after its data
    q.stop()
    return spark.table(name)


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_quota(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("client_key"), "event_id", "ts")
    got = run(spark, e, tmp_path, "quota", lambda s: jobs.quota(s, 5, 864_000, late="400 days"), files=2)
    columns = ["client_key", "event_id", "allowed", "retry_after"]
    assert rows(got, columns) == rows(logs.quota(e, 5, 864_000), columns)


def test_clients_expire(spark, tmp_path):
    """A client's state goes when the watermark passes its window."""
    e = spark.sql("SELECT id AS client_key, id AS event_id, timestamp_seconds(id * 100000) AS ts FROM range(1, 7)")
    e.repartitionByRange(6, "client_key").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.quota(stream, 5, 60, late="1 minute").writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    left = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    q.stop()
    assert left and left[-1] < 6 and spark.table("expiring").where("allowed").count() <= 6


def test_quota_edges(spark):
    e = spark.sql("SELECT 1L AS client_key, id AS event_id, timestamp_seconds(s) AS ts FROM VALUES (1L, 0), (2L, 1), (3L, 2), (4L, 10), (5L, 11), (6L, 12), (7L, 20) AS t(id, s)")
    got = [(r.allowed, r.retry_after) for r in logs.quota(e, 2, 10).orderBy("event_id").collect()]
    assert got == [(True, 0), (True, 0), (False, 8), (True, 0), (True, 0), (False, 8), (True, 0)]


def test_quality(spark, sf, tmp_path):
    p, g = pairs.pairs(spark, sf).limit(300), pairs.glossary(spark)
    got = run(spark, p, tmp_path, "quality", lambda s: jobs.quality(s, g).select("segment_id", F.array_join("warnings.code", ",").alias("codes")))
    want = qa.report(p, g).select("segment_id", F.array_join("warnings.code", ",").alias("codes"))
    assert rows(got, ["segment_id", "codes"]) == rows(want, ["segment_id", "codes"])


def test_current(spark, tmp_path):
    results = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 2, 1)], "doc_id int, job_id int, revision int")
    active = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 1, 6)], "doc_id int, job_id int, revision int, created_at int")
    assert rows(run(spark, results, tmp_path, "current", lambda s: jobs.current(s, active), files=1), ["job_id", "revision"]) == [(2, 1)]
