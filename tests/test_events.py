"""Logs read as they grow, and requests from deltas in list state, against their batch forms."""

import time

import pytest
from lectern.operators import logs
from lectern.plans import logs as plan
from lectern.streaming import events

LOGS = [
    (0, 'event: start\r\ndata: {"a":\r\ndata: 1}\r\n\r\ndata: [1]\n\n\n\nevent: é中\ndata: {"t": "é中😀"}\n\nevent: broken\ndata: {x\n\ndata: {}'),
    (1, ""), (2, "\n\n"), (3, "data: {}\r\n\r\n"), (4, 'event: a\ndata: {"x": "\\r\\n"}\r\n\r\nevent: b\r\ndata: {"y":　 2}\n'),
]
DELTAS = [
    (0, 'data: {"choices":[{"delta":{"content":"a é"}}]}\r\n\r\ndata: {broken\n: note\ndata:　{"choices":[{"delta":{"content":[{"text":"中"},{"text":"c"}]}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"late"}}]}\n'),
    (1, 'data: {"choices":[{"delta":{"content":"x"}}]}\n\ndata: {"choices":[{"delta":{"content":"cut'), (2, 'data: {"choices":[{"delta":{"content":"whole"}}]}'), (3, ""),
]


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, stream, tmp_path, name, expected, wait=60):
    """What a stream gives once all its rows are read; one with timers would go on after that."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
    seen, until = {}, time.time() + wait
    try:
        while sum(seen.values()) < expected and time.time() < until and not q.awaitTermination(0.5):
            seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
    finally:
        q.stop()
    return spark.table(name), seen


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def cut_everywhere(logs_):
    """For each place in each log a log that is cut there, and one cut at every byte."""
    for n, body in logs_:
        raw = body.encode()
        for at in range(len(raw) + 1):
            yield f"{n}-{at}", body, [raw[:at], raw[at:]]
        yield f"{n}-all", body, [raw[i : i + 1] for i in range(len(raw))] or [b""]


@pytest.mark.parametrize("kind", ["frames", "deltas"])
def test_logs_cut_at_every_byte(spark, tmp_path, kind):
    made = list(cut_everywhere(LOGS if kind == "frames" else DELTAS))
    pieces = [(name, i, bytearray(p), i == len(parts) - 1) for name, _, parts in made for i, p in enumerate(parts)]
    # first all even pieces, then all odd ones: many come too early
    schema = "log string, piece long, body binary, last boolean"
    for k in (0, 1):
        spark.createDataFrame([p for p in pieces if p[1] % 2 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame([(name, body) for name, body, _ in made], "log string, body string")
    one, many = (logs.frames, events.frames) if kind == "frames" else (logs.delta_texts, events.delta_texts)
    got, _ = run(spark, many(stream, "log"), tmp_path, f"cut_{kind}", len(pieces))
    want = one(whole, ["log"])
    assert rows(got) == rows(want.select(got.columns)) and want.count() > 100


def test_pieces_in_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for n, body in LOGS:
        raw = body.encode()
        for i in range(0, max(len(raw), 1), 7):
            (folder / f"log{n}.{i // 7}{'.last' if i + 7 >= len(raw) else ''}").write_bytes(raw[i : i + 7])
    (folder / "other.txt").write_text("no piece")
    got, _ = run(spark, events.frames(events.files_of_pieces(spark, str(folder), each=20), "log"), tmp_path, "in_files", sum(1 for _ in folder.iterdir()) - 1)
    want = logs.frames(spark.createDataFrame([(f"log{n}", body) for n, body in LOGS], "log string, body string"), ["log"])
    assert rows(got) == rows(want.select(got.columns))


def test_a_silent_log_ends(spark, tmp_path):
    schema = "log string, piece long, body binary, last boolean"
    spark.createDataFrame([("x", 0, bytearray(b"data: {}\n\ndata: {\"a\":1}"), False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = events.frames(stream, "log", seconds=2).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(30):
            if q.awaitTermination(1) or spark.table("silent").count() == 2:
                break
    finally:
        q.stop()
    assert rows(spark.table("silent")) == [("x", 0, "message", "{}"), ("x", 1, "message", '{"a":1}')]


def test_requests(spark, sf, tmp_path):
    made = plan.stream_events(spark, sf).select("request_id", "seq", "event", "data").limit(500)
    made.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    got, _ = run(spark, events.reassemble(stream), tmp_path, "requests", made.count(), wait=40)
    assert rows(got) == rows(logs.reassembled(made).where("status <> 'open'").select(got.columns))


def test_a_request_over_many_batches(spark, tmp_path):
    """Deltas are appended: state grows by what a batch brings, and the whole text comes at the end."""
    schema = "request_id long, seq long, event string, data string"
    for b in range(6):
        made = [(r, b * 50 + i, "delta", f'{{"text":"{r}:{b * 50 + i} "}}') for r in (1, 2) for i in range(50)]
        if b == 5:
            made += [(1, 300, "done", "{}"), (1, 301, "delta", '{"text":"late"}'), (2, 300, "error", '{"message":"down"}')]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, seen = run(spark, events.reassemble(stream), tmp_path, "batches", 603)
    assert rows(got) == [(1, "done", "".join(f"1:{i} " for i in range(300)), None), (2, "error", None, "down")]
    assert sum(seen.values()) == 603 and len(seen) >= 6


def test_malformed_frames_are_skipped(spark, tmp_path):
    made = [(1, 0, "delta", '{"text":"a"}'), (1, 1, "delta", "{no json"), (1, 2, "delta", '["list"]'), (1, 3, "delta", None), (1, 4, "delta", '{"text":"b"}'), (1, 5, "done", "{"), (2, 0, "error", '"x"'), (3, 0, "done", '{"text":"whole"}')]
    df = spark.createDataFrame(made, "request_id long, seq long, event string, data string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got, _ = run(spark, events.reassemble(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path, "malformed", len(made), wait=40)
    assert rows(got) == rows(logs.reassembled(df)) == [(1, "done", "ab", None), (2, "error", None, None), (3, "done", "whole", None)]
