"""Event logs read as they grow, and requests put together from their deltas.

Both keep state by key in the RocksDB store, which the session must name
(``use_state_store``). What a batch costs follows the batch: deltas are appended
to a list in state and read once, at the request's end; of a log only the cut end
of its last piece is carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators import logs

#: Seconds after which a request that never ended is given up, and a silent log counts as ended.
ABANDONED, SILENT = 120, 600
# Fixed value: white space that is trimmed.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Timed(StatefulProcessor):
    """Keeps one timer for each key, moved on whenever rows come."""

    def __init__(self, seconds: int):
        self.milliseconds = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def wait(self, timers) -> None:
        self.rest()
        at = timers.getCurrentProcessingTimeInMs() + self.milliseconds
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def rest(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])

    def close(self) -> None:
        pass


class Requests(Timed):
    """Deltas wait in a list until their request ends; a silent request is given out as ``open``, an ended one forgotten."""

    COLUMNS = ["request_id", "status", "text", "message"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.deltas = handle.getListState("deltas", "seq long, text string")
        self.ended = handle.getValueState("ended", "yes boolean")

    def _text(self) -> str:
        return "".join(t for _, t in sorted((r[0], r[1]) for r in self.deltas.get()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if not self.ended.exists():
            fresh = []
            for r in pd.concat(parts).sort_values("seq", kind="stable").itertuples():
                own = r.text if isinstance(r.text, str) else None
                if r.event == "delta":
                    fresh.append((int(r.seq), own or ""))
                elif r.event in ("done", "error"):
                    if fresh:
                        self.deltas.appendList(fresh)
                    done = r.event == "done"
                    text = (self._text() if own is None else own) if done else None
                    self.deltas.clear()
                    self.ended.update((True,))
                    self.wait(timerValues)
                    yield pd.DataFrame([[key[0], r.event, text, r.message if not done and isinstance(r.message, str) else None]], columns=self.COLUMNS)
                    return
            if fresh:
                self.deltas.appendList(fresh)
        self.wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ended.exists():
            yield pd.DataFrame([[key[0], "open", self._text(), None]], columns=self.COLUMNS)
        self.deltas.clear()
        self.ended.clear()
        self.timer.clear()


def reassemble(events: DataFrame, seconds: int = ABANDONED) -> DataFrame:
    """(request_id, status, text, message) of (request_id, seq, event, data) as requests end; the events of a request come in order.

    What comes after a request's end is dropped while its state is kept. Data
    that does not parse, or is no object, has no text and no message.
    """
    parsed = events.select("request_id", "seq", "event", F.get_json_object("data", "$.text").alias("text"), F.get_json_object("data", "$.message").alias("message"))
    return parsed.groupBy("request_id").transformWithStateInPandas(Requests(seconds), "request_id long, status string, text string, message string", "Append", "ProcessingTime")


class Pieces(Timed):
    """Cuts logs, which come in numbered pieces of bytes, at a mark that may itself be cut.

    Pieces that come too early wait for those before them. The rest behind the
    last mark is carried over; it is given out when the log's last piece has
    come, or when the log has been silent for so long. With ``data``, parts are
    lines, of which only the data counts, up to the line that ends it.
    """

    def __init__(self, mark: bytes, seconds: int, data: bool = False):
        super().__init__(seconds)
        self.mark, self.data = mark, data

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", "piece long, seq long, rest binary, over boolean")
        self.early = handle.getListState("early", "piece long, body binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        piece, seq, rest, over = self.place.get() if self.place.exists() else (0, 0, b"", False)
        if over:
            return
        waiting = {int(r[0]): (bytes(r[1]), bool(r[2])) for r in self.early.get()} if self.early.exists() else {}
        had = len(waiting)
        for part in rows:
            for r in part.itertuples():
                if int(r.piece) >= piece:
                    waiting.setdefault(int(r.piece), (bytes(r.body or b""), bool(r.last)))
        data = bytearray(rest)
        while piece in waiting and not over:
            body, over = waiting.pop(piece)
            data += body
            piece += 1
        *whole, rest = bytes(data).replace(b"\r\n", b"\n").split(self.mark)
        parts = whole + ([rest] if over else [])
        if self.data:
            parts, ended = self._data(parts)
            over |= ended
        if had or waiting:
            self.early.clear()
            if waiting and not over:
                self.early.put([(k, *v) for k, v in sorted(waiting.items())])
        self.place.update((piece, seq + len(parts), b"" if over else rest, over))
        self.wait(timerValues)
        if parts:
            yield self._given(key, seq, parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, seq, rest, over = self.place.get()
        self.early.clear()
        self.place.clear()
        self.timer.clear()
        parts = [] if over else [bytes(rest)]
        if self.data:
            parts, _ = self._data(parts)
        if parts:
            yield self._given(key, seq, parts)

    @staticmethod
    def _data(lines: list[bytes]) -> tuple[list[bytes], bool]:
        """What lines of data hold, up to the line that ends them, and whether that came."""
        out = []
        for line in lines:
            text = line.decode("utf-8", "replace").strip(BLANK)
            if text.startswith("data:"):
                own = text[5:].strip(BLANK)
                if own == "[DONE]":
                    return out, True
                out.append(own.encode())
        return out, False

    @staticmethod
    def _given(key, seq: int, parts: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"log": [key[0]] * len(parts), "seq": range(seq, seq + len(parts)), "part": [p.decode("utf-8", "replace") for p in parts]})


def _cut(pieces: DataFrame, key: str, mark: bytes, seconds: int, data: bool = False) -> DataFrame:
    rows = pieces.select(F.col(key).cast("string").alias("log"), F.col("piece").cast("long").alias("piece"), F.col("body").cast("binary").alias("body"), F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("log").transformWithStateInPandas(Pieces(mark, seconds, data), "log string, seq long, part string", "Append", "ProcessingTime")


def frames(pieces: DataFrame, key: str, seconds: int = SILENT) -> DataFrame:
    """(log, seq, event, data): the frames of logs that come as (key, piece, body, last), pieces numbered from 0 and cut anywhere."""
    return logs.parsed_frames(_cut(pieces, key, b"\n\n", seconds).withColumnRenamed("part", "frame"), ["log"])


def delta_texts(pieces: DataFrame, key: str, seconds: int = SILENT) -> DataFrame:
    """(log, seq, text): text pieces of provider streams that come so, up to the line that ends them."""
    return logs.parsed_deltas(_cut(pieces, key, b"\n", seconds, data=True).withColumnRenamed("part", "line"), ["log"])


def files_of_pieces(spark: SparkSession, folder: str, each: int = 1000, pattern: str = r"([^/]*)\.(\d+)(\.last)?\z") -> DataFrame:
    """(log, piece, body, last) of files ``<log>.<piece>``, the log's last one ``<log>.<piece>.last``, as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", each).load(folder)
    part = lambda i: F.regexp_extract("path", pattern, i)
    return files.where(F.col("path").rlike(pattern)).select(part(1).alias("log"), part(2).cast("long").alias("piece"), F.col("content").alias("body"), (part(3) != "").alias("last"))
