"""Continuous forms of the quota, quality and results jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import qa

#: Segments of a batch that a task checks.
TASK_ROWS = 20_000


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def quota(access: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(client_key, event_id, allowed, retry_after) of every event, in windows that a client's events open.

    A client's state goes once its window is over for good, that is when the
    watermark passes it; events that come later than ``late`` are dropped.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, -(1 << 62))
        out = []
        for r in _ordered(batches, ["us", "event_id"]).itertuples():
            if reset <= r.us:
                count, reset = 1, r.us + seconds * 1_000_000
                out.append((key[0], r.event_id, True, 0))
            elif count < limit:
                count += 1
                out.append((key[0], r.event_id, True, 0))
            else:
                out.append((key[0], r.event_id, False, max(1, math.ceil((reset - r.us) / 1_000_000))))
        state.update((count, reset))
        state.setTimeoutTimestamp(max(-(-reset // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client_key", "event_id", "allowed", "retry_after"])

    timed = access.select("client_key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = timed.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("client_key").applyInPandasWithState(run, "client_key long, event_id long, allowed boolean, retry_after long", "count long, reset long", "append", GroupStateTimeout.EventTimeTimeout)


def quality(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """The warnings of each finished segment as it comes, by a glossary that one broadcast row can hold; ``quality_writer`` takes any."""
    if not qa.is_small(terms):
        raise ValueError(f"over {qa.FEW_TERMS} terms: use quality_writer")
    return qa.warned(qa.in_rows(qa.with_facts(qa.tidied(segments), "source", "target"), terms))


def quality_writer(terms: DataFrame, index: DataFrame, give: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that gives on the report of each batch's segments; a glossary too large for one broadcast row is joined by its kept index (``qa.term_index``).

    A batch may be few large files: its segments are dealt out to as many tasks as they need.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tasks = max(batch.sparkSession.sparkContext.defaultParallelism, -(-batch.count() // TASK_ROWS))
        give(qa.report(batch.repartition(tasks, "segment_id"), terms, index), batch_id)

    return write


def current(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results of the latest job of each document; late ones of older jobs are dropped."""
    latest = jobs.groupBy("doc_id").agg(F.max_by(F.struct("job_id", "revision"), F.struct("created_at", "job_id")).alias("j")).select("doc_id", "j.*")
    return results.join(latest, ["doc_id", "job_id", "revision"], "left_semi")
