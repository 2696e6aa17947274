"""The engine's event streams: deliveries once, pushes debounced, metrics by window, state of jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import analytics

DEBOUNCE_SECONDS = 2


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def once(deliveries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each delivery id once, as long as repeats come within the watermark; deliveries without an id all pass."""
    return deliveries.withWatermark("received_at", late).withColumn("key", F.coalesce("delivery_id", F.expr("uuid()"))).dropDuplicatesWithinWatermark(["key"]).drop("key")


def debounced(pushes: DataFrame, late: str = "10 seconds", gap: int = DEBOUNCE_SECONDS) -> DataFrame:
    """One row for each run of pushes of a project with less than the gap between them."""
    return analytics.sessions(pushes.withWatermark("received_at", late), "project_id", "received_at", gap)


def metric_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return analytics.metric_windows(events.withWatermark("recorded_at", late), width)


STATE = "status string, started_at timestamp, completed_at timestamp"
JOB = "job_id string, status string, started_at timestamp, completed_at timestamp"
_ENDS = ("completed", "failed", "cancelled")


def advance(state: tuple, events: list[tuple]) -> tuple:
    """(status, started_at, completed_at) after (status, at) events: running starts, completed and failed
    end (cancelled sets no end), and an ended job changes no more unless it is queued again."""
    status, started, ended = state
    for to, at in sorted(events, key=lambda e: e[1]):
        if status in _ENDS and to != "queued":
            continue
        if to == "queued":
            started = ended = None
        elif to == "running" and started is None:
            started = at
        elif to in ("completed", "failed"):
            ended = at
        status = to
    return status, started, ended


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after each batch of (job_id, status, at) events; ``applyInPandasWithState`` keeps one row a job."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None, None)
        now = tuple(None if pd.isna(x) else x for x in now)
        for frame in frames:
            now = advance(now, list(zip(frame["status"], frame["at"])))
        state.update(tuple(None if x is None else x for x in now))
        yield pd.DataFrame({"job_id": [key[0]], "status": [now[0]], "started_at": pd.Series([now[1]], dtype="datetime64[ns]"), "completed_at": pd.Series([now[2]], dtype="datetime64[ns]")})

    return events.groupBy("job_id").applyInPandasWithState(run, JOB, STATE, "update", GroupStateTimeout.NoTimeout)
