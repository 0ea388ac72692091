"""Job status feed on Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """Watermarks need times with a zone; those without are the session's."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def latest_state(events: DataFrame) -> DataFrame:
    """Latest status of each job; use with output mode update or complete."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("updates"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts; rows later than the watermark are dropped."""
    return _timed(events, "ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with gaps of at most gap."""
    return _timed(events, "ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def changes(events: DataFrame) -> DataFrame:
    """Events whose status differs from the job's last one: one string of state per job."""

    def run(key, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            if e.event_type != last:
                out.append((e.user_id, e.event_id, e.event_type))
                last = e.event_type
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, event_type string", "last string", "append", "NoTimeout")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of overlapping windows."""
    return _timed(events, "ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))


def followed_by(events: DataFrame, first: str, then: str, within: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Pairs of a user's events of two types, the second at most that much later: an interval join of two streams with bounded state."""
    a = events.where(F.col("event_type") == first).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = events.where(F.col("event_type") == then).select(F.col("user_id").alias("then_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    a, b = _timed(a, "first_ts", late), _timed(b, "then_ts", late)
    return a.join(b, F.expr(f"user_id = then_user and then_ts >= first_ts and then_ts <= first_ts + interval {within}")).select("user_id", "first_id", "then_id")


def recovered(states: DataFrame, status: str = "status") -> DataFrame:
    """States after a restart: what was queued or running has failed."""
    return states.withColumn(status, F.when(F.col(status).isin("queued", "running"), "error").otherwise(F.col(status)))


def work_through(jobs: DataFrame, work, path: str, checkpoint: str):
    """Runs work(batch DataFrame) on each micro-batch of a stream of jobs and appends what it returns; a batch is written once."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
