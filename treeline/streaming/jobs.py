"""Job events as streams: latest states, sessions and progress by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a folder of parquet files of events."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_progress(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type and time window; state older than the watermark is dropped."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a user within a gap of each other."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def latest_states(events: DataFrame) -> DataFrame:
    """Latest state of each job, kept as one row of state for each: works on streams (update mode) and on tables."""

    def latest(key, frames, state):
        import pandas as pd

        best = state.get if state.exists else None
        for rows in frames:
            rows = rows.sort_values(["ts", "event_id"])
            last = rows.iloc[-1]
            now = (int(last["ts"].value), int(last["event_id"]), str(last["event_type"]))
            best = now if best is None or now[:2] > tuple(best)[:2] else best
        state.update(tuple(best))
        yield pd.DataFrame({"user_id": [key[0]], "state": [best[2]], "event_id": [best[1]]})

    if events.isStreaming:
        out = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("event_id", T.LongType())])
        kept = T.StructType([T.StructField("ts", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("state", T.StringType())])
        return events.groupBy("user_id").applyInPandasWithState(latest, out, kept, "update", "NoTimeout")
    best = events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("state"), F.col("b.event_id").alias("event_id"))
