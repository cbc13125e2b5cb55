"""Sweeps as Structured Streaming: resumable by checkpoint, late rows by watermark.

A sweep reads what is new since its checkpoint and stops (``availableNow``), which is how a job runs
in intervals on a cluster; the same plans run continuously with another trigger.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.registry import load, query
from ..sources.mirror import work_folder


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the schema is the table's, never inferred from new files."""
    schema = load(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def sweep(rows: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there exactly once into Parquet and read the output."""
    q = rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


def closed_sessions(events: DataFrame, gap: str = "20 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that can get no more rows: counts and spans."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = w.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fold_state(events: DataFrame) -> DataFrame:
    """Running fold of each user's events with custom state: events so far and the last type."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last_id, last = state.get if state.exists else (0, -1, "")
        for b in batches:
            n += len(b)
            i = b["event_id"].idxmax()
            if b["event_id"][i] > last_id:
                last_id, last = int(b["event_id"][i]), b["event_type"][i]
        state.update((n, last_id, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_type": [last]})

    rows = events.select("user_id", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last_type string", "n long, last_id long, last string", "append", GroupStateTimeout.NoTimeout)


@query("l1_stream_sweep", "SELECT event_id, user_id FROM events WHERE value > 50")
def l1(spark, d):
    """A resumable sweep over the log."""
    return sweep(stream(spark, d, "events").where("value > 50").select("event_id", "user_id"), work_folder(spark, "sweep"))


@query("l9_stream_sessions", """WITH s AS (SELECT user_id, ts, sum(CASE WHEN ts - prev < INTERVAL 20 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def l9s(spark, d):
    """Sessions closed by the watermark."""
    out = sweep(closed_sessions(stream(spark, d, "events")), work_folder(spark, "sessions"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_windows", """SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2)
  WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def windows(spark, d):
    """Tumbling windows with late rows up to an hour; only closed windows come out."""
    e = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    g = e.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    out = sweep(g.select("event_type", F.col("w.start").alias("start"), "n"), work_folder(spark, "windows"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("s19_stream_dedup", "SELECT user_id, event_type FROM events GROUP BY ALL")
def s19s(spark, d):
    """Exactly-once append by key."""
    e = stream(spark, d, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return sweep(e, work_folder(spark, "dedup"))


@query("r4_stream_fold", "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def r4(spark, d):
    """The fold kept as custom streaming state."""
    return newest(sweep(fold_state(stream(spark, d, "events")), work_folder(spark, "fold")))


def newest(rows: DataFrame) -> DataFrame:
    """Each run adds a row for every user it touched; the one with the most events is the state now."""
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("last_type", "n").alias("last_type"))
