"""Structured Streaming forms of the windowed and stateful operators.

Event time is ``ts``; late rows are accepted for ``LATENESS``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgate.sources.scratch import scratch_root

LATENESS = "1 hour"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream, with ts as event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run ``stream`` over all that is there now and read what it wrote (complete: its last state)."""
    spark = stream.sparkSession
    base = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    # A batch that runs again after a failure replaces what it wrote; a complete state replaces the one before.
    place = (lambda k: "state") if mode == "complete" else (lambda k: f"part={k}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{base}/out/{place(k)}")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*")


def daily_actions(events: DataFrame) -> DataFrame:
    """Actions per UTC day and user in tumbling windows."""
    windows = events.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 day").alias("w"), "user_id")
    return windows.agg(F.count("*").alias("actions")).select(F.col("w.start").cast("date").alias("day"), "user_id", "actions")


def sliding_log(events: DataFrame, most: int, window_s: int) -> DataFrame:
    """(user_id, event_id, allowed): a request is refused while ``most`` accepted ones lie within the window.

    The state of a user is the accepted times within the window, at most ``most``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"]:
            log = [t for t in log if at - t < window_s]
            allowed.append(len(log) < most)
            if allowed[-1]:
                log.append(at)
        state.update((log,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    rows = events.select("user_id", "event_id", F.unix_seconds("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, allowed boolean", "log array<bigint>", "append", GroupStateTimeout.NoTimeout)
