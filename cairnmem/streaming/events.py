"""Streams of events and operations.

Batch forms of the same aggregates are in the operators; on closed windows both give the same rows.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """A stream of the files under a path, with event time ``at``."""
    return spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type."""
    kept = events.withWatermark("at", late) if events.isStreaming else events
    out = kept.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    kept = events.withWatermark("at", late) if events.isStreaming else events
    out = kept.groupBy(F.window("at", width, step), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by inactivity."""
    kept = events.withWatermark("at", late) if events.isStreaming else events
    out = kept.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.unix_micros("session_window.start").alias("started_us"), "user_id", "n")


def once(events: DataFrame, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Each event once, as long as its copies are no later than the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def run(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into files, and return them as a table."""
    query = out.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def apply_batches(operations: DataFrame, path: str, checkpoint: str, key: str = "op_id") -> None:
    """Append a stream of operations to a table of files, each operation once, whatever is delivered
    again.  Known ids are state, dealt by hash and kept with the checkpoint, so that a batch costs what it
    brings and earlier files are never read; the file sink commits a batch that runs twice once."""
    once = operations.dropDuplicates([key])
    once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


_FOLDED = "target string, importance double, n_writes bigint, last_hlc bigint, tombstoned boolean"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    importance, at, op, writes, last, dead = state.get if state.exists else (None, -1, "", 0, -1, False)
    for rows in batches:
        last = max(last, int(rows["hlc"].max()))
        dead = bool(dead or (rows["op_type"] == "forget").any())
        written = rows[rows["op_type"] != "forget"]
        writes += len(written)
        if len(written):
            best = written.sort_values(["hlc", "op_id"]).iloc[-1]
            if (best["hlc"], best["op_id"]) > (at, op):
                importance, at, op = float(best["importance"]), int(best["hlc"]), str(best["op_id"])
    state.update((importance, at, op, writes, last, dead))
    yield pd.DataFrame({"target": [key[0]], "importance": [importance], "n_writes": [writes], "last_hlc": [last], "tombstoned": [dead]})


def fold(operations: DataFrame) -> DataFrame:
    """The running state of each target (target_rid, op_id, op_type, hlc, importance): what was written
    last by (hlc, op_id), whatever the order of arrival; a tombstone wins and is never dropped."""
    return operations.groupBy("target_rid").applyInPandasWithState(
        _fold, _FOLDED, "importance double, at bigint, op string, writes bigint, last bigint, dead boolean", "update", GroupStateTimeout.NoTimeout
    )
