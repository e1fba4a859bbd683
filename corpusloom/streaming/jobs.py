"""Structured Streaming forms of what keeps state over arrivals: dedup, request tallies, a token bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_stream(stream: DataFrame, key, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first arrival of each key within the watermark, beyond which keys are forgotten; times without a zone are taken as the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("_key", key).withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def tallies(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum of values by kind of event and window; the same on a table and on a stream.

    Times without a zone take no watermark, so such a stream is for complete output.
    """
    if events.isStreaming and events.schema["ts"].dataType.typeName() == "timestamp":
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def token_bucket(events: DataFrame, rate_per_s: float, burst: float, late: str = "1 hour") -> DataFrame:
    """(user_id, ts, allowed) of a stream: each user's bucket refills at the rate up to the burst, and an event takes one token.

    A bucket that would be full again by the watermark is dropped: it is then like that of a new user, so the state holds only users
    seen of late. Events of a batch are taken in order of time; one before a user's last event neither refills nor is left out.
    """
    import pandas as pd

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        times = pd.concat([pdf["ts"] for pdf in batches]).sort_values(ignore_index=True)
        allowed = []
        for ts in times:
            t = ts.timestamp()
            tokens = min(burst, tokens + max(t - last, 0.0) * rate_per_s) if last is not None else tokens
            last = t if last is None else max(last, t)
            allowed.append(tokens >= 1)
            tokens -= 1.0 if allowed[-1] else 0.0
        state.update((float(tokens), float(last)))
        full = int(1000 * (last + (burst - tokens) / rate_per_s)) + 1
        state.setTimeoutTimestamp(max(full, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "ts": times, "allowed": allowed})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
