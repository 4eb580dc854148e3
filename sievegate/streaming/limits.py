"""Stateful parts: the rate limiter, whose rejected hits don't count, and idempotency with a watermark."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(hits: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    """hits (id, login_id, created_at) with allowed: fewer than limit accepted hits in the last seconds. Each hit depends on
    the ones accepted before it, so a login's hits go through a queue of at most limit times; they are read batch by batch."""
    keyed = hits.select("id", "login_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us")).repartition("login_id").sortWithinPartitions("login_id", "us", "id")

    def run(batches):
        import pyarrow as pa

        login, accepted = None, deque()
        for batch in batches:
            allowed = []
            for who, us in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if who != login:
                    login, accepted = who, deque()
                while accepted and accepted[0] <= us - seconds * 1_000_000:
                    accepted.popleft()
                allowed.append(len(accepted) < limit)
                if allowed[-1]:
                    accepted.append(us)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], ["id", "login_id", "allowed"])

    return keyed.mapInArrow(run, "id long, login_id string, allowed boolean")


def rate_limited_stream(hits: DataFrame, limit: int = 10, seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """rate_limited for a stream: a login's state holds its accepted hits of the last seconds, limit at most, and goes by a timer when
    none is left. Hits of one batch are taken in order of time, batches as they come; hits behind the watermark are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])  # the hits of one login in one batch
        allowed = []
        for at in rows["created_at"]:
            us = at.value // 1000
            while accepted and accepted[0] <= us - seconds * 1_000_000:
                accepted.popleft()
            allowed.append(len(accepted) < limit)
            if allowed[-1]:
                accepted.append(us)
        state.update((list(accepted),))
        state.setTimeoutTimestamp(max(accepted[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"id": rows["id"], "login_id": key[0], "allowed": allowed})

    timed = hits.select("id", "login_id", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", late)
    return timed.groupBy("login_id").applyInPandasWithState(run, "id long, login_id string, allowed boolean", "accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def once(stream: DataFrame, keys: tuple[str, ...] = ("login_id", "client_request_id"), at: str = "created_at", ttl: str = "24 hours") -> DataFrame:
    """The first of the rows of a key within ttl: works on streams."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(list(keys))


def daily_windows(stream: DataFrame, at: str = "created_at", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), "action").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "action", "n")
