"""Files that are kept encrypted for a short time: rows with sealed content, bound to their reference, owner, request and scope.

The key is a column (16, 24 or 32 bytes), so that it can come from a table that executors alone can read; a literal would stand in
plans and logs. Sealing draws a nonce a row: the sealed bytes differ from run to run, what is opened doesn't. Null content is not
stored. A row that was changed in any bound column, or sealed with another key, does not open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The time to live, prefixes of references and scopes.
TTL_SECONDS = 900
REF, SCOPE = "fref_", "tscope_"
BOUND = ["file_ref", "subject_id", "request_id", "temp_scope_id"]


def _bound() -> Column:
    return F.to_json(F.struct(*BOUND)).cast("binary")


def store(files: DataFrame, key: Column, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """files (content, subject_id, request_id, and more columns) with file_ref, temp_scope_id, created_at, expires_at and sealed in the
    place of content. References and scopes are drawn anew unless files has them."""
    out = files.where("content IS NOT NULL")
    for name, prefix in (("file_ref", REF), ("temp_scope_id", SCOPE)):
        if name not in files.columns:
            out = out.withColumn(name, F.concat(F.lit(prefix), F.replace(F.uuid(), F.lit("-"), F.lit("")), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    out = out.withColumns({"created_at": now, "expires_at": now + F.make_dt_interval(secs=F.lit(ttl_seconds))})
    sealed = F.aes_encrypt(F.col("content").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _bound())
    return out.withColumn("sealed", sealed).drop("content")


def resolve(requests: DataFrame, stored: DataFrame, key: Column, now: Column) -> DataFrame:
    """requests (file_ref, subject_id, request_id, temp_scope_id, and more columns) with failure_code (null where the file may be read)
    and content."""
    s = stored.select("file_ref", *[F.col(c).alias(f"_{c}") for c in BOUND[1:]], "expires_at", "sealed", F.lit(True).alias("_there"))
    out = requests.join(s, "file_ref", "left")
    mine = F.lit(True)
    for c in BOUND[1:]:
        mine = mine & F.col(c).eqNullSafe(F.col(f"_{c}"))
    refused = F.when(F.col("_there").isNull() | ~F.col("file_ref").startswith(REF), "TEMP_FILE_NOT_FOUND").when(~mine, "TEMP_FILE_ACCESS_DENIED").when(now >= F.col("expires_at"), "TEMP_FILE_EXPIRED")
    content = F.try_aes_decrypt("sealed", key, F.lit("GCM"), F.lit("DEFAULT"), _bound())
    out = out.withColumn("_refused", refused).withColumn("content", F.when(F.col("_refused").isNull(), content))
    code = F.coalesce("_refused", F.when(F.col("content").isNull(), "TEMP_FILE_DECRYPT_FAILED"))
    return out.select(*requests.columns, code.alias("failure_code"), "content")


def swept(stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What stays at a time, and the references of what goes: all that has expired, or has no expiry that can be read."""
    gone = F.coalesce(F.col("expires_at") <= now, F.lit(True))
    return stored.where(~gone), stored.where(gone).select("file_ref")


def sweep_stream(stored: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Of a stream of stored files, the references (file_ref, expires_at) that expire, each once, when the watermark of created_at has
    passed their expiry: a timer for each reference. One that is stored again lives as long as its last expiry."""

    def due(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame({"file_ref": [key[0]], "expires_at": [pd.Timestamp(at, unit="ms", tz="UTC")]})
            return
        at = max([state.get[0] if state.exists else 0, *(int(t.timestamp() * 1000) for batch in rows for t in batch["expires_at"])])
        state.update((at,))
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))

    timed = stored.select("file_ref", "created_at", "expires_at").withWatermark("created_at", late)
    return timed.groupBy("file_ref").applyInPandasWithState(due, "file_ref string, expires_at timestamp", "at long", "append", GroupStateTimeout.EventTimeTimeout)
