"""Requests as JSON lines: their size is tested before they are parsed, and what does not parse is kept apart. Batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# The size of a request body in bytes, and its shape.
BODY_BYTES = 2_097_152
REQUEST = """client_request_id string, filter_config_revision string,
context struct<ai_service: string, ai_service_domain: string, page_url_origin: string, extension_version: string, browser: string, locale: string>,
inputs array<struct<input_id: string, kind: string, source: string, size_bytes: int, content_included: boolean, content: string, file_ref: string, temp_scope_id: string, file_kind: string,
mime: string, extension: string, size_bucket: string, metadata: variant, content_unavailable_reason: string, limit_exceeded: string>>"""
OK, TOO_LARGE, MALFORMED = "ok", "too_large", "malformed"


def guarded(lines: DataFrame, schema: str = REQUEST, most: int = BODY_BYTES, value: str = "value") -> DataFrame:
    """lines with size_bytes, verdict and request (null unless the verdict is ok). A line over the limit is never parsed. Malformed: no
    JSON object, or a field of another type than the schema has; unknown fields are left out. A null line is malformed."""
    kept = T._parse_datatype_string(schema).add("_corrupt", T.StringType())
    size = F.coalesce(F.octet_length(value), F.lit(0))
    parsed = F.when(size <= most, F.from_json(F.col(value).cast("string"), kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    out = lines.withColumn("size_bytes", size).withColumn("_r", parsed)
    good = F.col("_r").isNotNull() & F.col("_r._corrupt").isNull() & F.coalesce(F.trim(F.col(value).cast("string")).startswith("{"), F.lit(False))
    verdict = F.when(F.col("size_bytes") > most, TOO_LARGE).when(good, OK).otherwise(MALFORMED)
    out = out.withColumn("verdict", verdict)
    return out.withColumn("request", F.when(F.col("verdict") == OK, F.col("_r").dropFields("_corrupt"))).drop("_r")


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("size_bytes").cast("long").alias("bytes"))


def write_stream(lines: DataFrame, to: str, checkpoint: str, schema: str = REQUEST, most: int = BODY_BYTES) -> StreamingQuery:
    """A stream of lines into folders of one table, a folder for each verdict: requests that are ok, and of the others the line (not of
    those that are too large) for a second look. A batch that is run again replaces what it wrote."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = guarded(batch, schema, most)
        line = F.when(F.col("verdict") == MALFORMED, F.col("value").cast("string")).alias("line")
        rows.select("verdict", "size_bytes", F.to_json("request").alias("request"), line, F.lit(batch_id).alias("batch_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "verdict").parquet(to)

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
