"""Requests before and after the rules: ids, metadata, uploads, what is masked and what could not be read, evidence that is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions.keys import unsafe_metadata  # noqa: F401  a check of requests like the others

# Patterns, names and limits that the results depend on.
REQUEST_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
REVISION = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,79}$"
SECRET_LIKE = r"(?i)(?:gh[pousr]_|sk-[A-Za-z0-9]|xox[baprs]-|AKIA[0-9A-Z]|postgres://|mysql://|bearer|private[_-]?key)"
FILE_KINDS = ["plain_text", "image", "pdf", "office_document", "spreadsheet", "slide", "code", "unknown"]
MIME, EXTENSION = r"^[a-z0-9.+-]+/[a-z0-9.+-]+$", r"^[a-z0-9]{1,16}$"
COUNT_KEYS = ["match_count", "matched_condition_count", "keyword_count"]
MOST_INPUTS, TINY_BYTES, UPLOAD_BYTES, MOST_KEYWORDS = 20, 16_384, 1 << 20, 50


def request_checks(inputs: DataFrame) -> DataFrame:
    """inputs (request_id, client_request_id, revision, input_id), a row an input: request_id, violations (array) of each request.
    Null ids break the pattern."""
    per = inputs.groupBy("request_id", "client_request_id", "revision").agg(F.count("*").alias("n"), F.count_distinct("input_id").alias("ids"))
    bad = lambda c, p: F.when(~F.coalesce(F.col(c).rlike(p), F.lit(False)), f"{c}_pattern")
    secret = lambda c: F.when(F.col(c).rlike(SECRET_LIKE), f"{c}_secret_like")
    checks = [bad("client_request_id", REQUEST_ID), secret("client_request_id"), bad("revision", REVISION), secret("revision"), F.when(F.col("n") > MOST_INPUTS, "too_many_inputs"), F.when(F.col("ids") < F.col("n"), "repeated_input_id")]
    return per.select("request_id", F.array_compact(F.array(*checks)).alias("violations"))


def json_string(metadata: Column, name: str) -> Column:
    """The value of a top-level key where it is a string, else null."""
    value = F.try_variant_get(F.try_parse_json(metadata), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(metadata), f"$.{name}", "string"))


def adapted(inputs: DataFrame) -> DataFrame:
    """inputs (kind, metadata, mime, extension, size_bucket, unavailable_reason) with what their metadata and kind stand in for."""
    return inputs.withColumns(
        {
            "mime": F.coalesce("mime", json_string(F.col("metadata"), "mime")),
            "extension": F.coalesce("extension", json_string(F.col("metadata"), "extension")),
            "size_bucket": F.coalesce("size_bucket", F.when(~F.col("kind").isin("text", "file_reference"), "unknown")),
            "unavailable_reason": F.coalesce("unavailable_reason", F.when(F.col("kind") == "attachment_metadata", "metadata_only")),
        }
    )


def upload_intake(files: DataFrame) -> DataFrame:
    """files (file_kind, mime_hint, extension_hint, size): rejected (null where accepted), and hints cleaned or dropped, and a bucket."""
    mime, extension = F.trim(F.lower("mime_hint")), F.ltrim(F.trim(F.lower("extension_hint")), F.lit("."))
    rejected = F.when(~F.coalesce(F.col("file_kind").isin(FILE_KINDS), F.lit(False)), "unsupported_kind").when(F.col("size") > UPLOAD_BYTES, "too_large")
    bucket = F.when(F.col("size") == 0, "empty").when(F.col("size") <= TINY_BYTES, "tiny").otherwise("small")
    return files.withColumns({"rejected": rejected, "mime": F.when(mime.rlike(MIME), mime), "extension": F.when(extension.rlike(EXTENSION), extension), "bucket": F.when(rejected.isNull(), bucket)})


def extraction_requirement(file_kind: Column) -> Column:
    return F.when(file_kind == "image", "ocr_required").when(file_kind == "pdf", "native_parse_then_ocr_fallback").when(file_kind.isin("plain_text", "code", "office_document", "spreadsheet", "slide"), "native_parse").otherwise("metadata_only")


def first_composer(inputs: DataFrame, key: str) -> DataFrame:
    """Of each request, the first composer input with content and a match: the only one that is masked."""
    ok = F.col("content_included") & (F.col("source") == "composer") & (F.col("n_matches") > 0)
    return inputs.where(ok).groupBy(key).agg(F.min("input_index").alias("input_index"))


def content_unavailable(results: DataFrame) -> DataFrame:
    """The inputs that were not scanned, with a reason for each."""
    reason = F.coalesce("unavailable_reason", F.when(F.col("kind") == "attachment_metadata", "metadata_only").otherwise("unavailable"))
    return results.where(~F.col("content_scanned") & F.col("decision_basis").isin("content_unavailable", "metadata_only")).withColumn("reason", reason)


def capped(texts: DataFrame, composer_bytes: int, paste_bytes: int) -> DataFrame:
    """texts (source, content): a text over its limit goes on without content, with its size and the limit's name."""
    size = F.octet_length("content")
    over = size > F.when(F.col("source") == "composer", composer_bytes).otherwise(paste_bytes)
    limit = F.when(F.col("source") == "composer", "MAX_COMPOSER_TEXT_BYTES").otherwise("MAX_CONVERTED_PASTE_TEXT_BYTES")
    return texts.withColumns({"size_bytes": size, "content": F.when(~over, F.col("content")), "content_included": ~over, "unavailable_reason": F.when(over, "oversized"), "limit_exceeded": F.when(over, limit)})


def safe_strings(value: Column) -> Column:
    """The strings of a JSON list, the first 50; an empty array for anything else."""
    items = F.filter(F.from_json(value, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.slice(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), 1, MOST_KEYWORDS), F.array().cast("array<string>"))


def safe_numbers(value: Column, keys: list[str] | None = None) -> Column:
    """The whole numbers of a JSON object: of the given keys, or of all keys those that are not negative."""
    numbers = F.map_filter(F.from_json(value, "map<string,variant>"), lambda k, x: (F.schema_of_variant(x) == "BIGINT") & (k.isin(keys) if keys else F.lit(True)))
    whole = F.transform_values(numbers, lambda _, x: F.try_variant_get(x, "$", "long"))
    return whole if keys else F.map_filter(whole, lambda _, x: x >= 0)


def performance_verdict(elapsed: Column, units: Column, outcome: Column, most_elapsed: int, most_units: int) -> Column:
    """status, latency and size buckets, failure code of one measured operation."""
    code = F.when((elapsed < 0) | (units < 0), "PERFORMANCE_MALFORMED_SAMPLE").when(units == 0, "PERFORMANCE_EMPTY_SAMPLE").when(outcome == "timeout", "PERFORMANCE_TIMEOUT").when(outcome == "failed", "PERFORMANCE_FAILED").when(outcome == "partial", "PERFORMANCE_PARTIAL")
    within = lambda x, most: F.when(code.isNotNull(), "unknown").when(x <= most, "within_budget").otherwise("over_budget")
    size = F.when(code == "PERFORMANCE_EMPTY_SAMPLE", "empty").otherwise(within(units, most_units))
    status = F.when(code.isNotNull(), "failed").when((elapsed <= most_elapsed) & (units <= most_units), "passed").otherwise("budget_exceeded")
    return F.struct(status.alias("status"), within(elapsed, most_elapsed).alias("latency_bucket"), size.alias("size_bucket"), code.alias("failure_code"))


def event_filter(events: DataFrame, action: str | None = None, risk_level: str | None = None, user_id: int | None = None) -> DataFrame:
    for column, value in (("action", action), ("risk_level", risk_level), ("user_id", user_id)):
        events = events if value is None else events.where(F.col(column) == value)
    return events
