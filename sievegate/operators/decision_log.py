"""The decision log: rows of a decision without any content, appended table by table, and rules under change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions.scalars import size_bucket
from sievegate.operators.policy import first_of_key

# The columns that may be stored.
EVENT = ["event_id", "user_id", "login_id", "client_request_id", "action", "risk_score", "risk_level", "context", "created_at"]
INPUT = ["event_id", "input_index", "kind", "source", "size_bucket", "content_included", "content_scanned", "decision_basis", "content_unavailable_reason"]
DETECTION = ["event_id", "input_index", "rule_id", "category", "type", "source", "severity", "action", "confidence", "count", "reason_code", "value_lengths"]


def safe_context(status: Column, accepted: Column, candidates: Column, labels: Column, reason: Column) -> Column:
    """Context evidence as it is stored; null where the cascade is off or found no candidate."""
    floor = lambda n: F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))
    kept = F.struct(status.alias("status"), floor(accepted).alias("accepted_count"), floor(candidates).alias("candidate_count"), labels.alias("labels"), F.coalesce(reason, F.lit("RISK_CONTEXT_LR_ONLY")).alias("reason_code"))
    return F.when(status.isNotNull() & ~status.isin("disabled", "no_candidate"), kept)


def input_rows(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("size_bucket", size_bucket(F.col("size_bytes"))).select(INPUT)


def detection_rows(matches: DataFrame) -> DataFrame:
    """Lengths of values are kept where they can be lengths; no text is."""
    return matches.withColumn("value_lengths", F.filter("value_lengths", lambda n: n >= 0)).select(DETECTION)


def new_requests(requests: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("login_id", "client_request_id"), at: str = "created_at") -> DataFrame:
    """Requests whose key is in neither the log nor an earlier request of the batch."""
    order = [at, *[c for c in ("event_id",) if c in requests.columns]]
    return first_of_key(requests, list(keys), order).join(stored.select(*keys), list(keys), "left_anti").select(*requests.columns)


def append(base: str, batch: int, events: DataFrame, inputs: DataFrame, detections: DataFrame) -> None:
    """Adds a batch below base (foreachBatch gives its number). Each table's part of a batch is a folder that a retry writes anew, and
    keys come last: a batch that failed half way isn't taken for a repeat of itself, and no row is there twice after a retry."""
    keys = events.select("login_id", "client_request_id", "event_id", (F.col("created_at") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    dated = events.select(EVENT).withColumn("event_date", F.to_date("created_at"))
    for name, df, by in (("inputs", input_rows(inputs), []), ("detections", detection_rows(detections), []), ("events", dated, ["event_date"]), ("idempotency", keys, [])):
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{base}/{name}/batch={batch}")


def upsert_rules(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """stored (rule_id, origin, severity, action, enabled, archived, version) after changes (rule_id, op, severity, action). op: update,
    enable, disable or archive. Built-in rules can't be archived; each change raises the version; a change to a built-in rule that
    has no row yet makes one. One change a rule and batch."""
    c = changes.select(F.col("rule_id"), F.col("op"), F.col("severity").alias("_s"), F.col("action").alias("_a"))
    out = stored.join(c, "rule_id", "full")
    origin = F.coalesce("origin", F.when(F.startswith("rule_id", F.lit("detector:")), "built_in").otherwise("custom"))
    refused = (F.col("op") == "archive") & (origin == "built_in")
    change = F.col("op").isNotNull() & ~refused
    rows = out.where(F.col("version").isNotNull() | change)
    return rows.select(
        "rule_id",
        origin.alias("origin"),
        F.when(change, F.coalesce("_s", "severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(change, F.coalesce("_a", "action")).otherwise(F.col("action")).alias("action"),
        F.when(F.col("op") == "enable", True).when((F.col("op") == "disable") | (change & (F.col("op") == "archive")), False).otherwise(F.coalesce("enabled", F.lit(True))).alias("enabled"),
        (F.coalesce("archived", F.lit(False)) | (change & (F.col("op") == "archive"))).alias("archived"),
        (F.coalesce("version", F.lit(0)) + change.cast("int")).alias("version"),
    )


def rule_problems(kind: Column, pattern: Column, terms: Column, least: Column) -> Column:
    """What a custom rule breaks; an empty array if nothing. Patterns may not match the empty text: spans would have no length."""
    checks = [
        F.when(~kind.isin("keyword", "regex", "context"), "UNKNOWN_KIND"),
        F.when(kind.isin("keyword", "regex") & (F.coalesce(F.trim(pattern), F.lit("")) == ""), "PATTERN_MISSING"),
        F.when((kind == "context") & (F.coalesce(F.size(terms), F.lit(0)) <= 0), "TERMS_MISSING"),
        F.when((kind == "context") & ((least < 1) | (least > F.size(terms))), "CONDITION_COUNT"),
    ]
    return F.array_compact(F.array(*checks))


def audit(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """key, changed_fields (sorted) of the settings rows that differ; both tables have a column key."""
    b = before.select("key", *[F.col(c).alias(f"_{c}") for c in columns])
    changed = F.sort_array(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in columns])))
    return after.join(b, "key").select("key", changed.alias("changed_fields")).where(F.size("changed_fields") > 0)


def resolve_files(requests: DataFrame, manifest: DataFrame, now: str) -> DataFrame:
    """requests (file_ref, subject_id, request_id, session_id, scope_id) against manifest (the same, and file_kind, state, deleted_at,
    expires_at): the first reason that forbids a file, null where it may be read."""
    kinds = ["plain_text", "pdf", "image", "office_document", "spreadsheet", "slide", "code"]
    m = manifest.select("file_ref", *[F.col(c).alias(f"m_{c}") for c in manifest.columns if c != "file_ref"], F.lit(True).alias("_there"))
    out = requests.join(m, "file_ref", "left")
    scope = F.lit(True)
    for c in ("request_id", "session_id", "scope_id"):
        scope = scope & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    code = (
        F.when(F.col("_there").isNull(), "TEMP_FILE_NOT_FOUND")
        .when(~F.col("subject_id").eqNullSafe(F.col("m_subject_id")), "TEMP_FILE_OWNER_MISMATCH")
        .when(~scope, "TEMP_FILE_SCOPE_MISMATCH")
        .when(F.col("m_expires_at") <= F.lit(now).cast("timestamp"), "TEMP_FILE_EXPIRED")
        .when((F.col("m_state") != "staged") | F.col("m_deleted_at").isNotNull(), "TEMP_FILE_RESOLVE_FAILED")
        .when(~F.col("m_file_kind").isin(kinds), "UNSUPPORTED_FILE_KIND")
    )
    return out.select(*requests.columns, code.alias("failure_code"))
