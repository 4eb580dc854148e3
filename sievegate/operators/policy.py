"""One decision per request from all of its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions.scalars import SEVERITIES, rank_of

# Order of the policy's own actions.
POLICY_ACTIONS = ["allow", "warn", "mask", "block"]


def severity_for(action: Column) -> Column:
    return F.when(action == "block", "high").when(action == "warn", "medium").otherwise("info")


def safe_reason(category: Column) -> Column:
    up = F.upper(category)
    return F.when(up.contains("PII") | up.contains("PAYMENT"), "HIGH_RISK_PII").when(up.contains("SECRET") | up.contains("CREDENTIAL"), "SECRET_DETECTED").otherwise("UNMAPPED_RULE")


# Actions where no setting is stored.
SETTINGS = {"context_classifier_action": "warn", "content_not_scanned_action": "warn", "parser_or_ocr_failure_action": "warn", "empty_input_action": "allow", "unsupported_mask_fallback_action": "block"}


def stored_settings(scopes: DataFrame, rows: DataFrame) -> DataFrame:
    """The settings of every scope (the columns of scopes): those of its row in rows (these columns and the ones of SETTINGS) in lower
    case, and of SETTINGS where it has no row or a null."""
    on = scopes.columns
    return scopes.join(rows.select(*on, *SETTINGS), on, "left").select(*on, *[F.coalesce(F.lower(k), F.lit(v)).alias(k) for k, v in SETTINGS.items()])


def decide_requests(requests: DataFrame, evidence: DataFrame, settings: dict[str, str] | DataFrame | None = None, context: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """requests (request_id, n_inputs); evidence and failures (request_id, ord, action, severity, reason, masking_supported); context
    (request_id, status, accepted_count, candidate_count, reason_code); settings override SETTINGS, in any case. As a table
    (``stored_settings``) they hold for the requests with the same scope, so requests carry its columns.

    The highest action wins, then the highest severity, then the first in order; failures come last. A winning mask becomes the
    fallback if any mask of the request's rules is unsupported. Where nothing or only an allowing rule won, verified context, or
    candidates that the verifier failed on, take the context action; then an empty request its own."""
    if isinstance(settings, DataFrame):
        requests = requests.join(settings, [c for c in settings.columns if c not in SETTINGS], "left")
        use = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in SETTINGS.items()}
    else:
        use = {k: F.lit(v) for k, v in (SETTINGS | {k: v.lower() for k, v in (settings or {}).items() if v}).items()}
    columns = ["request_id", "ord", "action", "severity", "reason", "masking_supported"]
    rules = evidence.select(*columns, F.lit(True).alias("_rule"))
    if failures is not None:
        rules = rules.unionByName(failures.select(*columns, F.lit(False).alias("_rule")))
    order = F.struct(rank_of(F.col("action"), POLICY_ACTIONS), rank_of(F.col("severity"), SEVERITIES), -F.col("ord"))
    unsupported = F.coalesce(F.bool_or((F.col("action") == "mask") & ~F.col("masking_supported") & F.col("_rule")), F.lit(False))
    won = rules.groupBy("request_id").agg(F.max_by(F.struct("action", "severity", "reason"), order).alias("w"), unsupported.alias("unsupported"))
    out = requests.join(won, "request_id", "left")
    if context is None:
        out = out.withColumns({"c_counts": F.lit(False), "c_reason": F.lit(None).cast("string")})
    else:
        counts = ((F.col("status") == "verified") & (F.col("accepted_count") > 0)) | (F.col("status").isin("timeout", "failed") & (F.col("candidate_count") + F.col("accepted_count") > 0))
        out = out.join(context.select("request_id", counts.alias("c_counts"), F.col("reason_code").alias("c_reason")), "request_id", "left").na.fill(False, ["c_counts"])
    falls = (F.col("w.action") == "mask") & F.col("unsupported")
    nothing = F.col("w").isNull()
    empty = nothing & (F.col("n_inputs") == 0)
    by_context = F.col("c_counts") & ~empty & (nothing | (F.col("w.action") == "allow"))

    def chosen(set_: Column, reason: Column) -> Column:
        return F.struct(set_.alias("action"), reason.alias("reason_code"), severity_for(set_).alias("severity"))

    decision = (
        F.when(empty, chosen(use["empty_input_action"], F.lit("EMPTY_INPUT")))
        .when(by_context, chosen(use["context_classifier_action"], F.col("c_reason")))
        .when(nothing, chosen(F.lit("allow"), F.lit("NO_RISK_DETECTED")))
        .when(falls, chosen(use["unsupported_mask_fallback_action"], F.col("w.reason")))
        .otherwise(F.struct(F.col("w.action").alias("action"), F.col("w.reason").alias("reason_code"), F.col("w.severity").alias("severity")))
    )
    return out.select("request_id", decision.alias("d")).select("request_id", "d.*")


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Idempotency inside a batch: the first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def file_policy(files: DataFrame, max_count: int, max_total: int, max_file: int, allowed: list[str], excluded: list[str]) -> DataFrame:
    """Files (batch_id, name, size): the first reason that forbids a file; conditions of a batch hold for all of its files."""
    totals = files.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    reason = F.when(F.col("n") > max_count, "TOO_MANY_FILES").when(F.col("total") > max_total, "BATCH_TOO_LARGE").when(F.col("size") > max_file, "FILE_TOO_LARGE").when(ext.isin(excluded), "EXCLUDED_EXTENSION").when(~ext.isin(allowed), "UNSUPPORTED_EXTENSION")
    return files.join(totals, "batch_id").select("batch_id", "name", ext.alias("extension"), reason.alias("reason"), reason.isNull().alias("allowed"))
