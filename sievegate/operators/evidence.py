"""What the model cascade found, summed to a request: candidates, verifications, status, and the rules that labels set off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.operators.policy import severity_for

# Words of label groups, statuses of verifications.
LABEL_WORDS = {
    "risk": ["secret", "credential", "token", "key", "password", "private"],
    "suppressor": ["safe", "synthetic", "dummy", "example", "test"],
    "code": ["code", "source", "repository", "snippet"],
    "pii_relevance": ["pii", "personal", "email", "phone", "ssn", "rrn"],
}
STATUSES = ["confirmed", "rejected", "uncertain", "timeout", "failed"]


def bucket(score: Column, very_high: float) -> Column:
    return F.when(score >= very_high, "very_high").when(score >= 0.75, "high").when(score.isNotNull(), "candidate")


def label_group(label: Column) -> Column:
    """The first group of which a word is in the label; other if none."""
    groups = [F.when(F.lower(label).rlike("|".join(words)), group) for group, words in LABEL_WORDS.items()]
    return F.coalesce(*groups, F.lit("other"))


def classified(candidates: DataFrame, *keys: str) -> DataFrame:
    """candidates (keys, label, score): candidate_count, highest_score_bucket and a count for each group of labels."""
    group = label_group(F.col("label"))
    counts = [F.count_if(group == g).alias(g) for g in [*LABEL_WORDS, "other"]]
    return candidates.groupBy(*keys).agg(F.count("*").alias("candidate_count"), bucket(F.max("score"), 0.9).alias("highest_score_bucket"), *counts)


def verified(verifications: DataFrame, *keys: str) -> DataFrame:
    """verifications (keys, label, status, accepted, confidence): accepted_count, counts of statuses, accepted labels in order, and
    the bucket of the highest confidence (null where there is none)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    labels = F.sort_array(F.collect_set(F.when(F.col("accepted"), F.col("label"))))
    return verifications.groupBy(*keys).agg(F.count_if("accepted").alias("accepted_count"), *counts, labels.alias("labels"), bucket(F.max("confidence"), 0.95).alias("highest_confidence_bucket"))


def context(requests: DataFrame, candidates: DataFrame, verifications: DataFrame, failures: DataFrame) -> DataFrame:
    """requests (request_id), candidates and verifications by request, failures (request_id, input_index, failure_code): one row of
    context evidence for each request. A failure outweighs what was found; else accepted labels, else candidates."""
    failed = failures.groupBy("request_id").agg(F.min_by("failure_code", "input_index").alias("failure_code"))
    out = requests
    for part in (classified(candidates, "request_id").select("request_id", "candidate_count", "highest_score_bucket"), verified(verifications, "request_id"), failed):
        out = out.join(part, "request_id", "left")
    out = out.na.fill(0, ["candidate_count", "accepted_count", *STATUSES]).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    code = F.col("failure_code")
    ladder = [
        (F.upper(code).contains("TIMEOUT"), "timeout", "RISK_CONTEXT_LR_ONLY_VERIFIER_TIMEOUT"),
        (code.isNotNull(), "failed", "RISK_CONTEXT_LR_ONLY_VERIFIER_FAILED"),
        (F.col("accepted_count") > 0, "verified", "RISK_CONTEXT_VERIFIER_CONFIRMED"),
        ((F.col("candidate_count") > 0) & (F.col("uncertain") > 0), "candidate", "RISK_CONTEXT_VERIFIER_UNCERTAIN"),
        (F.col("candidate_count") > 0, "candidate", "RISK_CONTEXT_LR_ONLY"),
    ]
    first = lambda k, rest: F.coalesce(*[F.when(step[0], step[k]) for step in ladder], F.lit(rest))
    return out.withColumns({"status": first(1, "no_candidate"), "reason_code": first(2, "NO_RISK_DETECTED")})


def label_rules(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Evidence (request_id, ord, action, severity, reason, masking_supported) of labels of context() that a rule (detector_key,
    severity, action) is for. Context can't be masked, so such a rule blocks. The catalogue has a few rows."""
    labels = found.where(F.col("status").isin("verified", "candidate")).select("request_id", "reason_code", F.posexplode("labels").alias("ord", "detector_key"))
    action = F.lower("action")
    return labels.join(F.broadcast(rules), "detector_key").select("request_id", "ord", F.when(action == "mask", "block").otherwise(action).alias("action"), "severity", F.col("reason_code").alias("reason"), F.lit(False).alias("masking_supported"))


def codes(inputs: DataFrame) -> DataFrame:
    """inputs (request_id, input_index, kind, content_included, unavailable_reason, parse_status, failure_code): the request's distinct
    evidence codes, in the order of its inputs."""
    status, out = F.coalesce("parse_status", F.lit("")), F.lit(None).cast("string")
    unsupported = (F.col("kind") == "unsupported_attachment") | (F.coalesce("unavailable_reason", F.lit("")) == "unsupported")
    out = F.when(F.col("failure_code").isNotNull() | status.isin("failed", "timeout", "too_large", "encrypted"), "PARSER_OR_OCR_FAILED").when(status == "parsed", out).when(unsupported, "UNSUPPORTED_FILE").when(~F.col("content_included"), "CONTENT_NOT_SCANNED")
    per_code = inputs.select("request_id", "input_index", out.alias("code")).where("code IS NOT NULL").groupBy("request_id", "code").agg(F.min("input_index").alias("at"))
    return per_code.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"))


def failure_rules(requests: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """requests (request_id, codes, all_scanned): evidence of parser failures and of content that was not scanned, after all rules.
    Without settings, the columns of requests with their names hold the actions."""
    codes_ = F.coalesce("codes", F.array().cast("array<string>"))
    unscanned = ~F.col("all_scanned") | F.array_contains(codes_, "CONTENT_NOT_SCANNED") | F.array_contains(codes_, "UNSUPPORTED_FILE")
    cases = [(F.array_contains(codes_, "PARSER_OR_OCR_FAILED"), "parser_or_ocr_failure_action", "PARSER_OR_OCR_FAILED"), (unscanned, "content_not_scanned_action", "CONTENT_NOT_SCANNED")]
    rows = F.array_compact(F.array(*[F.when(when, F.struct(F.lit((1 << 20) + n).alias("ord"), (F.lit(settings[key]) if settings else F.col(key)).alias("action"), F.lit(reason).alias("reason"))) for n, (when, key, reason) in enumerate(cases)]))
    return requests.select("request_id", F.explode(rows).alias("r")).select("request_id", "r.ord", "r.action", severity_for(F.col("r.action")).alias("severity"), "r.reason", F.lit(False).alias("masking_supported"))


def upgraded_basis(inputs: DataFrame, decided: DataFrame) -> DataFrame:
    """inputs (request_id, content_scanned, decision_basis) of decided (request_id, reason_code, status, accepted_count): a scanned input
    without a detection rests on its context where verified context made the decision."""
    by_context = F.startswith(F.col("reason_code"), F.lit("RISK_CONTEXT_")) & (F.col("status") == "verified") & (F.col("accepted_count") > 0)
    up = F.coalesce(by_context, F.lit(False)) & F.col("content_scanned") & (F.col("decision_basis") == "no_detection")
    return inputs.join(decided.select("request_id", "reason_code", "status", "accepted_count"), "request_id", "left").withColumn("decision_basis", F.when(up, "context_risk").otherwise(F.col("decision_basis"))).select(*inputs.columns)
