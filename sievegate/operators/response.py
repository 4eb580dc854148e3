"""From the matches of a request's inputs to its public response, and the contract that clients hold a response against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions.scalars import ACTIONS, final_score, rank_of, risk_level, severity_score
from sievegate.operators import masking, requests, rules
from sievegate.operators.inputs import bound, scan_results, stripped

# Labels and messages of actions.
PUBLIC = {"ALLOW": "Allow", "WARN": "Warn", "MASK": "Mask", "BLOCK": "Block"}
MESSAGES = {
    "MASK": "Sensitive data was detected and replaced with placeholders.",
    "WARN": "Sensitive or governed content was detected. Review before sending.",
    "BLOCK": "Sensitive or governed content was detected and should not be sent.",
}
UNSCANNED = "One or more inputs could not be scanned safely, so the send attempt was blocked."
NOTHING = "No sensitive data was detected."


def public_action(action: Column) -> Column:
    """An action that is not known is a block."""
    return F.coalesce(*[F.when(action == k, v) for k, v in PUBLIC.items()], F.lit("Block"))


def user_message(action: Column, unavailable: Column) -> Column:
    return F.coalesce(F.when((action == "BLOCK") & unavailable, UNSCANNED), *[F.when(action == k, v) for k, v in MESSAGES.items()], F.lit(NOTHING))


def allow_original_send(action: Column) -> Column:
    return F.coalesce(action.isin("ALLOW", "WARN"), F.lit(False))


def requires_confirmation(action: Column) -> Column:
    return F.coalesce(action.isin("MASK", "WARN"), F.lit(False))


def respond(inputs: DataFrame, catalogue: list[rules.Rule]) -> DataFrame:
    """A row for each request of inputs (request_id, input_id, input_index, kind, source, content_included, content, unavailable_reason,
    limit_exceeded): action, risk_score, risk_level, user_message, the flags, the lists detections, input_results,
    content_unavailable_inputs and business_context_matches, masked_prompt and how often each placeholder stands in it.

    The highest action of all matches wins. Text is masked only where that is MASK, only in the first composer input with a match,
    and only what rules whose own action is MASK matched. Lists are in order of input, then of the rules; a request has up to 20
    inputs. A null content is not scanned."""
    spark = inputs.sparkSession
    keyed = inputs.withColumn("_key", F.struct("request_id", "input_index"))
    texts = keyed.where(F.col("content_included") & F.col("content").isNotNull()).select("_key", F.col("content").alias("text"))
    matches = rules.all_matches(texts, catalogue, "_key").join(F.broadcast(rules.about(spark, catalogue)), "rule_id")  # a row a rule
    per_input = matches.groupBy("_key").agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_list(F.struct("place", "rule_id", "category", "type", "source", "detector_id", "severity", "action", "confidence", "reason_code", "count"))).alias("found"))
    scanned = scan_results(keyed.join(per_input, "_key", "left").withColumns({"n_matches": F.coalesce("n_matches", F.lit(0)), "parse_status": F.lit(None).cast("string")}))
    one = lambda name, *more: F.struct("input_id", "input_index", "kind", "source", *more).alias(name)
    basis, limit = F.col("decision_basis"), F.col("limit_exceeded")
    unread = ~F.col("content_scanned") & basis.isin("content_unavailable", "metadata_only")
    reason = F.coalesce("unavailable_reason", F.when(F.col("kind") == "attachment_metadata", "metadata_only").otherwise("unavailable"))
    of = lambda m: F.struct(F.col("input_id"), F.col("input_index"), F.col("kind"), m["category"].alias("category"), m["type"].alias("type"), F.col("source"), m["rule_id"].alias("rule_id"), m["detector_id"].alias("detector_id"), m["severity"].alias("severity"), public_action(m["action"]).alias("action"), m["type"].alias("placeholder"), m["confidence"].alias("confidence"), m["reason_code"].alias("reason_code"), m["count"].alias("match_count"))
    context = lambda m: F.struct(F.col("input_id"), F.col("input_index"), F.col("kind"), F.col("source"), m["category"].alias("category"), m["reason_code"].alias("reason_code"), m["count"].alias("match_count"), F.array().cast("array<string>").alias("matched_keywords"), F.create_map(F.lit("matched_condition_count"), m["count"]).alias("evidence_counts"))
    rows = scanned.select(
        "request_id", "input_index", one("result", "content_included", "content_scanned", basis.alias("decision_basis"), F.col("unavailable_reason").alias("content_unavailable_reason"), limit.alias("limit_exceeded")),
        F.when(unread, F.struct("input_id", "input_index", "kind", "source", reason.alias("reason"), limit.alias("limit_exceeded"))).alias("unread"), F.transform("found", of).alias("detections"), F.transform(F.filter("found", lambda m: m["source"] == "custom_context_rule"), context).alias("contexts"),
        F.array_max(F.transform("found", lambda m: F.struct(rank_of(m["action"], ACTIONS).alias("r"), m["action"].alias("action")))).alias("best"), F.array_max(F.transform("found", lambda m: severity_score(m["severity"]))).alias("score"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("input_index", F.col(c).alias("x")))), lambda a, b: a["input_index"] - b["input_index"]), lambda y: y["x"])
    request = rows.groupBy("request_id").agg(
        F.coalesce(F.max("best")["action"], F.lit("ALLOW")).alias("decided"), F.coalesce(F.max("score"), F.lit(0)).alias("score"), F.flatten(listed("detections")).alias("detections"), listed("result").alias("input_results"),
        listed("unread").alias("content_unavailable_inputs"), F.flatten(listed("contexts")).alias("business_context_matches"))
    first = requests.first_composer(scanned, "request_id").join(request.where("decided = 'MASK'").select("request_id"), "request_id", "left_semi")
    target = texts.join(first.select(F.struct("request_id", "input_index").alias("_key")), "_key", "left_semi")
    spans = rules.masking_spans(target, catalogue, "_key").groupBy("_key").agg(F.collect_list(F.struct("start", "end", "detector_key")).alias("spans"))
    masked = target.join(spans, "_key").select(F.col("_key.request_id").alias("request_id"), masking.placeholders(F.col("text"), F.col("spans")).alias("m"))
    masked = masked.select("request_id", F.col("m.masked_text").alias("masked_prompt"), F.col("m.counts").alias("placeholder_counts"))
    action, risk = F.col("decided"), final_score(F.col("score"), F.col("decided"))
    out = request.join(masked, "request_id", "left")
    return out.select(
        "request_id", public_action(action).alias("action"), risk.alias("risk_score"), risk_level(risk).alias("risk_level"), user_message(action, F.size("content_unavailable_inputs") > 0).alias("user_message"), allow_original_send(action).alias("allow_original_send"),
        requires_confirmation(action).alias("requires_user_confirmation"), "detections", "input_results", "content_unavailable_inputs", "business_context_matches", "masked_prompt", "placeholder_counts")


# The fields of a response. Words with ? may be missing, with ~ null.
BASES = ["no_detection", "detection", "content_unavailable", "metadata_only", "context_risk"]
ENUMS = {"action": list(PUBLIC.values()), "level": ["low", "medium", "high", "critical"], "basis": BASES, "status": ["disabled", "no_candidate", "candidate", "verified", "timeout", "failed"]}
INPUT = {"input_id": "text", "input_index": "number", "kind": "text", "source": "text"}
CONTRACT = {
    "": {
        "event_id": "text", "request_id": "text", "action": "action", "checked_at": "text", "risk_score": "number", "risk_level": "level", "user_message": "string", "allow_original_send": "boolean", "requires_user_confirmation": "boolean",
        "client_request_id": "text", "filter_config_revision": "text",
    },
    "detections": {"input_id": "text", "input_index": "number", "kind": "text", "category": "text", "type": "text", "source": "text", "rule_id": "string~", "detector_id": "string~", "severity": "text", "action": "action", "placeholder": "text", "confidence": "number", "reason_code": "text", "match_count": "number"},
    "input_results": INPUT | {"content_included": "boolean", "content_scanned": "boolean", "decision_basis": "basis", "content_unavailable_reason": "text?", "limit_exceeded": "text?"},
    "content_unavailable_inputs": INPUT | {"reason": "text", "limit_exceeded": "text?"},
    "business_context_matches": INPUT | {"category": "text", "reason_code": "text", "match_count": "number", "matched_keywords": "array", "evidence_counts": "record"},
    "context_risk_evidence": {
        "enabled": "boolean", "status": "status", "candidate_count": "number", "accepted_count": "number", "labels": "strings", "status_counts": "record", "highest_score_bucket": "text?~", "highest_confidence_bucket": "text?~", "failure_code": "text?~", "reason_code": "text",
        "classifier_model_versions": "strings", "verifier_model_versions": "strings",
    },
}
LISTS = ["detections", "input_results", "content_unavailable_inputs", "business_context_matches"]


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _fits(value: Column, word: str) -> Column:
    """Whether a variant (null: missing) is what a word of the contract says."""
    name, kind = word.rstrip("?~"), _kind(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    if name in ENUMS:
        ok = (kind == "STRING") & text.isin(ENUMS[name])
    elif name == "text":
        ok = (kind == "STRING") & (stripped(text) != "")
    elif name == "number":
        ok = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (number >= 0) & (number < float("inf"))
    elif name == "record":
        ok = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    elif name == "array":
        ok = kind.startswith("ARRAY")
    elif name == "strings":
        ok = kind.startswith("ARRAY") & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False)))
    else:
        ok = kind == {"string": "STRING", "boolean": "BOOLEAN"}[name]
    ok = F.coalesce(ok, F.lit(False))
    if "?" in word:
        ok = ok | value.isNull()
    return ok | F.coalesce(kind == "VOID", F.lit(False)) if "~" in word else ok


def _broken(record: Column, fields: dict[str, str], prefix: Column) -> Column:
    """The paths of the fields that do not fit; the record's own path if it is none."""
    bad = [F.when(~_fits(F.try_variant_get(record, f"$.{name}", "variant"), word), F.concat(prefix, F.lit(name))) for name, word in fields.items()]
    isa = F.coalesce(_kind(record).startswith("OBJECT") | _kind(record).startswith("ARRAY"), F.lit(False))
    return F.when(isa, F.array_compact(F.array(*bad))).otherwise(F.array(F.regexp_replace(prefix, r"\.$", "")))


def _item(name: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: _broken(x, CONTRACT[name], F.concat(F.lit(f"{name}["), i, F.lit("].")))


def response_violations(text: Column) -> Column:
    """The paths of a response (a JSON text) that break the contract, in its order; an empty array if it may be acted on. What is no
    JSON object at all, and null, break it at $."""
    return bound(F.try_parse_json(text), _violations)


def _violations(body: Column) -> Column:
    parts = [_broken(body, CONTRACT[""], F.lit(""))]
    at = lambda name: F.try_variant_get(body, f"$.{name}", "variant")
    masked = (F.try_variant_get(body, "$.action", "string") == "Mask") & ~F.coalesce(_kind(at("masked_prompt")) == "STRING", F.lit(False))
    parts.append(F.when(masked, F.array(F.lit("masked_prompt"))))
    for name in LISTS:
        is_list = F.coalesce(_kind(at(name)).startswith("ARRAY"), F.lit(False))
        items = F.try_variant_get(body, f"$.{name}", "array<variant>")
        each = F.flatten(F.transform(items, _item(name)))
        parts.append(F.when(is_list, each).otherwise(F.array(F.lit(name))))
    risk = at("context_risk_evidence")
    parts.append(F.when(risk.isNotNull() & (_kind(risk) != "VOID"), _broken(risk, CONTRACT["context_risk_evidence"], F.lit("context_risk_evidence."))))
    none = F.array().cast("array<string>")
    whole = F.flatten(F.array(*[F.coalesce(p, none) for p in parts]))
    return F.when(F.coalesce(_kind(body).startswith("OBJECT"), F.lit(False)), whole).otherwise(F.array(F.lit("$")))
