"""Rules as data: the built-in catalogue, keyword, regex and context rules, scores and actions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.functions.detectors import with_detections
from sievegate.functions.scalars import ACTIONS, normalize_text, rank_of, risk_level, severity_score
from sievegate.functions.spans import each
from sievegate.operators import lexical

# Built-in detector rules (key, category, label, severity, action).
BUILT_IN = [
    ("EMAIL", "PII", "Email Address", "medium", "MASK"),
    ("PHONE", "PII", "Phone Number", "medium", "MASK"),
    ("RRN", "PII", "Resident Registration Number", "high", "MASK"),
    ("CARD", "Payment", "Card Number", "high", "MASK"),
    ("BANK_ACCOUNT", "Payment", "Korean Bank Account", "high", "MASK"),
]
# Built-in context labels (key, severity, action).
CONTEXT = [
    ("SECRET_CREDENTIAL_CONTEXT", "critical", "BLOCK"),
    ("PERSONAL_DATA_CONTEXT", "high", "WARN"),
    ("FINANCIAL_IDENTIFIER_CONTEXT", "high", "WARN"),
    ("CONFIDENTIAL_BUSINESS_CONTEXT", "critical", "BLOCK"),
    ("PROPRIETARY_TECHNICAL_CONTEXT", "critical", "BLOCK"),
    ("SECURITY_CONTROL_CONTEXT", "critical", "BLOCK"),
    ("INTERNAL_OPERATION_CONTEXT", "high", "WARN"),
    ("BULK_SENSITIVE_RECORD_CONTEXT", "critical", "BLOCK"),
]


RULE_TABLE = "pattern_id string, kind string, expression string, signal_type string, case_sensitive boolean"


def built_in_rules(spark: SparkSession) -> DataFrame:
    rows = [(f"detector:{d}", n, d, c, label, s, a) for n, (d, c, label, s, a) in enumerate(BUILT_IN)]
    return spark.createDataFrame(rows, "rule_id string, rule_order int, detector_key string, category string, label string, severity string, action string")


def merge_rules(built_in: DataFrame, stored: DataFrame, *keys: str, active_only: bool = True) -> DataFrame:
    """The rules of each catalogue (keys; without any there is one): the built-in rules (keys, rule_id, severity, action and what describes
    them), overridden by stored rows (keys, rule_id, severity, action, enabled, archived, and origin, built_in or custom, where it is
    known) of the same id where these are not null, then the custom ones. active_only: without those disabled or archived."""
    on = [*keys, "rule_id"]
    o = stored.select(*on, F.col("severity").alias("_s"), F.col("action").alias("_a"), "enabled", "archived")
    out = built_in.join(o, on, "left").withColumns({"severity": F.coalesce("_s", "severity"), "action": F.coalesce("_a", "action"), "origin": F.lit("built_in")}).drop("_s", "_a")
    if "origin" in stored.columns:
        custom = stored.where("origin = 'custom'").select(*on, "severity", "action", "enabled", "archived", "origin")
        out = out.unionByName(custom, allowMissingColumns=True)
    out = out.withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "archived": F.coalesce("archived", F.lit(False))})
    return out.where("enabled AND NOT archived") if active_only else out


def detector_matches(df: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """A row for each input and detector rule that fires: keys, the rule's columns and count. The catalogue has a few rows."""
    found = each(with_detections(df), list(keys), "detections", "d").groupBy(*keys, F.col("d.detector_key").alias("detector_key")).agg(F.count("*").alias("count"))
    return found.join(F.broadcast(rules), "detector_key")


def keyword_matches(df: DataFrame, keywords: dict[str, str], *keys: str) -> DataFrame:
    """keys, rule_id, count of each keyword rule (rule_id: keyword) that occurs in the normalised text, case folded."""
    import re

    text = normalize_text(F.coalesce("text", F.lit("")))
    counts = [F.struct(F.lit(r).alias("rule_id"), F.size(F.regexp_extract_all("_n", F.lit("(?iu)" + re.sub(r"([^\w\s])", r"\\\1", w)), F.lit(0))).cast("long").alias("count")) for r, w in keywords.items()]
    return df.withColumn("_n", text).select(*keys, F.explode(F.array(*counts)).alias("x")).select(*keys, "x.*").where("count > 0")


def regex_matches(df: DataFrame, patterns: dict[str, str], key: str, text: str = "text") -> DataFrame:
    """key, rule_id, match_count, value_lengths (of each match in the text itself, in order), confidence of the regex rules that match
    the normalised text without regard to case. A pattern that does not compile never matches: ``lexical.warnings`` tells of it."""
    table = df.sparkSession.createDataFrame([(rule, "regex", p, "regex", False) for rule, p in patterns.items()], RULE_TABLE)
    found = lexical.scan(df.select(key, F.col(text).alias("text")), table, [key]).where("start IS NOT NULL")
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: x["end"] - x["start"])
    per = found.groupBy(key, F.col("pattern_id").alias("rule_id")).agg(F.count("*").alias("match_count"), lengths.alias("value_lengths"))
    return per.select(key, "rule_id", "match_count", "value_lengths", F.lit(90).alias("confidence"))


def context_matches(df: DataFrame, rules: dict[str, tuple[list[str], int]], *keys: str) -> DataFrame:
    """keys, rule_id, n_conditions of each context rule (rule_id: terms, least number of them) that fires."""
    text = F.lower(normalize_text(F.coalesce("text", F.lit(""))))
    counts = [F.struct(F.lit(r).alias("rule_id"), sum((F.contains(F.col("_n"), F.lit(t.lower())).cast("long") for t in terms), F.lit(0).cast("long")).alias("n_conditions"), F.lit(least).alias("_least")) for r, (terms, least) in rules.items()]
    return df.withColumn("_n", text).select(*keys, F.explode(F.array(*counts)).alias("x")).select(*keys, "x.*").where("n_conditions >= _least").drop("_least")


def decide(inputs: DataFrame, matches: DataFrame, *keys: str) -> DataFrame:
    """Per input: matched, match_count, action, risk_score, risk_level. Inputs without a match are allowed."""
    best = matches.groupBy(*keys).agg(F.sum("count").alias("match_count"), F.max(severity_score(F.col("severity"))).alias("risk_score"), F.max_by("action", rank_of(F.col("action"), ACTIONS)).alias("action"))
    out = inputs.select(*keys).join(best, list(keys), "left")
    score = F.coalesce("risk_score", F.lit(0))
    return out.select(*keys, F.col("match_count").isNotNull().alias("matched"), F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"), F.coalesce("action", F.lit("ALLOW")).alias("action"), score.alias("risk_score"), risk_level(score).alias("risk_level"))


class Rule(NamedTuple):
    """A rule of a catalogue. kind: detector, keyword, regex or context_rule; expression: the key, word or pattern; terms, least: of contexts;
    touching: of addresses, also those that stand in a longer run of their own characters."""

    rule_id: str
    kind: str
    origin: str
    label: str
    severity: str
    action: str
    expression: str = ""
    terms: tuple[str, ...] = ()
    least: int = 1
    enabled: bool = True
    archived: bool = False
    category: str = "Custom"
    placeholder: str = ""
    touching: bool = False


SOURCES = {"detector": "built_in_detector", "keyword": "custom_keyword", "regex": "custom_regex", "context_rule": "custom_context_rule"}
NAMELESS = {"keyword": "CUSTOM_KEYWORD", "regex": "CUSTOM_REGEX", "context_rule": "CONTEXT_RULE"}
CONFIDENCE = {"detector": 100, "keyword": 90, "regex": 90, "context_rule": 80}


def reason_code(rule: Rule) -> str:
    name = (rule.expression if rule.kind == "detector" else "") or rule.label
    return f"{'BUILT_IN' if rule.origin == 'built_in' else 'CUSTOM'}_{rule.kind}_{name}".upper().replace(" ", "_")


def all_matches(df: DataFrame, catalogue: list[Rule], key: str) -> DataFrame:
    """key, place, rule_id, kind, count, confidence, reason_code, severity, action of every rule that is enabled, not archived, and
    matches: detectors first, the others in their order. The catalogue is a short list; df has key and text."""
    used = sorted((r for r in catalogue if r.enabled and not r.archived and r.origin in ("built_in", "custom")), key=lambda r: r.kind != "detector")
    of = lambda kind: [r for r in used if r.kind == kind and (r.expression or r.terms)]
    df = df.select(key, "text")
    parts = [df.sparkSession.createDataFrame([], df.select(key).schema.add("rule_id", "string").add("count", "long"))]
    if detectors := {r.expression: r.rule_id for r in of("detector")}:
        found = each(with_detections(df, keys=list(detectors), touching=[r.expression for r in of("detector") if r.touching]), [key], "detections", "d")
        names = F.create_map(*[F.lit(x) for pair in detectors.items() for x in pair])
        parts.append(found.groupBy(key, names[F.col("d.detector_key")].alias("rule_id")).agg(F.count("*").alias("count")))
    if words := {r.rule_id: r.expression for r in of("keyword")}:
        parts.append(keyword_matches(df, words, key))
    if patterns := {r.rule_id: r.expression for r in of("regex")}:
        parts.append(regex_matches(df, patterns, key).select(key, "rule_id", F.col("match_count").alias("count")))
    if contexts := {r.rule_id: (list(r.terms), r.least) for r in of("context_rule")}:
        parts.append(context_matches(df, contexts, key).select(key, "rule_id", F.col("n_conditions").alias("count")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    about = [(r.rule_id, n, r.kind, CONFIDENCE[r.kind], reason_code(r), r.severity, r.action) for n, r in enumerate(used) if r.kind in CONFIDENCE]
    columns = "rule_id string, place int, kind string, confidence int, reason_code string, severity string, action string"
    return out.join(df.sparkSession.createDataFrame(about, columns), "rule_id").select(key, "place", "rule_id", "kind", "count", "confidence", "reason_code", "severity", "action")


def match_type(rule: Rule) -> str:
    return rule.expression if rule.kind == "detector" else rule.placeholder or NAMELESS[rule.kind]


def about(spark: SparkSession, catalogue: list[Rule]) -> DataFrame:
    """rule_id, category, type, source, detector_id of each rule: what a match of it says of itself."""
    rows = [(r.rule_id, r.category, match_type(r), SOURCES[r.kind], match_type(r)) for r in catalogue if r.kind in SOURCES]
    return spark.createDataFrame(rows, "rule_id string, category string, type string, source string, detector_id string")


def masking_spans(df: DataFrame, catalogue: list[Rule], key: str) -> DataFrame:
    """key, start, end, detector_key (the placeholder) of all that the rules whose action is MASK match in df (key, text). Context rules
    have no places."""
    used = [r for r in catalogue if r.enabled and not r.archived and r.action == "MASK" and r.expression]
    df = df.select(key, "text")
    out = df.select(key).limit(0).withColumns({"start": F.lit(0), "end": F.lit(0), "detector_key": F.lit("")})
    if detectors := [r.expression for r in used if r.kind == "detector"]:
        found = with_detections(df, keys=detectors, touching=[r.expression for r in used if r.kind == "detector" and r.touching])
        out = out.unionByName(each(found, [key], "detections", "d").select(key, "d.start", "d.end", "d.detector_key"))
    if lexical_ := [(r.rule_id, r.kind, r.expression, match_type(r), False) for r in used if r.kind in ("keyword", "regex")]:
        found = lexical.scan(df, df.sparkSession.createDataFrame(lexical_, RULE_TABLE), [key]).where("start IS NOT NULL")
        out = out.unionByName(found.select(key, "start", "end", F.col("signal_type").alias("detector_key")))
    return out
