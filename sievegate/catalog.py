"""Registered queries and their SQL, but for those of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import scalars
from sievegate.functions.detectors import SECRET, with_detections
from sievegate.functions.spans import at, each, spans
from sievegate.operators import analytics, inputs, masking, policy, rules, segments
from sievegate.plans import cascade, client, dashboards, guards, intake, parsing, responses, scanning
from sievegate.plans import files as file_plans
from sievegate.sources import files, views
from sievegate.streaming import limits

FLAGSHIP = "dryrun_conversations"
AS_OF, DAYS = "2024-01-20", 14
KEYWORDS = {"kw-the": "the", "kw-and": "und", "kw-stop": "the."}
TOKEN = r'(?i)\btoken\s*=\s*"[0-9a-f]{32,}"'
CONTEXTS = {"ctx-en": (["the", "and", "tion"], 2), "ctx-de": (["der", "die", "und"], 3), "ctx-es": (["los", "que", "ción"], 2)}
WEIGHTS = {label: [((3 * k + 7 * n) % 11 - 5) / 2 for k in range(64)] for n, label in enumerate(["risk", "code", "other"])}


def _docs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text")


def _dry_run(df, key):
    matches = rules.detector_matches(df, rules.built_in_rules(df.sparkSession), key)
    return rules.decide(df, matches, key)


def dryrun_documents(spark, d):
    return _dry_run(_docs(spark, d), "doc_id")


def dryrun_conversations(spark, d):
    turns = views.requests(spark, d).select(F.concat_ws(":", "request_id", "input_index").alias("turn_id"), F.col("content").alias("text"))
    return _dry_run(turns, "turn_id")


def detect_email_counts(spark, d):
    found = with_detections(_docs(spark, d), keys=["EMAIL"], touching=["EMAIL"]).select("doc_id", F.size("detections").cast("long").alias("n"))
    return found.where("n > 0")


def pii_union_sorted(spark, d):
    found = each(with_detections(_docs(spark, d)), ["doc_id"], "detections", "d", "place")
    return found.select("doc_id", "place", "d.detector_key", "d.start", "d.end")


def detect_samples(spark, d):
    """Numbers of Korean formats, which the texts of the tables have none of, made of the keys of customers: phones, an account with and
    without its context, a card with and without a right check digit."""
    n = F.col("c_custkey")
    digits = lambda k, size: F.lpad((k % 10**size).cast("string"), size, "0")
    card = F.concat(F.lit("4111 1111 1111 "), digits(n, 4))
    texts = [
        F.concat(F.lit("연락처 010-"), digits(n * 7 + 1234, 4), F.lit("-"), digits(n * 13, 4), F.lit(", +82 10 9876 "), digits(n, 4)),
        F.concat(F.lit("국민은행 123-456-78"), digits(n, 4), F.lit(" 로 보내주세요")), F.concat(F.lit("계약 번호 123-456-78"), digits(n, 4)), F.concat(F.lit("pay "), card, F.lit(" now")), F.concat(F.lit("mail u"), n, F.lit(".b+c@mail.example.com. or x@y")),
    ]
    rows = views.table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*texts), (n % len(texts) + 1).cast("int")).alias("text"))
    found = each(with_detections(rows), ["c_custkey", "text"], "detections", "d")
    return found.select("c_custkey", "d.detector_key", "d.start", "d.end", F.length(at(F.col("text"), F.col("d"))).alias("value_length"))


def mask_documents(spark, d):
    out = masking.masked(with_detections(_docs(spark, d).where("text IS NOT NULL")))
    return out.select("doc_id", "n_masked", F.sha2("masked_text", 256).alias("masked_sha256"))


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.length(scalars.normalize_text(F.col("text"))).alias("n_chars"), F.sha2(scalars.normalize_text(F.col("text")), 256).alias("sha256"))


def rule_keyword_matches(spark, d):
    return rules.keyword_matches(_docs(spark, d), KEYWORDS, "doc_id").select("doc_id", "rule_id")


def rule_context_matches(spark, d):
    return rules.context_matches(_docs(spark, d), CONTEXTS, "doc_id")


def _tenant_rules(spark, d):
    """The built-in rules of every nation's catalogue."""
    each_rule = F.explode(F.array(*[F.struct(F.lit(f"detector:{k}").alias("rule_id"), F.lit(severity).alias("severity"), F.lit(action).alias("action")) for k, _, _, severity, action in rules.BUILT_IN]))
    return views.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("tenant"), each_rule.alias("r")).select("tenant", "r.*")


def rule_catalogue_merge(spark, d):
    return rules.merge_rules(_tenant_rules(spark, d), views.stored_rules(spark, d), "tenant").select("tenant", "rule_id", "origin", "severity", "action")


def rule_catalogue_manageable(spark, d):
    """What administrators see: also what is disabled or archived."""
    return rules.merge_rules(_tenant_rules(spark, d), views.stored_rules(spark, d), "tenant", active_only=False).select("tenant", "rule_id", "severity", "action", "enabled", "archived")


def _evidence(spark, d):
    """Evidence of v_inputs: detections mark their event's inputs by category."""
    ins = views.inputs(spark, d)
    det = views.detections(spark, d)
    rows = det.join(ins, "event_id").select(F.col("event_id").alias("request_id"), F.col("input_index"), "category", "type", "source")
    action = F.when(F.col("category") == "Secret", "block").when(F.col("category") == "Payment", "mask").when(F.col("category") == "PII", "mask").otherwise("warn")
    severity = F.when(F.col("category") == "Secret", "critical").when(F.col("category") == "Custom", "medium").otherwise("high")
    order = F.col("input_index") * 2 + F.when(F.col("type") == "PHONE", 1).otherwise(0)
    return rows.select("request_id", order.alias("ord"), action.alias("action"), severity.alias("severity"), policy.safe_reason(F.col("category")).alias("reason"), (F.col("source") == "composer").alias("masking_supported"))


def policy_decide_requests(spark, d):
    requests = views.inputs(spark, d).groupBy(F.col("event_id").alias("request_id")).agg(F.count("*").alias("n_inputs"))
    return policy.decide_requests(requests, _evidence(spark, d))


def idempotent_requests(spark, d):
    rows = views.events(spark, d).select("login_id", (F.col("id") % 97).alias("client_request_id"), "id", "created_at")
    return policy.first_of_key(rows, ["login_id", "client_request_id"], ["created_at", "id"]).select("login_id", "client_request_id", "id")


def size_buckets(spark, d):
    n = F.octet_length(F.coalesce("html", F.lit("")))
    return views.table(spark, d, "pages").select("page_id", n.alias("size_bytes"), scalars.size_bucket(n).alias("size_bucket"), scalars.length_bucket(n).alias("length_bucket"))


def file_policy(spark, d):
    rows = views.table(spark, d, "pages").select((F.col("page_id") % 40).alias("batch_id"), F.concat(F.lit("page-"), F.col("page_id"), F.element_at(F.array(*map(F.lit, [".HTML", ".txt", ".exe", ".bin"])), (F.col("page_id") % 4 + 1).cast("int"))).alias("name"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    return policy.file_policy(rows, 10_000, 1 << 40, 5000, ["html", "txt"], ["exe"])


def _window(spark, d):
    return analytics.window(views.events(spark, d), AS_OF, DAYS)


def event_stats_daily(spark, d):
    return analytics.daily(views.events(spark, d), AS_OF, DAYS)


def event_stats_totals(spark, d):
    return analytics.totals(_window(spark, d))


def event_stats_actions(spark, d):
    return analytics.distribution(_window(spark, d), "action")


def event_stats_risk(spark, d):
    return analytics.distribution(_window(spark, d), "risk_level")


def event_stats_detection_types(spark, d):
    return analytics.detection_distribution(_window(spark, d), views.detections(spark, d), "type")


def event_stats_categories(spark, d):
    return analytics.detection_distribution(_window(spark, d), views.detections(spark, d), "category")


def overview_unavailable(spark, d):
    return analytics.unavailable(_window(spark, d), views.inputs(spark, d))


def user_stats(spark, d):
    return analytics.user_stats(views.events(spark, d), views.detections(spark, d), views.users(spark, d))


def user_stats_topk(spark, d):
    return analytics.top_users(user_stats(spark, d), 50)


def event_primary_label(spark, d):
    return analytics.event_labels(views.detections(spark, d))


def events_list_latest(spark, d):
    return analytics.event_list(views.events(spark, d), views.detections(spark, d), views.inputs(spark, d), 100)


def _atoms(spark, d):
    return views.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("input_id"), (F.col("vec_id") % 10).cast("int").alias("ordinal"), F.col("label").alias("block"), F.col("embedding").alias("vector"))


def adjacent_cosine(spark, d):
    return segments.with_breaks(_atoms(spark, d)).where("cosine IS NOT NULL").select("input_id", "ordinal", F.round("cosine", 5).alias("cosine"))


def segment_list(spark, d):
    return segments.segments(segments.with_breaks(_atoms(spark, d), 0.1))


def segment_vectors(spark, d):
    return segments.segment_vectors(segments.with_breaks(_atoms(spark, d), 0.1)).select("input_id", "segment", "place", F.round("x", 5).alias("x"))


def lr_candidates(spark, d):
    rows = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return segments.linear_scores(rows, WEIGHTS).select("id", "label", "bucket")


def atoms_documents(spark, d):
    return segments.paragraphs(_docs(spark, d), "doc_id")


def rate_limit(spark, d):
    return limits.rate_limited(views.events(spark, d), 3, 3600)


def prompt_hash(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", scalars.hmac_sha256(F.to_json(F.struct(F.col("text").alias("prompt"), F.lit("w").alias("workspace_id"))), b"key").alias("prompt_hash"))


def input_results_basis(spark, d):
    rows = views.inputs(spark, d).withColumns({"parse_status": F.when((F.col("kind") == "file_reference") & (F.col("event_id") % 2 == 0), "parsed"), "n_matches": F.col("event_id") % 3})
    return inputs.scan_results(rows).select("event_id", "input_index", "content_scanned", F.col("decision_basis").alias("basis"))


def pdf_coverage(spark, d):
    n = (F.length(F.coalesce("html", F.lit(""))) % 200).cast("int")
    pages = views.table(spark, d, "pages").select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("page"), F.when(F.col("page_id") % 17 == 0, "failed").otherwise("ok").alias("status"), n.alias("n_chars"), F.element_at(F.array(*map(F.lit, ["present", "absent", "unknown"])), (F.col("page_id") % 3 + 1).cast("int")).alias("image"))
    return inputs.page_coverage(pages).select("page", "bucket", "reason", "candidate", "selected")


def rule_set_version(spark, d):
    return inputs.rule_set_version(views.stored_rules(spark, d).where("enabled AND NOT archived"), "tenant")


def signal_ids(spark, d):
    rows = each(_docs(spark, d).where("text IS NOT NULL"), ["doc_id"], spans(F.col("text"), "Th"), "s")
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start"), inputs.signal_id(F.col("doc_id"), F.lit("b0"), F.lit("p"), F.col("s")).alias("signal_id"))


def rule_regex_matches(spark, d):
    found = rules.regex_matches(_docs(spark, d), {"custom:secret": SECRET, "custom:token": TOKEN}, "doc_id")
    return found.select("doc_id", "rule_id", "match_count", F.array_join(F.col("value_lengths").cast("array<string>"), ",").alias("value_lengths"), "confidence")


def request_violations(spark, d):
    rows = views.requests(spark, d)
    found = inputs.violations(F.lit("text"), F.col("source"), F.col("input_index") % 4 != 3, F.when(F.col("input_index") % 5 != 4, F.col("content")), F.length("content"))
    return rows.select("request_id", "input_index", F.array_join(found, ",").alias("violations"))


def verifier_chunks(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(inputs.chunks(F.col("text"))).alias("nth", "chunk")).select("doc_id", "nth", F.length("chunk").alias("n_chars"))


def parsed_pages(spark, d):
    rows = views.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("code").alias("kind"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return files.parsed(rows).select("path", "status", "place", F.length("text").alias("n_chars"))


_QUERIES = [
    dryrun_documents, dryrun_conversations, detect_email_counts, pii_union_sorted, detect_samples, mask_documents, normalize_text, rule_keyword_matches, rule_context_matches, rule_regex_matches, rule_catalogue_merge, rule_catalogue_manageable,
    policy_decide_requests, idempotent_requests, size_buckets, file_policy, event_stats_daily, event_stats_totals, event_stats_actions, event_stats_risk, event_stats_detection_types,
    event_stats_categories, overview_unavailable, user_stats, user_stats_topk, event_primary_label, events_list_latest, adjacent_cosine, segment_list, segment_vectors, lr_candidates,
    atoms_documents, rate_limit, prompt_hash, input_results_basis, pdf_coverage, rule_set_version, signal_ids, request_violations, verifier_chunks, parsed_pages,
]


def queries() -> dict:
    return {f.__name__: f for f in [*_QUERIES, *dashboards.QUERIES, *cascade.QUERIES, *intake.QUERIES, *parsing.QUERIES, *scanning.QUERIES, *guards.QUERIES, *responses.QUERIES, *file_plans.QUERIES, *client.QUERIES]}


def oracle_sql() -> dict:
    from sievegate import oracle

    return oracle.SQL | dashboards.SQL | cascade.SQL | intake.SQL | parsing.SQL | scanning.SQL | guards.SQL | responses.SQL | file_plans.SQL | client.SQL
