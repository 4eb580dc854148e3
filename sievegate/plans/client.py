"""Queries over stored settings, whole event details and what clients make of responses, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.operators import analytics, client, evidence, policy, response
from sievegate.plans import responses
from sievegate.sources import views
from sievegate.sources.views import sql

NOW = "2024-01-15 00:00:00"
STORED = {
    "context_classifier_action": ["Allow", "WARN", "BLOCK"], "content_not_scanned_action": ["WARN", "Block", "ALLOW", "allow"], "parser_or_ocr_failure_action": ["BLOCK", "warn"],
    "empty_input_action": ["ALLOW", "Warn", "BLOCK"], "unsupported_mask_fallback_action": ["WARN", "Block"],
}
ORIGINS = [*client.TEXT_ORIGINS, *client.FILE_ORIGINS, *client.BARE_ORIGINS, "elsewhere"]
STATUSES = ["disabled", "no_candidate", "candidate", "verified", "timeout", "failed"]
LABELS = ["PERSONAL_DATA_CONTEXT", "CONFIDENTIAL_BUSINESS_CONTEXT", "BUSINESS_CONFIDENTIAL_CONTEXT", "odd", "FINANCIAL_CONTEXT", "other", "CUSTOMER_DATA_CONTEXT"]


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _settings(spark, d):
    n = F.col("n_nationkey")
    nations = views.table(spark, d, "nation").select(n.cast("int").alias("tenant"), n.alias("n"))
    rows = nations.where("n % 3 <> 1").select("tenant", *[F.when(F.col("n") % 7 != k, _pick(names, F.col("n") + k)).alias(key) for k, (key, names) in enumerate(STORED.items())])
    return policy.stored_settings(nations.select("tenant"), rows)


def policy_settings_rows(spark, d):
    return _settings(spark, d)


def policy_decide_tenants(spark, d):
    """Requests of 25 tenants, each by its own settings: empty ones, some with inputs that were not scanned or could not be parsed, some
    with verified context."""
    e = views.events(spark, d).select(F.col("id").alias("request_id"), (F.col("user_id") % 25).cast("int").alias("tenant"), (F.col("id") % 10 != 3).alias("full"))
    r = F.col("request_id")
    requests = e.select("request_id", "tenant", F.when(F.col("full"), 1).otherwise(0).alias("n_inputs"), F.when(F.col("full") & (r % 6 == 0), F.array(F.lit("PARSER_OR_OCR_FAILED"))).alias("codes"), (~F.col("full") | (r % 4 != 1)).alias("all_scanned"))
    action = F.when(F.col("category") == "Secret", "block").when(F.col("category") == "Custom", "allow").otherwise("mask")
    found = views.detections(spark, d).where("event_id % 10 <> 3").select(
        F.col("event_id").alias("request_id"), F.when(F.col("type") == "PHONE", 1).otherwise(0).alias("ord"), action.alias("action"), F.when(F.col("category") == "Secret", "critical").otherwise("high").alias("severity"),
        policy.safe_reason(F.col("category")).alias("reason"), (F.col("event_id") % 2 == 0).alias("masking_supported"))
    context = requests.where("n_inputs > 0 AND request_id % 5 = 2").select("request_id", F.lit("verified").alias("status"), F.lit(1).alias("accepted_count"), F.lit(1).alias("candidate_count"), F.lit("RISK_CONTEXT_VERIFIED").alias("reason_code"))
    settings = _settings(spark, d)
    failures = evidence.failure_rules(requests.join(settings, "tenant", "left"))
    return policy.decide_requests(requests.select("request_id", "tenant", "n_inputs"), found, settings, context, failures)


def event_detail_whole(spark, d):
    k = F.col("event_id")
    context = F.col("category") == "Custom"
    found = views.detections(spark, d).select(
        "event_id", "category", "type", "count", F.concat(F.lit("CODE_"), k % 3).alias("reason_code"), F.when(context, "custom_context_rule").otherwise("built_in_detector").alias("source"),
        F.when(context & (k % 4 == 0), F.array(F.lit("word"))).otherwise(F.array().cast("array<string>")).alias("matched_keywords"), F.when(context & (k % 3 == 0), F.create_map(F.lit("matched_condition_count"), F.col("count"))).alias("evidence_counts"))
    included = F.col("content_included")
    ins = views.inputs(spark, d).withColumns({"content_scanned": included & (F.col("kind") == "text"), "content_unavailable_reason": F.when(~included & (k % 2 == 0), "unsupported")})
    out = analytics.event_detail_whole(views.events(spark, d), found, ins)
    listed = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[y] for y in f])), ";").alias(c)
    contexts = F.array_join(F.transform("context_matches", lambda x: F.concat_ws(":", x["type"], x["reason_code"], x["count"], F.array_join(x["matched_keywords"], ","), F.array_join(F.transform(x["evidence_counts"], lambda y: F.concat_ws("=", y["key"], y["value"])), ","))), ";")
    return out.select("event_id", "login_id", "action", "risk_score", listed("detections", "category", "type", "reason_code", "count"), contexts.alias("context_matches"), listed("inputs", "input_index", "kind"), listed("unavailable", "input_index", "decision_basis", "content_unavailable_reason"))


def decision_evidence(spark, d):
    """The lines that users see of every request's response, with context evidence of all statuses beside it."""
    r = F.col("request_id")
    out = response.respond(responses._inputs(spark, d), responses.CATALOGUE)
    status = F.when(r % 7 != 6, _pick(STATUSES, r))
    labels = F.slice(F.array(*map(F.lit, LABELS)), (r % 3 + 1).cast("int"), (r % 6).cast("int"))
    lines = client.evidence_lines(F.col("action"), F.col("detections"), F.col("content_unavailable_inputs"), F.col("business_context_matches"), status, labels)
    return out.select("request_id", F.array_join(lines, "|").alias("lines"))


def context_group_terms(spark, d):
    """Texts of documents as forms: words are terms, some articles colons, sentences lines."""
    t = F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\n")), F.lit(" the "), F.lit(" :")), F.lit(" de "), F.lit(":")), F.lit(" "), F.lit(" , "))
    forms = views.table(spark, d, "documents").select("doc_id", t.alias("text"))
    return client.context_groups(forms, "doc_id").select("doc_id", "place", "name", F.array_join("terms", "|").alias("terms"))


def envelope_violations(spark, d):
    n = F.col("conv_id") * 5 + F.col("turn") * 3
    rows = views.table(spark, d, "conversations").select("conv_id", "turn", F.when(n % 31 != 30, _pick(ORIGINS, n)).alias("origin"), F.when(n % 4 < 2, F.col("text")).alias("text"), F.when(n % 8 > 3, F.lit("f")).alias("file_ref"), F.when(n % 16 > 5, F.lit("pdf")).alias("file_kind"))
    return rows.select("conv_id", "turn", client.envelope_violation(F.col("origin"), F.col("text"), F.col("file_ref"), F.col("file_kind")).alias("violation"))


def text_and_unread_inputs(spark, d):
    """Of each request, the places of its included texts and of what came without content."""
    rows = responses._inputs(spark, d)
    texts = client.included_texts(rows).select("request_id", "input_index", F.lit("text").alias("part"), F.length("content").alias("n_chars"))
    return texts.unionByName(client.without_content(rows).select("request_id", "input_index", F.lit("unread").alias("part"), F.lit(None).cast("int").alias("n_chars")))


def refresh_tokens_usable(spark, d):
    e = views.events(spark, d)
    hours = lambda k: F.col("created_at") + F.make_interval(hours=F.lit(k))
    tokens = e.where("id % 11 <> 7").select(F.col("id").alias("token_id"), F.col("user_id").alias("owner_id"), F.when(F.col("k") % 9 == 0, F.col("created_at")).alias("revoked_at"), hours(14 * 24).alias("expires_at"), F.when(F.col("k") % 4 != 1, hours(48)).alias("idle_expires_at"))
    asked = e.select(F.col("id").alias("token_id"), F.when(F.col("id") % 8 == 5, -1).otherwise(F.col("user_id")).alias("user_id"))
    return client.usable_tokens(asked, tokens, F.lit(NOW).cast("timestamp"))


def session_outcomes(spark, d):
    e = views.events(spark, d)
    sessions = e.where("id % 13 <> 4").select(F.col("id").alias("session_hash"), "user_id", F.when(F.col("k") % 6 == 0, F.col("created_at")).alias("revoked_at"), (F.col("created_at") + F.make_interval(hours=F.lit(240))).alias("expires_at"))
    users = views.users(spark, d).select("user_id", "status", F.when(F.col("user_id") % 3 == 0, "ADMIN").otherwise("USER").alias("role"))
    return client.session_outcomes(e.select(F.col("id").alias("session_hash")), sessions, users, F.lit(NOW).cast("timestamp"))


QUERIES = [policy_settings_rows, policy_decide_tenants, event_detail_whole, decision_evidence, context_group_terms, envelope_violations, text_and_unread_inputs, refresh_tokens_usable, session_outcomes]


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _case(key: str, labels: dict[str, str], rest: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {rest} END"


_STORED = "st AS (SELECT CAST(n_nationkey AS INTEGER) AS tenant, " + ", ".join(f"CASE WHEN n_nationkey % 3 <> 1 AND n_nationkey % 7 <> {k} THEN lower({_list(names)}[(n_nationkey + {k}) % {len(names)} + 1]) ELSE '{policy.SETTINGS[key]}' END AS {key}" for k, (key, names) in enumerate(STORED.items())) + " FROM nation)"
_SEVERITY = lambda a: f"CASE {a} WHEN 'block' THEN 'high' WHEN 'warn' THEN 'medium' ELSE 'info' END"
_GIVEN = "SELECT *, content_included AND kind = 'text' AS scanned, CASE WHEN NOT content_included AND event_id % 2 = 0 THEN 'unsupported' END AS why FROM v_inputs"
_B = r"[\t-\r\x{FEFF}\p{Z}]"
_TRIM = lambda x: f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"

SQL = {
    "policy_settings_rows": f"WITH {_STORED} SELECT * FROM st",
    "policy_decide_tenants": sql(
        f""", {_STORED},
q AS (SELECT id AS r, id % 10 <> 3 AS filled, st.* FROM v_events LEFT JOIN st ON st.tenant = user_id % 25),
ev AS (SELECT event_id AS r, CASE WHEN type = 'PHONE' THEN 1 ELSE 0 END AS ord, CASE category WHEN 'Secret' THEN 'block' WHEN 'Custom' THEN 'allow' ELSE 'mask' END AS action, CASE category WHEN 'Secret' THEN 'critical' ELSE 'high' END AS severity,
    CASE WHEN category IN ('PII', 'Payment') THEN 'HIGH_RISK_PII' WHEN category = 'Secret' THEN 'SECRET_DETECTED' ELSE 'UNMAPPED_RULE' END AS reason, event_id % 2 = 0 AS ok FROM v_detections WHERE event_id % 10 <> 3
  UNION ALL SELECT r, 1048576, parser_or_ocr_failure_action, {_SEVERITY("parser_or_ocr_failure_action")}, 'PARSER_OR_OCR_FAILED', true FROM q WHERE filled AND r % 6 = 0
  UNION ALL SELECT r, 1048577, content_not_scanned_action, {_SEVERITY("content_not_scanned_action")}, 'CONTENT_NOT_SCANNED', true FROM q WHERE filled AND r % 4 = 1),
b AS (SELECT *, bool_or(action = 'mask' AND NOT ok) OVER (PARTITION BY r) AS bad FROM ev QUALIFY row_number() OVER (PARTITION BY r ORDER BY list_position(['allow','warn','mask','block'], action) DESC, list_position(['info','low','medium','high','critical'], severity) DESC, ord) = 1),
w AS (SELECT q.r, CASE WHEN b.r IS NULL AND NOT filled THEN 'e' WHEN filled AND q.r % 5 = 2 AND coalesce(action, 'allow') = 'allow' THEN 'c' WHEN b.r IS NULL THEN 'n' WHEN action = 'mask' AND bad THEN 'f' ELSE 'w' END AS how, q.* EXCLUDE (r), b.* EXCLUDE (r) FROM q LEFT JOIN b ON b.r = q.r),
o AS (SELECT r, how, severity, reason, CASE how WHEN 'e' THEN empty_input_action WHEN 'c' THEN context_classifier_action WHEN 'n' THEN 'allow' WHEN 'f' THEN unsupported_mask_fallback_action ELSE action END AS action FROM w)
SELECT r AS request_id, action, CASE how WHEN 'e' THEN 'EMPTY_INPUT' WHEN 'c' THEN 'RISK_CONTEXT_VERIFIED' WHEN 'n' THEN 'NO_RISK_DETECTED' ELSE reason END AS reason_code, CASE how WHEN 'w' THEN severity ELSE {_SEVERITY("action")} END AS severity FROM o""",
        "v_events", "v_detections",
    ),
    "event_detail_whole": sql(
        f""", x AS (SELECT *, 'CODE_' || event_id % 3 AS code, category = 'Custom' AND event_id % 4 = 0 AS words, category = 'Custom' AND event_id % 3 = 0 AS counts FROM v_detections),
dl AS (SELECT event_id, string_agg(concat_ws(':', category, type, code, count), ';' ORDER BY category, type, code, count) AS l, string_agg(concat_ws(':', type, code, count, CASE WHEN words THEN 'word' ELSE '' END, CASE WHEN counts THEN 'matched_condition_count=' || count END), ';' ORDER BY category, type, code, count) FILTER (words OR counts) AS c FROM x GROUP BY 1),
il AS (SELECT event_id, string_agg(input_index || ':' || kind, ';' ORDER BY input_index) AS l, string_agg(concat_ws(':', input_index, decision_basis, why), ';' ORDER BY input_index) FILTER (NOT scanned OR decision_basis = 'content_unavailable' OR why IS NOT NULL) AS u FROM ({_GIVEN}) GROUP BY 1)
SELECT id AS event_id, login_id, action, risk_score, coalesce(dl.l, '') AS detections, coalesce(c, '') AS context_matches, coalesce(il.l, '') AS inputs, coalesce(u, '') AS unavailable FROM v_events LEFT JOIN dl ON dl.event_id = id LEFT JOIN il ON il.event_id = id""",
        "v_events", "v_detections", "v_inputs",
    ),
    "decision_evidence": f"""WITH {responses._RESPONSES},
y AS (SELECT *, CASE WHEN request_id % 7 <> 6 THEN {_list(STATUSES)}[request_id % {len(STATUSES)} + 1] END AS status, {_list(LABELS)}[request_id % 3 + 1 : request_id % 3 + request_id % 6] AS labels FROM s),
z AS (SELECT *, list_transform(labels, lambda x: {_case("x", client.CONTEXT_LABELS, f"'{client.OTHER_LABEL}'")}) AS all_names FROM y),
v AS (SELECT *, list_filter(all_names, lambda x, i: list_position(all_names, x) = i) AS said FROM z),
u AS (SELECT request_id, action, CASE WHEN status IN ('disabled', 'no_candidate') THEN NULL WHEN status = 'timeout' THEN '{client.TIMED_OUT}' WHEN status = 'failed' THEN '{client.FAILED}' WHEN len(said) > 0 THEN CASE WHEN status = 'verified' THEN '{client.FOUND}' ELSE '{client.CAREFUL}' END || array_to_string(said[1:3], ', ') || CASE WHEN len(said) > 3 THEN ' 외 ' || (len(said) - 3) || '개' ELSE '' END END AS c,
  list_transform(list_filter(string_split(d, ';'), lambda x: x <> '')[1:3], lambda x: '{client.FOUND}' || CASE split_part(x, ':', 2) WHEN 'email' THEN '이메일 주소' WHEN 'secret' THEN 'API 키 또는 인증 토큰' WHEN 'word' THEN 'custom' ELSE 'business' END) AS found,
  list_transform(list_filter(string_split(unread, ';'), lambda x: x <> '')[1:3], lambda x: '{client.UNREAD}' || {_case("split_part(x, ':', 2)", client.REASONS, "''")}) AS unread, list_transform(range(least(contexts, 2)), lambda x: '{client.POLICY}business') AS matched FROM v)
SELECT request_id, CASE WHEN len(l) = 0 AND action <> 'Allow' THEN '{client.REVIEW}' ELSE array_to_string(l, '|') END AS lines FROM (SELECT *, list_concat(list_filter([c], lambda x: x IS NOT NULL), found, unread, matched) AS l FROM u)""",
    "context_group_terms": f"""WITH f AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(replace(replace(replace(replace(text, '. ', chr(10)), ' the ', ' :'), ' de ', ':'), ' ', ' , '), chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, pos, {_TRIM("substr(line, 1, instr(line, ':') - 1)")} AS name, list_filter(list_transform(string_split(substr(line, instr(line, ':') + 1), ','), lambda x: {_TRIM("x")}), lambda x: x <> '') AS terms FROM f WHERE instr(line, ':') > 1)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS place, name, array_to_string(arg_max(terms, pos), '|') AS terms FROM g WHERE name <> '' AND len(terms) > 0 GROUP BY doc_id, name""",
    "envelope_violations": f"""WITH x AS (SELECT conv_id, turn, n, CASE WHEN n % 31 <> 30 THEN {_list(ORIGINS)}[n % {len(ORIGINS)} + 1] END AS o, n % 4 < 2 AND text IS NOT NULL AS t, n % 8 > 3 AS f, n % 16 > 5 AS k FROM (SELECT *, conv_id * 5 + turn * 3 AS n FROM conversations))
SELECT conv_id, turn, CASE WHEN o IS NULL OR o = 'elsewhere' THEN 'ORIGIN_UNKNOWN' WHEN o LIKE '%\\_text' ESCAPE '\\' THEN CASE WHEN NOT t OR f OR k THEN 'TEXT_REQUIRED_WITHOUT_FILE' END WHEN o LIKE '%\\_ref' ESCAPE '\\' THEN CASE WHEN NOT f OR NOT k OR t THEN 'FILE_REQUIRED_WITHOUT_TEXT' END WHEN t THEN 'TEXT_NOT_ALLOWED' END AS violation FROM x""",
    "text_and_unread_inputs": f"WITH {responses._RESPONSES} SELECT request_id, i AS input_index, CASE WHEN c IS NULL THEN 'unread' ELSE 'text' END AS part, CAST(length(c) AS INTEGER) AS n_chars FROM t",
    "refresh_tokens_usable": sql(f"SELECT id AS token_id, CASE WHEN id % 8 = 5 THEN -1 ELSE user_id END AS user_id, id % 11 <> 7 AND id % 8 <> 5 AND k % 9 <> 0 AND created_at + INTERVAL 336 HOURS > TIMESTAMP '{NOW}' AND (k % 4 = 1 OR created_at + INTERVAL 48 HOURS > TIMESTAMP '{NOW}') AS usable FROM v_events", "v_events"),
    "session_outcomes": sql(f"SELECT id AS session_hash, CASE WHEN id % 13 = 4 OR k % 6 = 0 OR status IS NULL OR created_at + INTERVAL 240 HOURS <= TIMESTAMP '{NOW}' THEN 'invalid' WHEN status <> 'ACTIVE' THEN 'not_active' WHEN e.user_id % 3 <> 0 THEN 'not_admin' ELSE 'ok' END AS outcome FROM v_events e LEFT JOIN v_users u ON u.user_id = e.user_id", "v_events", "v_users"),
}
