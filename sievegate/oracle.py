"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from sievegate.catalog import AS_OF, CONTEXTS, DAYS, KEYWORDS, TOKEN, WEIGHTS
from sievegate.functions.detectors import SECRET
from sievegate.plans.scanning import CHUNKS
from sievegate.sources.views import sql

_IN = f"created_at >= DATE '{AS_OF}' - {DAYS - 1} AND created_at < DATE '{AS_OF}' + 1"
_ACTIONS = ", ".join(f"CAST(count_if(action = '{a}') AS BIGINT) AS {a.lower()}" for a in ("ALLOW", "WARN", "MASK", "BLOCK"))
_NORMAL = """n AS (SELECT doc_id, text, array_to_string(list_transform(list_filter(generate_series(1, len(c)), lambda i: i = 1 OR c[i] <> c[i-1] OR NOT regexp_matches(c[i], '^[\\pP\\pS]$')), lambda i: c[i]), '') AS norm
  FROM (SELECT doc_id, text, string_split(text, '') AS c FROM documents))"""
_STATS = """SELECT u.login_id, u.username, coalesce(n_events, 0) AS n_events, coalesce(allow, 0) AS allow, coalesce(warn, 0) AS warn, coalesce(mask, 0) AS mask, coalesce(block, 0) AS block, last_day, top_category
  FROM v_users u LEFT JOIN (SELECT login_id, count(*) AS n_events, %s, max(CAST(created_at AS DATE)) AS last_day FROM v_events GROUP BY 1) e USING (login_id)
  LEFT JOIN (SELECT login_id, category AS top_category FROM (SELECT login_id, category, row_number() OVER (PARTITION BY login_id ORDER BY sum(count) DESC, category) AS r FROM v_detections d JOIN v_events v ON v.id = d.event_id GROUP BY 1, 2) WHERE r = 1) t USING (login_id)""" % _ACTIONS
_LABELS = """SELECT event_id, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN min(type) ELSE 'MULTIPLE' END AS type_label, CASE WHEN count(DISTINCT category) = 1 THEN min(category) ELSE 'MULTIPLE' END AS category_label
  FROM (SELECT event_id, category, type, sum(count) AS n FROM v_detections GROUP BY 1, 2, 3) GROUP BY 1"""
_ATOMS = """atoms AS (SELECT vec_id // 10 AS input_id, CAST(vec_id % 10 AS INTEGER) AS ordinal, label AS block, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT *, list_cosine_similarity(lag(v) OVER w, v) AS cosine, lag(block) OVER w <> block AS moved FROM atoms WINDOW w AS (PARTITION BY input_id ORDER BY ordinal)),
seg AS (SELECT *, CAST(sum(CASE WHEN coalesce(cosine < 0.1 OR moved, false) THEN 1 ELSE 0 END) OVER (PARTITION BY input_id ORDER BY ordinal) AS INTEGER) AS segment FROM pairs)"""


def _detection_sum(column: str) -> str:
    return sql(f"SELECT {column} AS name, CAST(sum(count) AS BIGINT) AS n FROM v_detections WHERE event_id IN (SELECT id FROM v_events WHERE {_IN}) GROUP BY 1", "v_events", "v_detections")


def _contexts() -> str:
    rows = " UNION ALL ".join("SELECT doc_id, '{}' AS rule_id, CAST({} AS BIGINT) AS n_conditions, {} AS least FROM n".format(r, " + ".join(f"CAST(contains(lower(norm), '{t}') AS INTEGER)" for t in terms), least) for r, (terms, least) in CONTEXTS.items())
    return f"WITH {_NORMAL} SELECT doc_id, rule_id, n_conditions FROM ({rows}) WHERE n_conditions >= least"


_MERGED = """, b AS (SELECT n_nationkey AS tenant, 'detector:' || k AS rule_id, s, a FROM nation, (VALUES ('EMAIL', 'medium', 'MASK'), ('PHONE', 'medium', 'MASK'), ('RRN', 'high', 'MASK'), ('CARD', 'high', 'MASK'), ('BANK_ACCOUNT', 'high', 'MASK')) t(k, s, a)),
all_ AS (SELECT b.tenant, b.rule_id, 'built_in' AS origin, coalesce(severity, s) AS severity, coalesce(action, a) AS action, coalesce(enabled, true) AS enabled, coalesce(archived, false) AS archived FROM b LEFT JOIN v_rules v ON v.tenant = b.tenant AND v.rule_id = b.rule_id
  UNION ALL SELECT tenant, rule_id, origin, severity, action, enabled, archived FROM v_rules WHERE origin = 'custom')"""

SQL = {
    "detect_email_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+')) AS BIGINT) AS n FROM documents WHERE n > 0",
    "normalize_text": f"WITH {_NORMAL} SELECT doc_id, CAST(length(norm) AS INTEGER) AS n_chars, sha256(norm) AS sha256 FROM n",
    "rule_keyword_matches": f"WITH {_NORMAL} " + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id FROM n WHERE contains(lower(norm), '{w}')" for r, w in KEYWORDS.items()),
    "rule_context_matches": _contexts(),
    "rule_catalogue_merge": sql(_MERGED + " SELECT tenant, rule_id, origin, severity, action FROM all_ WHERE enabled AND NOT archived", "v_rules"),
    "rule_catalogue_manageable": sql(_MERGED + " SELECT tenant, rule_id, severity, action, enabled, archived FROM all_", "v_rules"),
    "policy_decide_requests": sql(
        """, ev AS (SELECT d.event_id AS request_id, input_index * 2 + CASE WHEN type = 'PHONE' THEN 1 ELSE 0 END AS ord, CASE category WHEN 'Secret' THEN 'block' WHEN 'Payment' THEN 'mask' WHEN 'PII' THEN 'mask' ELSE 'warn' END AS action,
  CASE category WHEN 'Secret' THEN 'critical' WHEN 'Custom' THEN 'medium' ELSE 'high' END AS severity, CASE WHEN category IN ('PII', 'Payment') THEN 'HIGH_RISK_PII' WHEN category = 'Secret' THEN 'SECRET_DETECTED' ELSE 'UNMAPPED_RULE' END AS reason, source = 'composer' AS ok
  FROM v_detections d JOIN v_inputs USING (event_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY list_position(['allow','warn','mask','block'], action) DESC, list_position(['info','low','medium','high','critical'], severity) DESC, ord) AS r,
  bool_or(action = 'mask' AND NOT ok) OVER (PARTITION BY request_id) AS unsupported FROM ev)
SELECT q.request_id, CASE WHEN b.action IS NULL THEN 'allow' WHEN b.action = 'mask' AND unsupported THEN 'block' ELSE b.action END AS action, coalesce(b.reason, 'NO_RISK_DETECTED') AS reason_code,
  CASE WHEN b.action IS NULL THEN 'info' WHEN b.action = 'mask' AND unsupported THEN 'high' ELSE b.severity END AS severity
FROM (SELECT DISTINCT event_id AS request_id FROM v_inputs) q LEFT JOIN best b ON b.request_id = q.request_id AND b.r = 1""",
        "v_detections", "v_inputs",
    ),
    "idempotent_requests": sql("SELECT login_id, client_request_id, id FROM (SELECT login_id, id % 97 AS client_request_id, id, row_number() OVER (PARTITION BY login_id, id % 97 ORDER BY created_at, id) AS r FROM v_events) WHERE r = 1", "v_events"),
    "size_buckets": "SELECT page_id, CAST(n AS INTEGER) AS size_bytes, CASE WHEN n = 0 THEN 'empty' WHEN n <= 1048576 THEN 'small' WHEN n <= 10485760 THEN 'medium' ELSE 'large' END AS size_bucket, CASE WHEN n <= 0 THEN 'empty' WHEN n <= 32 THEN 'tiny' WHEN n <= 128 THEN 'short' WHEN n <= 512 THEN 'medium' WHEN n <= 2048 THEN 'long' ELSE 'huge' END AS length_bucket FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n FROM pages)",
    "file_policy": "WITH f AS (SELECT page_id % 40 AS batch_id, 'page-' || page_id || ['.HTML','.txt','.exe','.bin'][page_id % 4 + 1] AS name, ['html','txt','exe','bin'][page_id % 4 + 1] AS extension, octet_length(encode(coalesce(html, ''))) AS size FROM pages), r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY batch_id) > 10000 THEN 'TOO_MANY_FILES' WHEN size > 5000 THEN 'FILE_TOO_LARGE' WHEN extension = 'exe' THEN 'EXCLUDED_EXTENSION' WHEN extension NOT IN ('html', 'txt') THEN 'UNSUPPORTED_EXTENSION' END AS reason FROM f) SELECT batch_id, name, extension, reason, reason IS NULL AS allowed FROM r",
    "event_stats_daily": sql(f"SELECT s.day, coalesce(n, 0) AS n, coalesce(allow, 0) AS allow, coalesce(warn, 0) AS warn, coalesce(mask, 0) AS mask, coalesce(block, 0) AS block, coalesce(users, 0) AS users FROM (SELECT CAST(unnest(generate_series(DATE '{AS_OF}' - {DAYS - 1}, DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, {_ACTIONS}, count(DISTINCT user_id) AS users FROM v_events WHERE {_IN} GROUP BY 1) e USING (day)", "v_events"),
    "event_stats_totals": sql(f"SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_users, {_ACTIONS}, " + ", ".join(f"CAST(count_if(risk_level = '{x}') AS BIGINT) AS {x}" for x in ("low", "medium", "high", "critical")) + f" FROM v_events WHERE {_IN}", "v_events"),
    "event_stats_actions": sql(f"SELECT action AS name, count(*) AS n FROM v_events WHERE {_IN} GROUP BY 1", "v_events"),
    "event_stats_risk": sql(f"SELECT risk_level AS name, count(*) AS n FROM v_events WHERE {_IN} GROUP BY 1", "v_events"),
    "event_stats_detection_types": _detection_sum("type"),
    "event_stats_categories": _detection_sum("category"),
    "overview_unavailable": sql(f"SELECT count(*) AS n FROM v_events WHERE {_IN} AND id IN (SELECT event_id FROM v_inputs WHERE NOT content_included)", "v_events", "v_inputs"),
    "user_stats": sql(_STATS, "v_events", "v_detections", "v_users"),
    "user_stats_topk": sql(f"SELECT * FROM ({_STATS}) ORDER BY n_events DESC, last_day DESC NULLS LAST, lower(username) LIMIT 50", "v_events", "v_detections", "v_users"),
    "event_primary_label": sql(_LABELS, "v_detections"),
    "events_list_latest": sql(f"SELECT e.id AS event_id, login_id, action, risk_score, risk_level, coalesce(l.n, 0) AS n_detections, type_label, category_label, coalesce(i.n_inputs, 0) AS n_inputs, coalesce(i.n_unavailable, 0) AS n_unavailable FROM (SELECT * FROM v_events ORDER BY created_at DESC, id DESC LIMIT 100) e LEFT JOIN ({_LABELS}) l ON l.event_id = e.id LEFT JOIN (SELECT event_id, count(*) AS n_inputs, CAST(count_if(NOT content_included) AS BIGINT) AS n_unavailable FROM v_inputs GROUP BY 1) i ON i.event_id = e.id", "v_events", "v_detections", "v_inputs"),
    "adjacent_cosine": f"WITH {_ATOMS} SELECT input_id, ordinal, round(cosine, 5) AS cosine FROM pairs WHERE cosine IS NOT NULL",
    "segment_list": f"WITH {_ATOMS} SELECT input_id, segment, count(*) AS n_atoms, min(ordinal) AS first_atom, max(ordinal) AS last_atom, CASE WHEN count(*) = 1 THEN 'single_atom' ELSE 'semantic' END AS segment_type FROM seg GROUP BY 1, 2",
    "segment_vectors": f"WITH {_ATOMS}, m AS (SELECT input_id, segment, place - 1 AS place, avg(x) AS x FROM (SELECT input_id, segment, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM seg) GROUP BY 1, 2, 3) SELECT input_id, segment, CAST(place AS INTEGER) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY input_id, segment)), 5) AS x FROM m",
    "lr_candidates": "WITH w AS (SELECT * FROM (VALUES " + ", ".join(f"('{label}', {w})" for label, w in WEIGHTS.items()) + ") t(name, w)), s AS (SELECT vec_id AS id, name AS label, 1 / (1 + exp(-list_dot_product(CAST(embedding AS DOUBLE[]), CAST(w AS DOUBLE[])))) AS score FROM embeddings, w) SELECT id, label, CASE WHEN score >= 0.9 THEN 'very_high' WHEN score >= 0.75 THEN 'high' ELSE 'candidate' END AS bucket FROM s WHERE score >= 0.02",
    "atoms_documents": r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal, CAST(length(p[i]) AS INTEGER) AS n_chars FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS p FROM documents))",
    "input_results_basis": sql("""SELECT event_id, input_index, scanned AS content_scanned, CASE WHEN scanned AND event_id % 3 > 0 THEN 'detection' WHEN scanned THEN 'no_detection' WHEN kind = 'attachment_metadata' THEN 'metadata_only' ELSE 'content_unavailable' END AS basis
  FROM (SELECT *, (kind = 'file_reference' AND event_id % 2 = 0) OR (content_included AND kind = 'text') AS scanned FROM v_inputs)""", "v_inputs"),
    "pdf_coverage": """WITH p AS (SELECT page_id % 20 AS doc_id, page_id AS page, page_id % 17 = 0 AS failed, length(coalesce(html, '')) % 200 AS n, page_id % 3 <> 1 AS image FROM pages),
m AS (SELECT *, CASE WHEN n = 0 THEN 'zero' WHEN n < 30 THEN 'very_low' WHEN n < 120 THEN 'low' ELSE 'sufficient' END AS bucket, CASE WHEN failed THEN 'native_failed' WHEN n < 30 THEN 'low_text' WHEN n < 120 AND image THEN 'low_text_with_image' END AS reason FROM p)
SELECT page, bucket, reason, reason IS NOT NULL AS candidate, reason IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, reason IS NOT NULL ORDER BY page) <= 3 AS selected FROM m""",
    "rule_set_version": sql("SELECT tenant, 'filter-rules:' || substr(sha256(string_agg(rule_id || ':' || version, '|' ORDER BY rule_id)), 1, 16) AS version FROM v_rules WHERE enabled AND NOT archived GROUP BY 1", "v_rules"),
    # by construction: what stands where in each of the five texts; a card takes the space behind it along
    "detect_samples": """SELECT c_custkey, key AS detector_key, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST("end" - start AS INTEGER) AS value_length FROM (
  SELECT c_custkey, 'PHONE' AS key, 4 AS start, 17 AS "end" FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'PHONE', 19, 35 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'BANK_ACCOUNT', 5, 19 FROM customer WHERE c_custkey % 5 = 1
  UNION ALL SELECT c_custkey, 'CARD', 4, 24 FROM (SELECT c_custkey, '411111111111' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS c FROM customer WHERE c_custkey % 5 = 3)
    WHERE list_sum(list_transform(generate_series(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(c[i] AS INTEGER) ELSE CAST(c[i] AS INTEGER) * 2 - CASE WHEN CAST(c[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  UNION ALL SELECT c_custkey, 'EMAIL', 5, 27 + length(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 5 = 4)""",
    "signal_ids": """WITH RECURSIVE hit(doc_id, text, start) AS (SELECT doc_id, text, strpos(text, 'Th') - 1 FROM documents WHERE strpos(text, 'Th') > 0
UNION ALL SELECT doc_id, text, start + 1 + strpos(text[start + 3:], 'Th') FROM hit WHERE strpos(text[start + 3:], 'Th') > 0)
SELECT doc_id, CAST(start AS BIGINT) AS start, 'sig_' || substr(sha256(doc_id || ':b0:p:' || start || ':' || (start + 2)), 1, 20) AS signal_id FROM hit""",
    # of the normalised text, lengths in the text itself: kept lists the places of the characters that stay, and the end
    "rule_regex_matches": f"""WITH n AS (SELECT doc_id, array_to_string(list_transform(kept, lambda i: c[i]), '') AS norm, list_append(kept, len(c) + 1) AS kept
  FROM (SELECT doc_id, c, list_filter(generate_series(1, len(c)), lambda i: i = 1 OR c[i] <> c[i-1] OR NOT regexp_matches(c[i], '^[\\pP\\pS]$')) AS kept FROM (SELECT doc_id, string_split(text, '') AS c FROM documents))),
m AS ({" UNION ALL ".join(f"SELECT doc_id, kept, '{rule}' AS rule_id, list_transform(regexp_extract_all(norm, '{quoted}'), lambda x: length(x)) AS l, list_transform(string_split_regex(norm, '{quoted}'), lambda x: length(x)) AS g FROM n" for rule, quoted in (("custom:secret", SECRET.replace(chr(39), chr(39) * 2)), ("custom:token", TOKEN)))}),
p AS (SELECT *, list_transform(generate_series(1, len(l)), lambda i: list_sum(g[1:i]) + coalesce(list_sum(l[1:i - 1]), 0)) AS s FROM m WHERE len(l) > 0)
SELECT doc_id, rule_id, CAST(len(l) AS BIGINT) AS match_count, array_to_string(list_transform(generate_series(1, len(l)), lambda i: kept[CAST(s[i] + l[i] + 1 AS BIGINT)] - kept[CAST(s[i] + 1 AS BIGINT)]), ',') AS value_lengths, 90 AS confidence FROM p""",
    "rate_limit": sql(
        """RECURSIVE h AS (SELECT id, login_id, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY login_id ORDER BY created_at, id) AS n FROM v_events),
r AS (SELECT id, login_id, n, true AS allowed, [us] AS taken FROM h WHERE n = 1
  UNION ALL SELECT id, login_id, n, len(a) < 3, CASE WHEN len(a) < 3 THEN list_append(a, us) ELSE a END FROM (SELECT h.id, h.login_id, h.n, h.us, list_filter(r.taken, lambda t: t > h.us - 3600000000) AS a FROM r JOIN h ON h.login_id = r.login_id AND h.n = r.n + 1))
SELECT id, login_id, allowed FROM r""",
        "v_events",
    ).replace("WITH v_events", "WITH RECURSIVE v_events", 1).replace("RECURSIVE h AS", ", h AS", 1),
    "verifier_chunks": f"WITH t AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL),\n{CHUNKS} SELECT id AS doc_id, n AS nth, length(chunk) AS n_chars FROM c",
    "request_violations": sql("""SELECT request_id, input_index, concat_ws(',', CASE WHEN inc AND c IS NULL THEN 'CONTENT_MISSING' END, CASE WHEN NOT inc AND c IS NOT NULL THEN 'CONTENT_NOT_ALLOWED' END, CASE WHEN inc AND octet_length(encode(c)) <> length(content) THEN 'SIZE_MISMATCH' END, CASE WHEN inc AND octet_length(encode(c)) > CASE WHEN source = 'composer' THEN 262144 ELSE 1048576 END THEN 'CONTENT_TOO_LARGE' END) AS violations
  FROM (SELECT *, input_index % 4 <> 3 AS inc, CASE WHEN input_index % 5 <> 4 THEN content END AS c FROM v_requests)""", "v_requests"),
}
