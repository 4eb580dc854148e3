"""Queries over requests, uploads, evidence, checked segments and mapped signals, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions.detectors import EMAIL, SECRET
from sievegate.functions.spans import each, spans
from sievegate.operators import analytics, inputs, lexical, mapping, requests, rules
from sievegate.sources import views
from sievegate.sources.views import sql

METADATA = ['{"mime": "text/plain"}', '{"mime": 3, "extension": "txt"}', '{"a": [{"Path": "x"}], "mime": "a/b"}', '{"note": "\\"name\\": no key"}', "{not json"]
OUTCOMES = ["ok", "ok", "ok", "timeout", "failed", "partial"]
KINDS = ["image", "pdf", "code", "slide", "movie", "unknown"]
MIMES = [" Text/HTML ", "text", "image/png", "a b/c"]
EXTENSIONS = [".HTML", "tar.gz", "txt ", "..x1"]
CATALOGUE = [
    rules.Rule("k1", "keyword", "custom", "Word one", "low", "WARN", "the"),
    rules.Rule("off", "keyword", "custom", "Off", "low", "WARN", "and", enabled=False),
    rules.Rule("secret", "regex", "built_in", "API secret", "critical", "BLOCK", SECRET),
    rules.Rule("gone", "regex", "custom", "Gone", "low", "WARN", "e", archived=True),
    rules.Rule("ctx", "context_rule", "custom", "Two words", "high", "MASK", terms=("and", "tion", "que"), least=2),
    rules.Rule("email", "detector", "built_in", "Email Address", "medium", "MASK", "EMAIL", touching=True),
]
COMPOSER_BYTES, PASTE_BYTES = 150, 200


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def request_checks(spark, d):
    rows = views.requests(spark, d)
    r = F.col("request_id")
    client = F.when(r % 5 == 0, F.concat(F.lit("sk-A"), r)).when(r % 5 == 1, F.concat(F.lit("-x"), r)).when(r % 5 == 2, F.lit(None)).otherwise(F.concat(F.lit("req:"), r))
    named = rows.select("request_id", client.alias("client_request_id"), F.concat(F.lit("rev "), r % 2).substr(F.when(r % 3 == 0, 1).otherwise(5), F.lit(9)).alias("revision"), (F.col("input_index") % 4).alias("input_id"))
    return requests.request_checks(named).select("request_id", F.array_join("violations", ",").alias("violations"))


def adapted_inputs(spark, d):
    e = F.col("event_id")
    rows = views.inputs(spark, d).withColumns({"metadata": F.when(e % 7 != 6, _pick(METADATA, e)), "mime": F.when(e % 4 == 0, "image/png"), "extension": F.lit(None).cast("string"), "size_bucket": F.when(e % 3 == 0, "small"), "unavailable_reason": F.when(e % 6 == 0, "oversized")})
    return requests.adapted(rows.withColumn("unsafe", requests.unsafe_metadata(F.col("metadata")))).select("event_id", "input_index", "mime", "extension", "size_bucket", "unavailable_reason", "unsafe")


def upload_intake(spark, d):
    p = F.col("page_id")
    rows = views.table(spark, d, "pages").select("page_id", _pick(KINDS, p).alias("file_kind"), _pick(MIMES, p).alias("mime_hint"), _pick(EXTENSIONS, F.floor(p / 4)).alias("extension_hint"), (F.octet_length(F.coalesce("html", F.lit(""))) * (p % 9) * 40).alias("size"))
    return requests.upload_intake(rows).select("page_id", "rejected", "mime", "extension", "bucket", requests.extraction_requirement(F.col("file_kind")).alias("requirement"))


def first_composer_inputs(spark, d):
    return requests.first_composer(views.inputs(spark, d).withColumn("n_matches", F.col("event_id") % 3), "event_id")


def content_unavailable_inputs(spark, d):
    e = F.col("event_id")
    rows = inputs.scan_results(views.inputs(spark, d).withColumns({"parse_status": F.when(e % 4 == 0, "parsed"), "n_matches": e % 3, "unavailable_reason": F.when(e % 5 == 0, "unsupported")}))
    return requests.content_unavailable(rows).select("event_id", "input_index", "kind", "source", "reason")


def capped_texts(spark, d):
    return requests.capped(views.requests(spark, d), COMPOSER_BYTES, PASTE_BYTES).select("request_id", "input_index", "size_bytes", F.sha2("content", 256).alias("content_sha256"), "content_included", "unavailable_reason", "limit_exceeded")


def safe_evidence(spark, d):
    k = views.k().cast("string")
    rows = views.table(spark, d, "events").select("event_id", F.concat(F.lit('["a'), k, F.lit('", 1, null, "b"]')).alias("words"), F.concat(F.lit('{"match_count": '), k, F.lit(', "other": 2, "keyword_count": "x"}')).alias("counts"), F.concat(F.lit('{"confirmed": '), views.k() - 50, F.lit(', "uncertain": 1.5, "rejected": 2}')).alias("states"))
    counts, states = requests.safe_numbers(F.col("counts"), requests.COUNT_KEYS), requests.safe_numbers(F.col("states"))
    return rows.select("event_id", F.array_join(requests.safe_strings(F.col("words")), ",").alias("keywords"), counts["match_count"].alias("match_count"), F.size(counts).alias("n_counts"), states["confirmed"].alias("confirmed"), F.size(states).alias("n_states"))


def performance_verdicts(spark, d):
    rows = views.table(spark, d, "events").select("event_id", requests.performance_verdict(views.k() - 5, views.k() % 7, _pick(OUTCOMES, F.col("event_id")), 50, 4).alias("v"))
    return rows.select("event_id", "v.*")


def audit_counts(spark, d):
    """Numbers alone of each event: detections, and files among its inputs."""
    found = views.detections(spark, d).groupBy("event_id").agg(F.sum(F.greatest(F.col("count"), F.lit(0))).alias("n"))
    files = views.inputs(spark, d).where("kind = 'file_reference'").groupBy("event_id").agg(F.count("*").alias("f"))
    rows = views.events(spark, d).select(F.col("id").alias("event_id"), "action", "risk_level").join(found, "event_id", "left").join(files, "event_id", "left")
    return rows.select("event_id", "action", "risk_level", F.coalesce("n", F.lit(0)).cast("long").alias("detection_count"), F.coalesce("f", F.lit(0)).cast("long").alias("file_count"))


def events_filtered(spark, d):
    return requests.event_filter(views.events(spark, d), action="BLOCK", risk_level="critical").select("id", "user_id", "risk_score")


def overview_chart(spark, d):
    """The last 14 buckets of a longer series."""
    return analytics.daily(views.events(spark, d), "2024-01-25", 30).orderBy(F.desc("day")).limit(14)


def active_admins(spark, d):
    """The administrators that may be removed: none while a single one is active."""
    admins = views.users(spark, d).where((F.col("user_id") % 10 == 0) & (F.col("status") == "ACTIVE"))
    return admins.select("login_id", admins.agg(F.count("*")).scalar().alias("n_admins")).withColumn("removable", F.col("n_admins") > 1)


def _atoms(spark, d):
    v = F.col("vec_id")
    vector = F.when((v % 53 != 7), F.when(v % 47 == 5, F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")).otherwise(F.col("embedding")))
    return views.table(spark, d, "embeddings").select(F.floor(v / 10).alias("input_id"), (v % 10).cast("int").alias("ordinal"), F.concat(F.lit("a"), v).alias("atom_id"), F.floor(v / 4).alias("block"), vector.alias("vector"), (v * 7).alias("start"), (v * 7 + 5).alias("end"), F.concat(F.lit("t"), v % 10).alias("text"))


def checked_segments(spark, d):
    return mapping.checked_segments(_atoms(spark, d), 0.0, 2)


def _mapped(spark, d, several=False):
    docs = views.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("input_id"), "text")
    start = F.col("start")
    block = lambda k: F.when(k % 9 == 4, "b1").otherwise("b0")
    found = each(docs, ["input_id"], spans(F.col("text"), "th"), "s", "signal_id").select("input_id", "signal_id", "s.start", "s.end")
    signals = found.select("*", F.when(start % 11 == 3, "b1").otherwise("b0").alias("block_id"), _pick(["low", "high", "info", "critical", "medium"], start).alias("severity"))
    cut = docs.select("input_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("text")) / 50).cast("int"))).alias("atom_id"))
    k = F.col("atom_id")
    atoms = cut.select("input_id", F.floor(k / 3).cast("int").alias("segment"), "atom_id", block(k).alias("block_id"), (k * 50).alias("start"), (k * 50 + 50).alias("end"))
    return mapping.mapped_signals(signals, atoms, several)


def signals_mapped(spark, d):
    return _mapped(spark, d)


def signal_sets(spark, d):
    return mapping.signal_sets(_mapped(spark, d, True))


def rules_in_order(spark, d):
    return rules.all_matches(views.table(spark, d, "documents"), CATALOGUE, "doc_id")


def restored_ranges(spark, d):
    """Sentence ends found in the normalised text, where they are in the text itself, in which every stop stands three times."""
    rows = views.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\.", "...").alias("t"))
    rule = spark.createDataFrame([("end", "regex", r"\. [A-Z]", "END", True)], rules.RULE_TABLE)
    return lexical.scan(rows.select("doc_id", F.col("t").alias("text")), rule, ["doc_id"]).select("doc_id", "start", "end")


QUERIES = [rules_in_order, restored_ranges, request_checks, adapted_inputs, upload_intake, first_composer_inputs, content_unavailable_inputs, capped_texts, safe_evidence, performance_verdicts, audit_counts, events_filtered, overview_chart, active_admins, checked_segments, signals_mapped, signal_sets]


def _list(names) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in names) + "]"


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_STRING = "CASE WHEN json_valid(metadata) AND json_type(metadata, '$.{0}') = 'VARCHAR' THEN json_extract_string(metadata, '$.{0}') END"
_SECRET = requests.SECRET_LIKE
_MAPPED = """RECURSIVE hit(input_id, text, signal_id, start) AS (SELECT doc_id, text, 0, strpos(text, 'th') - 1 FROM documents WHERE strpos(text, 'th') > 0
UNION ALL SELECT input_id, text, signal_id + 1, start + 1 + strpos(text[start + 3:], 'th') FROM hit WHERE strpos(text[start + 3:], 'th') > 0),
met AS (SELECT input_id, signal_id, ['low','high','info','critical','medium'][start % 5 + 1] AS severity, atom // 3 AS segment, count(*) AS n_atoms
  FROM (SELECT *, unnest(CASE WHEN start // 50 = (start + 1) // 50 THEN [start // 50] ELSE [start // 50, start // 50 + 1] END) AS atom FROM hit)
  WHERE (start % 11 = 3) = (atom % 9 = 4) GROUP BY ALL),
cut AS (SELECT doc_id AS input_id, unnest(generate_series(0, length(text) // 50)) AS atom FROM documents),
one AS (SELECT input_id, atom // 3 AS segment, count(DISTINCT atom % 9 = 4) = 1 AS one FROM cut GROUP BY ALL)"""

#: Without what stands before and after an address: RE2 has no lookaround.
_EMAIL = EMAIL.split(")", 1)[1].rsplit("(?!", 1)[0]
_SECRET_RULE = SECRET.replace("'", "''")

SQL = {
    "rules_in_order": f"""WITH n AS (SELECT doc_id, text, lower(array_to_string(list_transform(list_filter(generate_series(1, len(c)), lambda i: i = 1 OR c[i] <> c[i-1] OR NOT regexp_matches(c[i], '^[\\pP\\pS]$')), lambda i: c[i]), '')) AS norm
  FROM (SELECT doc_id, text, string_split(text, '') AS c FROM documents)),
m AS (SELECT doc_id, 0 AS place, 'email' AS rule_id, 'detector' AS kind, len(regexp_extract_all(text, '{_EMAIL}')) AS count, 100 AS confidence, 'BUILT_IN_DETECTOR_EMAIL' AS reason_code, 'medium' AS severity, 'MASK' AS action FROM n
UNION ALL SELECT doc_id, 1, 'k1', 'keyword', (length(norm) - length(replace(norm, 'the', ''))) // 3, 90, 'CUSTOM_KEYWORD_WORD_ONE', 'low', 'WARN' FROM n
UNION ALL SELECT doc_id, 2, 'secret', 'regex', len(regexp_extract_all(norm, '{_SECRET_RULE}')), 90, 'BUILT_IN_REGEX_API_SECRET', 'critical', 'BLOCK' FROM n
UNION ALL SELECT doc_id, 3, 'ctx', 'context_rule', CASE WHEN k >= 2 THEN k ELSE 0 END, 80, 'CUSTOM_CONTEXT_RULE_TWO_WORDS', 'high', 'MASK' FROM (SELECT doc_id, CAST(contains(norm, 'and') AS INTEGER) + CAST(contains(norm, 'tion') AS INTEGER) + CAST(contains(norm, 'que') AS INTEGER) AS k FROM n))
SELECT * REPLACE (CAST(count AS BIGINT) AS count) FROM m WHERE count > 0""",
    "restored_ranges": r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(m) AS INTEGER) AS "end" FROM (SELECT doc_id, i, regexp_extract(t[i:], '^\.+ [A-Z]') AS m FROM
  (SELECT doc_id, t, unnest(list_filter(generate_series(1, len(c)), lambda i: c[i] = '.' AND (i = 1 OR c[i - 1] <> '.'))) AS i FROM (SELECT doc_id, t, string_split(t, '') AS c FROM (SELECT doc_id, replace(text, '.', '...') AS t FROM documents)))) WHERE m <> ''""",
    "request_checks": sql(
        f"""SELECT request_id, concat_ws(',', CASE WHEN c IS NULL OR NOT regexp_full_match(c, '[A-Za-z0-9][A-Za-z0-9._:-]*') THEN 'client_request_id_pattern' END, CASE WHEN regexp_matches(c, '{_SECRET}') THEN 'client_request_id_secret_like' END,
  CASE WHEN request_id % 3 = 0 THEN 'revision_pattern' END, CASE WHEN n > 20 THEN 'too_many_inputs' END, CASE WHEN ids < n THEN 'repeated_input_id' END) AS violations
FROM (SELECT request_id, CASE request_id % 5 WHEN 0 THEN 'sk-A' || request_id WHEN 1 THEN '-x' || request_id WHEN 2 THEN NULL ELSE 'req:' || request_id END AS c, count(*) AS n, count(DISTINCT input_index % 4) AS ids FROM v_requests GROUP BY 1, 2)""",
        "v_requests",
    ),
    "adapted_inputs": sql(
        f"""SELECT event_id, input_index, CASE WHEN event_id % 4 = 0 THEN 'image/png' ELSE {_STRING.format("mime")} END AS mime, {_STRING.format("extension")} AS extension,
  CASE WHEN event_id % 3 = 0 THEN 'small' WHEN kind NOT IN ('text', 'file_reference') THEN 'unknown' END AS size_bucket, CASE WHEN event_id % 6 = 0 THEN 'oversized' WHEN kind = 'attachment_metadata' THEN 'metadata_only' END AS unavailable_reason,
  metadata IS NOT NULL AND event_id % {len(METADATA)} IN (2, 4) AS unsafe FROM (SELECT *, CASE WHEN event_id % 7 <> 6 THEN {_list(METADATA)}[event_id % {len(METADATA)} + 1] END AS metadata FROM v_inputs)""",
        "v_inputs",
    ),
    "upload_intake": f"""SELECT page_id, rejected, CASE mime WHEN 1 THEN 'text/html' WHEN 3 THEN 'image/png' END AS mime, CASE extension WHEN 1 THEN 'html' WHEN 3 THEN 'txt' WHEN 4 THEN 'x1' END AS extension,
  CASE WHEN rejected IS NULL THEN CASE WHEN size = 0 THEN 'empty' WHEN size <= 16384 THEN 'tiny' ELSE 'small' END END AS bucket, CASE WHEN kind = 'image' THEN 'ocr_required' WHEN kind = 'pdf' THEN 'native_parse_then_ocr_fallback' WHEN kind IN ('code', 'slide') THEN 'native_parse' ELSE 'metadata_only' END AS requirement
FROM (SELECT *, CASE WHEN kind = 'movie' THEN 'unsupported_kind' WHEN size > 1048576 THEN 'too_large' END AS rejected FROM (SELECT page_id, {_list(KINDS)}[page_id % 6 + 1] AS kind, page_id % 4 + 1 AS mime, page_id // 4 % 4 + 1 AS extension, octet_length(encode(coalesce(html, ''))) * (page_id % 9) * 40 AS size FROM pages))""",
    "first_composer_inputs": sql("SELECT event_id, min(input_index) AS input_index FROM v_inputs WHERE content_included AND source = 'composer' AND event_id % 3 > 0 GROUP BY 1", "v_inputs"),
    "content_unavailable_inputs": sql("SELECT event_id, input_index, kind, source, CASE WHEN event_id % 5 = 0 THEN 'unsupported' WHEN kind = 'attachment_metadata' THEN 'metadata_only' ELSE 'unavailable' END AS reason FROM v_inputs WHERE NOT (event_id % 4 = 0 OR (content_included AND kind = 'text'))", "v_inputs"),
    "capped_texts": sql(
        f"""SELECT request_id, input_index, CAST(n AS INTEGER) AS size_bytes, CASE WHEN n <= most THEN sha256(content) END AS content_sha256, n <= most AS content_included, CASE WHEN n > most THEN 'oversized' END AS unavailable_reason,
  CASE WHEN n > most THEN CASE WHEN source = 'composer' THEN 'MAX_COMPOSER_TEXT_BYTES' ELSE 'MAX_CONVERTED_PASTE_TEXT_BYTES' END END AS limit_exceeded
FROM (SELECT *, octet_length(encode(content)) AS n, CASE WHEN source = 'composer' THEN {COMPOSER_BYTES} ELSE {PASTE_BYTES} END AS most FROM v_requests)""",
        "v_requests",
    ),
    "safe_evidence": f"SELECT event_id, 'a' || k || ',b' AS keywords, CAST(k AS BIGINT) AS match_count, 1 AS n_counts, CAST(CASE WHEN k >= 50 THEN k - 50 END AS BIGINT) AS confirmed, CASE WHEN k >= 50 THEN 2 ELSE 1 END AS n_states FROM (SELECT event_id, {_K} AS k FROM events)",
    "performance_verdicts": f"""WITH s AS (SELECT event_id, {_K} - 5 AS elapsed, {_K} % 7 AS units, {_list(OUTCOMES)}[event_id % {len(OUTCOMES)} + 1] AS outcome FROM events),
c AS (SELECT *, CASE WHEN elapsed < 0 THEN 'MALFORMED_SAMPLE' WHEN units = 0 THEN 'EMPTY_SAMPLE' WHEN outcome <> 'ok' THEN upper(outcome) END AS code FROM s)
SELECT event_id, CASE WHEN code IS NOT NULL THEN 'failed' WHEN elapsed <= 50 AND units <= 4 THEN 'passed' ELSE 'budget_exceeded' END AS status, CASE WHEN code IS NOT NULL THEN 'unknown' WHEN elapsed <= 50 THEN 'within_budget' ELSE 'over_budget' END AS latency_bucket,
  CASE WHEN code = 'EMPTY_SAMPLE' THEN 'empty' WHEN code IS NOT NULL THEN 'unknown' WHEN units <= 4 THEN 'within_budget' ELSE 'over_budget' END AS size_bucket, 'PERFORMANCE_' || code AS failure_code FROM c""",
    "audit_counts": sql("SELECT id AS event_id, action, risk_level, CAST(coalesce((SELECT sum(count) FROM v_detections d WHERE d.event_id = e.id), 0) AS BIGINT) AS detection_count, (SELECT count(*) FROM v_inputs i WHERE i.event_id = e.id AND kind = 'file_reference') AS file_count FROM v_events e", "v_events", "v_detections", "v_inputs"),
    "events_filtered": sql("SELECT id, user_id, risk_score FROM v_events WHERE action = 'BLOCK' AND risk_level = 'critical'", "v_events"),
    "overview_chart": sql(
        "SELECT day, count(id) AS n, "
        + ", ".join(f"CAST(count_if(action = '{a}') AS BIGINT) AS {a.lower()}" for a in ("ALLOW", "WARN", "MASK", "BLOCK"))
        + ", count(DISTINCT user_id) AS users FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-12', DATE '2024-01-25', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN v_events e ON CAST(e.created_at AS DATE) = s.day GROUP BY 1",
        "v_events",
    ),
    "active_admins": sql("SELECT login_id, count(*) OVER () AS n_admins, count(*) OVER () > 1 AS removable FROM v_users WHERE user_id % 10 = 0 AND status = 'ACTIVE'", "v_users"),
    "checked_segments": """WITH RECURSIVE atoms AS (SELECT vec_id, vec_id // 10 AS input_id, vec_id % 10 AS i, vec_id // 4 AS block, CAST(embedding AS DOUBLE[]) AS v, bool_or(vec_id % 53 = 7 OR vec_id % 47 = 5) OVER w AS failed, count(*) OVER w AS n FROM embeddings WINDOW w AS (PARTITION BY vec_id // 10)),
want AS (SELECT *, coalesce(lead(block) OVER w <> block, false) OR (NOT failed AND coalesce(list_cosine_similarity(v, lead(v) OVER w) < 0.0, false)) AS cut, CASE WHEN failed THEN 1 ELSE 2 END AS least FROM atoms WINDOW w AS (PARTITION BY input_id ORDER BY i)),
walk AS (SELECT input_id, i, CASE WHEN cut AND i + 1 >= least AND n - i - 1 >= least THEN i ELSE -1 END AS last FROM want WHERE i = 0
  UNION ALL SELECT w.input_id, w.i, CASE WHEN w.cut AND w.i - k.last >= w.least AND w.n - w.i - 1 >= w.least THEN w.i ELSE k.last END FROM walk k JOIN want w ON w.input_id = k.input_id AND w.i = k.i + 1),
seg AS (SELECT w.*, coalesce(count(*) FILTER (k.last = k.i) OVER (PARTITION BY w.input_id ORDER BY w.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM want w JOIN walk k USING (input_id, i))
SELECT input_id, CAST(segment AS INTEGER) AS segment, 'seg_' || substr(sha256(input_id || ':a' || min(vec_id) || ':a' || max(vec_id) || ':' || segment), 1, 16) AS segment_id, CASE WHEN count(*) = 1 THEN 'single_atom' WHEN failed THEN 'structure' ELSE 'semantic' END AS segment_type,
  CAST(count(*) AS INTEGER) AS n_atoms, min(vec_id) * 7 AS start, max(vec_id) * 7 + 5 AS "end", string_agg('t' || i, '' ORDER BY i) AS text, failed FROM seg GROUP BY input_id, segment, failed""",
    "signals_mapped": f"""WITH {_MAPPED}, f AS (SELECT *, row_number() OVER (PARTITION BY input_id, signal_id ORDER BY segment) AS nth FROM met)
SELECT input_id, CAST(signal_id AS INTEGER) AS signal_id, severity, CAST(segment AS INTEGER) AS segment, n_atoms, CASE WHEN one THEN 'offset_overlap' ELSE 'atom_membership' END AS basis FROM f JOIN one USING (input_id, segment) WHERE nth = 1""",
    "signal_sets": f"WITH {_MAPPED} SELECT input_id, CAST(segment AS INTEGER) AS segment, count(*) AS signal_count, max_by(severity, list_position(['info','low','medium','high','critical'], severity)) AS max_severity FROM met GROUP BY 1, 2",
}
