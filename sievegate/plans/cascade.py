"""Queries over atoms, segments and the evidence of the model cascade, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions.spans import each, spans
from sievegate.operators import atoms, evidence, inputs, policy, rules, segments
from sievegate.sources import views
from sievegate.sources.views import sql

LABELS = ["SECRET_CREDENTIAL_CONTEXT", "PERSONAL_DATA_CONTEXT", "INTERNAL_OPERATION_CONTEXT", "synthetic_example"]


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def atoms_bounded(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("input_id"), F.lit("b0").alias("block_id"), F.lit(0).alias("block_order"), F.lit("text").alias("source_type"), "text")
    return atoms.atoms(docs).select("input_id", "ordinal", "atom_id", "atom_type", "start", "end")


def _broken(spark, d):
    v = F.col("vec_id")
    rows = views.table(spark, d, "embeddings").select(F.floor(v / 10).alias("input_id"), (v % 10).cast("int").alias("ordinal"), F.lit("b").alias("block"), F.col("embedding").alias("vector"), (v % 7 * 150 + 50).alias("n_chars"))
    return segments.with_breaks(rows, -0.1)


def segment_target_split(spark, d):
    return segments.split_large(_broken(spark, d), 1000).select("input_id", "ordinal", "segment")


def segment_refill(spark, d):
    return segments.refill(_broken(spark, d), 1500)


def signal_segment_map(spark, d):
    docs = views.table(spark, d, "documents").where("text IS NOT NULL")
    signals = each(docs.withColumnRenamed("doc_id", "input_id"), ["input_id"], spans(F.col("text"), "the"), "s", "signal_id").select("input_id", "signal_id", "s.start", "s.end")
    cut = docs.select(F.col("doc_id").alias("input_id"), F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 500).cast("int"))).alias("segment"))
    return inputs.signals_to_segments(signals, cut.withColumns({"start": F.col("segment") * 500, "end": F.col("segment") * 500 + 500}))


def _candidates(spark, d):
    v = F.col("vec_id")
    return views.table(spark, d, "embeddings").select(F.floor(v / 4).alias("request_id"), _pick(LABELS, v).alias("label"), (v * 37 % 100 / 100).alias("score"), v)


def _verifications(spark, d):
    status = _pick(evidence.STATUSES, F.col("vec_id") * 3 + F.floor(F.col("vec_id") / 8))
    rows = _candidates(spark, d).where("score >= 0.3").withColumn("status", status)
    return rows.select("request_id", "label", "status", ((F.col("status") == "confirmed") & (F.col("vec_id") % 3 > 0)).alias("accepted"), F.when(F.col("status").isin("confirmed", "rejected"), F.col("score")).alias("confidence"))


def classifier_summary(spark, d):
    return evidence.classified(_candidates(spark, d), "request_id")


def verifier_summary(spark, d):
    return evidence.verified(_verifications(spark, d), "request_id").withColumn("labels", F.array_join("labels", ","))


def _context(spark, d):
    requests = _candidates(spark, d).select("request_id").distinct()
    r = F.col("request_id")
    failures = requests.where("request_id % 6 = 0").select("request_id", F.lit(0).alias("input_index"), F.when(r % 12 == 0, "verifier_timeout").otherwise("scorer_error").alias("failure_code"))
    return evidence.context(requests, _candidates(spark, d).where("score >= 0.3"), _verifications(spark, d), failures)


def context_evidence(spark, d):
    return _context(spark, d).select("request_id", "candidate_count", "accepted_count", "uncertain", F.array_join("labels", ",").alias("labels"), "highest_score_bucket", "highest_confidence_bucket", "failure_code", "status", "reason_code")


def _catalogue(spark):
    return spark.createDataFrame(rules.CONTEXT, "detector_key string, severity string, action string")


def context_label_rules(spark, d):
    return evidence.label_rules(_context(spark, d), _catalogue(spark)).select("request_id", "ord", "action", "severity", "reason")


def policy_decide_context(spark, d):
    found = _context(spark, d)
    requests = found.select("request_id", F.when(F.col("request_id") % 10 == 9, 0).otherwise(1).alias("n_inputs"), F.when(F.col("request_id") % 7 == 0, F.array(F.lit("PARSER_OR_OCR_FAILED"))).alias("codes"), (F.col("request_id") % 5 > 0).alias("all_scanned"))
    failures = evidence.failure_rules(requests, policy.SETTINGS)
    return policy.decide_requests(requests.select("request_id", "n_inputs"), evidence.label_rules(found, _catalogue(spark)), context=found, failures=failures)


def context_basis_upgrade(spark, d):
    rows = inputs.scan_results(views.inputs(spark, d).withColumns({"parse_status": F.lit(None).cast("string"), "n_matches": F.col("event_id") % 3, "request_id": F.col("event_id")}))
    decided = rows.select("request_id").distinct().select("request_id", F.when(F.col("request_id") % 4 > 0, "RISK_CONTEXT_VERIFIER_CONFIRMED").otherwise("NO_RISK_DETECTED").alias("reason_code"), F.when(F.col("request_id") % 5 > 0, "verified").otherwise("candidate").alias("status"), (F.col("request_id") % 2).alias("accepted_count"))
    return evidence.upgraded_basis(rows, decided).select("event_id", "input_index", "decision_basis")


def evidence_codes(spark, d):
    e = F.col("event_id")
    rows = views.inputs(spark, d).withColumns({"request_id": e, "unavailable_reason": F.when(e % 3 == 0, "unsupported"), "parse_status": F.when(e % 5 == 0, "parsed").when(e % 11 == 0, "timeout"), "failure_code": F.lit(None).cast("string")})
    return evidence.codes(rows).select("request_id", F.array_join("codes", ",").alias("codes"))


QUERIES = [atoms_bounded, segment_target_split, segment_refill, signal_segment_map, classifier_summary, verifier_summary, context_evidence, context_label_rules, policy_decide_context, context_basis_upgrade, evidence_codes]

_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_STATUS = "[" + ", ".join(f"'{x}'" for x in evidence.STATUSES) + "]"
_BROKEN = """pairs AS (SELECT vec_id // 10 AS input_id, CAST(vec_id % 10 AS INTEGER) AS ordinal, vec_id % 7 * 150 + 50 AS n_chars, list_cosine_similarity(lag(CAST(embedding AS DOUBLE[])) OVER w, CAST(embedding AS DOUBLE[])) AS cosine FROM embeddings WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id)),
seg AS (SELECT *, coalesce(cosine < -0.1, false) AS breaks, sum(CAST(coalesce(cosine < -0.1, false) AS INTEGER)) OVER (PARTITION BY input_id ORDER BY ordinal) AS s FROM pairs)"""
_CAND = f"cand AS (SELECT vec_id, vec_id // 4 AS request_id, {_LIST}[vec_id % {len(LABELS)} + 1] AS label, vec_id * 37 % 100 / 100 AS score FROM embeddings)"
_VER = f"""ver AS (SELECT *, status = 'confirmed' AND vec_id % 3 > 0 AS accepted, CASE WHEN status IN ('confirmed', 'rejected') THEN score END AS confidence
  FROM (SELECT *, {_STATUS}[(vec_id * 3 + vec_id // 8) % {len(evidence.STATUSES)} + 1] AS status FROM cand WHERE score >= 0.3))"""
_BUCKET = "CASE WHEN max({0}) >= {1} THEN 'very_high' WHEN max({0}) >= 0.75 THEN 'high' WHEN max({0}) IS NOT NULL THEN 'candidate' END"
_VSUM = (
    "SELECT request_id, CAST(count_if(accepted) AS BIGINT) AS accepted_count, "
    + ", ".join(f"CAST(count_if(status = '{s}') AS BIGINT) AS {s}" for s in evidence.STATUSES)
    + f", coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (accepted), '') AS labels, {_BUCKET.format('confidence', 0.95)} AS highest_confidence_bucket FROM ver GROUP BY 1"
)
_CONTEXT = f"""{_CAND}, {_VER}, v AS ({_VSUM}), c AS (SELECT request_id, count(*) AS candidate_count, {_BUCKET.format("score", 0.9)} AS highest_score_bucket FROM cand WHERE score >= 0.3 GROUP BY 1),
base AS (SELECT request_id, coalesce(candidate_count, 0) AS candidate_count, coalesce(accepted_count, 0) AS accepted_count, coalesce(uncertain, 0) AS uncertain, coalesce(labels, '') AS labels, highest_score_bucket, highest_confidence_bucket,
  CASE WHEN request_id % 12 = 0 THEN 'verifier_timeout' WHEN request_id % 6 = 0 THEN 'scorer_error' END AS failure_code FROM (SELECT DISTINCT request_id FROM cand) LEFT JOIN c USING (request_id) LEFT JOIN v USING (request_id)),
ctx AS (SELECT *, CASE failure_code WHEN 'verifier_timeout' THEN 'timeout' WHEN 'scorer_error' THEN 'failed' ELSE CASE WHEN accepted_count > 0 THEN 'verified' WHEN candidate_count > 0 THEN 'candidate' ELSE 'no_candidate' END END AS status,
  CASE WHEN failure_code = 'verifier_timeout' THEN 'RISK_CONTEXT_LR_ONLY_VERIFIER_TIMEOUT' WHEN failure_code = 'scorer_error' THEN 'RISK_CONTEXT_LR_ONLY_VERIFIER_FAILED' WHEN accepted_count > 0 THEN 'RISK_CONTEXT_VERIFIER_CONFIRMED'
  WHEN candidate_count > 0 AND uncertain > 0 THEN 'RISK_CONTEXT_VERIFIER_UNCERTAIN' WHEN candidate_count > 0 THEN 'RISK_CONTEXT_LR_ONLY' ELSE 'NO_RISK_DETECTED' END AS reason_code FROM base)"""
_RULES = "r(k, severity, action) AS (VALUES " + ", ".join(f"('{k}', '{s}', '{a.lower()}')" for k, s, a in rules.CONTEXT) + ")"
_LABELLED = f"{_CONTEXT}, {_RULES}, lr AS (SELECT request_id, CAST(i - 1 AS INTEGER) AS ord, action, severity, reason_code AS reason FROM (SELECT *, string_split(labels, ',') AS ls, unnest(generate_series(1, len(string_split(labels, ',')))) AS i FROM ctx WHERE status IN ('verified', 'candidate') AND labels <> '') x JOIN r ON r.k = x.ls[i])"

SQL = {
    "segment_target_split": f"""WITH {_BROKEN}, g AS (SELECT *, sum(n_chars) OVER (PARTITION BY input_id, s) AS chars, row_number() OVER (PARTITION BY input_id, s ORDER BY ordinal) AS nth FROM seg),
h AS (SELECT *, row_number() OVER (PARTITION BY input_id, s, nth > 1 ORDER BY cosine, ordinal) AS weak FROM g)
SELECT input_id, ordinal, CAST(sum(CASE WHEN breaks OR (chars > 1000 AND nth > 1 AND weak = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY input_id ORDER BY ordinal) AS INTEGER) AS segment FROM h""",
    "signal_segment_map": """WITH RECURSIVE hit(input_id, text, signal_id, start) AS (SELECT doc_id, text, 0, strpos(text, 'the') - 1 FROM documents WHERE strpos(text, 'the') > 0
UNION ALL SELECT input_id, text, signal_id + 1, start + 2 + strpos(text[start + 4:], 'the') FROM hit WHERE strpos(text[start + 4:], 'the') > 0)
SELECT input_id, CAST(signal_id AS INTEGER) AS signal_id, CAST(start // 500 AS INTEGER) AS segment FROM hit""",
    "classifier_summary": f"""WITH {_CAND} SELECT request_id, count(*) AS candidate_count, {_BUCKET.format("score", 0.9)} AS highest_score_bucket, CAST(count_if(label = 'SECRET_CREDENTIAL_CONTEXT') AS BIGINT) AS risk,
CAST(count_if(label = 'synthetic_example') AS BIGINT) AS suppressor, CAST(0 AS BIGINT) AS code, CAST(count_if(label = 'PERSONAL_DATA_CONTEXT') AS BIGINT) AS pii_relevance, CAST(count_if(label = 'INTERNAL_OPERATION_CONTEXT') AS BIGINT) AS other FROM cand GROUP BY 1""",
    "verifier_summary": f"WITH {_CAND}, {_VER} {_VSUM}",
    "context_evidence": f"WITH {_CONTEXT} SELECT * FROM ctx",
    "context_label_rules": f"WITH {_LABELLED} SELECT * FROM lr",
    "policy_decide_context": f"""WITH {_LABELLED}, ev AS (SELECT * FROM lr UNION ALL SELECT request_id, 1000001, 'warn', 'medium', 'PARSER_OR_OCR_FAILED' FROM ctx WHERE request_id % 7 = 0 UNION ALL SELECT request_id, 1000002, 'warn', 'medium', 'CONTENT_NOT_SCANNED' FROM ctx WHERE request_id % 5 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY list_position(['allow','warn','mask','block'], action) DESC, list_position(['info','low','medium','high','critical'], severity) DESC, ord) AS n FROM ev)
SELECT x.request_id, CASE WHEN b.action IS NOT NULL THEN b.action WHEN x.request_id % 10 = 9 THEN 'allow' WHEN counts THEN 'warn' ELSE 'allow' END AS action,
  CASE WHEN b.action IS NOT NULL THEN b.reason WHEN x.request_id % 10 = 9 THEN 'EMPTY_INPUT' WHEN counts THEN reason_code ELSE 'NO_RISK_DETECTED' END AS reason_code,
  CASE WHEN b.action IS NOT NULL THEN b.severity WHEN x.request_id % 10 = 9 THEN 'info' WHEN counts THEN 'medium' ELSE 'info' END AS severity
FROM (SELECT *, (status = 'verified' AND accepted_count > 0) OR (status IN ('timeout', 'failed') AND candidate_count + accepted_count > 0) AS counts FROM ctx) x LEFT JOIN b ON b.request_id = x.request_id AND b.n = 1""",
    "context_basis_upgrade": sql(
        """SELECT event_id, input_index, CASE WHEN scanned AND event_id % 3 > 0 THEN 'detection' WHEN scanned AND event_id % 4 > 0 AND event_id % 5 > 0 AND event_id % 2 > 0 THEN 'context_risk' WHEN scanned THEN 'no_detection' WHEN kind = 'attachment_metadata' THEN 'metadata_only' ELSE 'content_unavailable' END AS decision_basis
FROM (SELECT *, content_included AND kind = 'text' AS scanned FROM v_inputs)""",
        "v_inputs",
    ),
    "evidence_codes": sql(
        """SELECT event_id AS request_id, string_agg(code, ',' ORDER BY pos) AS codes FROM (SELECT event_id, code, min(input_index) AS pos FROM (SELECT event_id, input_index, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'PARSER_OR_OCR_FAILED' WHEN event_id % 3 = 0 THEN 'UNSUPPORTED_FILE' WHEN NOT content_included THEN 'CONTENT_NOT_SCANNED' END AS code FROM v_inputs) WHERE code IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
        "v_inputs",
    ),
}
