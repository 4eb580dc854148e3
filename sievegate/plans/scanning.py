"""Queries over the scan with many rules, the verifier and the outcome of requests, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.operators import lexical, verifier
from sievegate.sources import views

LONG_WORD = "[A-Za-z]{5,}"
BAD = [("bad:open", "("), ("bad:star", "*a")]


def _rules(spark, d):
    """A keyword and a regex of every long word of the benchmark, and two that do not compile."""
    words = views.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(LONG_WORD), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    rule = lambda tag, kind, expression: words.select(F.concat(F.lit(tag), "w").alias("pattern_id"), F.lit(kind).alias("kind"), expression.alias("expression"), F.lit("WORD").alias("signal_type"), F.lit(False).alias("case_sensitive"))
    bad = spark.createDataFrame([(p, "regex", x, "WORD", False) for p, x in BAD], "pattern_id string, kind string, expression string, signal_type string, case_sensitive boolean")
    return rule("k:", "keyword", F.col("w")).unionByName(rule("r:", "regex", F.concat("w", F.lit("[.,]")))).unionByName(bad)


def _blocks(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text")


def lexical_signals(spark, d):
    found = lexical.scan(_blocks(spark, d).withColumn("block_id", F.lit("b0")), _rules(spark, d), ["doc_id", "block_id"])
    return lexical.with_signal_id(found, "doc_id", "block_id").select("doc_id", "pattern_id", "n_start", "n_end", "start", "end", "signal_id")


def lexical_status(spark, d):
    blocks, rules = _blocks(spark, d), _rules(spark, d)
    return lexical.scan_status(blocks, lexical.scan(blocks, rules, ["doc_id"]), lexical.warnings(rules), "doc_id")


def lexical_warnings(spark, d):
    return lexical.warnings(_rules(spark, d))


LABELS = ["SECRET_CREDENTIAL_CONTEXT", "PERSONAL_DATA_CONTEXT", "INTERNAL_OPERATION_CONTEXT", "unknown_label", "HALF_DEFINED"]
DEFINITIONS = [("SECRET_CREDENTIAL_CONTEXT", "a secret", "no secret", "an example", 0.5), ("PERSONAL_DATA_CONTEXT", "a person", "nobody", "a role", 0.52), ("INTERNAL_OPERATION_CONTEXT", "inside", "outside", "press", 0.49), ("HALF_DEFINED", "x", "y", "z", None)]
WEIGHTS = {"th": 9.0, "er": -7.5, "de": 6.0, "que": -3.0}
BROKEN, ODD = "%%%", "| "


class Touchy(verifier.LinearScorer):
    """A scorer that raises on some texts and gives scores above 1 on others."""

    def score(self, pairs, max_length_tokens):
        if any(BROKEN in p for p in pairs):
            raise ValueError("unreadable")
        return [x + 1 if ODD in p else x for x, p in zip(super().score(pairs, max_length_tokens), pairs, strict=True)]


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _verified(spark, d):
    i = F.col("doc_id")
    docs = views.table(spark, d, "documents").select(F.floor(i / 3).alias("input_id"), (i % 3).cast("int").alias("ord"), i.alias("segment_id"), F.when(i % 13 == 4, F.lit("  \n ")).otherwise(F.col("text")).alias("text"))
    candidates = docs.select("input_id", "ord", "segment_id", _pick(LABELS, F.col("segment_id")).alias("label"))
    definitions = spark.createDataFrame(DEFINITIONS, "label string, positive string, negative string, boundary string, threshold double")
    segments = docs.where(F.col("segment_id") % 17 != 6)
    return verifier.verify(verifier.requested(candidates, segments), definitions, "touchy-1", lambda: Touchy(WEIGHTS, -0.02))


def verifications(spark, d):
    return _verified(spark, d)[0].select("input_id", "ord", "segment_id", "label", "status", "accepted", F.round("confidence", 6).alias("confidence"), "reason")


def verifier_failures(spark, d):
    return _verified(spark, d)[1]


CODES = ["OFFSET_MAPPING_FAILED", "ATOMIZER_EMPTY", "EMBEDDING_FAILED"]


def request_outcomes(spark, d):
    """Requests of several inputs of which some fail, at their first, middle and last place."""
    k = F.col("request_id") * 5 + F.col("input_index") * 3
    rows = views.requests(spark, d).select(
        "request_id", "input_index", F.when(k % 7 != 6, F.col("content")).otherwise("  ").alias("content"), F.when(k % 19 == 5, _pick(CODES, k)).alias("stage_failure"), F.when(k % 23 == 7, F.lit("CLASSIFIER_TIMEOUT")).alias("classifier_failure"),
        (k % 4).cast("long").alias("n_candidates"), F.when(k % 17 == 2, F.lit("VERIFIER_MODEL_FAILED")).alias("verifier_failure"), F.when(F.col("request_id") % 6 != 5, k % 3).cast("long").alias("accepted_count"))
    r = F.col("request_id")
    providers = rows.select("request_id").distinct().select("request_id", (r % 11 != 10).alias("enabled"), (r % 13 != 12).alias("available"), F.when(r % 2 == 0, F.lit("CLASSIFIER_ARTIFACT_MISSING")).alias("provider_failure"))
    return verifier.outcomes(rows, providers)


QUERIES = [verifications, verifier_failures, request_outcomes, lexical_signals, lexical_status, lexical_warnings]

_SIGNALS = f"""w AS (SELECT DISTINCT lower(x) AS w FROM (SELECT unnest(regexp_extract_all(text, '{LONG_WORD}')) AS x FROM benchmark)),
n AS MATERIALIZED (SELECT doc_id, lower(array_to_string(list_transform(kept, lambda i: c[i]), '')) AS low, list_append(kept, len(c) + 1) AS kept
  FROM (SELECT doc_id, c, list_filter(generate_series(1, len(c)), lambda i: i = 1 OR c[i] <> c[i-1] OR NOT regexp_matches(c[i], '^[\\pP\\pS]$')) AS kept FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE text IS NOT NULL))),
h AS MATERIALIZED (SELECT n.doc_id, w.w, n.low FROM n JOIN w ON contains(n.low, w.w)),
g AS (SELECT doc_id, 'k:' || w AS pattern_id, length(w) AS size, list_transform(string_split(low, w), lambda x: length(x)) AS g FROM h
  UNION ALL SELECT doc_id, 'r:' || w, length(w) + 1, list_transform(string_split_regex(low, w || '[.,]'), lambda x: length(x)) FROM h),
p AS (SELECT doc_id, pattern_id, size, unnest(list_transform(generate_series(1, len(g) - 1), lambda i: list_sum(g[1:i]) + (i - 1) * size)) AS s FROM g WHERE len(g) > 1),
signals AS MATERIALIZED (SELECT doc_id, pattern_id, CAST(s AS INTEGER) AS n_start, CAST(s + size AS INTEGER) AS n_end, CAST(kept[CAST(s + 1 AS BIGINT)] - 1 AS INTEGER) AS start, CAST(kept[CAST(s + size + 1 AS BIGINT)] - 1 AS INTEGER) AS "end" FROM p JOIN n USING (doc_id))"""

_SPACE = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_TIDY = lambda x: f"regexp_replace({x}, '{_SPACE}+', ' ', 'g')"
#: Of t (id, text): c (id, n, chunk), in order.
CHUNKS = f"""s0 AS (SELECT id, {_STRIP("text")} AS t FROM t),
w0 AS (SELECT id, 0 AS part, k, {_STRIP("substr(t, CAST(k + 1 AS BIGINT), 900)")} AS chunk FROM s0, LATERAL (SELECT unnest(CASE WHEN length(t) <= 900 THEN [0] ELSE range(0, length(t) - 120, 780) END) AS k)
  UNION ALL SELECT id, 1, i, {_STRIP("l[i]")} FROM (SELECT id, string_split_regex(t, '\\r\\n|[\\n-\\r\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM s0 WHERE length(t) > 900), LATERAL (SELECT unnest(generate_series(1, len(l))) AS i) WHERE length({_STRIP("l[i]")}) BETWEEN 80 AND 900),
k0 AS (SELECT id, {_TIDY("chunk")} AS key, min((part, k)) AS place, arg_min(chunk, (part, k)) AS chunk FROM w0 WHERE chunk <> '' GROUP BY 1, 2),
c AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS n, chunk FROM k0 QUALIFY n < 8)"""
_QUOTED = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
_Z = " + ".join(["-0.02", *[f"{w} * ((length(chunk) - length(replace(chunk, '{x}', ''))) // {len(x)}) / length(chunk)" for x, w in WEIGHTS.items()]])
_VERIFIED = f"""d AS (SELECT doc_id // 3 AS input_id, CAST(doc_id % 3 AS INTEGER) AS ord, doc_id AS segment_id, [{", ".join(map(repr, LABELS))}][doc_id % {len(LABELS)} + 1] AS label,
  CASE WHEN doc_id % 17 = 6 THEN '' WHEN doc_id % 13 = 4 THEN ' ' ELSE coalesce(text, '') END AS text FROM documents),
t AS (SELECT segment_id AS id, text FROM d),
{CHUNKS},
p AS (SELECT id, max(1 / (1 + exp(-({_Z})))) AS confidence, bool_or(contains(chunk, '{BROKEN}')) AS broken, bool_or(contains(chunk, '{ODD}')) AS odd FROM c GROUP BY 1),
v AS (SELECT d.*, threshold, p.confidence, CASE WHEN threshold IS NOT NULL AND broken THEN 'VERIFIER_MODEL_FAILED' WHEN threshold IS NOT NULL AND odd THEN 'VERIFIER_INVALID_SCORE' END AS error, p.id IS NULL AS blank
  FROM d LEFT JOIN (VALUES {_QUOTED(DEFINITIONS)}) x(label, positive, negative, boundary, threshold) USING (label) LEFT JOIN p ON p.id = d.segment_id)"""

SQL = {
    "verifications": f"""WITH {_VERIFIED} SELECT input_id, ord, segment_id, label, CASE WHEN blank THEN 'failed' WHEN threshold IS NULL THEN 'uncertain' WHEN confidence >= threshold THEN 'confirmed' ELSE 'rejected' END AS status,
  NOT blank AND threshold IS NOT NULL AND confidence >= threshold AS accepted, CASE WHEN NOT blank AND threshold IS NOT NULL THEN round(confidence, 6) END AS confidence,
  CASE WHEN blank THEN 'VERIFIER_TEXT_UNAVAILABLE' WHEN threshold IS NULL THEN 'VERIFIER_LABEL_DEFINITION_MISSING' WHEN confidence >= threshold THEN 'VERIFIER_CONFIRMED' ELSE 'VERIFIER_REJECTED' END AS reason
FROM v WHERE input_id NOT IN (SELECT input_id FROM v WHERE error IS NOT NULL)""",
    "verifier_failures": f"WITH {_VERIFIED} SELECT input_id, arg_min(error, ord) AS failure_code FROM v WHERE error IS NOT NULL GROUP BY 1",
    "request_outcomes": views.sql(f""", x AS (SELECT request_id AS r, input_index AS i, request_id * 5 + input_index * 3 AS k, content FROM v_requests),
y AS (SELECT r, i, k % 4 AS n, CASE WHEN k % 19 = 5 THEN 0 WHEN k % 23 = 7 THEN 1 WHEN k % 17 = 2 AND k % 4 > 0 THEN 2 END AS how, CASE WHEN k % 19 = 5 THEN [{", ".join(map(repr, CODES))}][k % 3 + 1] WHEN k % 23 = 7 THEN 'CLASSIFIER_TIMEOUT' WHEN k % 17 = 2 THEN 'VERIFIER_MODEL_FAILED' END AS code,
  CASE WHEN r % 6 <> 5 THEN k % 3 END AS acc FROM x WHERE k % 7 <> 6 AND regexp_matches(content, '[^ \\s]')),
f AS (SELECT r, list({{'i': i, 'h': how, 'c': code}} ORDER BY i)[1] AS f FROM y WHERE how IS NOT NULL GROUP BY r),
s AS (SELECT y.r, any_value(f.h) AS h, any_value(f.c) AS c, count(*) FILTER (coalesce(f.h, 3) > 0 AND (f IS NULL OR y.i < f.i OR (y.i = f.i AND f.h = 2))) AS nc, sum(n) FILTER (coalesce(f.h, 3) > 0 AND (f IS NULL OR y.i < f.i OR (y.i = f.i AND f.h = 2))) AS cc,
  count(*) FILTER (coalesce(f.h, 3) > 1 AND (f IS NULL OR y.i < f.i) AND n > 0 AND acc IS NOT NULL) AS nv, sum(acc) FILTER (coalesce(f.h, 3) > 1 AND (f IS NULL OR y.i < f.i) AND n > 0) AS ac FROM y LEFT JOIN f USING (r) GROUP BY y.r),
z AS (SELECT DISTINCT r, r % 11 <> 10 AS enabled, r % 13 <> 12 AS available FROM x)
SELECT r AS request_id, enabled, CASE WHEN enabled AND NOT available THEN CASE WHEN r % 2 = 0 THEN 'CLASSIFIER_ARTIFACT_MISSING' ELSE 'ANALYZE_CLASSIFIER_FAILED' END WHEN enabled THEN c END AS failure_code, enabled AND available AND (coalesce(h, 3) = 2 OR coalesce(cc, 0) > 0) AS has_candidates,
  CAST(CASE WHEN enabled AND available THEN coalesce(nc, 0) ELSE 0 END AS BIGINT) AS n_classified, CAST(CASE WHEN enabled AND available THEN coalesce(cc, 0) ELSE 0 END AS BIGINT) AS candidate_count,
  CAST(CASE WHEN enabled AND available THEN coalesce(nv, 0) ELSE 0 END AS BIGINT) AS n_verified, CAST(CASE WHEN enabled AND available THEN coalesce(ac, 0) ELSE 0 END AS BIGINT) AS accepted_count FROM z LEFT JOIN s USING (r)""", "v_requests"),
    "lexical_signals": f"""WITH {_SIGNALS} SELECT *, 'sig_' || substr(sha256(concat_ws(':', doc_id, 'b0', pattern_id, n_start, n_end)), 1, 20) AS signal_id FROM signals""",
    "lexical_status": f"""WITH {_SIGNALS} SELECT doc_id, count(pattern_id) AS n_signals, CAST(0 AS BIGINT) AS n_failures, 'partial' AS scanner_status FROM documents LEFT JOIN signals USING (doc_id) GROUP BY doc_id""",
    "lexical_warnings": "SELECT * FROM (VALUES ('bad:open', 'INVALID_REGEX:bad:open'), ('bad:star', 'INVALID_REGEX:bad:star')) t(pattern_id, warning)",
}
