"""Queries over what is refused before the rules: keys of metadata and messages, bodies of requests; and meaningful characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import keys, scalars
from sievegate.operators import temp_store
from sievegate.sources import views, wire

#: Messages with escaped, nested and case-folded keys, keys in values, and texts that are no JSON. X stands for a number.
MESSAGES = [
    '{"mime": "a/b", "n": X}', '{"\\u006eame": "X"}', '{"a": [{"b": {"PATH": X}}, 3]}', '{"note": "\\"url\\": X"}', '{"a": [[[{"ﬁlename": X}]]]}', '{"vector": [X, 1], "Text": {"text": {"deep": X}}}', '{"prompts": X}', "{no json X",
    '[{"Raw_Prompt": X, "fileName": "f"}, {"text": [X]}]', '{"name, x": X}', '{"a": {"name ": X}, "MASKED_PROMPT": null, "masked_prompt": X}', '"text"',
]
BODY = 400


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _messages(spark, d):
    e = F.col("event_id")
    return views.table(spark, d, "events").select("event_id", F.when(e % 41 != 7, F.replace(_pick(MESSAGES, e), F.lit("X"), views.k().cast("string"))).alias("m"))


def forbidden_keys(spark, d):
    m = F.col("m")
    listed = lambda c: F.array_join(c, ",")
    return _messages(spark, d).select("event_id", keys.unsafe_metadata(m).alias("unsafe"), listed(keys.found_keys(m, keys.WORKER_KEYS)).alias("worker_keys"), listed(keys.found_keys(m, keys.DIAGNOSTIC_KEYS, fold=False)).alias("diagnostic_keys"))


def redacted_diagnostics(spark, d):
    """The messages of diagnostics with their values blanked; what is left of them has no forbidden value."""
    return _messages(spark, d).select("event_id", keys.redacted(F.col("m")).alias("redacted")).where("redacted IS NOT NULL")


def _bodies(spark, d):
    rows = views.table(spark, d, "conversations").select("conv_id", "turn", F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", ""), 1, 500).alias("t"))
    k = F.col("conv_id") * 3 + F.col("turn")
    inputs = F.when(k % 9 == 4, F.lit("5")).otherwise(F.concat(F.lit('[{"input_id": "i", "size_bytes": '), F.length("t"), F.lit(', "content": "'), "t", F.lit('"}]')))
    body = F.concat(F.lit('{"client_request_id": "r'), "conv_id", F.lit("-"), "turn", F.lit('", "extra": [1], "inputs": '), inputs, F.lit("}"))
    return rows.select("conv_id", "turn", F.when(k % 7 == 3, F.substring(body, 1, 30)).when(k % 31 == 5, F.lit("")).otherwise(body).alias("value"))


def guarded_requests(spark, d):
    return wire.guarded(_bodies(spark, d), most=BODY).select("conv_id", "turn", "size_bytes", "verdict", "request.client_request_id", F.element_at("request.inputs", 1)["size_bytes"].alias("content_bytes"))


def guarded_counts(spark, d):
    return wire.counted(wire.guarded(_bodies(spark, d), most=BODY))


def meaningful_characters(spark, d):
    return views.table(spark, d, "documents").select("doc_id", scalars.meaningful_characters(F.col("text")).cast("long").alias("n"))


def temp_files(spark, d):
    """Pages stored as files and asked for: by their owners, by others, too late, under no reference, and after a change of the row."""
    p = F.col("page_id")
    owner, scope = F.concat(F.lit("u"), p % 7), F.concat(F.lit("tscope_"), p)
    files = views.table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"), owner.alias("subject_id"), F.concat(F.lit("r"), p).alias("request_id"), F.concat(F.lit("fref_"), p).alias("file_ref"), scope.alias("temp_scope_id"))
    key = F.unhex(F.sha2(F.lit("a key of tests"), 256))
    start = F.timestamp_seconds(F.lit(1_700_000_000) + p)
    stored = temp_store.store(files, key, start)
    changed = stored.withColumn("temp_scope_id", F.when(p % 13 == 6, F.concat("temp_scope_id", F.lit("x"))).otherwise(F.col("temp_scope_id")))
    asked = files.select("page_id", F.when(p % 11 == 3, F.lit("fref_none")).when(p % 11 == 4, F.concat(F.lit("x"), "file_ref")).otherwise(F.col("file_ref")).alias("file_ref"), F.when(p % 5 == 2, F.lit("u9")).otherwise(owner).alias("subject_id"), "request_id", F.when(p % 13 == 6, F.concat("temp_scope_id", F.lit("x"))).otherwise(F.col("temp_scope_id")).alias("temp_scope_id"))
    got = temp_store.resolve(asked, changed, key, F.timestamp_seconds(F.lit(1_700_000_000 + 900 + 100)))
    return got.select("page_id", "failure_code", F.sha2("content", 256).alias("content_sha256"))


QUERIES = [temp_files, forbidden_keys, redacted_diagnostics, guarded_requests, guarded_counts, meaningful_characters]

_LIST = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_MESSAGES = f"""m AS (SELECT event_id, CASE WHEN event_id % 41 <> 7 THEN replace([{", ".join("'" + x + "'" for x in MESSAGES)}][event_id % {len(MESSAGES)} + 1], 'X', json_extract_string(props, '$.k')) END AS m FROM events),
ok AS (SELECT event_id, m FROM m WHERE m IS NOT NULL AND json_valid(m)),
keys AS (SELECT event_id, key FROM ok, LATERAL (SELECT t.key, t.parent, t.type FROM json_tree(ok.m) t) WHERE key IS NOT NULL AND NOT regexp_full_match(key, '[0-9]+'))"""
_BODIES = f"""b AS (SELECT conv_id, turn, t, k, CASE WHEN k % 7 = 3 THEN substr(body, 1, 30) WHEN k % 31 = 5 THEN '' ELSE body END AS value FROM (SELECT *, '{{"client_request_id": "r' || conv_id || '-' || turn || '", "extra": [1], "inputs": ' ||
  CASE WHEN k % 9 = 4 THEN '5' ELSE '[{{"input_id": "i", "size_bytes": ' || length(t) || ', "content": "' || t || '"}}]' END || '}}' AS body FROM (SELECT conv_id, turn, conv_id * 3 + turn AS k, substr(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), 1, 500) AS t FROM conversations))),
v AS (SELECT *, CAST(strlen(value) AS INTEGER) AS size_bytes, CASE WHEN strlen(value) > {BODY} THEN 'too_large' WHEN NOT json_valid(value) OR k % 9 = 4 THEN 'malformed' ELSE 'ok' END AS verdict FROM b)"""

SQL = {
    "forbidden_keys": f"""WITH {_MESSAGES},
f AS (SELECT event_id, bool_or(replace(lower(key), 'ﬁ', 'fi') IN {_LIST(keys.FILE_KEYS)}) AS bad, string_agg(DISTINCT key, ',' ORDER BY key) FILTER (lower(key) IN {_LIST(keys.WORKER_KEYS)}) AS w, string_agg(DISTINCT key, ',' ORDER BY key) FILTER (key IN {_LIST(keys.DIAGNOSTIC_KEYS)}) AS g FROM keys GROUP BY 1)
SELECT m.event_id, CASE WHEN m.m IS NULL THEN false WHEN ok.m IS NULL OR json_type(ok.m) <> 'OBJECT' THEN true ELSE coalesce(bad, false) END AS unsafe, CASE WHEN ok.m IS NOT NULL THEN coalesce(w, '') END AS worker_keys, CASE WHEN ok.m IS NOT NULL THEN coalesce(g, '') END AS diagnostic_keys
FROM m LEFT JOIN ok USING (event_id) LEFT JOIN f USING (event_id)""",
    # the places of values that are blanked, one for each message
    "redacted_diagnostics": f"""WITH {_MESSAGES} SELECT event_id, CASE event_id % {len(MESSAGES)} WHEN 1 THEN '{{"name":"' || n || '"}}' WHEN 3 THEN '{{"note":"\\"url\\": ' || n || '"}}' WHEN 5 THEN '{{"vector":[' || n || ',1],"Text":{{"text":"[redacted]"}}}}' WHEN 8 THEN '[{{"Raw_Prompt":' || n || ',"fileName":"[redacted]"}},{{"text":"[redacted]"}}]'
  WHEN 10 THEN '{{"a":{{"name ":' || n || '}},"MASKED_PROMPT":null,"masked_prompt":"[redacted]"}}' ELSE regexp_replace(regexp_replace(m, '([:,]) ', '\\1', 'g'), 'name,x', 'name, x') END AS redacted FROM ok JOIN (SELECT event_id, json_extract_string(props, '$.k') AS n FROM events) USING (event_id)""",
    # expiry: 900 s after 1,700,000,000 + page_id, asked for at 1,700,001,000
    "temp_files": """SELECT page_id, code AS failure_code, CASE WHEN code IS NULL THEN sha256(html) END AS content_sha256 FROM (SELECT page_id, html, CASE WHEN html IS NULL OR page_id % 11 IN (3, 4) THEN 'TEMP_FILE_NOT_FOUND' WHEN page_id % 5 = 2 THEN 'TEMP_FILE_ACCESS_DENIED'
  WHEN page_id <= 100 THEN 'TEMP_FILE_EXPIRED' WHEN page_id % 13 = 6 THEN 'TEMP_FILE_DECRYPT_FAILED' END AS code FROM pages)""",
    "guarded_requests": f"WITH {_BODIES} SELECT conv_id, turn, size_bytes, verdict, CASE WHEN verdict = 'ok' THEN 'r' || conv_id || '-' || turn END AS client_request_id, CASE WHEN verdict = 'ok' THEN CAST(length(t) AS INTEGER) END AS content_bytes FROM v",
    "guarded_counts": f"WITH {_BODIES} SELECT verdict, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM v GROUP BY 1",
    # the tables hold no compatibility characters: composition is all that normalising does to them
    "meaningful_characters": "SELECT doc_id, CAST(len(regexp_extract_all(nfc_normalize(text), '[\\pL\\pN]')) AS BIGINT) AS n FROM documents",
}
