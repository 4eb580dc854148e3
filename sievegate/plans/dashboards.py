"""Queries over the decision log beyond the plain counts, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.operators import analytics, decision_log
from sievegate.sources import views
from sievegate.sources.views import sql

AS_OF, DAYS = "2024-01-20", 14
NOW = "2024-01-15 00:00:00"
_IN = f"created_at >= DATE '{AS_OF}' - {DAYS - 1} AND created_at < DATE '{AS_OF}' + 1"


def overview_totals(spark, d):
    return analytics.overview(views.events(spark, d), views.users(spark, d), views.inputs(spark, d), AS_OF, DAYS)


def overview_grouping_sets(spark, d):
    return analytics.action_risk_cube(analytics.window(views.events(spark, d), AS_OF, DAYS))


def dashboard_users_30d(spark, d):
    users = views.users(spark, d).withColumn("last_event_at", F.when(F.col("user_id") % 3 == 0, F.lit("2024-01-10").cast("timestamp")))
    out = analytics.dashboard_users(views.events(spark, d), users, AS_OF)
    return out.withColumn("last_event_at", F.unix_micros("last_event_at"))


def event_detection_summary(spark, d):
    return analytics.detection_summary(views.detections(spark, d))


def user_detection_distribution(spark, d):
    return analytics.user_detections(views.events(spark, d), views.detections(spark, d))


def context_matches_only(spark, d):
    return views.detections(spark, d).where("category = 'Custom'").select("event_id", "type", "count")


def _scanned(spark, d):
    included = F.col("content_included")
    return views.inputs(spark, d).withColumns({"content_scanned": included & (F.col("kind") == "text"), "content_unavailable_reason": F.when(~included & (F.col("event_id") % 2 == 0), "unsupported")})


def event_unavailable_inputs(spark, d):
    return analytics.unavailable_inputs(_scanned(spark, d)).select("event_id", "input_index", "decision_basis")


def event_detail_flat(spark, d):
    ids = views.events(spark, d).select(F.col("id").alias("event_id"))
    out = analytics.event_detail(ids, views.events(spark, d), views.detections(spark, d), views.inputs(spark, d))
    listed = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[k] for k in f])), ";"), F.lit(""))
    return out.select("event_id", "action", "risk_level", listed("detections", ["category", "type", "count"]).alias("detections"), listed("inputs", ["input_index", "kind"]).alias("inputs"))


def stored_input_rows(spark, d):
    return decision_log.input_rows(_scanned(spark, d).withColumn("size_bytes", F.col("event_id") * 4099 % (12 << 20)))


def new_requests(spark, d):
    rows = views.events(spark, d).select("login_id", (F.col("id") % 97).alias("client_request_id"), F.col("id").alias("event_id"), "created_at")
    return decision_log.new_requests(rows.where("created_at >= DATE '2024-01-15'"), rows.where("created_at < DATE '2024-01-15'")).select("login_id", "client_request_id", "event_id")


def temp_file_resolution(spark, d):
    e = views.events(spark, d)
    kinds = F.element_at(F.array(*map(F.lit, ["pdf", "image", "exe"])), (F.col("id") % 3 + 1).cast("int"))
    manifest = e.where("id % 7 <> 0").select(F.col("id").alias("file_ref"), "user_id", (F.col("id") % 11).alias("request_id"), kinds.alias("file_kind"), F.when(F.col("id") % 13 == 0, "deleted").otherwise("staged").alias("state"), (F.col("created_at") + F.expr("INTERVAL 900 SECONDS")).alias("expires_at"))
    manifest = manifest.select("file_ref", F.col("user_id").alias("subject_id"), "request_id", F.lit("s").alias("session_id"), F.lit("t").alias("scope_id"), "file_kind", "state", F.lit(None).cast("timestamp").alias("deleted_at"), "expires_at")
    asked = e.select(F.col("id").alias("file_ref"), F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("user_id")).alias("subject_id"), (F.col("id") % 11 + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("request_id"), F.lit("s").alias("session_id"), F.lit("t").alias("scope_id"))
    return decision_log.resolve_files(asked, manifest, NOW).select("file_ref", "failure_code")


def rule_changes(spark, d):
    """Stored custom rules after a change to some of them, and changes to built-in rules that have no row yet."""
    n = F.col("n")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    stored = views.stored_rules(spark, d).where("origin = 'custom'")
    op = F.when(n % 2 == 0, pick(["archive", "disable", "enable", "update"], F.floor(n / 2)))
    custom = stored.select("rule_id", op.alias("op"), F.when(n % 6 == 0, F.lit("critical")).alias("severity"), F.when(n % 10 == 0, F.lit("BLOCK")).alias("action")).where("op IS NOT NULL")
    k = F.col("n_nationkey")
    built_in = views.table(spark, d, "nation").select(F.concat(F.lit("detector:N"), k).alias("rule_id"), pick(["archive", "disable", "update"], k).alias("op"), F.lit("high").alias("severity"), F.lit("MASK").alias("action"))
    return decision_log.upsert_rules(stored.select("rule_id", "origin", "severity", "action", "enabled", "archived", "version"), custom.unionByName(built_in))


def service_health(spark, d):
    """The state of every user's services: a service of a type of event is unhealthy from 40 % of blocks on, degraded from 20 %; those
    of users divisible by 3 are required."""
    e = views.events(spark, d)
    share = F.count_if(F.col("action") == "BLOCK") / F.count("*")
    status = F.when(share >= 0.4, "unhealthy").when(share >= 0.2, "degraded").otherwise("healthy")
    parts = e.groupBy("user_id", (F.col("k") % 4).alias("name")).agg(status.alias("status"))
    return analytics.health(parts.withColumn("required", (F.col("user_id") % 3 == 0) & (F.col("name") < 2)), "user_id")


QUERIES = [overview_totals, overview_grouping_sets, dashboard_users_30d, event_detection_summary, user_detection_distribution, context_matches_only, event_unavailable_inputs, event_detail_flat, stored_input_rows, new_requests, temp_file_resolution, rule_changes, service_health]

_COUNTS = ", ".join([f"CAST(count_if(action = '{a}') AS BIGINT) AS n_{a.lower()}" for a in ("ALLOW", "WARN", "MASK", "BLOCK")] + [f"CAST(count_if(risk_level = '{x}') AS BIGINT) AS n_{x}" for x in ("low", "medium", "high", "critical")])
_SCANNED = "SELECT *, content_included AND kind = 'text' AS content_scanned, CASE WHEN NOT content_included AND event_id % 2 = 0 THEN 'unsupported' END AS content_unavailable_reason FROM v_inputs"

SQL = {
    "overview_totals": sql(
        f"""SELECT count(*) AS n_events, {_COUNTS}, count(DISTINCT CASE WHEN login_id IN (SELECT login_id FROM v_users) THEN login_id END) AS n_users,
  CAST(count_if(id IN (SELECT event_id FROM v_inputs WHERE NOT content_included)) AS BIGINT) AS n_unavailable, max(CAST(created_at AS DATE)) AS last_day FROM v_events WHERE {_IN}""",
        "v_events", "v_inputs", "v_users",
    ),
    "overview_grouping_sets": sql(f"SELECT 'action' AS kind, action AS name, count(*) AS n FROM v_events WHERE {_IN} GROUP BY 2 UNION ALL SELECT 'risk_level', risk_level, count(*) FROM v_events WHERE {_IN} GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM v_events WHERE {_IN}", "v_events"),
    "dashboard_users_30d": sql(
        f"""SELECT user_id, u.login_id, status, coalesce(n_events, 0) AS n_events, coalesce(n_block, 0) AS n_block, coalesce(n_mask, 0) AS n_mask, coalesce(n_warn, 0) AS n_warn,
  epoch_us(greatest(CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-10' END, last)) AS last_event_at
FROM v_users u LEFT JOIN (SELECT user_id, {_COUNTS}, count(*) AS n_events, max(created_at) AS last FROM v_events WHERE created_at >= DATE '{AS_OF}' - 29 AND created_at < DATE '{AS_OF}' + 1 GROUP BY 1) e USING (user_id)""",
        "v_events", "v_users",
    ),
    "event_detection_summary": sql("SELECT event_id, category, type, CAST(sum(count) AS BIGINT) AS n FROM v_detections GROUP BY 1, 2, 3", "v_detections"),
    "user_detection_distribution": sql("SELECT login_id, type, CAST(sum(count) AS BIGINT) AS n FROM v_detections d JOIN v_events e ON e.id = d.event_id GROUP BY 1, 2", "v_events", "v_detections"),
    "context_matches_only": sql("SELECT event_id, type, count FROM v_detections WHERE category = 'Custom'", "v_detections"),
    "event_unavailable_inputs": sql(f"SELECT event_id, input_index, decision_basis FROM ({_SCANNED}) WHERE NOT content_scanned OR decision_basis = 'content_unavailable' OR content_unavailable_reason IS NOT NULL", "v_inputs"),
    "event_detail_flat": sql(
        """SELECT e.id AS event_id, action, risk_level, coalesce(d.l, '') AS detections, coalesce(i.l, '') AS inputs FROM v_events e
  LEFT JOIN (SELECT event_id, string_agg(category || ':' || type || ':' || count, ';' ORDER BY category, type, count) AS l FROM v_detections GROUP BY 1) d ON d.event_id = e.id
  LEFT JOIN (SELECT event_id, string_agg(input_index || ':' || kind, ';' ORDER BY input_index) AS l FROM v_inputs GROUP BY 1) i ON i.event_id = e.id""",
        "v_events", "v_detections", "v_inputs",
    ),
    "stored_input_rows": sql(f"SELECT event_id, input_index, kind, source, CASE WHEN n = 0 THEN 'empty' WHEN n <= 1048576 THEN 'small' WHEN n <= 10485760 THEN 'medium' ELSE 'large' END AS size_bucket, content_included, content_scanned, decision_basis, content_unavailable_reason FROM (SELECT *, event_id * 4099 % 12582912 AS n FROM ({_SCANNED}))", "v_inputs"),
    "new_requests": sql(
        """SELECT login_id, client_request_id, event_id FROM (SELECT login_id, id % 97 AS client_request_id, id AS event_id, created_at, row_number() OVER (PARTITION BY login_id, id % 97 ORDER BY created_at, id) AS r FROM v_events)
WHERE r = 1 AND created_at >= DATE '2024-01-15'""",
        "v_events",
    ),
    "temp_file_resolution": sql(
        f"""SELECT id AS file_ref, CASE WHEN id % 7 = 0 THEN 'TEMP_FILE_NOT_FOUND' WHEN id % 5 = 0 THEN 'TEMP_FILE_OWNER_MISMATCH' WHEN id % 4 = 0 THEN 'TEMP_FILE_SCOPE_MISMATCH'
  WHEN created_at + INTERVAL 900 SECONDS <= TIMESTAMP '{NOW}' THEN 'TEMP_FILE_EXPIRED' WHEN id % 13 = 0 THEN 'TEMP_FILE_RESOLVE_FAILED' WHEN id % 3 = 2 THEN 'UNSUPPORTED_FILE_KIND' END AS failure_code FROM v_events""",
        "v_events",
    ),
    "rule_changes": sql(
        """SELECT rule_id, origin, CASE WHEN op IS NOT NULL AND n % 6 = 0 THEN 'critical' ELSE severity END AS severity, CASE WHEN op IS NOT NULL AND n % 10 = 0 THEN 'BLOCK' ELSE action END AS action, CASE op WHEN 'enable' THEN true WHEN 'disable' THEN false WHEN 'archive' THEN false ELSE enabled END AS enabled,
  archived OR coalesce(op = 'archive', false) AS archived, CAST(version + CASE WHEN op IS NULL THEN 0 ELSE 1 END AS INTEGER) AS version FROM (SELECT *, CASE WHEN n % 2 = 0 THEN ['archive', 'disable', 'enable', 'update'][n // 2 % 4 + 1] END AS op FROM v_rules WHERE origin = 'custom')
UNION ALL SELECT 'detector:N' || n_nationkey, 'built_in', 'high', 'MASK', n_nationkey % 3 = 2, false, 1 FROM nation WHERE n_nationkey % 3 <> 0""",
        "v_rules",
    ),
    "service_health": sql(
        """SELECT user_id, CASE WHEN bool_or(s >= 0.4 AND user_id % 3 = 0 AND name < 2) THEN 'unhealthy' WHEN bool_or(s >= 0.2) THEN 'degraded' ELSE 'healthy' END AS status
FROM (SELECT user_id, k % 4 AS name, count(*) FILTER (action = 'BLOCK') / count(*) AS s FROM v_events GROUP BY 1, 2) GROUP BY 1""",
        "v_events",
    ),
}
