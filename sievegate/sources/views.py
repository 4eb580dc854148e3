"""Views of the test tables in the shape of requests, decisions and users. Each is DuckDB SQL as well, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.functions.scalars import final_score, risk_level


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "BLOCK").when(F.col("event_type") == "purchase", "MASK").when(F.col("event_type") == "click", "WARN").otherwise("ALLOW")
    named = raw.select(F.col("event_id").alias("id"), "user_id", F.concat(F.lit("user-"), F.col("user_id")).alias("login_id"), action.alias("action"), F.least(F.lit(100), F.floor("value")).cast("int").alias("base"), F.col("ts").alias("created_at"), k().alias("k"))
    scored = named.withColumn("risk_score", final_score(F.col("base"), F.col("action"))).drop("base")
    return scored.withColumn("risk_level", risk_level(F.col("risk_score")))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.col("event_id"), k().alias("k"))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), F.col("k") % 4 + 1)
    first = raw.where("k % 3 <> 0").select("event_id", pick("PII", "Payment", "Secret", "Custom").alias("category"), pick("EMAIL", "CARD", "API_SECRET", "CUSTOM_KEYWORD").alias("type"), (F.col("k") % 5 + 1).cast("int").alias("count"))
    return first.unionByName(raw.where("k % 7 = 0").select("event_id", F.lit("PII").alias("category"), F.lit("PHONE").alias("type"), F.lit(1).alias("count")))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", k().alias("k"))
    rows = raw.withColumn("input_index", F.explode(F.sequence(F.lit(0), F.col("k") % 2)))
    mark = (F.col("k") + F.col("input_index")) % 3
    included = (F.col("k") + F.col("input_index")) % 5 != 0
    return rows.select(
        "event_id",
        F.col("input_index").cast("int").alias("input_index"),
        F.when(mark == 0, "text").when(mark == 1, "file_reference").otherwise("attachment_metadata").alias("kind"),
        F.when(mark == 0, "composer").when(mark == 1, "attachment").otherwise("converted_paste").alias("source"),
        included.alias("content_included"),
        F.when(~included, "content_unavailable").when(F.col("k") % 3 != 0, "detection").otherwise("no_detection").alias("decision_basis"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer")
    return raw.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("user-"), F.col("c_custkey")).alias("login_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("department"), F.when(F.col("c_acctbal") < 0, "DISABLED").otherwise("ACTIVE").alias("status"))


def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that administrators have stored, a row for each supplier: every fourth changes a built-in rule of its nation."""
    n = F.col("s_suppkey")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    built_in = n % 4 == 0
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("int").alias("tenant"), n.alias("n"), F.when(built_in, F.concat(F.lit("detector:"), pick(["EMAIL", "PHONE", "RRN", "CARD", "BANK_ACCOUNT"], F.floor(n / 4)))).otherwise(F.concat(F.lit("custom:"), n)).alias("rule_id"), F.when(built_in, "built_in").otherwise("custom").alias("origin"),
        F.when(n % 3 != 0, pick(["low", "medium", "high", "critical"], n)).alias("severity"), F.when(n % 5 != 0, pick(["WARN", "MASK", "BLOCK"], n)).alias("action"), (n % 7 != 3).alias("enabled"), (n % 11 == 5).alias("archived"), (n % 4 + 1).cast("int").alias("version"))
    last = rows.groupBy("tenant", "rule_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("tenant", "rule_id")]), "n").alias("x"))
    return last.select("tenant", "rule_id", "x.*")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations")
    return raw.select(F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("input_index"), F.when(F.col("role") == "user", "composer").otherwise("converted_paste").alias("source"), F.coalesce("text", F.lit("")).alias("content"))


SQL = {
    "v_events": """v_events AS (SELECT id, user_id, login_id, action, created_at, k, risk_score, CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level
  FROM (SELECT *, CAST(CASE action WHEN 'BLOCK' THEN greatest(base, 95) WHEN 'WARN' THEN greatest(base, 40) ELSE base END AS INTEGER) AS risk_score
  FROM (SELECT event_id AS id, user_id, 'user-' || user_id AS login_id, CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'purchase' THEN 'MASK' WHEN 'click' THEN 'WARN' ELSE 'ALLOW' END AS action,
    CAST(least(100, floor(value)) AS INTEGER) AS base, ts AS created_at, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))""",
    "v_detections": """v_detections AS (SELECT event_id, ['PII','Payment','Secret','Custom'][k % 4 + 1] AS category, ['EMAIL','CARD','API_SECRET','CUSTOM_KEYWORD'][k % 4 + 1] AS type, k % 5 + 1 AS count
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k % 3 <> 0
  UNION ALL SELECT event_id, 'PII', 'PHONE', 1 FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 = 0)""",
    "v_inputs": """v_inputs AS (SELECT event_id, CAST(i AS INTEGER) AS input_index, ['text','file_reference','attachment_metadata'][(k + i) % 3 + 1] AS kind, ['composer','attachment','converted_paste'][(k + i) % 3 + 1] AS source,
    (k + i) % 5 <> 0 AS content_included, CASE WHEN (k + i) % 5 = 0 THEN 'content_unavailable' WHEN k % 3 <> 0 THEN 'detection' ELSE 'no_detection' END AS decision_basis
  FROM (SELECT event_id, k, unnest(range(0, k % 2 + 1)) AS i FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))""",
    "v_users": """v_users AS (SELECT c_custkey AS user_id, 'user-' || c_custkey AS login_id, c_name AS username, c_mktsegment AS department, CASE WHEN c_acctbal < 0 THEN 'DISABLED' ELSE 'ACTIVE' END AS status FROM customer)""",
    "v_rules": """v_rules AS (SELECT * FROM (SELECT s_nationkey AS tenant, s_suppkey AS n, CASE WHEN s_suppkey % 4 = 0 THEN 'detector:' || ['EMAIL','PHONE','RRN','CARD','BANK_ACCOUNT'][s_suppkey // 4 % 5 + 1] ELSE 'custom:' || s_suppkey END AS rule_id, CASE WHEN s_suppkey % 4 = 0 THEN 'built_in' ELSE 'custom' END AS origin,
    CASE WHEN s_suppkey % 3 <> 0 THEN ['low','medium','high','critical'][s_suppkey % 4 + 1] END AS severity, CASE WHEN s_suppkey % 5 <> 0 THEN ['WARN','MASK','BLOCK'][s_suppkey % 3 + 1] END AS action, s_suppkey % 7 <> 3 AS enabled, s_suppkey % 11 = 5 AS archived, CAST(s_suppkey % 4 + 1 AS INTEGER) AS version FROM supplier)
  QUALIFY row_number() OVER (PARTITION BY tenant, rule_id ORDER BY n DESC) = 1)""",
    "v_requests": """v_requests AS (SELECT conv_id AS request_id, CAST(turn AS INTEGER) AS input_index, CASE WHEN role = 'user' THEN 'composer' ELSE 'converted_paste' END AS source, coalesce(text, '') AS content FROM conversations)""",
}


def sql(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body
