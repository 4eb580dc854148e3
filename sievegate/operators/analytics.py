"""Dashboards over the decision log: plain aggregates, with filters on raw columns so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Events of the last days UTC days that end with as_of."""
    end = F.lit(as_of).cast("date")
    return events.where((F.col("created_at") >= F.date_sub(end, days - 1).cast("timestamp")) & (F.col("created_at") < F.date_add(end, 1).cast("timestamp")))


def daily(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """A row for each day, empty ones too, with counts by action."""
    end = F.lit(as_of).cast("date")
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    per_day = window(events, as_of, days).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("ALLOW", "WARN", "MASK", "BLOCK")], F.countDistinct("user_id").alias("users"))
    return spine.join(per_day, "day", "left").na.fill(0)


def distribution(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))


def detection_distribution(events: DataFrame, detections: DataFrame, column: str) -> DataFrame:
    """Sums of counts of the detections of these events."""
    return detections.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").groupBy(F.col(column).alias("name")).agg(F.sum("count").alias("n"))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("ALLOW", "WARN", "MASK", "BLOCK")], *[F.count_if(F.col("risk_level") == x).alias(x) for x in ("low", "medium", "high", "critical")])


def unavailable(events: DataFrame, inputs: DataFrame) -> DataFrame:
    """How many events have an input without content."""
    return events.join(inputs.where(~F.col("content_included")).select(F.col("event_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("n"))


def user_stats(events: DataFrame, detections: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each user, without events too: counts by action and the category found most (then by name)."""
    counted = events.groupBy("login_id").agg(F.count("*").alias("n_events"), *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("ALLOW", "WARN", "MASK", "BLOCK")], F.max(F.to_date("created_at")).alias("last_day"))
    per_category = detections.join(events.select(F.col("id").alias("event_id"), "login_id"), "event_id").groupBy("login_id", "category").agg(F.sum("count").alias("n"))
    top = per_category.groupBy("login_id").agg(F.min_by("category", F.struct((-F.col("n")).alias("n"), "category")).alias("top_category"))
    return users.join(counted, "login_id", "left").join(top, "login_id", "left").select("login_id", "username", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "allow", "warn", "mask", "block")], "last_day", "top_category")


def top_users(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.desc("n_events"), F.desc_nulls_last("last_day"), F.lower("username")).limit(n)


def event_labels(detections: DataFrame) -> DataFrame:
    """Per event: sum of counts, its type and category, or MULTIPLE."""
    pairs = detections.groupBy("event_id", "category", "type").agg(F.sum("count").alias("n"))
    one = lambda count, column: F.when(count == 1, F.min(column)).otherwise("MULTIPLE")
    return pairs.groupBy("event_id").agg(F.sum("n").alias("n"), one(F.count("*"), "type").alias("type_label"), one(F.countDistinct("category"), "category").alias("category_label"))


def event_list(events: DataFrame, detections: DataFrame, inputs: DataFrame, n: int) -> DataFrame:
    """The latest events with their labels and counts of inputs; children are looked up after the limit."""
    latest = events.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    ids = latest.select(F.col("id").alias("event_id"))
    labels = event_labels(detections.join(ids, "event_id", "left_semi"))
    per_event = inputs.join(ids, "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("n_inputs"), F.count_if(~F.col("content_included")).alias("n_unavailable"))
    out = latest.withColumnRenamed("id", "event_id").join(labels, "event_id", "left").join(per_event, "event_id", "left")
    return out.select("event_id", "login_id", "action", "risk_score", "risk_level", F.coalesce("n", F.lit(0)).alias("n_detections"), "type_label", "category_label", F.coalesce("n_inputs", F.lit(0)).alias("n_inputs"), F.coalesce("n_unavailable", F.lit(0)).alias("n_unavailable"))


def overview(events: DataFrame, users: DataFrame, inputs: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row: counts by action and risk, logins that are users, events with an input without content, the last day."""
    seen = window(events, as_of, days)
    bare = inputs.where(~F.col("content_included")).select(F.col("event_id").alias("id")).distinct().withColumn("bare", F.lit(True))
    known = users.select("login_id", F.lit(True).alias("known"))
    rows = seen.join(bare, "id", "left").join(known, "login_id", "left")
    return rows.agg(
        F.count("*").alias("n_events"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ("ALLOW", "WARN", "MASK", "BLOCK")],
        *[F.count_if(F.col("risk_level") == x).alias(f"n_{x}") for x in ("low", "medium", "high", "critical")],
        F.countDistinct(F.when(F.col("known"), F.col("login_id"))).alias("n_users"),
        F.count_if("bare").alias("n_unavailable"),
        F.max(F.to_date("created_at")).alias("last_day"),
    )


def action_risk_cube(events: DataFrame) -> DataFrame:
    """Counts by action, by risk level and of all, from one aggregation over grouping sets."""
    keys = [F.col("action"), F.col("risk_level")]
    grouped = events.groupingSets([[keys[0]], [keys[1]], []], *keys).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 1, "action").when(F.col("g") == 2, "risk_level").otherwise("all")
    return grouped.select(kind.alias("kind"), F.coalesce("action", "risk_level", F.lit("all")).alias("name"), "n")


def dashboard_users(events: DataFrame, users: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """A row for each user with counts of the window; users' own last_event_at counts too."""
    per = window(events, as_of, days).groupBy("user_id").agg(F.count("*").alias("n_events"), *[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ("BLOCK", "MASK", "WARN")], F.max("created_at").alias("_last"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_block", "n_mask", "n_warn")]
    return users.join(per, "user_id", "left").select("user_id", "login_id", "status", *counts, F.greatest("last_event_at", "_last").alias("last_event_at"))


def detection_summary(detections: DataFrame) -> DataFrame:
    return detections.groupBy("event_id", "category", "type").agg(F.sum("count").alias("n"))


def user_detections(events: DataFrame, detections: DataFrame) -> DataFrame:
    """Sums of counts by login and type of detection."""
    return detections.join(events.select(F.col("id").alias("event_id"), "login_id"), "event_id").groupBy("login_id", "type").agg(F.sum("count").alias("n"))


def _is_unavailable():
    return ~F.col("content_scanned") | (F.col("decision_basis") == "content_unavailable") | F.col("content_unavailable_reason").isNotNull()


def unavailable_inputs(inputs: DataFrame) -> DataFrame:
    """Inputs that an event's detail lists as unavailable: not scanned, or for a reason, or decided on missing content."""
    return inputs.where(_is_unavailable())


def event_detail(event_ids: DataFrame, events: DataFrame, detections: DataFrame, inputs: DataFrame) -> DataFrame:
    """Events of event_ids (event_id) with nested detections and inputs, each in order."""
    some = lambda df: df.join(event_ids, "event_id", "left_semi")
    found = some(detections).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("category", "type", "count"))).alias("detections"))
    given = some(inputs).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("input_index", "kind", "source", "decision_basis"))).alias("inputs"))
    base = some(events.withColumnRenamed("id", "event_id")).select("event_id", "login_id", "action", "risk_score", "risk_level")
    return base.join(found, "event_id", "left").join(given, "event_id", "left")


def event_detail_whole(events: DataFrame, detections: DataFrame, inputs: DataFrame) -> DataFrame:
    """Every event with all lists of its detail: detections by category, type and reason_code; inputs and those unavailable by place; and
    context_matches, the detections of context rules that have matched_keywords or evidence_counts. An empty list where there is none."""
    found = ["category", "type", "reason_code", "count"]
    context = (F.col("source") == "custom_context_rule") & ((F.size("matched_keywords") > 0) | (F.size("evidence_counts") > 0))
    counts = F.array_sort(F.map_entries("evidence_counts")).alias("evidence_counts")
    rows = detections.select("event_id", F.struct(*found).alias("d"), F.when(context, F.struct(*found, "matched_keywords", counts)).alias("c"))
    lists = rows.groupBy("event_id").agg(F.array_sort(F.collect_list("d")).alias("detections"), F.array_sort(F.collect_list("c")).alias("context_matches"))
    given = F.struct("input_index", "kind", "source", "decision_basis", "content_unavailable_reason")
    parts = inputs.groupBy("event_id").agg(F.array_sort(F.collect_list(given)).alias("inputs"), F.array_sort(F.collect_list(F.when(_is_unavailable(), given))).alias("unavailable"))
    out = events.select(F.col("id").alias("event_id"), "login_id", "action", "risk_score", "risk_level").join(lists, "event_id", "left").join(parts, "event_id", "left")
    none = lambda c: F.when(F.col(c).isNull(), F.array()).otherwise(F.col(c)).alias(c)
    return out.select("event_id", "login_id", "action", "risk_score", "risk_level", *map(none, ["detections", "context_matches", "inputs", "unavailable"]))


def health(states: DataFrame, *keys: str) -> DataFrame:
    """states (keys, name, required, status) to one status each: a required part that fails fails the whole, any other degrades it."""
    bad = F.col("status") == "unhealthy"
    whole = F.when(F.bool_or(bad & F.col("required")), "unhealthy").when(F.bool_or(F.col("status").isin("unhealthy", "degraded")), "degraded").otherwise("healthy")
    return states.groupBy(*keys).agg(whole.alias("status"))
