from collections import defaultdict, deque

from pyspark.sql import functions as F

from sievegate import catalog
from sievegate.operators import decision_log, evidence, policy, rules, segments
from sievegate.streaming import limits


def test_policy_order_ties_and_fallback(spark):
    requests = spark.createDataFrame([(k, 0 if k == 5 else 1) for k in range(7)], "request_id int, n_inputs int")
    evidence = spark.createDataFrame(
        [(0, 0, "warn", "high", "A", True), (0, 1, "block", "low", "B", True), (1, 0, "mask", "high", "A", True), (2, 0, "mask", "high", "A", True), (2, 1, "mask", "low", "B", False), (3, 0, "warn", "low", "A", True), (3, 1, "warn", "low", "B", True), (4, 0, "allow", "low", "A", True)],
        "request_id int, ord int, action string, severity string, reason string, masking_supported boolean",
    )
    got = {r.request_id: (r.action, r.reason_code, r.severity) for r in policy.decide_requests(requests, evidence).collect()}
    assert got == {0: ("block", "B", "low"), 1: ("mask", "A", "high"), 2: ("block", "A", "high"), 3: ("warn", "A", "low"), 4: ("allow", "A", "low"), 5: ("allow", "EMPTY_INPUT", "info"), 6: ("allow", "NO_RISK_DETECTED", "info")}


def test_rules(spark):
    df = spark.createDataFrame([(1, "The SECRET!! plan"), (2, "geheim ÄÖ"), (3, None)], "id int, text string")
    got = {(r.id, r.rule_id, r["count"]) for r in rules.keyword_matches(df, {"a": "secret!", "b": "äö"}, "id").collect()}
    assert got == {(1, "a", 1), (2, "b", 1)}
    got = {(r.id, r.n_conditions) for r in rules.context_matches(df, {"c": (["plan", "secret", "none"], 2)}, "id").collect()}
    assert got == {(1, 2)}
    dry = rules.decide(df, rules.detector_matches(df.withColumn("text", F.concat("text", F.lit(" a@b.com"))), rules.built_in_rules(spark), "id"), "id")
    assert {(r.id, r.action, r.risk_score, r.risk_level, r.match_count) for r in dry.collect()} == {(1, "MASK", 55, "medium", 1), (2, "MASK", 55, "medium", 1), (3, "ALLOW", 0, "low", 0)}


def test_rate_limit_ignores_rejected_hits(spark, sf_dir):
    rows = [(r.id, r.login_id, r.created_at.timestamp()) for r in catalog.views.events(spark, sf_dir).collect()]
    want, queues = {}, defaultdict(deque)
    for i, who, t in sorted(rows, key=lambda r: (r[2], r[0])):
        q = queues[who]
        while q and q[0] <= t - 36_000:
            q.popleft()
        want[i] = len(q) < 2
        if want[i]:
            q.append(t)
    got = {r.id: r.allowed for r in limits.rate_limited(catalog.views.events(spark, sf_dir), 2, 36_000).collect()}
    assert got == want and not all(got.values())


def test_streams(spark, sf_dir, tmp_path):
    catalog.views.events(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("client_request_id", F.col("id") % 50).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", limits.once(source), "append"), ("days", limits.daily_windows(source), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert spark.table("once").count() == batch.select("login_id", "client_request_id").distinct().count()
    assert spark.table("days").agg(F.sum("n")).first()[0] == batch.count()


def test_segments(spark):
    atoms = [(1, 0, 0, [1.0, 0.0]), (1, 1, 0, [1.0, 0.1]), (1, 2, 0, [0.0, 1.0]), (1, 3, 1, [0.0, 1.0]), (2, 0, 0, [0.0, 0.0]), (2, 1, 0, [1.0, 0.0])]
    broken = segments.with_breaks(spark.createDataFrame(atoms, "input_id int, ordinal int, block int, vector array<double>"))
    assert [r.segment for r in broken.orderBy("input_id", "ordinal").collect()] == [0, 0, 1, 2, 0, 0]
    assert {(r.input_id, r.segment, r.n_atoms) for r in segments.segments(broken).collect()} == {(1, 0, 2), (1, 1, 1), (1, 2, 1), (2, 0, 2)}


def test_oracle_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_policy_context_failures_and_settings(spark):
    requests = spark.createDataFrame([(k, 0 if k == 3 else 1, ["PARSER_OR_OCR_FAILED"] if k == 1 else None, k != 4) for k in range(6)], "request_id int, n_inputs int, codes array<string>, all_scanned boolean")
    ddl = "request_id int, ord int, action string, severity string, reason string, masking_supported boolean"
    rules_ = spark.createDataFrame([(2, 0, "allow", "low", "A", True), (5, 0, "mask", "high", "M", True)], ddl)
    context = spark.createDataFrame([(0, "verified", 1, 1, "C"), (2, "timeout", 0, 2, "T"), (3, "verified", 1, 1, "C"), (5, "verified", 1, 1, "C")], "request_id int, status string, accepted_count int, candidate_count int, reason_code string")
    settings = {"context_classifier_action": "BLOCK", "empty_input_action": "WARN"}
    out = policy.decide_requests(requests.select("request_id", "n_inputs"), rules_, settings, context, evidence.failure_rules(requests, policy.SETTINGS))
    got = {r.request_id: (r.action, r.reason_code, r.severity) for r in out.collect()}
    assert got == {0: ("block", "C", "high"), 1: ("warn", "PARSER_OR_OCR_FAILED", "medium"), 2: ("block", "T", "high"), 3: ("warn", "EMPTY_INPUT", "medium"), 4: ("warn", "CONTENT_NOT_SCANNED", "medium"), 5: ("mask", "M", "high")}


def test_decision_log(spark, tmp_path):
    events = spark.createDataFrame([(1, 7, "u", 5, "WARN", 40, "medium", None, "2024-01-02 03:04:05", "a secret")], "event_id int, user_id int, login_id string, client_request_id int, action string, risk_score int, risk_level string, context string, created_at string, text string").withColumn("created_at", F.to_timestamp("created_at"))
    ins = spark.createDataFrame([(1, 0, "text", "composer", 10, True, True, "detection", None, "a secret")], "event_id int, input_index int, kind string, source string, size_bytes int, content_included boolean, content_scanned boolean, decision_basis string, content_unavailable_reason string, text string")
    found = spark.createDataFrame([(1, 0, "r", "PII", "EMAIL", "s", "high", "MASK", 100, 1, "R", [3, -1], "a secret")], "event_id int, input_index int, rule_id string, category string, type string, source string, severity string, action string, confidence int, count int, reason_code string, value_lengths array<int>, text string")
    for _ in range(2):  # a retry leaves no second row
        decision_log.append(str(tmp_path), 0, events, ins, found)
    stored = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("events", "inputs", "detections", "idempotency")}
    assert all("text" not in df.columns and df.count() == 1 for df in stored.values())
    assert stored["detections"].first().value_lengths == [3] and stored["inputs"].first().size_bucket == "small"
    again = events.unionByName(events.withColumns({"event_id": F.lit(2), "client_request_id": F.lit(6)}))
    assert [r.event_id for r in decision_log.new_requests(again, stored["idempotency"]).collect()] == [2]


def test_rule_problems_and_audit(spark):
    df = spark.createDataFrame([("keyword", " ", None, None), ("context", None, ["a"], 2), ("regex", "a+", None, None), ("x", "a", None, None)], "kind string, pattern string, terms array<string>, least int")
    got = [r.p for r in df.select(decision_log.rule_problems(F.col("kind"), F.col("pattern"), F.col("terms"), F.col("least")).alias("p")).collect()]
    assert got == [["PATTERN_MISSING"], ["CONDITION_COUNT"], [], ["UNKNOWN_KIND"]]
    a, b = (spark.createDataFrame([("default", x, y)], "key string, a string, b string") for x, y in (("W", None), ("X", "Y")))
    assert [r.changed_fields for r in decision_log.audit(a, b, ["b", "a"]).collect()] == [["a", "b"]]
