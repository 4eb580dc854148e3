"""Evidence lines, context groups, envelopes, tokens, sessions, stored settings: nulls, empties, ties, unknown values."""

from datetime import datetime

from pyspark.sql import functions as F

from sievegate.operators import analytics, client, policy

LISTS = "action string, detections array<struct<type:string,placeholder:string,detector_id:string,category:string>>, unread array<struct<reason:string>>, contexts array<struct<category:string>>, status string, labels array<string>"


def lines(spark, *rows):
    df = spark.createDataFrame(list(rows), LISTS)
    out = df.select(client.evidence_lines(F.col("action"), F.col("detections"), F.col("unread"), F.col("contexts"), F.col("status"), F.col("labels")).alias("l"))
    return [r.l for r in out.collect()]


def test_evidence_lines(spark):
    mail = ("x", " e-mail ", None, "PII")
    got = lines(
        spark,
        ("Allow", None, None, None, None, None),
        ("Block", [], [], [], "no_candidate", ["PERSONAL_DATA_CONTEXT"]),
        ("Warn", [("bank account", None, None, None), mail, ("odd_Thing", "", "", ""), ("CARD", "", "", "")], [("oversized",), (None,), ("",), ("x_y",)], [("A__b-c",), ("d",), ("e",)], None, None),
        ("Warn", [], [], [], "verified", ["PERSONAL_DATA_CONTEXT", "a", "b", "FINANCIAL_CONTEXT", "CUSTOMER_DATA_CONTEXT"]),
        ("Warn", [], [], [], "candidate", ["CONFIDENTIAL_BUSINESS_CONTEXT", "BUSINESS_CONFIDENTIAL_CONTEXT"]),
        ("Warn", [], [], [], "timeout", []), ("Warn", [], [], [], "verified", []),
    )
    assert got[0] == []
    assert got[1] == [client.REVIEW]
    assert got[2] == ["탐지: 계좌번호", "탐지: 개인정보", "탐지: odd thing", "검사 불가: 용량 초과", "검사 불가: unavailable", "검사 불가: unavailable", "정책 매칭: a b c", "정책 매칭: d"]  # no reason: the word itself, not its label
    assert got[3] == ["탐지: 개인정보, 정책 관련 정보, 금융 또는 상업 조건 외 1개"]
    assert got[4] == ["주의: 기밀 비즈니스 정보"]
    assert got[5:] == [[client.TIMED_OUT], [client.REVIEW]]


def test_context_groups(spark):
    text = "a: x, y ,,\n: none\nno colon\n b　:z: q\nc: ,\na: last\n d :﻿1"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string").withColumn("name", F.lit("clash"))
    got = {(r.id, r.name): (r.place, r.terms) for r in client.context_groups(df, "id").collect()}
    assert got == {(1, "a"): (0, ["last"]), (1, "b"): (3, ["z: q"]), (1, "d"): (6, ["1"])}


def test_envelopes(spark):
    rows = [("composer_text", "", None, None), ("composer_text", None, None, None), ("converted_paste_text", "t", None, "pdf"), ("attached_file_ref", None, "f", "pdf"), ("attached_file_ref", None, "f", None), ("attachment_metadata", None, None, None), ("unsupported_attachment", "t", None, None), (None, "t", None, None), ("x_ref", None, "f", "pdf")]
    df = spark.createDataFrame(rows, "o string, t string, f string, k string")
    got = [r[0] for r in df.select(client.envelope_violation(*map(F.col, "otfk"))).collect()]
    assert got == [None, "TEXT_REQUIRED_WITHOUT_FILE", "TEXT_REQUIRED_WITHOUT_FILE", None, "FILE_REQUIRED_WITHOUT_TEXT", None, "TEXT_NOT_ALLOWED", "ORIGIN_UNKNOWN", "ORIGIN_UNKNOWN"]


def test_tokens_and_sessions(spark):
    now, soon, past = datetime(2024, 1, 2), datetime(2024, 1, 3), datetime(2024, 1, 1)
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    tokens = spark.createDataFrame([(1, 7, None, soon, None), (2, 7, past, soon, None), (3, 7, None, now, None), (4, 7, None, soon, now), (5, 8, None, soon, soon)], "token_id int, owner_id int, revoked_at timestamp, expires_at timestamp, idle_expires_at timestamp")
    asked = spark.createDataFrame([(k, 7) for k in range(1, 7)] + [(5, 8), (None, 7)], "token_id int, user_id int")
    got = client.usable_tokens(asked, tokens, at).collect()
    assert {(r.token_id, r.user_id) for r in got if r.usable} == {(1, 7), (5, 8)} and len(got) == 8
    sessions = spark.createDataFrame([("a", 1, None, soon), ("b", 2, None, soon), ("c", 3, None, soon), ("d", 1, past, soon), ("e", 1, None, now), ("f", 9, None, soon)], "session_hash string, user_id int, revoked_at timestamp, expires_at timestamp")
    users = spark.createDataFrame([(1, "ACTIVE", "ADMIN"), (2, "DISABLED", "ADMIN"), (3, "ACTIVE", None)], "user_id int, status string, role string")
    asked = spark.createDataFrame([(x,) for x in "abcdefg"], "session_hash string")
    assert {r.session_hash: r.outcome for r in client.session_outcomes(asked, sessions, users, at).collect()} == dict(a="ok", b="not_active", c="not_admin", d="invalid", e="invalid", f="invalid", g="invalid")


def test_stored_settings_decide(spark):
    rows = spark.createDataFrame([("a", "BLOCK", None, "Warn", "Warn", "WARN")], "tenant string, " + ", ".join(f"{k} string" for k in policy.SETTINGS))
    scopes = spark.createDataFrame([("a",), ("b",)], "tenant string")
    settings = policy.stored_settings(scopes, rows)
    got = {r.tenant: r.asDict() for r in settings.collect()}
    assert got["b"] == {"tenant": "b"} | policy.SETTINGS
    assert got["a"]["content_not_scanned_action"] == "warn" and got["a"]["context_classifier_action"] == "block"
    requests = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "a", 1), (4, "b", 1), (5, "zz", 1), (6, None, 0)], "request_id int, tenant string, n_inputs int")
    found = spark.createDataFrame([(k, 0, "mask", "high", "R", False) for k in (3, 4, 5)], "request_id int, ord int, action string, severity string, reason string, masking_supported boolean")
    decided = {r.request_id: r.action for r in policy.decide_requests(requests, found, settings).collect()}
    assert decided == {1: "warn", 2: "allow", 3: "warn", 4: "block", 5: "block", 6: "allow"}


def test_detail_of_an_event_without_rows(spark):
    events = spark.createDataFrame([(1, "u", "ALLOW", 0, "low")], "id int, login_id string, action string, risk_score int, risk_level string")
    none = spark.createDataFrame([], "event_id int, category string, type string, reason_code string, count int, source string, matched_keywords array<string>, evidence_counts map<string,int>")
    ins = spark.createDataFrame([], "event_id int, input_index int, kind string, source string, decision_basis string, content_unavailable_reason string, content_scanned boolean")
    row = analytics.event_detail_whole(events, none, ins).first()
    assert (row.detections, row.context_matches, row.inputs, row.unavailable) == ([], [], [], [])
    found = spark.createDataFrame([(1, "B", "t", "r", 1, "custom_context_rule", None, None), (1, "A", "t", "r", 1, "custom_context_rule", [], {"n": 2})], none.schema)
    row = analytics.event_detail_whole(events, found, ins).first()
    assert [x.category for x in row.detections] == ["A", "B"] and [x.category for x in row.context_matches] == ["A"]
