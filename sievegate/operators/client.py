"""What clients make of requests and responses: origins of inputs, evidence lines for the user, groups of context terms, tokens and
sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of contexts and detections, reasons, lines.
CONTEXT_LABELS = {
    "BULK_SENSITIVE_RECORD_CONTEXT": "대량 민감 기록", "CONFIDENTIAL_BUSINESS_CONTEXT": "기밀 비즈니스 정보", "FINANCIAL_IDENTIFIER_CONTEXT": "금융 식별 정보", "INTERNAL_OPERATION_CONTEXT": "내부 운영 정보",
    "PROPRIETARY_TECHNICAL_CONTEXT": "독점 기술 정보", "SECURITY_CONTROL_CONTEXT": "보안 통제 정보", "SECRET_CREDENTIAL_CONTEXT": "인증 정보 또는 접근 권한", "PERSONAL_DATA_CONTEXT": "개인정보", "BUSINESS_CONFIDENTIAL_CONTEXT": "기밀 비즈니스 정보",
    "FINANCIAL_CONTEXT": "금융 또는 상업 조건", "LEGAL_CONTRACT_CONTEXT": "법무 또는 계약 정보", "SECURITY_INCIDENT_CONTEXT": "보안 운영 정보", "CUSTOMER_DATA_CONTEXT": "고객 또는 계정 정보",
}
OTHER_LABEL = "정책 관련 정보"
DETECTION_LABELS = {"API_SECRET": "API 키 또는 인증 토큰", "BANK_ACCOUNT": "계좌번호", "CARD": "카드번호", "EMAIL": "이메일 주소", "PAYMENT": "결제 정보", "PHONE": "전화번호", "PII": "개인정보", "RRN": "주민등록번호", "SECRET": "인증 정보"}
REASONS = {"unsupported": "지원되지 않는 형식", "oversized": "용량 초과", "metadata_only": "메타데이터만 검사됨", "unavailable": "내용 확인 불가"}
TIMED_OUT, FAILED, REVIEW = "검사 시간이 초과되었습니다. 다시 시도해 주세요.", "검사를 완료하지 못했습니다. 다시 시도해 주세요.", "검토가 필요합니다."
FOUND, CAREFUL, UNREAD, POLICY = "탐지: ", "주의: ", "검사 불가: ", "정책 매칭: "
TEXT_ORIGINS = ["composer_text", "converted_paste_text"]
FILE_ORIGINS = ["pasted_file_ref", "pasted_image_ref", "screenshot_image_ref", "attached_file_ref"]
BARE_ORIGINS = ["attachment_metadata", "unsupported_attachment"]
# White space as browsers know it.
_BLANK = r"[\t-\r\x{FEFF}\p{Z}]"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+\z", "")


def _lookup(key: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key)


def _phrase(value: Column) -> Column:
    """Words of a code, in small letters."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), rf"(_|-|{_BLANK})+", " "))


def _token(value: Column) -> Column:
    return _lookup(F.regexp_replace(F.upper(_trimmed(F.coalesce(value, F.lit("")))), rf"(-|{_BLANK})+", "_"), DETECTION_LABELS)


def _detected(d: Column) -> Column:
    category = F.when(d["category"] == "", d["type"]).otherwise(F.coalesce(d["category"], d["type"]))
    return F.coalesce(_token(d["type"]), _token(d["placeholder"]), _token(d["detector_id"]), _token(d["category"]), _phrase(category))


def _context_line(status: Column, labels: Column) -> Column:
    """null where there is nothing to say."""
    names = F.array_distinct(F.transform(labels, lambda x: F.coalesce(_lookup(x, CONTEXT_LABELS), F.lit(OTHER_LABEL))))
    more = F.when(F.size(names) > 3, F.concat(F.lit(" 외 "), F.size(names) - 3, F.lit("개"))).otherwise("")
    line = F.concat(F.when(status == "verified", FOUND).otherwise(CAREFUL), F.array_join(F.slice(names, 1, 3), ", "), more)
    return F.when(status.isin("disabled", "no_candidate"), F.lit(None)).when(status == "timeout", TIMED_OUT).when(status == "failed", FAILED).when(F.size(names) > 0, line)


def evidence_lines(action: Column, detections: Column, unavailable: Column, contexts: Column, status: Column, labels: Column) -> Column:
    """The lines that tell a user why: context first, then up to three detections (of type, placeholder, detector_id, category), three
    unavailable inputs (of reason) and two context matches (of category), without internal codes. Null lists are empty; without any
    line, whatever isn't allowed asks for review. status is null where a response has no context evidence."""
    listed = lambda c, most, f: F.coalesce(F.transform(F.slice(c, 1, most), f), F.array().cast("array<string>"))
    reason = lambda r: F.coalesce(_lookup(r, REASONS), _phrase(F.when(r == "", "unavailable").otherwise(F.coalesce(r, F.lit("unavailable")))))
    parts = [
        F.array_compact(F.array(_context_line(status, labels))),
        listed(detections, 3, lambda d: F.concat(F.lit(FOUND), _detected(d))),
        listed(unavailable, 3, lambda u: F.concat(F.lit(UNREAD), reason(u["reason"]))),
        listed(contexts, 2, lambda m: F.concat(F.lit(POLICY), _phrase(m["category"]))),
    ]
    lines = F.flatten(F.array(*parts))
    return F.when((F.size(lines) == 0) & (action != "Allow"), F.array(F.lit(REVIEW))).otherwise(lines)


def context_groups(forms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, place, name, terms of the groups in a form's text, a line each: ``name: term, term``. Lines without a colon, a name or a term
    are left out; of lines with one name, the last has the terms and the first the place (from 0, among all lines). Null texts are
    empty."""
    line = F.col("line")
    colon = F.instr(line, ":")
    terms = F.filter(F.transform(F.split(F.substr(line, colon + 1), ","), _trimmed), lambda t: t != "")
    rows = forms.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).where(colon > 1)
    rows = rows.select(key, "pos", _trimmed(F.substr(line, F.lit(1), colon - 1)).alias("name"), terms.alias("terms")).where("name <> '' AND size(terms) > 0")
    return rows.groupBy(key, "name").agg(F.min("pos").alias("place"), F.max_by("terms", "pos").alias("terms"))


def envelope_violation(origin: Column, text: Column, file_ref: Column, file_kind: Column) -> Column:
    """What is wrong with what an input of an origin carries; null if nothing."""
    as_text = text.isNull() | file_ref.isNotNull() | file_kind.isNotNull()
    as_file = file_ref.isNull() | text.isNotNull() | file_kind.isNull()
    return (
        F.when(origin.isNull() | ~origin.isin(TEXT_ORIGINS + FILE_ORIGINS + BARE_ORIGINS), "ORIGIN_UNKNOWN")
        .when(origin.isin(TEXT_ORIGINS), F.when(as_text, "TEXT_REQUIRED_WITHOUT_FILE"))
        .when(origin.isin(FILE_ORIGINS), F.when(as_file, "FILE_REQUIRED_WITHOUT_TEXT"))
        .when(text.isNotNull(), "TEXT_NOT_ALLOWED")
    )


def included_texts(inputs: DataFrame) -> DataFrame:
    """Text inputs with their content, at their own place."""
    return inputs.where((F.col("kind") == "text") & F.col("content_included") & F.col("content").isNotNull())


def without_content(inputs: DataFrame) -> DataFrame:
    return inputs.where(~F.col("content_included"))


def _over(at: Column, now: Column) -> Column:
    return F.coalesce(at <= now, F.lit(False))


def usable_tokens(asked: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """asked (token_id, user_id) with usable: the token (token_id, owner_id, revoked_at, expires_at, idle_expires_at) exists, is this
    user's, isn't revoked, and neither its end nor its end of idling (null: none) has come by now."""
    t = asked.join(tokens, "token_id", "left")
    ok = (F.col("owner_id") == F.col("user_id")) & F.col("revoked_at").isNull() & (F.col("expires_at") > now) & ~_over(F.col("idle_expires_at"), now)
    return t.select("token_id", "user_id", F.coalesce(ok, F.lit(False)).alias("usable"))


def session_outcomes(asked: DataFrame, sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """asked (session_hash) with the outcome: invalid (unknown, revoked, over, or of no user), not_active, not_admin, or ok."""
    s = asked.join(sessions, "session_hash", "left").join(users.select("user_id", "status", "role"), "user_id", "left")
    good = F.col("status").isNotNull() & F.col("revoked_at").isNull() & F.coalesce(F.col("expires_at") > now, F.lit(False))
    return s.select("session_hash", F.when(~good, "invalid").when(F.col("status") != "ACTIVE", "not_active").when(F.coalesce(F.col("role"), F.lit("")) != "ADMIN", "not_admin").otherwise("ok").alias("outcome"))
