"""Detectors of personal and payment data: arrays of (start, end) of a text column, without UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegate.functions.spans import at, overlap, spans

# Patterns, context words and checksum weights that the results depend on.
ADDRESS = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"
EMAIL = rf"(?<![A-Za-z0-9._%+-]){ADDRESS}(?![A-Za-z0-9_%+-])"
PHONE = r"(?U)(?<!\d)(?:(?:\+82[-.\s]?(?:10|2|[3-6][1-5]|70)[-.\s]?\d{3,4}[-.\s]?\d{4})|(?:0(?:10|2|[3-6][1-5]|70)[-.\s]?\d{3,4}[-.\s]?\d{4}))(?!\d)"
RESIDENT = r"(?U)(?<!\d)(\d{6})[-\s]?([1-4]\d{6})(?!\d)"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
ACCOUNT = r"(?U)(?<!\d)(?:\d{2,6}[-\s]?){2,4}\d{2,6}(?!\d)"
SECRET = r"(?i)(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{22,}|xox[baprs]-[A-Za-z0-9-]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----|(?:api[_-]?key|access[_-]?token|secret[_-]?key|client[_-]?secret|bearer)\s*[:=]\s*['\"]?[A-Za-z0-9._~+/=-]{16,})"
BANK_WORDS = "계좌|은행|국민|신한|우리|하나|농협|기업|카카오|토스|부산|대구|광주|전북|경남|수협|새마을|우체국"
RESIDENT_WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]

KEYS = ["EMAIL", "PHONE", "RRN", "CARD", "BANK_ACCOUNT"]


#: Every decimal digit of Unicode and its value.
_DIGITS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"}


def digits(value: Column) -> Column:
    """The decimal digits of any script, as 0 to 9."""
    kept = F.regexp_replace(value, r"\P{Nd}", "")
    return F.when(kept.rlike("[^0-9]"), F.translate(kept, "".join(_DIGITS), "".join(_DIGITS.values()))).otherwise(kept)


def valid_resident(value: Column) -> Column:
    d = F.transform(F.split(digits(value), ""), lambda x: x.cast("int"))
    total = F.aggregate(F.zip_with(F.slice(d, 1, 12), F.array(*map(F.lit, RESIDENT_WEIGHTS)), lambda x, w: x * w), F.lit(0), lambda a, x: a + x)
    return (F.length(digits(value)) == 13) & ((11 - total % 11) % 10 == F.element_at(d, 13))


def valid_card(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def email(text: Column, touching: bool = False) -> Column:
    """Texts without an @ are not searched. touching: also addresses that stand in a longer run of their own characters."""
    return F.when(F.contains(text, F.lit("@")), spans(text, ADDRESS if touching else EMAIL)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def phone(text: Column) -> Column:
    return spans(text, PHONE)


def resident(text: Column) -> Column:
    return F.filter(spans(text, RESIDENT), lambda s: valid_resident(at(text, s)))


def account(text: Column) -> Column:
    """Accounts of 10 to 16 digits with a bank word within 24 characters before or 12 after."""

    def near_bank(s: Column) -> Column:
        lo = F.greatest(s["start"] - 24, F.lit(0))
        return F.substring(text, lo + 1, s["end"] + 12 - lo).rlike(BANK_WORDS)

    return F.filter(spans(text, ACCOUNT), lambda s: F.length(digits(at(text, s))).between(10, 16) & near_bank(s))


def card(text: Column, accounts: Column, residents: Column) -> Column:
    """Luhn-valid numbers that overlap neither an account nor a resident number."""
    taken = F.concat(accounts, residents)
    return F.filter(spans(text, CARD), lambda s: valid_card(at(text, s)) & ~F.exists(taken, lambda t: overlap(s, t)))


def with_detections(df, text: str = "text", keys: list[str] | None = None, touching: Collection[str] = ()):
    """Adds detections: array of (start, end, detector_key), sorted; of some detectors only if keys are given. Each detector's spans
    become a column first, so that no regex runs twice. touching: the keys of detectors (EMAIL) whose
    matches may stand in a longer run of their own characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    columns = {k: c for k, c in zip(KEYS, ["_email", "_phone", "_rrn", "_card", "_account"], strict=True) if keys is None or k in keys}
    first = {"_email": lambda t: email(t, "EMAIL" in touching), "_phone": phone, "_rrn": resident, "_account": account}
    needed = set(columns.values()) | ({"_rrn", "_account"} if "CARD" in columns else set())
    out = df.withColumns({c: find(t) for c, find in first.items() if c in needed})
    if "CARD" in columns:
        out = out.withColumn("_card", card(t, F.col("_account"), F.col("_rrn")))

    def tag(key: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(key).alias("detector_key"))

    tagged = [F.transform(F.col(c), tag(k)) for k, c in columns.items()]
    none = F.array().cast("array<struct<start:int,end:int,detector_key:string>>")
    return out.withColumn("detections", F.sort_array(F.concat(*tagged)) if tagged else none).drop(*needed, "_card")
