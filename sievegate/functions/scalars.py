"""Small scalar functions: normalisation, bands, scores, labels, keyed hashes."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegate.functions.spans import REPEATED

# Scores by severity, order of actions and severities.
SEVERITY_SCORE = {"low": 25, "medium": 55, "high": 80, "critical": 95}
ACTIONS = ["ALLOW", "WARN", "MASK", "BLOCK"]
SEVERITIES = ["info", "low", "medium", "high", "critical"]


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in an order, from 0; -1 where it is in none."""
    return F.array_position(F.array(*map(F.lit, order)), value).cast("int") - 1


def normalize_text(text: Column) -> Column:
    """Runs of one punctuation mark or symbol become one."""
    return F.regexp_replace(text, REPEATED, "$1")


def risk_level(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def final_score(score: Column, action: Column) -> Column:
    return F.when(action == "BLOCK", F.greatest(score, F.lit(95))).when(action == "WARN", F.greatest(score, F.lit(40))).otherwise(score)


def severity_score(severity: Column) -> Column:
    out = F.lit(0)
    for name, score in SEVERITY_SCORE.items():
        out = F.when(severity == name, score).otherwise(out)
    return out


def size_bucket(size: Column) -> Column:
    """empty, small (1 MiB), medium (10 MiB) or large; null for negative sizes."""
    return F.when(size == 0, "empty").when((size > 0) & (size <= 1 << 20), "small").when((size > 0) & (size <= 10 << 20), "medium").when(size > 0, "large")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 0, "empty").when(n <= 32, "tiny").when(n <= 128, "short").when(n <= 512, "medium").when(n <= 2048, "long").otherwise("huge")


def public_action(action: Column) -> Column:
    return F.when(action == "ALLOW", "Allow").when(action == "WARN", "Warn").when(action == "MASK", "Mask").otherwise("Block")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed hash from sha2 alone."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero or of another dimension."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


@functools.cache
def _meaningful() -> tuple[dict[int, str], dict[int, str], str, str, str, str]:
    """For each number of letters and digits that a character other than ASCII is when normalised (NFKC), the class of these
    characters, and of those up to U+024F; and the classes of what ends in a leading consonant, in a vowel, in a syllable without
    final, in a final, of Hangul."""
    import unicodedata

    by_count: dict[int, list[int]] = {}
    jamo: dict[str, list[int]] = {k: [] for k in "LVST"}
    for code in range(128, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        form = unicodedata.normalize("NFKC", chr(code))
        if n := sum(unicodedata.category(x)[0] in "LN" for x in form):
            by_count.setdefault(n, []).append(code)
        if len(form) == 1:
            x = ord(form)
            kind = "L" if 0x1100 <= x < 0x1113 else "V" if 0x1161 <= x < 0x1176 else "T" if 0x11A8 <= x < 0x11C3 else "S" if 0xAC00 <= x < 0xD7A4 and (x - 0xAC00) % 28 == 0 else ""
            if kind:
                jamo[kind].append(code)
    classes = {n: _class(codes) for n, codes in by_count.items()}
    narrow = {n: _class(low) for n, codes in by_count.items() if (low := [c for c in codes if c < 0x250])}
    return classes, narrow, *[_class(jamo[k]) for k in "LVST"]


def _class(codes: list[int]) -> str:
    ranges, begin = [], codes[0]
    for a, b in zip(codes, [*codes[1:], -1], strict=True):
        if b != a + 1:
            ranges.append(f"\\x{{{begin:X}}}-\\x{{{a:X}}}")
            begin = b
    return "[" + "".join(ranges) + "]"


def meaningful_characters(text: Column) -> Column:
    """How many letters and numbers a text has after compatibility composition (NFKC), without normalising it: characters count by
    what they become, and where Hangul parts that follow each other become one syllable, it counts once. Null: null.

    Each class is counted by what is left without the others; the wide classes are for what stands above U+024F only, without general
    punctuation, which has no letters."""
    classes, narrow, lead, vowel, open_, final = _meaningful()
    left = lambda t, chars: F.length(F.regexp_replace(t, f"[^{chars[1:]}+", ""))
    latin = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    n = left(text, "[0-9A-Za-z]") + sum((k * left(latin, chars) for k, chars in narrow.items()), F.lit(0))
    other = F.regexp_replace(text, r"[\x00-\x{24F}\x{2000}-\x{206F}]+", " ")
    wide = sum((k * left(other, chars) for k, chars in classes.items()), F.lit(0)) - F.regexp_count(other, F.lit(lead + vowel)) - F.regexp_count(other, F.lit(f"(?:{lead}{vowel}|{open_}){final}"))
    return n + F.when(other.rlike("[^ ]"), wide).otherwise(0)
