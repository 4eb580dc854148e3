"""Inputs of a request: their contract, whether they were scanned, and what that is evidence of; coverage of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of texts in bytes, thresholds of page coverage in characters.
COMPOSER_BYTES, PASTE_BYTES = 262_144, 1_048_576
OCR_BELOW, OCR_WITH_IMAGE_BELOW = 30, 120


def violations(kind: Column, source: Column, included: Column, content: Column, size: Column) -> Column:
    """What an input breaks of its contract; an empty array if nothing."""
    limit = F.when(source == "composer", COMPOSER_BYTES).otherwise(PASTE_BYTES)
    checks = [
        F.when(included & content.isNull(), "CONTENT_MISSING"),
        F.when(~included & content.isNotNull(), "CONTENT_NOT_ALLOWED"),
        F.when(included & (kind != "text"), "CONTENT_ONLY_FOR_TEXT"),
        F.when(included & (F.octet_length(content) != size), "SIZE_MISMATCH"),
        F.when(included & (F.octet_length(content) > limit), "CONTENT_TOO_LARGE"),
    ]
    return F.array_compact(F.array(*checks))


def scan_results(inputs: DataFrame) -> DataFrame:
    """inputs (kind, content_included, parse_status, n_matches): content_scanned and decision_basis."""
    parsed = F.coalesce(F.col("parse_status") == "parsed", F.lit(False))
    scanned = parsed | (F.col("content_included") & (F.col("kind") == "text"))
    basis = F.when(scanned & (F.col("n_matches") > 0), "detection").when(scanned, "no_detection").when(F.col("kind") == "attachment_metadata", "metadata_only").otherwise("content_unavailable")
    return inputs.withColumns({"content_scanned": scanned, "decision_basis": basis})


def page_coverage(pages: DataFrame, most: int = 3) -> DataFrame:
    """pages (doc_id, page, status, n_chars, image): bucket, candidate reason, and whether it is one of the first candidates to be read."""
    n = F.col("n_chars")
    bucket = F.when(n == 0, "zero").when(n < OCR_BELOW, "very_low").when(n < OCR_WITH_IMAGE_BELOW, "low").otherwise("sufficient")
    reason = F.when(F.col("status") == "failed", "native_failed").when(n < OCR_BELOW, "low_text").when((n < OCR_WITH_IMAGE_BELOW) & F.col("image").isin("present", "unknown"), "low_text_with_image")
    marked = pages.withColumns({"bucket": bucket, "reason": reason}).withColumn("candidate", F.col("reason").isNotNull())
    nth = F.row_number().over(Window.partitionBy("doc_id", "candidate").orderBy("page"))
    return marked.withColumn("selected", F.col("candidate") & (nth <= most))


def rule_set_version(rules: DataFrame, *keys: str) -> DataFrame:
    """keys, version: a short hash of all rule ids and versions of each catalogue, 'filter-rules:none' without rules (where there are no
    keys). A catalogue's rules are settings, a short list."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "version"))), lambda r: F.concat_ws(":", r["rule_id"], r["version"]))
    short = F.when(F.size("ids") == 0, "none").otherwise(F.substring(F.sha2(F.array_join("ids", "|"), 256), 1, 16))
    return rules.groupBy(*keys).agg(ids.alias("ids")).select(*keys, F.concat(F.lit("filter-rules:"), short).alias("version"))


def signal_id(input_id: Column, block_id: Column, pattern_id: Column, span: Column) -> Column:
    return F.concat(F.lit("sig_"), F.substring(F.sha2(F.concat_ws(":", input_id, block_id, pattern_id, span["start"], span["end"]), 256), 1, 20))


def signals_to_segments(signals: DataFrame, segments: DataFrame) -> DataFrame:
    """Each signal (input_id, signal_id, start, end) with the first segment (input_id, segment, start, end) that it overlaps;
    touching ranges don't overlap. The join is on input_id, the range a condition on its pairs."""
    s = segments.select("input_id", "segment", F.col("start").alias("_start"), F.col("end").alias("_end"))
    met = signals.join(s, "input_id").where((F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")))
    return met.groupBy("input_id", "signal_id").agg(F.min("segment").alias("segment"))


#: White space and line ends as Python's str has them.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]"
LINE_END = r"\r\n|[\n-\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, also within the lambdas of use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(text: Column, size: int = 900, overlap: int = 120, most: int = 8) -> Column:
    """A short text whole; else windows of size characters and lines of 80 to size, without repeats (white space aside), the first few."""
    tidy = lambda x: F.struct(F.regexp_replace(x, f"{SPACE}+", " ").alias("key"), x.alias("chunk"))

    def parts(t: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - overlap, F.lit(1)), F.lit(size - overlap)), lambda k: stripped(F.substring(t, k, F.lit(size))))
        lines = F.filter(F.transform(F.split(t, LINE_END), stripped), lambda x: F.length(x).between(80, size))
        return F.filter(F.when(F.length(t) <= size, F.array(t)).otherwise(F.concat(windows, lines)), lambda x: x != "")

    def firsts(found: Column) -> Column:
        keys = F.slice(F.array_distinct(F.transform(found, lambda x: x["key"])), 1, most)
        return F.transform(keys, lambda key: F.element_at(F.filter(found, lambda x: x["key"] == key), 1)["chunk"])

    return bound(F.transform(bound(stripped(text), parts), tidy), firsts)
