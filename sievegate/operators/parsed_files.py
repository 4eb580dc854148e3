"""From blocks of texts and files to the matches of rules in them and what becomes of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.functions.scalars import ACTIONS, rank_of, risk_level, severity_score
from sievegate.operators import rules
from sievegate.operators.inputs import scan_results


def wrapped_texts(inputs: DataFrame) -> DataFrame:
    """Texts of inputs (input_id, kind, text, and file_ref where a file was given as well) as blocks in the shape of ``files.parsed``,
    the input_id as path. Only text_wrapper inputs with a text and without a file can be wrapped; an empty text has no block."""
    bad = (F.coalesce(F.col("kind"), F.lit("")) != "text_wrapper") | F.col("text").isNull()
    if "file_ref" in inputs.columns:
        bad = bad | F.col("file_ref").isNotNull()
    text = F.when(~bad & (F.col("text") != ""), F.col("text"))
    return inputs.select(F.col("input_id").cast("string").alias("path"), "kind", F.when(bad, "failed").otherwise("parsed").alias("status"), F.when(bad, "UNSUPPORTED_FILE_KIND").alias("failure_code"), F.when(text.isNotNull(), 0).alias("block_index"), text.alias("text"), F.lit(None).cast("int").alias("place"))


def _gathered(blocks: DataFrame) -> DataFrame:
    """path, s (status, failure_code), b (block_index, text) of each file. All that follows asks for these two whole, so that Spark
    plans one exchange and files are parsed once. Rows without a path are no file."""
    block = F.when(F.col("block_index").isNotNull(), F.struct("block_index", "text"))
    return blocks.where("path IS NOT NULL").groupBy("path").agg(F.first(F.struct("status", "failure_code")).alias("s"), F.collect_list(block).alias("b"))


def _texts(gathered: DataFrame) -> DataFrame:
    texts = F.filter(F.transform(F.array_sort("b"), lambda x: x["text"]), lambda t: t != "")
    return gathered.where("s.status = 'parsed'").select("path", F.array_join(texts, "\n").alias("text")).where("text <> ''")


def runtime_texts(blocks: DataFrame) -> DataFrame:
    """path, text of each file whose status is parsed: its texts in order, a line break between them, empty ones left out. Files
    without a text have no row. A row holds the text of one file, as rules may match across its blocks."""
    return _texts(_gathered(blocks))


def file_matches(blocks: DataFrame, catalogue: list[rules.Rule]) -> DataFrame:
    """Every rule that matches the text of a parsed file: path, place, rule_id, kind, count, confidence, reason_code, severity, action."""
    return rules.all_matches(runtime_texts(blocks), catalogue, "path")


def file_results(blocks: DataFrame, catalogue: list[rules.Rule]) -> DataFrame:
    """A row for each file: path, status, failure_code, n_blocks, content_scanned, decision_basis, n_matches, action, risk_score,
    risk_level. What is partial, failed or unsupported is not scanned, so nothing in it is matched."""
    gathered = _gathered(blocks)
    found = rules.all_matches(_texts(gathered), catalogue, "path")
    best = found.groupBy("path").agg(F.count("*").alias("n_matches"), F.max(severity_score(F.col("severity"))).alias("score"), F.max_by("action", rank_of(F.col("action"), ACTIONS)).alias("action"))
    files = gathered.select("path", F.col("s.status").alias("parse_status"), F.col("s.failure_code").alias("failure_code"), F.size("b").cast("long").alias("n_blocks"))
    score = F.coalesce("score", F.lit(0))
    rows = files.join(best, "path", "left").withColumns({"n_matches": F.coalesce("n_matches", F.lit(0)).cast("long"), "kind": F.lit("file_reference"), "content_included": F.lit(False)})
    return scan_results(rows).select("path", F.col("parse_status").alias("status"), "failure_code", "n_blocks", "content_scanned", "decision_basis", "n_matches", F.coalesce("action", F.lit("ALLOW")).alias("action"), score.alias("risk_score"), risk_level(score).alias("risk_level"))
