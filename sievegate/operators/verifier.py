"""The verifier half of the cascade: candidates with their texts, chunks, pair texts, a scorer behind a port, and what a request comes to.

A scorer is anything with ``score(pairs, max_length_tokens) -> list of floats``. ``verify`` is given a function that loads one, and a
name; a worker loads it once under that name. Candidates are scored on their own, so what one of them breaks stays with its input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegate.operators import inputs


class Scorer(Protocol):
    def score(self, pairs: list[str], max_length_tokens: int) -> list[float]: ...


class LinearScorer:
    """The logistic function of a bias and the shares of words in the text below the definition."""

    def __init__(self, weights: dict[str, float], bias: float = 0.0):
        self.weights, self.bias = weights, bias

    def score(self, pairs: list[str], max_length_tokens: int) -> list[float]:
        out = []
        for pair in pairs:
            text = pair.split("\nText:\n", 1)[1]
            z = self.bias + sum(w * text.count(word) / max(len(text), 1) for word, w in self.weights.items())
            out.append(1 / (1 + math.exp(-z)))
        return out


_LOADED: dict[str, Scorer] = {}


def _scorer(name: str, load: Callable[[], Scorer]) -> Scorer:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def requested(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """candidates (input_id, ord, segment_id, label) of the classifier with the text of their segment (input_id, segment_id, text);
    one whose segment is missing has an empty text."""
    return candidates.join(segments.select("input_id", "segment_id", "text"), ["input_id", "segment_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def pair_text(label: Column, positive: Column, negative: Column, boundary: Column, text: Column) -> Column:
    return F.concat(F.lit("Label: "), label, F.lit("\nYES: "), positive, F.lit("\nNO: "), negative, F.lit("\nBoundary: "), boundary, F.lit("\n\nText:\n"), text)


def _scored(rows: DataFrame, name: str, load: Callable[[], Scorer], max_length_tokens: int) -> DataFrame:
    """Adds confidence (the highest of the pairs) and error (null, or why there is none)."""
    schema = T.StructType(list(rows.schema.fields)).add("confidence", T.DoubleType()).add("error", T.StringType())

    def one(scorer: Scorer, pairs: list[str] | None) -> tuple[float | None, str | None]:
        if pairs is None:
            return None, None
        try:
            scores = scorer.score(pairs, max_length_tokens)
        except Exception:  # whatever a model raises is its failure, not that of the job
            return None, "VERIFIER_MODEL_FAILED"
        if len(scores) != len(pairs) or any(not math.isfinite(x) or not 0 <= x <= 1 for x in scores):
            return None, "VERIFIER_INVALID_SCORE"
        return max(map(float, scores)), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, load)
        for batch in batches:
            got = [one(scorer, pairs) for pairs in batch.column("pairs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def verify(candidates: DataFrame, definitions: DataFrame, name: str, load: Callable[[], Scorer], max_length_tokens: int = 384) -> tuple[DataFrame, DataFrame]:
    """verifications (input_id, ord, segment_id, label, status, accepted, confidence, reason) and failures (input_id, failure_code).

    candidates (input_id, ord, segment_id, label, text); definitions (label, positive, negative, boundary, threshold), a small table
    of settings. No text: failed. No definition or threshold: uncertain. Else the highest score of the chunks decides, from the
    threshold on confirmed. A scorer that raises, or whose scores are not numbers from 0 to 1, one a pair, fails its input as a whole,
    with the code of the first such candidate (by ord): the input has no verifications."""
    d = definitions.where("threshold IS NOT NULL AND positive IS NOT NULL").select("label", "positive", "negative", "boundary", "threshold")
    rows = candidates.select("input_id", "ord", "segment_id", "label", "text").join(d, "label", "left")
    chunks = inputs.chunks(F.coalesce("text", F.lit("")))
    known, blank = F.col("threshold").isNotNull(), F.size("chunks") == 0
    pairs = F.transform("chunks", lambda c: pair_text(F.col("label"), F.col("positive"), F.coalesce("negative", F.lit("")), F.coalesce("boundary", F.lit("")), c))
    rows = rows.withColumn("chunks", chunks).withColumn("blank", blank).withColumn("pairs", F.when(known & ~blank, pairs))
    scored = _scored(rows.select("input_id", "ord", "segment_id", "label", "threshold", "blank", "pairs"), name, load, max_length_tokens).drop("pairs")
    failures = scored.where("error IS NOT NULL").groupBy("input_id").agg(F.min_by("error", "ord").alias("failure_code"))
    confirmed = F.col("confidence") >= F.col("threshold")
    status = F.when(F.col("blank"), "failed").when(F.col("threshold").isNull(), "uncertain").when(confirmed, "confirmed").otherwise("rejected")
    reason = F.when(F.col("blank"), "VERIFIER_TEXT_UNAVAILABLE").when(F.col("threshold").isNull(), "VERIFIER_LABEL_DEFINITION_MISSING").when(confirmed, "VERIFIER_CONFIRMED").otherwise("VERIFIER_REJECTED")
    kept = scored.join(failures, "input_id", "left_anti")
    return kept.select("input_id", "ord", "segment_id", "label", status.alias("status"), F.coalesce(confirmed & ~F.col("blank"), F.lit(False)).alias("accepted"), "confidence", reason.alias("reason")), failures


def outcomes(results: DataFrame, providers: DataFrame) -> DataFrame:
    """What the classifier and the verifier make of each request, its inputs taken in order up to the first that fails.

    providers (request_id, enabled, available, provider_failure). results, a row an input: request_id, input_index, content,
    stage_failure (of normalising, scanning, atoms, embeddings, segments, mapping), classifier_failure, n_candidates,
    verifier_failure, accepted_count (null where there is no verifier). Blank inputs count for nothing.

    A failed stage voids all summaries, a failed classifier those of the verifier, a failed verifier only what follows. Rows:
    request_id, enabled, failure_code, has_candidates, n_classified, candidate_count, n_verified, accepted_count."""
    texts = results.where(F.length(inputs.stripped(F.coalesce("content", F.lit("")))) > 0)
    kind = F.when(F.col("stage_failure").isNotNull(), 0).when(F.col("classifier_failure").isNotNull(), 1).when((F.col("n_candidates") > 0) & F.col("verifier_failure").isNotNull(), 2)
    texts = texts.withColumns({"kind": kind, "code": F.coalesce("stage_failure", "classifier_failure", "verifier_failure")})
    first = texts.where("kind IS NOT NULL").groupBy("request_id").agg(F.min(F.struct("input_index", "kind", "code")).alias("x")).select("request_id", F.col("x.input_index").alias("end"), F.col("x.kind").alias("how"), "x.code")
    rows = texts.drop("code").join(first, "request_id", "left")
    before = F.col("end").isNull() | (F.col("input_index") < F.col("end"))
    classified = (before | (F.col("input_index") == F.col("end")) & (F.col("how") == 2)) & (F.coalesce("how", F.lit(3)) > 0)
    verified = before & (F.coalesce("how", F.lit(3)) > 1) & (F.col("n_candidates") > 0) & F.col("accepted_count").isNotNull()
    per = rows.groupBy("request_id").agg(
        F.first("code").alias("code"), F.first("how").alias("how"), F.count_if(classified).alias("n_classified"), F.sum(F.when(classified, F.col("n_candidates"))).alias("candidate_count"),
        F.count_if(verified).alias("n_verified"), F.sum(F.when(verified, F.col("accepted_count"))).alias("accepted"))
    out = providers.join(per, "request_id", "left")
    on = F.col("enabled") & F.col("available")
    number = lambda c: F.when(on, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    failure = F.when(F.col("enabled") & ~F.col("available"), F.coalesce("provider_failure", F.lit("ANALYZE_CLASSIFIER_FAILED"))).when(on, F.col("code"))
    has = on & ((F.coalesce("how", F.lit(3)) == 2) | (F.coalesce("candidate_count", F.lit(0)) > 0))
    return out.select("request_id", "enabled", failure.alias("failure_code"), has.alias("has_candidates"), number("n_classified").alias("n_classified"), number("candidate_count").alias("candidate_count"), number("n_verified").alias("n_verified"), number("accepted").alias("accepted_count"))
