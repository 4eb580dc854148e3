"""Names of keys at any depth of JSON texts, after their escapes are resolved: what must not be in metadata, messages and diagnostics.

Nesting has no bound that a column expression could follow, so a small walk over the parsed text runs in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that may name a file, compared without regard to case.
FILE_KEYS = ["name", "filename", "file_name", "original_filename", "path", "url"]
# Keys that messages of workers must not have, compared in lower case.
WORKER_KEYS = [
    "raw_prompt", "prompt", "file_content", "extracted_text", "ocr_text", "atom_text", "segment_text", "candidate_text", "detected_raw_value", "raw_value", "original_filename", "filename", "path", "url",
    "embedding", "embeddings", "embedding_vector", "segment_vector", "vector", "logits", "raw_logits", "classifier_score", "exact_score", "masked_prompt",
]
# Keys that metadata of signals must not have.
SIGNAL_KEYS = ["raw_value", "matched_value", "value", "action", "recommended_action", "reason_code", "user_message", "user_notice", "confidence_hint"]
# Keys that are blanked in diagnostics, compared as they are.
DIAGNOSTIC_KEYS = [
    "raw_prompt", "file_content", "fileContent", "extracted_text", "extractedText", "detected_raw_value", "detectedRawValue", "filename", "fileName", "file_name", "original_filename", "originalFileName",
    "masked_prompt", "maskedPrompt", "content_text", "contentText", "text",
]
REDACTED = "[redacted]"
METADATA_CHARS = 2048


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _parsed(text: str | None) -> Any:
    """The value of a JSON text; raises ValueError or RecursionError for anything else. NaN and infinities are no JSON."""
    return json.loads(text, parse_constant=_no_constant)


def _keys(value: Any) -> Iterator[str]:
    """The keys of all objects within a value."""
    left = [value]
    while left:
        v = left.pop()
        if isinstance(v, dict):
            yield from v
            left.extend(v.values())
        elif isinstance(v, list):
            left.extend(v)


def _redact(value: Any, keys: frozenset[str]) -> Any:
    if isinstance(value, dict):
        return {k: REDACTED if k in keys else _redact(v, keys) for k, v in value.items()}
    return [_redact(v, keys) for v in value] if isinstance(value, list) else value


def _each(use: Callable[[Any], Any], otherwise: Any, kind: str) -> Callable[[Column], Column]:
    """A function of a column of JSON texts: null for null, otherwise for what is no JSON."""

    def one(text: str | None) -> Any:
        if text is None:
            return None
        try:
            return use(_parsed(text))
        except (ValueError, RecursionError):
            return otherwise

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(batch, kind)


def found_keys(text: Column, keys: list[str], fold: bool = True) -> Column:
    """The keys of a JSON text, as written, that are among keys, in order and once each; null for null and for no JSON. fold: in
    lower case."""
    wanted = frozenset(keys)
    return _each(lambda v: sorted({k for k in _keys(v) if (k.lower() if fold else k) in wanted}), None, "array<string>")(text)


def unsafe_metadata(text: Column) -> Column:
    """Whether a JSON text is no object, is over METADATA_CHARS characters when written anew, or has a key at any depth that may name
    a file; null is safe."""
    wanted = frozenset(FILE_KEYS)

    def unsafe(v: Any) -> bool:
        return not isinstance(v, dict) or len(json.dumps(v, ensure_ascii=False, sort_keys=True)) > METADATA_CHARS or any(k.casefold() in wanted for k in _keys(v))

    return F.coalesce(_each(unsafe, True, "boolean")(text), F.lit(False))


def redacted(text: Column, keys: list[str] = DIAGNOSTIC_KEYS) -> Column:
    """The JSON text with the values of these keys blanked at any depth; null for null and for no JSON."""
    wanted = frozenset(keys)
    return _each(lambda v: json.dumps(_redact(v, wanted), ensure_ascii=False, separators=(",", ":")), None, "string")(text)
