"""Chunks against Python's own strings, the verifier and the outcome of requests against plain loops."""

import random

from pyspark.sql import functions as F

from sievegate.operators import inputs, verifier


def plain_chunks(text, size=900, overlap=120, most=8):
    t = text.strip()
    if not t:
        return []
    parts = [t] if len(t) <= size else [t[k : k + size].strip() for k in range(0, len(t) - overlap, size - overlap)] + [s for x in t.splitlines() if 80 <= len(s := x.strip()) <= size]
    first = {}
    for p in parts:
        if key := " ".join(p.split()):
            first.setdefault(key, p)
    return list(first.values())[:most]


def texts():
    rng = random.Random(8)
    spaces = [" ", "  ", "\n", "\r\n", "\t", " ", " ", "\x85", "\x1c", "　"]
    out = ["", " \n ", "short", " x " * 300, "y" * 900, "y" * 901, "é" * 2000]
    for _ in range(60):
        out.append("".join(rng.choice(["word", "lönger", "z" * 90, "a"]) * rng.choice([1, 1, 20]) + rng.choice(spaces) for _ in range(rng.randrange(1, 400))))
    return out


def test_chunks(spark):
    rows = list(enumerate(texts()))
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, t string").select("i", inputs.chunks(F.col("t"))).collect()}
    assert got == {i: plain_chunks(t) for i, t in rows}


class Counting:
    loads = 0

    def __init__(self):
        type(self).loads += 1

    def score(self, pairs, max_length_tokens):
        assert max_length_tokens == 384 and all(p.startswith("Label: L") and "\nYES: yes\nNO: no\nBoundary: edge\n\nText:\n" in p for p in pairs)
        text = [p.split("\nText:\n", 1)[1] for p in pairs]
        if any("raise" in t for t in text):
            raise RuntimeError
        if any("short" in t for t in text):
            return [0.5] * (len(pairs) - 1)
        return [float("nan") if "nan" in t else 2.0 if "high" in t else min(1.0, len(t) / 1000) for t in text]


def test_verify(spark):
    candidates = [(1, 0, "a", "L1", "x" * 500), (1, 1, "b", "L1", "x" * 499), (1, 2, "c", "L2", "any"), (1, 3, "d", "L3", "any"), (1, 4, "e", "L1", None), (1, 5, "f", "L2", " "), (1, 6, "g", "L1", "y" * 950),
                  (2, 0, "a", "L1", "fine"), (2, 1, "b", "L1", "nan"), (2, 2, "c", "L1", "raise"), (3, 0, "a", "L1", "raise"), (3, 1, "b", "L1", "high"), (4, 0, "a", "L1", "short"), (5, 0, "a", "L2", "raise"), (6, 0, "a", "L1", "high")]
    df = spark.createDataFrame(candidates, "input_id int, ord int, segment_id string, label string, text string").repartition(3)
    definitions = spark.createDataFrame([("L1", "yes", "no", "edge", 0.5), ("L3", "yes", "no", "edge", None)], "label string, positive string, negative string, boundary string, threshold double")
    found, failures = verifier.verify(df, definitions, "counting", Counting)
    got = {(r["input_id"], r["segment_id"]): (r["status"], r["accepted"], r["confidence"], r["reason"]) for r in found.collect()}
    assert got == {
        (1, "a"): ("confirmed", True, 0.5, "VERIFIER_CONFIRMED"), (1, "b"): ("rejected", False, 0.499, "VERIFIER_REJECTED"),
        (1, "c"): ("uncertain", False, None, "VERIFIER_LABEL_DEFINITION_MISSING"), (1, "d"): ("uncertain", False, None, "VERIFIER_LABEL_DEFINITION_MISSING"),
        (1, "e"): ("failed", False, None, "VERIFIER_TEXT_UNAVAILABLE"), (1, "f"): ("failed", False, None, "VERIFIER_TEXT_UNAVAILABLE"),
        (1, "g"): ("confirmed", True, 0.9, "VERIFIER_CONFIRMED"), (5, "a"): ("uncertain", False, None, "VERIFIER_LABEL_DEFINITION_MISSING"),
    }
    assert {r[0]: r[1] for r in failures.collect()} == {2: "VERIFIER_INVALID_SCORE", 3: "VERIFIER_MODEL_FAILED", 4: "VERIFIER_INVALID_SCORE", 6: "VERIFIER_INVALID_SCORE"}


def test_requested_takes_candidates_alone(spark):
    c = spark.createDataFrame([(1, 0, 7, "L"), (1, 1, 9, "L")], "input_id int, ord int, segment_id int, label string")
    s = spark.createDataFrame([(1, 7, "seven"), (1, 8, "eight"), (2, 9, "other input")], "input_id int, segment_id int, text string")
    assert {(r["segment_id"], r["text"]) for r in verifier.requested(c, s).collect()} == {(7, "seven"), (9, "")}


def plain_outcome(rows, enabled, available, code):
    if not enabled:
        return None, False, 0, 0, 0, 0
    if not available:
        return code or "ANALYZE_CLASSIFIER_FAILED", False, 0, 0, 0, 0
    classified, verified = [], []
    for _, content, stage, classifier, n, failed, accepted in sorted(rows, key=lambda r: r[0]):
        if not (content or "").strip():
            continue
        if stage:
            return stage, False, 0, 0, 0, 0
        if classifier:
            return classifier, sum(classified) > 0, len(classified), sum(classified), 0, 0
        classified.append(n)
        if n and failed:
            return failed, True, len(classified), sum(classified), len(verified), sum(verified)
        if n and accepted is not None:
            verified.append(accepted)
    return None, sum(classified) > 0, len(classified), sum(classified), len(verified), sum(verified)


def test_outcomes(spark):
    rng = random.Random(9)
    rows, providers, want = [], [], {}
    for r in range(300):
        mine = [(i, rng.choice(["a", "a", " \n", None, ""]), rng.choice([None] * 8 + ["S1", "S2"]), rng.choice([None] * 8 + ["C"]), rng.randrange(3), rng.choice([None] * 5 + ["V"]), rng.choice([None, 0, 2])) for i in rng.sample(range(20), rng.randrange(0, 6))]
        on = (rng.random() < 0.9, rng.random() < 0.9, rng.choice([None, "P"]))
        rows += [(r, *m) for m in mine]
        providers.append((r, *on))
        want[r] = (on[0], *plain_outcome(mine, *on))
    df = spark.createDataFrame(rows, "request_id int, input_index int, content string, stage_failure string, classifier_failure string, n_candidates long, verifier_failure string, accepted_count long").repartition(4)
    got = verifier.outcomes(df, spark.createDataFrame(providers, "request_id int, enabled boolean, available boolean, provider_failure string"))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
