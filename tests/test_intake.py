import itertools
import math
import unicodedata

from pyspark.sql import functions as F

from sievegate.functions.spans import REPEATED, restored, spans
from sievegate.operators import mapping, requests, rules


def test_metadata(spark):
    rows = [(1, '{"mime": "a/b"}'), (2, '{"A": [{"File_Name": 1}]}'), (3, '{"note": "\\"url\\": x"}'), (4, "{"), (5, None), (6, '{"x": "' + "y" * 2048 + '"}'), (7, "")]
    df = spark.createDataFrame(rows, "id int, m string")
    got = {r.id: (r.unsafe, r.mime) for r in df.select("id", requests.unsafe_metadata(F.col("m")).alias("unsafe"), requests.json_string(F.col("m"), "mime").alias("mime")).collect()}
    assert got == {1: (False, "a/b"), 2: (True, None), 3: (False, None), 4: (True, None), 5: (False, None), 6: (True, None), 7: (True, None)}


def test_evidence_readers(spark):
    rows = [(1, '["a", 1, null, "b"]', '{"match_count": 3, "z": 4, "keyword_count": 1.5}'), (2, '{"a": 1}', '{"match_count": -3}'), (3, None, None), (4, "[" + ",".join(['"w"'] * 60) + "]", "[]"), (5, "no", "no")]
    df = spark.createDataFrame(rows, "id int, w string, c string")
    got = {r.id: (r.w, r.c, r.n) for r in df.select("id", requests.safe_strings(F.col("w")).alias("w"), requests.safe_numbers(F.col("c"), requests.COUNT_KEYS).alias("c"), requests.safe_numbers(F.col("c")).alias("n")).collect()}
    assert got[1] == (["a", "b"], {"match_count": 3}, {"match_count": 3, "z": 4})
    assert got[2] == ([], {"match_count": -3}, {})
    assert got[3] == ([], None, None) and len(got[4][0]) == 50 and got[5][0] == []


def atoms(spark, vectors, blocks=None):
    rows = [(1, k, f"a{k}", (blocks or [0] * len(vectors))[k], v, k * 10, k * 10 + 10, f"t{k}") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "input_id int, ordinal int, atom_id string, block int, vector array<double>, start int, end int, text string")


def cuts(df, **more):
    return [(r.segment_type, r.text, r.start, r.end) for r in mapping.checked_segments(df, **more).orderBy("segment").collect()]


def test_segments_checked(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    assert cuts(atoms(spark, [x, x, y, y])) == [("semantic", "t0t1", 0, 20), ("semantic", "t2t3", 20, 40)]
    assert cuts(atoms(spark, [x, y, y, x]), min_atoms=2) == [("semantic", "t0t1t2t3", 0, 40)]
    assert cuts(atoms(spark, [x])) == [("single_atom", "t0", 0, 10)]
    for bad in (None, [], [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], [1.0], [None, 1.0]):
        assert cuts(atoms(spark, [x, y, bad], [0, 0, 1])) == [("structure", "t0t1", 0, 20), ("single_atom", "t2", 20, 30)], bad
    assert cuts(atoms(spark, [x]).limit(0)) == []


def test_signals_mapped(spark):
    at = spark.createDataFrame([(1, 0, "a", "b0", 0, 2000), (1, 0, "b", "b1", 2000, 2010), (1, 1, "c", "b0", 2010, 5000)], "input_id int, segment int, atom_id string, block_id string, start int, end int")
    rows = [(1, "s", "b0", 1990, 2020, "low"), (1, "s", "b0", 1995, 2020, "high"), (1, "t", "b1", 1990, 2020, "high"), (1, "touching", "b1", 2010, 2012, "low"), (1, "empty", "b0", 5, 5, "low"), (2, "s", "b0", 1, 2, "low")]
    signals = spark.createDataFrame(rows, "input_id int, signal_id string, block_id string, start int, end int, severity string")
    got = sorted((r.signal_id, r.segment, r.basis, r.severity) for r in mapping.mapped_signals(signals, at).collect())
    assert got == [("s", 0, "atom_membership", "low"), ("t", 0, "atom_membership", "high")]
    every = mapping.mapped_signals(signals, at, several=True)
    assert sorted((r.signal_id, r.segment, r.basis) for r in every.collect()) == [("s", 0, "atom_membership"), ("s", 1, "offset_overlap"), ("t", 0, "atom_membership")]
    assert {r.segment: (r.signal_count, r.max_severity) for r in mapping.signal_sets(every).collect()} == {0: (2, "high"), 1: (1, "low")}


def test_uploads(spark):
    rows = [(1, "pdf", " Text/HTML ", ".PDF", 0), (2, "movie", None, None, 5), (3, "code", "a b", "x.y", 16_385), (4, None, "", "", 1 << 21)]
    df = requests.upload_intake(spark.createDataFrame(rows, "id int, file_kind string, mime_hint string, extension_hint string, size long"))
    assert {r.id: (r.rejected, r.mime, r.extension, r.bucket) for r in df.collect()} == {1: (None, "text/html", "pdf", "empty"), 2: ("unsupported_kind", None, None, None), 3: (None, None, None, "small"), 4: ("unsupported_kind", None, None, None)}


def test_restored_ranges(spark):
    texts = ["a!!b..", "...", "--==x", "a🙂🙂🙂b!!", "", "plain", "!!a!!"]
    rows = [(t, s, e) for t in texts for s in range(-1, 7) for e in range(8)]

    def plain(t, s, e):
        runs = [list(g) for _, g in itertools.groupby(range(len(t)), lambda i: (t[i], None if unicodedata.category(t[i])[0] in "PS" else i))]
        return (runs[s][0], runs[e - 1][-1] + 1) if 0 <= s < e <= len(runs) else None

    df = spark.createDataFrame(rows, "t string, start int, end int")
    for r in df.withColumn("o", restored(spans(F.col("t"), REPEATED), F.length("t"), F.struct("start", "end"))).collect():
        assert (r.o and tuple(r.o)) == plain(r.t, r.start, r.end), r


def test_rules_in_order(spark):
    R = rules.Rule
    catalogue = [R("k", "keyword", "custom", "My word", "low", "WARN", "stop"), R("c", "context_rule", "custom", "ctx", "high", "MASK", terms=("one", "two"), least=2), R("x", "regex", "built_in", "Code", "low", "BLOCK", "[0-9]{3}z"), R("card", "detector", "built_in", "Card", "high", "MASK", "CARD"), R("off", "keyword", "custom", "Off", "low", "WARN", "one", enabled=False), R("other", "keyword", "imported", "O", "low", "WARN", "one")]
    rows = [(1, "Stop stop 123z one TWO 4111 1111 1111 1111"), (2, "one"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = [(r.id, r.rule_id, r["count"], r.confidence, r.reason_code) for r in rules.all_matches(df, catalogue, "id").orderBy("id", "place").collect()]
    assert got == [(1, "card", 1, 100, "BUILT_IN_DETECTOR_CARD"), (1, "k", 2, 90, "CUSTOM_KEYWORD_MY_WORD"), (1, "c", 2, 80, "CUSTOM_CONTEXT_RULE_CTX"), (1, "x", 1, 90, "BUILT_IN_REGEX_CODE")]
    assert rules.all_matches(df, [], "id").count() == 0
