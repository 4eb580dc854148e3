"""Keys at any depth, bodies by their size first, in batch and stream, and meaningful characters over all code points."""

import json
import random
import unicodedata

from pyspark.sql import functions as F

from sievegate.functions import keys, scalars
from sievegate.sources import wire


def test_keys_after_their_escapes(spark):
    deep = '{"a":' * 500 + '{"url": 1}' + "}" * 500
    rows = [("plain", '{"mime": "x"}'), ("escaped", '{"\\u006eame": 1}'), ("nested", '{"a": [1, {"b": [{"Path": 0}]}]}'), ("mixed", '{"a": [{"URL": 1}, 3, "x"]}'), ("value", '{"note": "\\"name\\": 1"}'), ("quoted", '{"x, name: y": 1, "`name`": 2}'),
            ("deep", deep), ("abyss", "[" * 100_000), ("list", "[1]"), ("none", None), ("broken", "{"), ("long", json.dumps({"k": "é" * 2040})), ("fits", json.dumps({"k": "é" * 2039})), ("spaces", '{"k":' + " " * 5000 + "1}"), ("nan", '{"k": NaN}'), ("twice", '{"name": 1, "name": 2}'), ("ligature", '{"ﬁlename": 1}')]
    df = spark.createDataFrame(rows, "id string, m string")
    got = {r["id"]: r["u"] for r in df.select("id", keys.unsafe_metadata(F.col("m")).alias("u")).collect()}
    assert {k for k, v in got.items() if v} == {"escaped", "nested", "mixed", "deep", "abyss", "list", "broken", "long", "nan", "twice", "ligature"}
    found = {r["id"]: r["k"] for r in df.select("id", keys.found_keys(F.col("m"), keys.WORKER_KEYS).alias("k")).collect()}
    assert found["nested"] == ["Path"] and found["deep"] == ["url"] and found["plain"] == [] and found["broken"] is None and found["ligature"] == []


def test_redacted_has_no_forbidden_key_with_a_value(spark):
    rng = random.Random(5)
    make = lambda d: rng.choice([1, "s", None]) if d == 0 else ({rng.choice(["text", "Text", "a", "fileName", "b"]): make(d - 1) for _ in range(3)} if rng.random() < 0.6 else [make(d - 1) for _ in range(2)])
    rows = [(k, json.dumps(make(4))) for k in range(50)]
    for r in spark.createDataFrame(rows, "i int, m string").select("m", keys.redacted(F.col("m")).alias("r")).collect():
        def same(a, b):
            if isinstance(a, dict):
                return a.keys() == b.keys() and all(b[k] == keys.REDACTED if k in keys.DIAGNOSTIC_KEYS else same(v, b[k]) for k, v in a.items())
            return len(a) == len(b) and all(map(same, a, b)) if isinstance(a, list) else a == b
        assert same(json.loads(r["m"]), json.loads(r["r"]))


LINES = [
    ('{"client_request_id": "a", "inputs": [{"input_id": "1", "size_bytes": 3, "metadata": {"k": [1]}}], "more": 1}', "ok"),
    ('{"client_request_id": "b", "inputs": 5}', "malformed"), ('{"client_request_id": "c"', "malformed"), ("", "malformed"), ("[1]", "malformed"), ("7", "malformed"), ("{}", "ok"),
    ('{"client_request_id": "' + "x" * 300 + '"}', "too_large"), ("{" * 400, "too_large"), ('{"client_request_id": "' + "é" * 88 + '"}', "ok"), ('{"client_request_id": "' + "é" * 89 + '"}', "too_large"),
]


def test_guarded_lines(spark):
    df = spark.createDataFrame([*LINES, (None, "malformed")], "value string, want string")
    rows = wire.guarded(df, most=202).collect()
    assert all(r["verdict"] == r["want"] and (r["request"] is not None) == (r["want"] == "ok") for r in rows)
    assert rows[0]["request"]["inputs"][0]["size_bytes"] == 3
    assert {r["verdict"]: r["n"] for r in wire.counted(wire.guarded(df, most=202)).collect()} == {"ok": 3, "malformed": 6, "too_large": 3}


def test_stream_and_batch_agree(spark, tmp_path):
    source, to = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(3):
        (source / f"{k}.txt").write_text("\n".join(line for line, _ in LINES[k::3]) + "\n")
    wire.write_stream(spark.readStream.text(str(source)), to, str(tmp_path / "c"), most=202).awaitTermination()
    (source / "late.txt").write_text(LINES[0][0] + "\n")
    wire.write_stream(spark.readStream.text(str(source)), to, str(tmp_path / "c"), most=202).awaitTermination()
    got = spark.read.parquet(to)
    want = wire.counted(wire.guarded(spark.read.text(str(source)), most=202))
    assert {tuple(r) for r in wire.counted(got).collect()} == {tuple(r) for r in want.collect()}
    assert got.where("verdict = 'too_large' AND (line IS NOT NULL OR request IS NOT NULL)").isEmpty()
    assert got.select("batch_id").distinct().count() == 2


def plain_meaningful(text):
    return sum(unicodedata.category(c)[0] in "LN" for c in unicodedata.normalize("NFKC", text))


def test_meaningful_characters_of_all_code_points(spark):
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(6)
    jamo = [chr(c) for a, b in ((0x1100, 0x1116), (0x1161, 0x117A), (0x11A7, 0x11C6), (0x3131, 0x3190), (0xFFA0, 0xFFDD), (0x3260, 0x3270)) for c in range(a, b)] + ["가", "각", "a", " ", "́"]
    texts = [*codes, *["".join(rng.choice(jamo) for _ in range(rng.randrange(2, 9))) for _ in range(20_000)], *["".join(rng.choices(codes[:0x3000], k=8)) for _ in range(20_000)], "", "é ½ ﬃ ㎏ ｶﾞ ①"]
    df = spark.createDataFrame([(t, plain_meaningful(t)) for t in texts], "t string, n int").repartition(8)
    wrong = df.where(scalars.meaningful_characters(F.col("t")) != F.col("n"))
    assert wrong.take(5) == []


def test_meaningful_characters_beside_each_other(spark):
    """Latin, punctuation and wide characters in one text: parts of a syllable with something between them are two."""
    texts = ["é–ß…", "가", "ᄀ–ᅡ", "ᄀɏᅡᆨ", "ﬃ é ㌀x", "", "… – ’", "½⅐²", "1éɐ⁰"]
    df = spark.createDataFrame([(t, plain_meaningful(t)) for t in texts], "t string, n int")
    assert df.where(scalars.meaningful_characters(F.col("t")) != F.col("n")).collect() == []
