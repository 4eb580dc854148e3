import pytest
from pyspark.sql import functions as F

from sievegate.functions import scalars
from sievegate.functions.detectors import SECRET, digits, with_detections
from sievegate.functions.spans import at, spans
from sievegate.operators import masking

VECTORS = [
    ("mail to a.b@example.com now", [("EMAIL", "a.b@example.com")]),
    ("x.y+z@sub.mail.example.co.uk.", [("EMAIL", "x.y+z@sub.mail.example.co.uk")]),
    ("a@b, @c.com, d@@e.com", []),
    ("010-1234-5678 and 02-345-6789", [("PHONE", "010-1234-5678"), ("PHONE", "02-345-6789")]),
    ("+82 10 9876 5432", [("PHONE", "+82 10 9876 5432")]),
    ("4111 1111 1111 1111", [("CARD", "4111 1111 1111 1111")]),
    ("4111-1111-1111-1112", []),
    ("378282246310005", [("CARD", "378282246310005")]),
    ("국민은행 123-456-789012", [("BANK_ACCOUNT", "123-456-789012")]),
    ("계약 123-456-789012", []),
    ("🙂 일 a@b.kr", [("EMAIL", "a@b.kr")]),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(VECTORS)], "id int, text string")
    return with_detections(df).withColumn("values", F.transform("detections", lambda d: at(F.col("text"), d))).cache()


def test_vectors(found):
    for r in found.collect():
        assert [(d.detector_key, v) for d, v in zip(r.detections, r["values"] or [], strict=False)] == VECTORS[r.id][1], r.text


def test_resident_checksum(spark):
    base = "900101123456"
    last = (11 - sum(int(d) * w for d, w in zip(base, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], strict=True)) % 11) % 10
    df = spark.createDataFrame([(k, f"no {base[:6]}-{base[6:]}{k} here") for k in range(10)], "id int, text string")
    assert [r.id for r in with_detections(df).where(F.exists("detections", lambda d: d["detector_key"] == "RRN")).collect()] == [last]


def test_masking_numbers_and_overlaps(spark):
    df = spark.createDataFrame([("a@b.com then c@d.org then a@b.com; 4111 1111 1111 1111",)], "text string")
    r = masking.masked(with_detections(df)).first()
    assert r.masked_text == "[EMAIL_1] then [EMAIL_2] then [EMAIL_1]; [CARD_1]" and r.n_masked == 4
    spans_ = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("detector_key")) for a, b, k in ((0, 5, "X"), (3, 10, "Y"), (10, 12, "Z"))])
    r = spark.range(1).select(masking.disjoint(spans_).alias("d")).first()
    assert [(x.start, x.end) for x in r.d] == [(3, 10), (10, 12)]  # touching spans don't overlap


def test_spans_of_a_pattern(spark):
    r = spark.createDataFrame([("a1🙂22b", "none")], "x string, y string").select(spans(F.col("x"), r"\d+").alias("x"), spans(F.col("y"), r"\d+").alias("y")).first()
    assert [tuple(s) for s in r.x] == [(1, 2), (3, 5)] and r.y == []


def test_scalars(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("wow!!! --a== ..b aabb",)], "t string")
    r = df.select(scalars.normalize_text(F.col("t")).alias("n"), scalars.hmac_sha256(F.col("t"), b"secret").alias("h"), scalars.hmac_sha256(F.col("t"), b"k" * 90).alias("h2")).first()
    assert r.n == "wow! -a= .b aabb"
    assert r.h == hmac.new(b"secret", b"wow!!! --a== ..b aabb", hashlib.sha256).hexdigest() and r.h2 == hmac.new(b"k" * 90, b"wow!!! --a== ..b aabb", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(s, a) for s in (0, 40, 70, 90) for a in ("ALLOW", "WARN", "BLOCK")], "s int, a string").select("s", "a", scalars.final_score(F.col("s"), F.col("a")).alias("f"), scalars.risk_level(F.col("s")).alias("l")).collect()
    assert {(r.s, r.l) for r in rows} == {(0, "low"), (40, "medium"), (70, "high"), (90, "critical")}
    assert all(r.f == {"ALLOW": r.s, "WARN": max(40, r.s), "BLOCK": max(95, r.s)}[r.a] for r in rows)
    sizes = spark.createDataFrame([(n,) for n in (-1, 0, 1 << 20, (1 << 20) + 1, 11 << 20)], "n long").select(scalars.size_bucket(F.col("n")).alias("b")).collect()
    assert [r.b for r in sizes] == [None, "empty", "small", "medium", "large"]


def test_digits_and_spaces_of_any_script(spark):
    rows = [(1, "010　1234　5678"), (2, "국민은행 123 456 789012"), (3, "０１０-１２３４-５６７８"), (4, "٤١١١ ١١١١ ١١١١ ١١١١"), (5, "010x1234x5678")]
    got = {r.id: [d["detector_key"] for d in r.detections] for r in with_detections(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: ["PHONE"], 2: ["BANK_ACCOUNT"], 3: [], 4: ["CARD"], 5: []}
    assert spark.createDataFrame([("１2٣ x",)], "t string").select(digits(F.col("t")).alias("d")).first().d == "123"


def test_regex_rules(spark):
    from sievegate.operators import rules

    rows = [(1, "key AKIA" + "A" * 16 + " and ghp_" + "b" * 24), (2, "api_key = '" + "c" * 16 + "'"), (3, "nothing"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.match_count, r.value_lengths) for r in rules.regex_matches(df, {"secret": SECRET}, "id").collect()}
    assert got == {1: (2, [20, 28]), 2: (1, [27])}
    mixed = spark.createDataFrame([(1, "FOO!!bar foo!bar"), (2, "fo!!!o")], "id int, text string")
    got = {(r.id, r.rule_id): r.value_lengths for r in rules.regex_matches(mixed, {"a": "foo!bar", "bad": "(", "b": "o!o", "empty": "x*"}, "id").collect()}
    assert got == {(1, "a"): [8, 7], (2, "b"): [5]}
