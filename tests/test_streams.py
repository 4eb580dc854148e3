"""The stream forms of the rate limiter and of the sweep of files, against the batch forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievegate.operators import temp_store
from sievegate.streaming import limits

START = datetime(2024, 1, 1)


def stream(spark, folder, batches, schema, build):
    """The rows that build(stream) gives, one file a batch, in order."""
    source = folder / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(folder / f"b{k}"))
        (next((folder / f"b{k}").glob("part-*.parquet"))).rename(source / f"{k}.parquet")
        query = build(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(folder / "out")).collect()


def test_rate_limit(spark, tmp_path):
    import random

    rng = random.Random(2)
    hits = sorted(((START + timedelta(seconds=rng.randrange(0, 900)), k, rng.choice(["a", "a", "b", "c"])) for k in range(200)), key=lambda h: h[:2])
    rows = [(k, who, at) for at, k, who in hits]
    schema = "id long, login_id string, created_at timestamp"
    got = stream(spark, tmp_path, [rows[:70], rows[70:71], rows[71:]], schema, lambda s: limits.rate_limited_stream(s, 3, 60, "1 hour"))
    want = limits.rate_limited(spark.createDataFrame(rows, schema), 3, 60).collect()
    assert sorted(map(tuple, got)) == sorted((r["id"], r["login_id"], r["allowed"]) for r in want)
    assert 0 < sum(r["allowed"] for r in want) < 200


def test_sweep(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[("fref_a", at(0), at(100)), ("fref_b", at(0), at(5000))], [("fref_c", at(90), at(300)), ("fref_a", at(95), at(150))], [("fref_d", at(1000), at(2000))], [("fref_e", at(1001), at(2000))]]
    got = stream(spark, tmp_path, batches, "file_ref string, created_at timestamp, expires_at timestamp", temp_store.sweep_stream)
    assert sorted((r["file_ref"], r["expires_at"]) for r in got) == [("fref_a", at(150)), ("fref_c", at(300))]


def key():
    return F.unhex(F.lit("00112233445566778899aabbccddeeff" * 2))


@pytest.fixture(scope="module")
def stored(spark):
    files = spark.createDataFrame([(1, bytearray(b"one"), "u", "r"), (2, bytearray(b""), "u", "r"), (3, None, "u", "r"), (4, bytearray(b"\x00\xff" * 5000), None, "r")], "n int, content binary, subject_id string, request_id string")
    return temp_store.store(files, key(), F.lit(START)).checkpoint()


def test_round_trip_and_what_forbids_it(spark, stored):
    assert "content" not in stored.columns and stored.count() == 3
    rows = {r["n"]: r for r in stored.collect()}
    assert all(r["file_ref"].startswith("fref_") and r["temp_scope_id"].startswith("tscope_") and r["expires_at"] == START + timedelta(seconds=900) and b"one" not in bytes(r["sealed"]) for r in rows.values())
    ask = lambda **other: stored.select("n", *[other.get(c, F.col(c)) for c in temp_store.BOUND])
    late = lambda s: F.lit(START + timedelta(seconds=s))
    codes = lambda df: {r["n"]: (r["failure_code"], None if r["content"] is None else bytes(r["content"])) for r in df.collect()}
    assert codes(temp_store.resolve(ask(), stored, key(), late(899))) == {1: (None, b"one"), 2: (None, b""), 4: (None, b"\x00\xff" * 5000)}
    for df, code in (
        (temp_store.resolve(ask(), stored, key(), late(900)), "TEMP_FILE_EXPIRED"), (temp_store.resolve(ask(subject_id=F.lit("v").alias("subject_id")), stored, key(), late(1)), "TEMP_FILE_ACCESS_DENIED"), (temp_store.resolve(ask(file_ref=F.lit("fref_x").alias("file_ref")), stored, key(), late(1)), "TEMP_FILE_NOT_FOUND"),
        (temp_store.resolve(ask(), stored, F.unhex(F.lit("ff" * 32)), late(1)), "TEMP_FILE_DECRYPT_FAILED"), (temp_store.resolve(ask(request_id=F.lit("q").alias("request_id")), stored.withColumn("request_id", F.lit("q")), key(), late(1)), "TEMP_FILE_DECRYPT_FAILED"),
        (temp_store.resolve(ask(), stored.limit(0), key(), late(1)), "TEMP_FILE_NOT_FOUND"),
    ):
        assert set(codes(df).values()) == {(code, None)}


def test_swept(spark, stored):
    kept, gone = temp_store.swept(stored, F.lit(START + timedelta(seconds=899)))
    assert kept.count() == 3 and gone.count() == 0
    kept, gone = temp_store.swept(stored.withColumn("expires_at", F.when(F.col("n") == 1, F.lit(None)).otherwise(F.col("expires_at"))), F.lit(START + timedelta(seconds=800)))
    assert kept.count() == 2 and gone.count() == 1
