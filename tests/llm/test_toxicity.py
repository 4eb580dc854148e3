"""Operator 12: held-out accuracy, the gradient of the noisy-or, sentences found, odd rows."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sievegate.llm import toxicity
from tests.llm import cases


def test_noisy_or_is_one_less_the_product():
    z = np.array([-3.0, 0.2, -1.0])
    assert abs(toxicity.noisy_or(z) - (1 - np.prod(1 - 1 / (1 + np.exp(-z))))) < 1e-12


def test_features_against_a_plain_reading():
    text = "You IDIOT, go. Café über\n\n!? it's fine"
    places, sentences, spans = toxicity.features(text)
    words = [[w.group().lower() for w in re.finditer(rb"[A-Za-z0-9'\x80-\xff]+", s)] for s in re.split(rb"[.!?\n]", text.encode())]
    words = [s for s in words if s]
    begun = sum(len(w) > k for s in words for w in s for k in toxicity.BEGINNINGS)
    assert len(places) == sum(2 * len(s) - 1 for s in words) + begun
    assert len(spans) == len(words) == sentences.max() + 1
    assert [text.encode()[a:b].decode() for a, b in spans] == ["You IDIOT, go", "Café über", "it's fine"]
    again, *_ = toxicity.features(text.replace("IDIOT", "idiot"))
    assert (places == again).all()


def test_long_texts_are_read_in_whole_pieces(monkeypatch):
    text = " ".join(" ".join(cases.words(__import__("random").Random(k), 7)) + "." for k in range(300))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "PIECE", 500)
    cut = toxicity.features(text)
    assert (whole[2] == cut[2]).all()
    assert sorted(zip(*whole[:2], strict=True)) == sorted(zip(*cut[:2], strict=True))


def test_training_lowers_the_loss_and_finds_the_sentence():
    texts = [(f"a plain line {k}. another one here. and more {k % 7} words.", 0) for k in range(60)] + [(f"a plain line {k}. what an awful gronk you are. more {k % 5} words.", 1) for k in range(40)]
    rows = [(*toxicity.features(t)[:2], len(toxicity.features(t)[2]), y) for t, y in texts]
    w = toxicity.train(rows, l1=0.1)
    score = lambda t: toxicity.noisy_or(toxicity.sentence_logits(*toxicity.features(t)[:2], w, len(toxicity.features(t)[2])))
    assert all((score(t) >= 0.5) == y for t, y in texts)
    z = toxicity.sentence_logits(*rows[-1][:2], w, rows[-1][2])
    assert z.argmax() == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in toxicity.op12_toxicity(spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    one, zero = [r["score"] for r, y in held if y], [r["score"] for r, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero)) > 0.85
    assert sum(x >= 0.5 for x in zero) <= 0.03 * len(zero)


def test_labels_held_out_are_not_learned_and_score_ignores_other_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = toxicity.with_split(docs)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    a = toxicity.fit(rows.where("NOT held_out").select("doc_id", "text"), labels.where(~held))
    b = toxicity.fit(rows.where("NOT held_out").select("doc_id", "text"), labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).where(~held))
    assert a["weights"].tolist() == b["weights"].tolist(), np.flatnonzero(a["weights"] != b["weights"])


def test_odd_rows(spark):
    df = cases.frame(spark)
    labels = spark.createDataFrame([(k, k % 4 == 0) for k in range(40)] + [(3, None), (None, True), (5, True)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic")
    rows = toxicity.with_split(df)
    got = toxicity.score(rows, toxicity.fit(rows.where("NOT held_out").select("doc_id", "text"), labels)).collect()
    assert len(got) == df.count()
    by_text = {}
    for r, text in ((r, t) for t in df.select("doc_id", "text").collect() for r in got if r["doc_id"] == t["doc_id"] and cases_count(df, t["doc_id"]) == 1):
        by_text.setdefault(text["text"], set()).add(r["score"])
    assert all(len(x) == 1 for x in by_text.values()) and by_text[""] == {0.0}
    for none, share in ((labels.where("false"), 0.0), (labels.where("toxic = 1"), 1.0)):
        assert {r["score"] for r in toxicity.score(rows, toxicity.fit(rows.select("doc_id", "text"), none)).collect()} == {share}
    assert toxicity.score(rows.where("false"), {"weights": None, "share": 0.0}).count() == 0


_COUNTS = {}


def cases_count(df, doc_id):
    if not _COUNTS:
        for r in df.groupBy("doc_id").count().collect():
            _COUNTS[r["doc_id"]] = r["count"]
    return _COUNTS[doc_id]
