import hashlib
from collections import Counter

from sievegate.llm import suffix
from tests.llm import cases


def brute(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(suffix.op10_suffix_dedup(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    data = cases.rows()
    assert result(suffix.removal(cases.frame(spark, data))) == brute([r[:2] for r in data])


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 300)
    data = cases.rows(3)
    found = list(suffix.groups(suffix.as_bytes(data[3][1] * 4)))
    assert sum(len(x[0]) for x in found) > 0
    assert sum(int((x[4] - x[3] + 1).sum()) for x in found) == max(0, 4 * len(data[3][1].encode()) - 199)


def test_texts_keep_other_columns(spark):
    df = cases.frame(spark)
    out = suffix.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    nulls = df.where("text IS NULL").count()
    assert out.where("text IS NULL").count() == nulls
    assert suffix.without_repeats(cases.frame(spark, [])).count() == 0
    copies = [(k, "many words that repeat " * 20, None, None, None) for k in range(2)] + [(2, "é" * 30, None, None, None)]
    assert sorted(r["text"] for r in suffix.without_repeats(cases.frame(spark, copies)).collect()) == ["", "", "é" * 30]


def test_prefix_doubling_of_every_position(spark):
    """Without the prefilter: every position takes part."""
    from pyspark.sql import functions as F

    from sievegate.llm.common import keyed

    data = cases.rows(7, 30)
    docs = keyed(cases.frame(spark, data)).withColumn("ranges", F.lit(None).cast("array<struct<lo:long,hi:long>>"))
    for length, first in ((200, 25), (64, 1), (16, 16)):
        got, _ = suffix.doubling(docs, length, first)
        texts = [(r[0], (r[1] or "").encode()) for r in data]
        seen = Counter(d[k : k + length] for _, d in texts for k in range(len(d) - length + 1))
        want = Counter((doc_id, k) for doc_id, d in texts for k in range(len(d) - length + 1) if seen[d[k : k + length]] > 1)
        assert Counter((r["doc_id"], r["at"]) for r in got.collect()) == want


def test_hot_passage(spark):
    """One passage in most texts, with other surroundings in each, and a text that is one byte over and over."""
    passage = " ".join(f"shared{k}" for k in range(60))
    data = [(k, f"{'abcdefgh'[k % 8] * (k % 90)} {k} {passage} {k * 7} end", None, None, None) for k in range(300)] + [(300, "z" * 1500, None, None, None)]
    assert result(suffix.removal(cases.frame(spark, data))) == brute([r[:2] for r in data])
