import corpus_pipeline
from sievegate.llm import near
from tests.llm import cases, test_near


def similarity(a, b):
    a, b = test_near.shingles(a), test_near.shingles(b)
    return len(a & b) / len(a | b)


def test_pairs_from_80_on_go(spark, sf_dir):
    base = [f"w{k}" for k in range(204)]  # 200 shingles
    texts = [" ".join(base[:-cut] if cut else base) for cut in (0, 40)]  # 160 of 200 shingles: at the threshold
    texts += [" ".join(f"v{k}" for k in range(lo, lo + 204)) for lo in (0, 20, 400)]  # 180 of 220
    texts += [" ".join([f"u{k}" for k in range(104)][: 104 - cut]) for cut in (0, 21)]  # 79 of 100
    assert similarity(*texts[:2]) == 0.8 and 0.8 < similarity(*texts[2:4]) < 0.85 and similarity(*texts[5:]) == 0.79
    docs = cases.frame(spark, [(k, t, "en", "s", None) for k, t in enumerate(texts)])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == {0, 2, 4, 5, 6}


def test_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {r[0] for r in test_near.brute(rows, 80) if r[3]}
    assert want < {r[0] for r in test_near.brute(rows, 85) if r[3]}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == want


def test_signatures_of_pairs_at_the_threshold():
    assert near.least_agreement(80) < near.least_agreement(85) == 0.85 - 6 * (0.85 * (1 - 0.85) / near.MINIMA) ** 0.5
