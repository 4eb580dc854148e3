import corpus_pipeline
from sievegate.llm import quality
from tests.llm import cases, test_lines, test_near, test_packing, test_suffix


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in quality.op6_quality_rules(spark, sf_dir).collect() if r.kept}
    now = stages["quality rules"](spark, docs, sf_dir)
    assert now.columns == docs.columns and texts(now) == {k: t for k, t in texts(docs).items() if k in kept}

    import hashlib

    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    before = sorted(texts(now).items())
    now = stages["line dedup"](spark, now, sf_dir).cache()
    assert now.columns == docs.columns and sorted((k, sha(t)) for k, t in texts(now).items()) == sorted((r[0], r[3]) for r in test_lines.brute(before))

    before = sorted(texts(now).items())
    now = stages["MinHash near-dedup"](spark, now, sf_dir).cache()
    assert now.columns == docs.columns and set(texts(now)) == {r[0] for r in test_near.brute(before, corpus_pipeline.NEAR_PERCENT) if r[3]}

    before = sorted(texts(now).items())
    now = stages["suffix-array dedup"](spark, now, sf_dir).cache()
    found = {r[0]: r for r in test_suffix.brute(before)}
    assert now.columns == docs.columns and set(texts(now)) == set(found)
    for k, t in texts(now).items():
        assert len(t.encode()) <= found[k][1] - found[k][2] and (found[k][2] or t == dict(before)[k])

    rows = sorted(texts(now).items())
    test_packing.check(stages["best-fit packing"](spark, now, sf_dir).collect(), rows)
    test_packing.check(corpus_pipeline.run(spark, sf_dir).collect(), rows)


def test_rows_of_one_doc_id_are_judged_each(spark, sf_dir):
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(1, good, "en", "s", 1), (1, "drop me", "en", "s", 1), (1, None, "en", "s", 1), (None, good, "en", "s", 1), (None, "short", "en", "s", 1), (2, good, None, "s", 1)]
    out = dict(corpus_pipeline.STAGES)["quality rules"](spark, cases.frame(spark, rows), sf_dir)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, good), (None, good), (2, good)], key=repr)


def test_odd_rows_and_none(spark, sf_dir):
    for data in (cases.rows(9), []):
        docs = cases.frame(spark, data)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == cases.frame(spark, data).columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
