import math
import re
from collections import Counter

from sievegate.llm import quality
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen = Counter(five)
    covered = {k + j for k, f in enumerate(five) if seen[f] > 1 for j in range(5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_measures_of_odd_rows(spark):
    data = cases.rows(4)
    got = quality.judge(cases.frame(spark, data), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    key = lambda r: repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    assert sorted(map(key, got)) == sorted(repr((r[0], *brute(r[1]))) for r in data)
    assert all(r.kept == (not r.base_failed) for r in got)  # without labels nothing else rejects
    assert quality.judge(cases.frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_exact_bound(spark):
    from pyspark.sql import functions as F

    rows = [(k, n) for n in (1, 50, 2000) for k in (0, 1, n // 50)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality.log_binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("x")).collect()
    for r in got:
        assert math.isclose(math.exp(r.x), sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)), rel_tol=1e-9)


def test_cutoffs_reject_bad_and_keep_good(spark):
    good = [(k, " ".join(f"word{k}x{j}" for j in range(40)), "en", "s", None) for k in range(4000)]
    bad = [(10_000 + k, " ".join(f"#word{k}x{j}##" for j in range(40)), "en", "s", None) for k in range(400)]
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (5, None, 0)]
    got = {r.doc_id: r.kept for r in quality.judge(cases.frame(spark, good + bad), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[r[0]] for r in good) and not any(got[r[0]] for r in bad)


def test_main_path_is_native(spark, sf_dir):
    plan = quality.op6_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_first_rung_needs_enough_labels(spark):
    """217 good labels without a rejection certify a rung for four strata, 216 do not."""
    rows = [(f"{n}-{k}", f"s{n}-{c}", False, None) for n, c in ((216, 0), (217, 0), (216, 1), (217, 1)) for k in range(n)] + [(f"bad{s}", s, False, 3) for s in ("s216-0", "s217-0", "s216-1", "s217-1")]
    ids = {r[0]: k for k, r in enumerate(rows)}
    measured = spark.createDataFrame([(ids[r[0]], *r[1:]) for r in rows for _ in range(1)], "doc_id long, stratum string, base_failed boolean, rung int")
    labels = spark.createDataFrame([(k, int(not name.startswith("bad"))) for name, k in ids.items()], "doc_id long, quality int")
    assert {r["stratum"] for r in quality.cutoffs(measured, labels).collect()} <= {"s217-0", "s217-1"}
    assert {r["last"] for r in quality.cutoffs(measured.where("stratum LIKE 's217%' OR stratum = 's216-0'"), labels, delta=0.0375).collect()} == {3}


def test_guarantee_over_simulated_holdouts(spark):
    """Each stratum is a holdout of its own of 400 good documents; rungs from 5 on truly reject more than ALPHA of them."""
    from pyspark.sql import functions as F

    holdouts, alpha, delta = 400, 0.02, 0.05
    true = [0.002 * (k + 1) if k < 5 else 0.0202 + 0.002 * (k - 5) for k in range(12)]
    draw = F.rand(11)
    rung = F.coalesce(*[F.when(F.col("u") < p, F.lit(k)) for k, p in enumerate(true)])
    good = spark.range(holdouts * 400).select(F.col("id").alias("doc_id"), (F.col("id") % holdouts).cast("string").alias("stratum"), draw.alias("u")).withColumn("rung", rung)
    bad = spark.range(holdouts * 40).select((F.col("id") + 1_000_000).alias("doc_id"), (F.col("id") % holdouts).cast("string").alias("stratum"), (F.col("id") / holdouts % 12).cast("int").alias("rung"))
    measured = good.drop("u").unionByName(bad).withColumn("base_failed", F.lit(False))
    labels = measured.select("doc_id", (F.col("doc_id") < 1_000_000).cast("int").alias("quality"))
    last = [r["last"] for r in quality.cutoffs(measured, labels, alpha, delta * holdouts).collect()]  # delta for each holdout
    assert sum(true[k] > alpha for k in last) <= delta * holdouts
    assert len(last) > holdouts / 2  # and yet the rules act
