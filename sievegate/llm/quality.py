"""Operator 6: quality rules with risk-controlled cutoffs. DataFrame and SQL functions only.

Each document gets integer measures. A few base conditions reject at once. Beyond them each rule compares a ratio with a
cutoff. All cutoffs lie on one ladder, fixed beforehand, from lenient to strict: each rung tightens one rule, the others stay
as they are, so what a rung rejects is rejected by all later ones. The rung of a document is the first that rejects it.

Labelled documents choose how far each stratum (the language) goes. Rung by rung, an exact binomial bound on the good
documents that all rules together reject tests that their share is at most ``ALPHA``; the first rung that fails ends the
sequence. Tests in a fixed order need no correction for their number; for the number of strata ``DELTA`` is divided by it. So
with probability 1 - DELTA no stratum loses more than a share ALPHA of its good documents. Of the certified rungs the one with
the greatest lead of the share of bad documents rejected over that of good ones is taken, the most lenient of equals; none if
there is no lead. The least number of good labels that certifies anything is log(DELTA / strata) / log(1 - ALPHA): 217 with four
strata. A stratum with fewer has the base conditions alone.

Nulls: a null text has no words and fails the base conditions; a null lang is the stratum ''; labels without doc_id or quality
are ignored; a document with labels that differ counts as bad. Rows that repeat are judged alike, ties of a ratio with a cutoff
are kept. Without labels only the base conditions reject. An empty table gives an empty one. Very long texts are measured
whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegate.llm.common import documents, materialize, remove

ALPHA, DELTA = 0.02, 0.05
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: ALPHA: the share of good documents that a stratum may lose. DELTA: the probability that any stratum loses more.
#: rule: (numerator, denominator, sign, cutoffs in thousandths); rejects where sign * (1000 * numerator - cutoff * denominator) > 0. Strictest last.
RULES: dict[str, tuple[str, str, int, list[int]]] = {
    "symbols": ("n_symbols", "word_chars", 1, [300, 200, 150, 100, 70, 50, 30, 20]),
    "long_words": ("word_chars", "n_words", 1, [30000, 20000, 15000, 12000, 11000, 10000, 9000, 8000]),
    "short_words": ("word_chars", "n_words", -1, [1000, 1500, 2000, 2500, 3000, 3500, 4000, 4500]),
    "dup_lines": ("n_dup_lines", "n_lines", 1, [500, 400, 300, 250, 200, 150, 100, 50]),
    "repeats": ("n_repeat_words", "n_words", 1, [190, 170, 150, 130, 110, 90, 70, 50]),
}
#: (rule, cutoff) of each rung: the first cutoff of every rule, then the second of every rule, and so on.
LADDER = [(rule, grid[k]) for k in range(8) for rule, (*_, grid) in RULES.items()]
#: Strata up to which the table of cutoffs is broadcast; beyond, it is joined by a shuffle.
BROADCAST_STRATA = 10_000


def repeat_words(windows: Column, distinct: Column) -> Column:
    """Words covered by windows of 5 whose hash occurs twice or more. windows: the hashes by place."""
    m = F.size(windows)
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def covered(s: Column) -> Column:
        same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
        at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), m - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False))), lambda j: F.get(s, j)["p"]))
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    # the sorted array is bound once, by a transform over an array of one
    return F.when(m == distinct, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(ranked), covered), 1))


def measures(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed of text."""
    bare = df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    cut = bare.select(
        *keep,
        "_t",
        F.split(F.trim(F.col("_t"), F.lit(SPACES)), r"[\x20\x09-\x0D]+").alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("_lines"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = cut.select(
        *keep,
        "word_chars",
        "n_symbols",
        F.when(F.col("word_chars") == 0, 0).otherwise(F.size("_words")).alias("_n"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    five = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(5)])
    windows = hashed.withColumn("_windows", F.when(F.col("_n") >= 5, F.transform(F.sequence(F.lit(0), F.col("_n") - 5), five)).otherwise(F.array().cast("array<bigint>"))).drop("_hashes")
    counted = windows.withColumn("_distinct", F.size(F.array_distinct("_windows"))).withColumn("n_repeat_words", repeat_words(F.col("_windows"), F.col("_distinct")))
    done = counted.select(*keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    return done.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rejects(rule: str, cutoff: Column) -> Column:
    num, den, sign, _ = RULES[rule]
    return sign * (1000 * F.col(num) - cutoff * F.col(den)) > 0


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """The logarithm of P(X <= k) for X binomial (n, p), term by term."""
    import math

    first, odds = n.cast("double") * math.log1p(-p), math.log(p) - math.log1p(-p)
    step = lambda t, i: t + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(odds)
    add = lambda s, t: F.greatest(s, t) + F.log1p(F.exp(-F.abs(s - t)))
    start = F.struct(first.alias("t"), first.alias("s"))
    return F.when(k < 1, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, lambda a, i: F.struct(step(a["t"], i).alias("t"), add(a["s"], step(a["t"], i)).alias("s")), lambda a: a["s"]))


def rung() -> Column:
    """The first rung that rejects, null if none does."""
    return F.least(*[F.when(rejects(rule, F.lit(c)), F.lit(k)) for k, (rule, c) in enumerate(LADDER)])


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, last (the last rung that rejects) of the strata where a rung is certified and useful; with n_good and n_bad, the
    labels, and k and bad, how many of them are rejected. measured: doc_id, stratum, base_failed, rung."""
    import math

    quality = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).alias("good"))
    seen = measured.where("NOT base_failed").select("doc_id", "stratum", "rung").join(quality, "doc_id")
    # a row for each stratum and rung, and their number on the driver
    steps, path = materialize(seen.groupBy("stratum", "rung").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")), "quality-rungs")
    strata = steps.select("stratum").distinct().count()
    whole = Window.partitionBy("stratum")
    so_far = whole.orderBy("rung").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"n_good": F.sum("g").over(whole), "n_bad": F.sum("b").over(whole)})
    held = steps.where("rung IS NOT NULL").withColumns({"k": F.sum("g").over(so_far), "bad": F.sum("b").over(so_far)})
    tested, _ = materialize(held.where(F.col("k") <= F.floor(F.col("n_good") * alpha)), "quality-tests")
    remove(measured.sparkSession, path)
    certified = tested.where(log_binomial_cdf(F.col("k"), F.col("n_good"), alpha) <= math.log(delta) - math.log(max(strata, 1)))
    lead = certified.withColumn("lead", F.col("bad") * F.col("n_good") - F.col("k") * F.col("n_bad")).where("lead > 0")
    return lead.groupBy("stratum").agg(F.max_by(F.struct("rung", "n_good", "n_bad", "k", "bad"), F.struct("lead", -F.col("rung"))).alias("x")).select("stratum", F.col("x.rung").alias("last"), "x.n_good", "x.n_bad", "x.k", "x.bad")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, more and the measures of each document with base_failed and kept. more: columns of docs that are carried along."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), *more, "text")
    measured, _ = materialize(measures(rows, ["doc_id", "stratum", *more]).withColumn("rung", rung()), "quality")  # a few numbers a document; the texts are read once
    chosen, path = materialize(cutoffs(measured, labels, alpha, delta).select("stratum", "last"), "cutoffs")
    if (found := chosen.limit(BROADCAST_STRATA + 1).collect()) and len(found) <= BROADCAST_STRATA:
        chosen = F.broadcast(spark.createDataFrame(found, chosen.schema))
        remove(spark, path)
    verdict = ~F.col("base_failed") & F.coalesce(F.col("rung") > F.col("last"), F.col("rung").isNull() | F.col("last").isNull())
    return measured.join(chosen, "stratum", "left").select("doc_id", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", verdict.alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def verdict_sql(docs: str = "documents") -> str:
    """DuckDB: the same judgement of a relation of documents, as common table expressions that end in ``judged``."""
    rejected = lambda rule, c: "{s} * (1000 * {n} - {c} * {d}) > 0".format(s=RULES[rule][2], n=RULES[rule][0], d=RULES[rule][1], c=c)
    ladder = " ".join(f"WHEN {rejected(rule, c)} THEN {k}" for k, (rule, c) in enumerate(LADDER))
    return rf"""
split AS (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {docs}),
marked AS (SELECT *, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' ')) AS five FROM split),
spread AS (SELECT doc_id, t, unnest(five) AS g, generate_subscripts(five, 1) AS i FROM marked),
repeated AS (SELECT doc_id, t, i, g, count(*) OVER (PARTITION BY doc_id, t, g) AS c, dense_rank() OVER (PARTITION BY doc_id, t, g, i ORDER BY 1) FROM (SELECT DISTINCT * FROM spread)),
gaps AS (SELECT doc_id, t, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id, t ORDER BY i) - i, 5)) AS n FROM repeated WHERE c > 1),
covered AS (SELECT doc_id, t, sum(n) AS n FROM gaps GROUP BY ALL),
measured AS (SELECT m.*, coalesce(lang, '') AS stratum, len(w) AS n_words, length(regexp_replace(m.t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(m.t) - length(translate(m.t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM marked m LEFT JOIN covered c ON m.doc_id = c.doc_id AND m.t = c.t),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
quality AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
placed AS (SELECT *, CASE {ladder} END AS rung FROM based),
labelled AS (SELECT stratum, rung, good FROM placed JOIN quality USING (doc_id) WHERE NOT base_failed),
totals AS (SELECT stratum, count_if(good) AS n_good, count_if(NOT good) AS n_bad FROM labelled GROUP BY 1),
steps AS (SELECT DISTINCT stratum, rung FROM labelled WHERE rung IS NOT NULL),
tests AS (SELECT t.stratum, s.rung, n_good, n_bad, count_if(good AND l.rung <= s.rung) AS k, count_if(NOT good AND l.rung <= s.rung) AS bad
    FROM steps s JOIN totals t USING (stratum) JOIN labelled l ON l.stratum = s.stratum GROUP BY ALL),
sure AS (SELECT *, bad * n_good - k * n_bad AS lead FROM tests WHERE bad * n_good > k * n_bad
    AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({ALPHA!r}) + (n_good - i) * ln(1 - {ALPHA!r})))) <= {DELTA!r} / (SELECT count(*) FROM totals)),
chosen AS (SELECT stratum, arg_max(rung, (lead, -rung)) AS last FROM sure GROUP BY 1),
judged AS (SELECT placed.*, NOT base_failed AND coalesce(rung > last, true) AS kept FROM placed LEFT JOIN chosen USING (stratum))"""


ORACLE = f"WITH {verdict_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, kept FROM judged"
