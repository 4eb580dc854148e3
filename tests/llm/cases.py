"""Small documents with nulls, empty and long texts, ties, repeated rows, extra columns with clashing names, and none at all."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ["_text", "spans", "text_key", "key", "component", "rep", "length", "part", "_row", "starts", "core"]


def words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "straße", "日本", "x"]) + str(rng.randrange(400)) for _ in range(n)]


def rows(seed=0, n=60):
    rng = random.Random(seed)
    common = "\n".join(" ".join(words(rng, 12)) for _ in range(4))
    base = [" ".join(words(rng, rng.choice([3, 8, 40, 150, 400]))) for _ in range(n // 3)]
    texts = []
    for _ in range(n):
        t = rng.choice(base)
        kind = rng.randrange(6)
        if kind == 1:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 2:
            t = t + "\n" + common + "\n\n" + " ".join(words(rng, 20))
        elif kind == 3:
            t = "\n".join(t[k : k + 90] for k in range(0, len(t), 90))
        elif kind == 4:
            t = " ".join(words(rng, 30)) + " " + t[len(t) // 3 :]
        texts.append(t)
    texts += [None, "", "   \n\t ", "one", "One  two", "a b c d", "A b C d", "ab " * 400, "ab " * 401, "x" * 1000, "é" * 150, " ".join(words(rng, 9000)), "    wide", "🙂 mixed 🙂 emoji"]
    out = [(k, t, rng.choice(["en", "de", None]), "s", None) for k, t in enumerate(texts)]
    return [*out, out[5], out[7], (None, base[0], "en", "s", 1), (None, None, None, None, None), (3, "another text of a repeated doc_id", "en", "s", 1)]


def frame(spark, data=None, extra=True):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("extra").alias(c) for c in CLASHING])
    return df
