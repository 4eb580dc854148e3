"""Operator 1: language identification.

Sparse multinomial logistic regression on TF-IDF of hashed character 1- to 3-grams, trained by follow-the-regularised-leader
(FTRL-proximal) with elastic-net penalties, then calibrated by one temperature on rows that the training left out.

Document frequencies count every training row of the table. The regression is fitted on a bounded, deterministic sample of
them: of each language the ``per_class`` rows of least hash of doc_id, all where there are fewer, and ``sample`` rows at most in
all, shared evenly. ``max_classes`` bounds the model: of more values of lang, those with most rows are learned, ties by name; the
others are never predicted. So neither model nor driver grow with the table. Each whole text is predicted.

Nulls: rows without lang or doc_id are predicted, never learned from. Null texts and texts without a letter are ``und`` with
score 0. Without any labelled row all are ``und``. Rows that repeat are predicted alike. Ties go to the first language in
alphabetical order. An empty table gives an empty one. Very long texts are counted in pieces, whole. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegate.llm.common import documents, map_arrow, materialize, remove, tuned

BITS = 15
SIZE = 1 << BITS
PIECE = 1 << 18  # characters looked at at once
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed character n-grams of the lower-cased text, runs of other characters than letters as one blank; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kept = letters()[codes]
    if not kept.any():
        return None
    codes = np.where(kept, codes, 32)
    codes = np.concatenate([[32], codes[kept | np.concatenate([[True], kept[:-1]])], [32]]).astype(np.uint32)
    out = np.zeros(SIZE, np.int64)
    for at in range(0, len(codes), PIECE):
        a = codes[max(0, at - 2) : at + PIECE]
        old = min(at, 2)
        h1 = a * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ a[1:]) * np.uint32(0x85EBCA6B)
        h3 = (h2[:-1] ^ a[2:]) * np.uint32(0xC2B2AE35)
        for h, n in ((h1, 1), (h2, 2), (h3, 3)):
            new = h[max(0, old - n + 1) :]  # grams that end in this piece
            out += np.bincount((new ^ new >> np.uint32(15)) >> np.uint32(32 - BITS), minlength=SIZE)
    return out


def features(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the normalised TF-IDF vector (logarithmic term frequency)."""
    at = np.flatnonzero(count)
    x = (1 + np.log(count[at])) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """FTRL-proximal: weights come from the sums z and n of adjusted and squared gradients, with soft thresholds for l1."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, SIZE), np.append(x, 1.0)  # the last place is the bias
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(train: DataFrame, per_class: int = 400, calibration_share: float = 0.25, sample: int = 12_000, max_classes: int = 256) -> dict:
    """A model from rows (doc_id, text, lang), lang not null. To the driver go one document frequency for each of the SIZE
    hashed n-grams, summed by Spark, and the n-gram counts of the bounded sample."""
    spark = tuned(train.sparkSession)
    per_lang = {r["lang"]: r["count"] for r in train.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_classes).collect()}
    langs = sorted(per_lang)
    if not langs:
        return {"langs": [], "idf": np.zeros(SIZE), "weights": np.zeros((SIZE + 1, 0)), "temperature": 1.0}
    per_class = max(1, min(per_class, sample // len(langs)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000_000))
    # twice as many rows as are wanted are drawn by their hash, and of these the first are taken
    drawn = F.coalesce(*[F.when(F.col("lang") == k, place < F.lit(int(2e9 * per_class / n) + 1)) for k, n in per_lang.items()], F.lit(False))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, n = np.zeros(SIZE, np.int64), 0
        schema = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("at", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])
        for batch in batches:
            for lang, doc_id, taken, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (c := counts(text)) is None:
                    continue
                df_ += c > 0
                n += 1
                if taken:
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "doc_id": [doc_id], "at": [at], "count": [c[at]]}, schema=schema)
        if n:  # the document frequencies of this task, with the number of documents last
            at = np.flatnonzero(df_)
            yield pa.RecordBatch.from_pydict({"lang": [None], "doc_id": [None], "at": [np.append(at, SIZE)], "count": [np.append(df_[at], n)]}, schema=schema)

    seen, path = materialize(train.select("lang", "doc_id", drawn.alias("taken"), "text").mapInArrow(look, "lang string, doc_id long, at array<int>, count array<long>"), "langid")
    df_ = np.zeros(SIZE + 1)
    for r in seen.where("lang IS NULL").select(F.explode(F.arrays_zip("at", "count")).alias("x")).groupBy("x.at").agg(F.sum("x.count").alias("n")).collect():
        df_[r["at"]] = r["n"]
    n, df_ = df_[SIZE], df_[:SIZE]
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))  # of some 2 * per_class rows
    rows = seen.where("lang IS NOT NULL").withColumn("nth", nth).where(F.col("nth") <= per_class).collect()
    remove(spark, path)
    idf = np.log((1 + n) / (1 + df_)) + 1
    learn, rest = [], []
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"])):
        c = np.zeros(SIZE, np.int64)
        c[r["at"]] = r["count"]
        (rest if (r["doc_id"] * 2654435761 >> 7) % 1000 < 1000 * calibration_share else learn).append((*features(c, idf), langs.index(r["lang"])))
    weights = ftrl(learn or rest, len(langs))
    scored = rest or learn
    t = temperature(np.array([x @ weights[at] + weights[SIZE] for at, x, _ in scored]), np.array([y for *_, y in scored])) if scored and len(langs) > 1 else 1.0
    return {"langs": langs, "idf": idf, "weights": weights, "temperature": t}


def predict(df: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out (as it is), lang_pred, score of rows (doc_id, held_out, text)."""
    langs, t = model["langs"], model["temperature"]
    spark = tuned(df.sparkSession)
    sent = spark.sparkContext.broadcast((model["idf"].astype(np.float32), model["weights"].astype(np.float32)))  # SIZE rows of the number of languages
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> dict:
        idf, w = sent.value
        pred, score = [], []
        for text in batch.column(2).to_pylist():
            c = counts(text) if langs else None
            if c is None:
                pred.append("und")
                score.append(0.0)
                continue
            at, x = features(c, idf)
            p = softmax((x @ w[at] + w[SIZE]).astype(np.float64) / t)
            k = int(p.argmax())
            pred.append(langs[k])
            score.append(min(1.0, float(p[k])))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pred, "score": score}

    return map_arrow(df.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double", schema)


def with_split(df: DataFrame) -> DataFrame:
    """held_out: crc32 of doc_id as text is 1 modulo 3; rows without doc_id are held out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_split(documents(spark, sf_dir))
    model = fit(rows.where("NOT held_out AND lang IS NOT NULL").select("doc_id", "text", "lang"))
    return predict(rows, model)
