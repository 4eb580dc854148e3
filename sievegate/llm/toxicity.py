"""Operator 12: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the features of its words, their beginnings and pairs of neighbouring words, hashed
into ``SIZE`` places; its score is the logistic function of the sum of their weights and a bias; the scores are combined by noisy-or: a document
is clean if none of its sentences is toxic, each on its own. Only documents have labels: weights follow the gradient of the
document's log loss through the noisy-or to its sentences (FTRL-proximal steps with l1, so that few words have weights).
Sentences that reach the threshold are the offending ones, with their places in the text.

The model is fitted on a bounded, deterministic sample: of each label the ``per_label`` documents of least hash of doc_id, whole,
as long as their features are ``most_features`` in all; a label of which only a part is drawn weighs as much as all its rows.
Counts of labels cover all training rows. Each whole text is scored.

A word is a run of ASCII letters, digits, apostrophes and non-ASCII bytes, ASCII folded to lower case. A sentence ends after '.', '!',
'?' or a line end.

Nulls: null and empty texts have no sentence: score 0 of a document without toxic sentences. Rows without doc_id are held out and
scored. Labels that are null, and rows of labels without doc_id, are not learned; of several labels of a doc_id the largest holds.
Rows that repeat a doc_id are learned and scored each by its own text. Without both labels every score is the share of toxic
labels (0 without labels). An empty table gives an empty one. Very long texts are read in pieces of whole words. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.common import Prefix, documents, materialize, mix, remove, tuned

BITS = 18
SIZE = 1 << BITS
PIECE = 1 << 20  # bytes looked at at once
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes of the beginnings of words that are features
MARK = 0.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of about PIECE bytes that end after a sentence, or failing that after a word."""
    at = 0
    while len(data) - at > PIECE:
        window = data[at : at + PIECE]
        ends = np.flatnonzero(_END[window])
        ends = ends if len(ends) else np.flatnonzero(~_WORD[window])
        cut = int(ends[-1]) + 1 if len(ends) else PIECE
        yield at, data[at : at + cut]
        at += cut
    yield at, data[at:]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """places of all features, the sentence (from 0) of each, and (start, end) in bytes of each sentence that has a word."""
    places, sentences, spans, before = [], [], [], 0
    for at, raw in _pieces(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)):
        word = np.concatenate([[False], _WORD[raw], [False]])
        edge = np.diff(word.astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        hashes = Prefix(_FOLD[raw])
        h = hashes.spans(starts, ends)
        sentence = np.concatenate([[0], np.cumsum(_END[raw])])[starts]  # sentences ended before the word
        _, first, sentence = np.unique(sentence, return_index=True, return_inverse=True)
        pair = sentence[1:] == sentence[:-1]
        two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pair]
        longer = [ends - starts > k for k in BEGINNINGS]
        begun = [mix(hashes.spans(starts[x], starts[x] + k)) for k, x in zip(BEGINNINGS, longer, strict=True)]
        places.append((np.concatenate([h, two, *begun]) >> np.uint64(64 - BITS)).astype(np.int32))
        sentences.append(np.concatenate([sentence, sentence[1:][pair], *[sentence[x] for x in longer]]) + before)
        last = np.append(first[1:], len(starts)) - 1
        spans.append(np.stack([starts[first], ends[last]], 1) + at)
        before += len(first)
    if not places:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    return np.concatenate(places), np.concatenate(sentences), np.concatenate(spans)


def sentence_logits(places: np.ndarray, sentences: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """weights: one for each place, the bias last."""
    return np.bincount(sentences, weights[places], n) + weights[SIZE]


def noisy_or(z: np.ndarray) -> float:
    """1 less the product of the chances that each sentence is clean."""
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray, int, int]], importance: tuple[float, float] = (1.0, 1.0), alpha: float = 0.6, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1, epochs: int = 8, seed: int = 11) -> np.ndarray:
    """Weights from rows (places, sentences, number of sentences, label 0 or 1)."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    z[SIZE] = 4.0 * (beta / alpha + l2) + l1  # sentences begin clean
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            places, sentences, count, y = rows[k]
            if not count:
                continue
            at, inverse = np.unique(places, return_inverse=True)
            at = np.append(at, SIZE)
            w = weights(at)
            logit = np.bincount(sentences, w[inverse], count) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            toxic = max(noisy_or(logit), 1e-12)
            g = p * importance[0] if y == 0 else -p * (1 - toxic) / toxic * importance[1]  # of the loss, for each sentence's logit
            grad = np.append(np.bincount(inverse, g[sentences], len(at) - 1), g.sum())
            z[at] += grad - (np.sqrt(n[at] + grad * grad) - np.sqrt(n[at])) / alpha * w
            n[at] += grad * grad
    return weights(slice(None))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, most_features: int = 8_000_000) -> dict:
    """A model from documents (doc_id, text) and labels (doc_id, toxic), all of which may be learned from."""
    spark = tuned(docs.sparkSession)
    of = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    rows = {r["toxic"]: r["count"] for r in of.groupBy("toxic").count().collect()}
    if len(rows) < 2:
        return {"weights": None, "share": 1.0 if 1 in rows else 0.0}
    place = F.xxhash64("doc_id", F.lit("toxicity"))
    drawn = of.where("toxic = 0").orderBy(place, "doc_id").limit(per_label).unionByName(of.where("toxic = 1").orderBy(place, "doc_id").limit(per_label))
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("place", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("sentences", pa.binary())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, toxic, at, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                places, sentences, spans = features(text)
                yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "toxic": [toxic], "place": [at], "n": [len(spans)], "places": [places.astype("<i4").tobytes()], "sentences": [sentences.astype("<i4").tobytes()]}, schema=schema)

    # 2 * per_label ids are sent to all
    texts = docs.join(F.broadcast(drawn.withColumn("place", place)), "doc_id").select("doc_id", "toxic", "place", "text").mapInArrow(look, "doc_id long, toxic int, place long, n int, places binary, sentences binary")
    texts, path = materialize(texts.withColumns({"size": F.length("places") / 4, "tie": F.xxhash64("places", "sentences")}), "toxicity")
    order, left, last = ["place", "doc_id", "tie"], most_features, None
    for r in texts.select(*order, "size").orderBy(*order).limit(2 * per_label).collect():
        left -= r["size"]
        if left < 0:
            break
        last = r
    within = F.struct(*[F.col(c).cast("long").alias(c) for c in order]) <= F.struct(*[F.lit(last[c]).cast("long").alias(c) for c in order]) if last else F.lit(False)
    rows_ = texts.where(within).orderBy(*order).limit(2 * per_label).collect()  # most_features at most
    remove(spark, path)
    sample = [(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["sentences"], "<i4"), r["n"], r["toxic"]) for r in rows_]
    seen = [max(1, sum(x[3] == y for x in sample)) for y in (0, 1)]
    importance = np.array([rows[y] / seen[y] for y in (0, 1)])
    return {"weights": train(sample, tuple(importance / importance.min())).astype(np.float32), "share": rows[1] / (rows[0] + rows[1])}


def score(df: DataFrame, model: dict, threshold: float = MARK) -> DataFrame:
    """doc_id, held_out (as it is), score, predicted, and offending: (start, end, score) of the sentences that reach the threshold,
    in characters of the text, of rows (doc_id, held_out, text)."""
    spark = tuned(df.sparkSession)
    sent = spark.sparkContext.broadcast(model["weights"])  # SIZE + 1 floats
    share = model["share"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, found = [], []
            for text in batch.column(2).to_pylist():
                if w is None:
                    scores.append(share)
                    found.append([])
                    continue
                places, sentences, spans = features(text)
                z = sentence_logits(places, sentences, w, len(spans))
                scores.append(min(1.0, max(0.0, noisy_or(z))) if len(z) else 0.0)
                marks = np.flatnonzero(z >= np.log(threshold / (1 - threshold)))
                if len(marks):
                    lead = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
                    chars = np.concatenate([[0], np.cumsum(lead)])
                    found.append([{"start": int(chars[a]), "end": int(chars[b]), "score": float(1 / (1 + np.exp(-z[k])))} for k, (a, b) in zip(marks, spans[marks], strict=True)])
                else:
                    found.append([])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": [int(x >= MARK) for x in scores], "offending": found}, schema=schema)

    return df.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")


def with_split(docs: DataFrame) -> DataFrame:
    """held_out: crc32 of doc_id as text is 0 modulo 5; rows without doc_id are held out."""
    held = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_split(documents(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    model = fit(rows.where("NOT held_out").select("doc_id", "text"), labels.where(~held))
    return score(rows, model)
