"""Operator 9: document fingerprints of improbable features (a similarity digest).

Every window of 64 bytes has an entropy, in thousandths of its maximum. How rare each level is over all documents ranks the
windows; a window that is the rarest of many of the 64-window stretches around it is a feature. The distinct features of a
text, in order, go into a chain of Bloom filters (2,048 bits, 5 bits a feature, 160 features each). The likeness of two
digests is, for each filter of the shorter chain, the overlap in bits with its best counterpart, normalised between what
chance gives and what is possible, then averaged.

Short texts have too few windows to choose from: under SHORT bytes, all windows of 8 bytes are features as well, and under 64
bytes each byte with its place, so that a text of which a part is kept stays alike.

A null text is empty; an empty text has an empty chain, alike (1) to empty ones only. A text whose windows are all of one level
has its first windows as features. Rows that repeat a doc_id are put in the order of their texts; a null doc_id comes first. A
lone document is its own next one. An empty table gives an empty one. Very long texts are looked at in pieces, whole. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.common import documents, mix, partitions, tuned

WINDOW, LEVELS, POPULAR = 64, 1001, 16
SHORT, SMALL = 1024, 8
BITS, HASHES, PER_FILTER = 2048, 5, 160
CHANCE = 0.3  # share of the way from the overlap of chance to a full one that counts as none
PIECE = 1 << 17  # windows looked at at once
#: Exact steps of c * log2(c), as integers, so that pieces give the same levels as whole texts.
_F = np.array([0] + [round(c * np.log2(c) * (1 << 20)) for c in range(1, WINDOW + 1)], np.int64)
_G = np.diff(_F, prepend=0)


def _levels(data: np.ndarray) -> np.ndarray:
    """Entropy levels of all windows of a piece."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = order + data[order].astype(np.int64) * (2 * n + 2 * WINDOW)
    k = np.arange(n)
    first = np.searchsorted(key, key - (WINDOW - 1))  # in the window that ends here
    last = np.cumsum(np.bincount(first, minlength=n))
    entering, leaving = np.empty(n, np.uint8), np.empty(n, np.uint8)
    entering[order] = k - first + 1
    leaving[order] = last - k
    start = int(_F[np.bincount(data[:WINDOW], minlength=256)].sum())
    sums = start + np.concatenate([[0], np.cumsum(_G[entering[WINDOW:]] - _G[leaving[: n - WINDOW]])])
    return ((int(_F[WINDOW]) - sums) * (LEVELS - 1) // int(_F[WINDOW])).astype(np.uint16)


def levels(data: np.ndarray) -> np.ndarray:
    n = len(data) - WINDOW + 1
    return np.concatenate([_levels(data[at : min(at + PIECE, n) + WINDOW - 1]) for at in range(0, n, PIECE)]) if n > 0 else np.zeros(0, np.uint16)


def chosen(rank: np.ndarray) -> np.ndarray:
    """Places of the windows that are the rarest (leftmost first) of at least POPULAR stretches of 64 windows; fewer windows are one stretch."""
    n = len(rank)
    if n <= WINDOW:
        return np.array([int(rank.argmin())]) if n else np.zeros(0, np.int64)
    popular = np.zeros(n, np.int32)
    stretches = n - WINDOW + 1
    for at in range(0, stretches, PIECE):
        end = min(at + PIECE, stretches)
        low = rank[at : end + WINDOW - 1].astype(np.int64) << 32 | np.arange(at, end + WINDOW - 1)
        for step in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-step], low[step:])
        at_, times = np.unique(low & 0xFFFFFFFF, return_counts=True)
        popular[at_] += times.astype(np.int32)
    picked = np.flatnonzero(popular >= POPULAR)
    return picked if len(picked) else np.array([int(rank.argmin())])


def filters(text: str | None, ranks: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, bits unpacked: an array of (filters, BITS)."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros((0, BITS), np.uint8)
    hashes = np.zeros(0, np.uint64)
    if len(data) >= WINDOW:
        hashes = window_hashes(data, chosen(ranks[levels(data)]))
    if SMALL <= len(data) < SHORT:
        small = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SMALL)).view(np.uint64)[:, 0]
        hashes = np.concatenate([hashes, mix(small + np.uint64(0x632BE59BD9B4E019))])
    if len(data) < WINDOW:
        hashes = np.concatenate([hashes, mix((np.arange(len(data), dtype=np.uint64) << np.uint64(8) | data) + np.uint64(0xE220A8397B1DCDAF))])
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    out = np.zeros((-(-len(hashes) // PER_FILTER), BITS), np.uint8)
    which = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        out[which, (hashes >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return out


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at these places."""
    out = np.empty(len(at), np.uint64)
    for k in range(0, len(at), 4096):
        rows = data[at[k : k + 4096, None] + np.arange(WINDOW)]
        words = mix(np.ascontiguousarray(rows).view(np.uint64) + np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = words[:, 0]
        for j in range(1, 8):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[:, j])
        out[k : k + 4096] = h
    return out


def to_string(chain: np.ndarray) -> str:
    return f"{len(chain)}:" + base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode()


def from_string(value: str) -> np.ndarray:
    n, _, data = value.partition(":")
    return np.unpackbits(np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(n), BITS // 8), axis=1) if int(n) else np.zeros((0, BITS), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(1, dtype=np.float64)[:, None], b.sum(1, dtype=np.float64)[None, :]
    best = np.zeros(len(a))
    for k in range(0, len(a), 64):  # bounded memory for chains of any length
        x = a[k : k + 64].astype(np.float32)
        for j in range(0, len(b), 512):
            common = x @ b[j : j + 512].astype(np.float32).T
            top, chance = np.minimum(na[k : k + 64], nb[:, j : j + 512]), na[k : k + 64] * nb[:, j : j + 512] / BITS
            floor = chance + CHANCE * (top - chance)
            best[k : k + 64] = np.maximum(best[k : k + 64], (np.clip(common - floor, 0, None) / np.maximum(top - floor, 1e-9)).max(1))
    return float(min(1.0, best.mean()))


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level (0: rarest), from the windows of all documents. To the driver goes a count for each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += np.bincount(levels(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)), minlength=LEVELS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"level": pa.array(at, pa.int32()), "n": pa.array(seen[at], pa.int64())})

    seen = np.zeros(LEVELS, np.int64)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        seen[r["level"]] = r["n"]
    order = np.lexsort((np.arange(LEVELS), seen))
    ranks = np.empty(LEVELS, np.uint16)
    ranks[order] = np.arange(LEVELS)
    return ranks


def edit(text: str, following: str) -> str:
    """The last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, chain: np.ndarray, following: str, next_chain: np.ndarray, ranks: np.ndarray) -> tuple:
    edited = edit(text, following)
    other = filters(edited, ranks)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_string(chain), to_string(other), likeness(chain, other), likeness(chain, next_chain)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness. Texts are dealt once, by ranges of doc_id; the first
    document of each range also goes behind the last one of the range before, so that no task needs another's and nothing is kept on
    disk but that one shuffle. To the driver go the bounds of the ranges, a number each, and which of them hold rows."""
    spark = tuned(docs.sparkSession)
    ranks, n = rarity(docs), partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    below = F.filter(F.lit(sorted(set(bounds[: n - 1])) or [0]).cast("array<long>"), lambda bound: F.coalesce(bound < F.col("doc_id"), F.lit(False)))
    rows = rows.withColumn("range", F.size(below) if n > 1 else F.lit(0))
    first = sorted((r["range"], r["head"]["doc_id"]) for r in rows.groupBy("range").agg(F.min(F.struct("doc_id")).alias("head")).collect())
    heads = spark.createDataFrame([(doc_id, k, first[i - 1][0]) for i, (k, doc_id) in enumerate(first)], "head long, of int, before int")
    heads = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["head"])).groupBy("before", "doc_id").agg(F.min("text").alias("text"))
    dealt = rows.select("range", F.lit(False).alias("after"), "doc_id", "text").union(heads.select("before", F.lit(True), "doc_id", "text"))
    ranged = dealt.repartitionById(n, "range").sortWithinPartitions("range", "after", "doc_id", "text").select("after", "doc_id", "text")
    schema = pa.schema(_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            found = []
            for after, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                chain = filters(text, ranks)
                if held is not None:
                    found.append(_row(*held, text, chain, ranks))
                held = None if after else (doc_id, text, chain)
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*found, strict=True), strict=True)), schema=schema)

    return ranged.mapInArrow(run, _DDL)


def fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint", ranks: np.ndarray | None = None) -> DataFrame:
    """Adds the fingerprint of a text column."""
    ranks = rarity(df.select(F.col(text).alias("text"))) if ranks is None else ranks

    @F.pandas_udf("string")
    def digest(texts):
        return texts.map(lambda x: to_string(filters(x, ranks)))

    return df.withColumn(to, digest(F.col(text)))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))
