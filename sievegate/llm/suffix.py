"""Operator 10: removal of repeated byte strings, by distributed prefix doubling over the positions that a prefilter leaves.

Every byte covered by a string of LENGTH bytes that also starts elsewhere goes, in all of its places.

``doubling`` is prefix doubling: positions carry the rank of the string of k bytes that starts there; Spark sorts the distinct
pairs of the ranks at i and at i + k, which gives the ranks of the strings of 2 k bytes; positions of unique pairs are dropped;
k doubles from FIRST until it reaches the threshold of LENGTH. It would do alone, but takes rows for each byte of the corpus (the
README has figures). So rounds over groups of positions go before it and decide most of them:

* Of each window of LENGTH bytes the least hashed gram of GRAM bytes is its anchor. Equal windows have equal anchors at equal
  places, so windows that start next to each other and share an anchor form a group, in which equal windows meet.
* A group whose core, the bytes that all of its windows contain, is unique holds unique windows only and is dropped. Groups of
  equal extent are repeated as a whole, and one of them goes on, as a partner for those that are still open.
* Open groups are cut into groups of 16 windows, then of 4, whose cores are longer, and looked at again. The windows of those
  still open are ranked by prefix doubling.

Cores and extents are counted by partial sums; the rows of hot ones are dealt over tasks, so that none reads a hot group.
The spans found are merged for each document; only then are the texts read again.

Defined results: null and short texts have no windows and stay as they are. Rows that repeat both doc_id and text are two
places of their text, as other copies are. A null doc_id is a doc_id like any other. An empty table gives an empty one. Very long
texts are looked at in pieces, whole. Other columns are ignored, or stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.common import Prefix, documents, join_counted, keyed, materialize, mix, partitions, remove, same_row, tuned

LENGTH, GRAM, STEPS, FIRST = 200, 48, (16, 4), 50
PIECE = 1 << 18  # windows looked at at once; the groups they form end there
_PLACE = (1 << 20) - 1
_C1, _C2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _tagged(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(h + x.astype(np.uint64) * _C1 + y.astype(np.uint64) * _C2).view(np.int64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def groups(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """core rank, extent rank, anchor, first window, last window of all groups, in pieces."""
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        part = data[at : at + PIECE + LENGTH - 1]
        prefix = Prefix(part)
        grams = prefix.grams(GRAM)
        place = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min((grams & ~np.uint64(_PLACE)) | place, LENGTH - GRAM + 1)
        anchor = (least & np.uint64(_PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        a = anchor[first]
        yield grams[a].view(np.int64), _tagged(prefix.spans(first, last + LENGTH), a - first, a - last), a + at, first + at, last + at


def _parts(anchors: list[dict], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups of step windows at most, by distance to the anchor: anchor, block, first and last window."""
    a, lo, hi = (np.array([x[k] for x in anchors], np.int64) for k in ("a", "lo", "hi"))
    low, high = (a - hi) // step, (a - lo) // step
    n = high - low + 1
    which = np.repeat(np.arange(len(a)), n)
    block = low[which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    a = a[which]
    return a, block, np.maximum(lo[which], a - block * step - step + 1), np.minimum(hi[which], a - block * step)


def _first_round(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("core", pa.int64()), ("extent", pa.int64()), ("a", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc_id, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for found in groups(as_bytes(text)):
                    n = len(found[0])
                    held.append(pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, key)), *map(pa.array, found)], schema=schema))
                    size += n
                    if size > 50_000:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, core long, extent long, a long, lo long, hi long")


def _next_round(docs: DataFrame, step: int) -> DataFrame:
    """Groups of step windows of rows with an array of open anchors."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("core", pa.int64()), ("extent", pa.int64()), ("a", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text, anchors in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for at in range(0, len(anchors), 4096):
                    a, block, lo, hi = _parts(anchors[at : at + 4096], step)
                    start = int(min(lo.min(), (a - block * step - step + 1).min()))
                    prefix = Prefix(as_bytes(text)[max(0, start) : int(hi.max()) + LENGTH])
                    a, lo, hi = a - max(0, start), lo - max(0, start), hi - max(0, start)
                    end = a - block * step
                    core = _tagged(prefix.spans(end, end - step + 1 + LENGTH), block, block)
                    extent = _tagged(prefix.spans(lo, hi + LENGTH), a - lo, a - hi)
                    n, back = len(lo), max(0, start)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, key)), pa.array(core), pa.array(extent), pa.array(a + back), pa.array(lo + back), pa.array(hi + back)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, text_key long, core long, extent long, a long, lo long, hi long")


def _positions(docs: DataFrame, length: int, first: int) -> DataFrame:
    """row (unique), doc_id, text_key, at, one, two: the names (hashes) of the first bytes at every place that a window of rows with
    ranges (lo, hi) of window starts needs a rank of: its start and each first bytes on. Without ranges, of every place. two is 0."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int64()), ("one", pa.int64())])

    def together(held: list[tuple]) -> pa.RecordBatch:
        n = [len(x[4]) for x in held]
        which = pa.array(np.repeat(np.arange(len(held)), n))
        row, doc_id, key = (pa.array([x[k] for x in held], pa.int64()).take(which) for k in range(3))
        at = np.concatenate([np.arange(x[3], x[3] + len(x[4])) for x in held])
        return pa.RecordBatch.from_arrays([row, doc_id, key, pa.array(at), pa.array(np.concatenate([x[4] for x in held]).view(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, key, text, ranges, row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                data = as_bytes(text)
                last = len(data) - length
                starts = merged([{"lo": 0, "hi": last}] * (last >= 0) if ranges is None else sorted(ranges, key=lambda r: r["lo"]), 1)
                places = merged([{"lo": lo + k, "hi": hi - 1 + k} for k in range(0, length, first) for lo, hi in starts], 1, in_order=False)
                for lo, hi in places:
                    for at in range(lo, hi, PIECE):
                        held.append((row, doc_id, key, at, Prefix(data[at : min(hi, at + PIECE) + first - 1]).grams(first)))
                        size += len(held[-1][4])
                        if size > 50_000:
                            yield together(held)
                            held, size = [], 0
        if held:
            yield together(held)

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, text_key long, at long, one long").withColumn("two", F.lit(0).cast("long"))


def doubling(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> tuple[DataFrame, str]:
    """doc_id, text_key, at of the windows of length bytes that start elsewhere too, by prefix doubling, and the folder they are in.
    docs: doc_id, text_key, text, ranges (array of (lo, hi), the window starts looked at; null: all). length is first times a
    power of two."""
    spark = docs.sparkSession
    rows, path = materialize(_positions(docs.select("doc_id", "text_key", "text", "ranges"), length, first), "suffix-positions")
    k = first
    while True:
        pairs = rows.groupBy("one", "two").agg(F.count("*").alias("_n")).where("_n > 1")
        ordered = pairs.repartitionByRange(partitions(spark), "one", "two").sortWithinPartitions("one", "two")
        ranks, ranks_path = materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), "suffix-ranks")  # in the order of the pairs
        ranked, ranked_path = materialize(join_counted(rows, ranks, ["one", "two"]).select("row", "doc_id", "text_key", "at", "rank"), "suffix-ranked")
        remove(spark, path, ranks_path)
        if k == length:
            return ranked, ranked_path
        ahead = ranked.select("row", (F.col("at") - k).alias("at"), F.col("rank").alias("two"))
        rows, path = materialize(ranked.join(ahead, ["row", "at"]).select("row", "doc_id", "text_key", "at", F.col("rank").alias("one"), "two"), "suffix-pairs")
        remove(spark, ranked_path)
        k *= 2


def _sifted(rows: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Drops groups of unique cores; adds whole (the extent is repeated) and open (goes on: one of each extent)."""
    spark = rows.sparkSession
    cores, cores_path = materialize(rows.groupBy("core").agg(F.count("*").alias("_n")).where("_n > 1"), "suffix-cores")
    kept, kept_path = materialize(join_counted(rows, cores, "core", "left_semi").drop("core"), "suffix-kept")
    remove(spark, path, cores_path)
    place = F.struct("doc_id", "text_key", "lo")
    extents, extents_path = materialize(kept.groupBy("extent").agg(F.count("*").alias("_n"), F.min(place).alias("first")).where("_n > 1"), "suffix-extents")
    whole = F.col("first").isNotNull()
    out, out_path = materialize(join_counted(kept, extents, "extent", "left").select(*[c for c in kept.columns if c != "extent"], whole.alias("whole"), (~whole | place.eqNullSafe(F.col("first"))).alias("open")), "suffix-sifted")
    remove(spark, kept_path, extents_path)
    return out, out_path


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (array of (lo, hi), first bytes of windows that start elsewhere too) of rows of keyed()."""
    spark = tuned(docs.sparkSession)

    def with_open(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        found = rows.where("open").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*columns)).alias(name)).hint("merge")
        return docs.join(found, same_row(docs, found)).select(docs["doc_id"], docs["text_key"], docs["text"], found[name])

    sifted = [_sifted(*materialize(_first_round(docs), "suffix-groups"))]
    for step in STEPS:
        sifted.append(_sifted(*materialize(_next_round(with_open(sifted[-1][0], "anchors", "a", "lo", "hi"), step), "suffix-groups")))
    last, last_path = doubling(with_open(sifted[-1][0], "ranges", "lo", "hi"))
    spans = last.select("doc_id", "text_key", F.col("at").alias("lo"), F.col("at").alias("hi"))
    for x, _ in sifted:
        spans = spans.unionByName(x.where("whole").select("doc_id", "text_key", "lo", "hi"))
    spans, _ = materialize(spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "suffix-spans")
    remove(spark, last_path, *[path for _, path in sifted])
    return spans.hint("merge")  # it grows with the corpus: never broadcast


def merged(spans: list[dict] | None, length: int = LENGTH, in_order: bool = True) -> list[tuple[int, int]]:
    """Maximal runs of the bytes of windows of length bytes, half-open. spans: first and last starts, sorted if in_order."""
    out: list[tuple[int, int]] = []
    for x in (spans if in_order else sorted(spans, key=lambda x: x["lo"])) if spans is not None else []:
        lo, hi = x["lo"], x["hi"] + length
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = out[-1][0], hi
        else:
            out.append((lo, hi))
    return out


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    keep, at = [], 0
    for lo, hi in runs:
        keep.append(data[at:lo])
        at = hi
    keep.append(data[at:])
    return b"".join(keep)


def with_spans(docs: DataFrame) -> DataFrame:
    """The rows of keyed() and their spans, null where there are none."""
    spans = repeated_spans(docs)
    return docs.join(spans, same_row(docs, spans), "left").select(*[docs[c] for c in docs.columns], spans["spans"])


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data, runs = (text or "").encode("utf-8", "surrogatepass"), merged(spans)
                rows.append((doc_id, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut(data, runs)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    return with_spans(keyed(docs)).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the repeated bytes cut out of text; characters of which a byte went are dropped. Null texts stay null."""

    @F.pandas_udf("string")
    def kept(texts, spans):
        import pandas as pd

        return pd.Series([t if t is None or s is None else cut(t.encode("utf-8", "surrogatepass"), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)])

    whole = F.struct(*docs.columns).alias("_row")
    found = with_spans(keyed(docs, whole)).withColumn("_text", kept("text", "spans"))
    return found.select(*[F.when(F.col("_row.text").isNotNull(), F.col("_text")).alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(documents(spark, sf_dir))
