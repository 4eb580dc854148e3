"""Operator 11: vector code compression.

Product codes by Elkan's form of Lloyd's iteration, in whole numbers. A component x becomes floor(scale * x); a vector is cut into
equal consecutive parts; each part position has a codebook, begun with that part of the vectors of least vec_id. A table in the
shared folder holds for each part its entry, an upper bound of the distance to it, and a lower bound of the distance to each entry
of its codebook. A round shifts the bounds by how far the entries moved, leaves out every entry that the triangle inequality
strictly excludes, and compares the others by squared distances in whole numbers, ties to the lower index. So the codes are those
of the plain iteration. Bounds are rounded away from the distances: lower bounds are kept as whole steps of a byte (step: 1/128 of
the largest distance of two entries at the start, rounded down), upper bounds as 32-bit floats, rounded up.

Vectors stay in their tasks. To the driver go the sums of each entry of each codebook, a row for each.

Nulls: vectors that are null or hold null or non-finite components are dropped. A null vec_id counts as the last; a null label is a
label like the others. Vectors that repeat a vec_id are coded each; among the first, ties of vec_id go by the vector. Vectors of
another length than the first one's, and all if that is no multiple of the parts, have no code: null code and error. Components
beyond 2**27 after scaling raise ValueError, as squared distances would not fit. Fewer vectors than entries give that many entries.
An empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.common import join_counted, materialize, remove, tuned

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 27
STEPS = 128  # steps of a lower bound in the diameter of a first codebook; a byte holds twice as many
BATCH = 256
_SLACK = 1e-9

STATE = "vec_id long, label_key string, x binary, entry binary, upper binary, lower binary"
_STATE = pa.schema([("vec_id", pa.int64()), ("label_key", pa.string()), ("x", pa.binary()), ("entry", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary())])


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label_key (null label: null), x: array<long> of the rows kept."""
    v = F.col("embedding").cast("array<double>")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = F.transform(v, lambda c: F.when(F.abs(c * scale) > MOST, F.raise_error(F.lit(f"a component is beyond {MOST} after scaling")).cast("long")).otherwise(F.floor(c * scale)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label_key"), v.alias("embedding")).where("embedding IS NOT NULL").where(ok).select("vec_id", "label_key", x.alias("x"))


def down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - _SLACK)


def up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + _SLACK)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...k,...k->...", d, d)


class Codebooks:
    """The entries of every part position, int64 [parts, entries, width], and what the inequality needs of them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squares(entries[:, :, None], entries[:, None])
        self.half = down(between) / 2  # [part, entry, entry]
        np.einsum("pee->pe", self.half)[...] = 0

    def step(self) -> np.ndarray:
        """The step of lower bounds of each part position."""
        return np.maximum(2 * self.half.max(axis=(1, 2)) / STEPS, 1e-6)

    def moved(self, to: Codebooks) -> np.ndarray:
        return up(squares(self.entries, to.entries))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first(x: np.ndarray, books: Codebooks, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """entry, upper, lower of the vectors [n, parts, width], every distance computed."""
    d = squares(x[:, :, None], books.entries[None])
    entry = d.argmin(-1)
    upper = up(np.take_along_axis(d, entry[..., None], -1)[..., 0])
    return entry, upper, np.minimum(down(d) / step[None, :, None], 255).astype(np.uint8)


def again(x: np.ndarray, books: Codebooks, step: np.ndarray, moved: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The next entry, upper and lower, and how many distances were computed. moved: how far each entry went since the bounds."""
    part = np.arange(x.shape[1])[None]
    upper = upper + moved[part, entry]
    shifted = np.maximum(lower * step[None, :, None] - moved[None], 0)
    own = np.arange(books.entries.shape[1]) == entry[..., None]
    near = ~own & (shifted <= upper[..., None]) & (books.half[part, entry] <= upper[..., None])  # equality excludes nothing
    tight = near.any(-1)
    exact = squares(x, books.entries[part, entry])
    upper = np.where(tight, up(exact), upper)
    near &= (shifted <= upper[..., None]) & (books.half[part, entry] <= upper[..., None])
    n, p, e = np.nonzero(near)
    found = squares(x[n, p], books.entries[p, e])
    shifted[n, p, e] = down(found)
    row = n * x.shape[1] + p
    # least (square, index) of each part: its own entry against those that were compared
    rows = np.concatenate([np.arange(exact.size), row])
    dist, index = np.concatenate([exact.ravel(), found]), np.concatenate([entry.ravel(), e])
    order = np.lexsort((index, dist, rows))
    best = order[np.searchsorted(rows[order], np.arange(exact.size))]
    chosen = index[best].reshape(entry.shape)
    upper = np.where(chosen != entry, up(dist[best].reshape(entry.shape)), upper)
    n, p = np.nonzero(tight)
    shifted[n, p, entry[n, p]] = down(exact[n, p])
    return chosen, upper, np.minimum(shifted / step[None, :, None], 255).astype(np.uint8), len(found) + int(tight.sum())


def _wide(upper: np.ndarray) -> bytes:
    """As 32-bit floats, rounded up."""
    return np.nextafter(upper.astype(np.float32), np.float32(np.inf)).tobytes()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _stacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _state(batch: pa.RecordBatch, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    cols = {"vec_id": batch.column("vec_id"), "label_key": batch.column("label_key"), "x": [x[k].astype("<i4").tobytes() for k in range(n)]}
    cols |= {"entry": [entry[k].astype(np.uint8).tobytes() for k in range(n)], "upper": [_wide(upper[k]) for k in range(n)], "lower": [lower[k].tobytes() for k in range(n)]}
    return pa.RecordBatch.from_pydict(cols, schema=_STATE)


def assigned_first(rows: DataFrame, books: Codebooks, step: np.ndarray) -> DataFrame:
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist(), np.int64).reshape(batch.num_rows, parts, width)
                yield _state(batch, x, *first(x, books, step))

    return rows.mapInArrow(run, STATE)


def _read(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, ...]:
    parts, entries, width = books.entries.shape
    of = lambda name, kind, *shape: _stacked(batch.column(name), kind, *shape)
    return of("x", "<i4", parts, width).astype(np.int64), of("entry", np.uint8, parts).astype(np.int64), of("upper", "<f4", parts).astype(np.float64), of("lower", np.uint8, parts, entries)


def assigned_again(state: DataFrame, books: Codebooks, step: np.ndarray, moved: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            if batch.num_rows:
                x, *bounds = _read(batch, books)
                yield _state(batch, x, *again(x, books, step, moved, *bounds)[:3])

    return state.mapInArrow(run, STATE)


def updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the componentwise floor of the mean of its parts; entries without any stay. A task sends one row an entry."""
    parts, entries, width = books.entries.shape
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in _blocks(batches):
            if batch.num_rows:
                x, entry = _stacked(batch.column("x"), "<i4", parts, width), _stacked(batch.column("entry"), np.uint8, parts)
                at = (np.arange(parts)[None] * entries + entry).ravel()
                n += np.bincount(at, minlength=len(n))
                np.add.at(sums, at, x.reshape(-1, width).astype(np.int64))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": used.astype(np.int32), "n": n[used], "sums": sums[used].tolist()}, schema=schema)

    sent = state.select("x", "entry").mapInArrow(run, "at int, n long, sums array<long>")
    total = sent.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    to = books.entries.copy().reshape(-1, width)
    for r in total.collect():  # parts * entries rows at most
        to[r["at"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return Codebooks(to.reshape(parts, entries, width))


def coded(state: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label_key, code (two hex digits for each part), error."""
    schema = pa.schema([("vec_id", pa.int64()), ("label_key", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            if batch.num_rows:
                x, entry, *_ = _read(batch, books)
                error = squares(x, books.entries[np.arange(x.shape[1])[None], entry]).sum(1)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label_key": batch.column("label_key"), "code": [bytes(k).hex() for k in entry.astype(np.uint8)], "error": error}, schema=schema)

    return state.mapInArrow(run, "vec_id long, label_key string, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label_key, code, error of every vector kept, and the codebooks (None if no vector can be coded). entries: up to 256."""
    spark = tuned(vectors.sparkSession)
    rows = whole(vectors, scale)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # as many as a codebook has entries
    size = len(start[0]["x"]) if start else 0
    without = rows.select("vec_id", "label_key", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.size("x").alias("_n"))
    if not size or size % parts:
        return without.drop("_n"), None
    if any(len(r["x"]) != size for r in start):
        start = rows.where(F.size("x") == size).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = Codebooks(np.array([r["x"] for r in start], np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2).copy())
    step = books.step()
    state, path = materialize(assigned_first(rows.where(F.size("x") == size), books, step), "codes")
    for _ in range(rounds):
        to = updated(state, books)
        new, new_path = materialize(assigned_again(state, to, step, books.moved(to)), "codes")
        remove(spark, path)
        state, path, books = new, new_path, to
    return coded(state, books).unionByName(without.where(F.col("_n") != size).drop("_n")), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: error summed over equal labels, nulls together. Frequent labels are salted in the join."""
    keyed, _ = materialize(codes.select("vec_id", "code", "error", F.col("label_key").isNull().alias("_no"), F.coalesce("label_key", F.lit("")).alias("_label")), "coded")
    sums, _ = materialize(keyed.groupBy("_no", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    return join_counted(keyed, sums, ["_no", "_label"]).select("vec_id", "code", "error", "label_error")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(tuned(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return with_label_error(codes).withColumn("codebooks_sha256", F.lit(digest))


def _round(k: int, after: str) -> str:
    """SQL of an assignment to the entries of table c{k}: plain Lloyd."""
    entries = f"SELECT p, e, {', '.join(f'x{i}' for i in range(4))} FROM c{k}"
    distance = " + ".join(f"(v.x{i} - c.x{i}) * (v.x{i} - c.x{i})" for i in range(4))
    return f"a{k} AS (SELECT vec_id, label, p, any_value(v.x0) AS x0, any_value(v.x1) AS x1, any_value(v.x2) AS x2, any_value(v.x3) AS x3, min(({distance}) * {ENTRIES} + e) AS best FROM v JOIN ({entries}) c USING (p) GROUP BY ALL),\n{after}"


def _means(k: int) -> str:
    means = ", ".join(f"coalesce(m.x{i}, c.x{i}) AS x{i}" for i in range(4))
    sums = ", ".join(f"CAST(floor(CAST(sum(x{i}) AS DOUBLE) / count(*)) AS BIGINT) AS x{i}" for i in range(4))
    return f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, {means} FROM c{k} c LEFT JOIN (SELECT p, best % {ENTRIES} AS e, {sums} FROM a{k} GROUP BY ALL) m ON m.p = c.p AND m.e = c.e),\n"


ORACLE = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, p, x[4 * p + 1] AS x0, x[4 * p + 2] AS x1, x[4 * p + 3] AS x2, x[4 * p + 4] AS x3 FROM k, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, n - 1 AS e, x0, x1, x2, x3 FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS n FROM v) WHERE n <= {ENTRIES}),
{_round(0, _means(0))}{_round(1, _means(1))}{_round(2, "")}r AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256 FROM r"""
