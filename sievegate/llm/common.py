"""Shared pieces: the shared folder, materialised intermediates, and vectorised substring hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_WRITTEN: list[str] = []

#: Records and bytes of one Arrow batch bound what a Python worker holds of long texts at once; the shuffle files of a
#: written table go when it is written.
CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Sets what bounds the memory of Python workers and the disk of shuffles, where the session does not set it itself."""
    given = dict(spark.sparkContext.getConf().getAll())
    for key, value in CONF.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset it is a temporary one in local mode,
    as in tests, and an error on a cluster, whose executors would write to disks of their own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="sievegate-"))
    return _OWN[0]


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_base(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and rereads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables that were written inside it, but for those whose path is put into the list it gives."""
    start, keep = len(_WRITTEN), []
    yield keep
    remove(spark, *[path for path in _WRITTEN[start:] if path not in keep])
    _WRITTEN[start:] = keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text_key (a hash that tells rows of one doc_id apart), text (null: empty), and more columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), *more)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """The join condition of two tables with the columns of keyed; a null doc_id is a doc_id like any other."""
    return (a["text_key"] == b["text_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


#: Keys of more than a share 1 / HOT of all rows are hot; there are fewer than HOT of them, whatever the table holds. The rows of
#: a hot key are dealt over SPREAD parts.
HOT, SPREAD = 256, 64


def join_counted(rows: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined (inner, left or left_semi) with a written table small of a row a key, of which _n counts the rows of the key. Hot
    keys are salted: their row of small is repeated for each part, so that no task reads a hot group. Keys are not null. The plan is
    the same with and without hot keys: a hash that no key has, or by chance a cold one, stands for none."""
    keys = [key] if isinstance(key, str) else key
    total = small.agg(F.sum("_n")).first()[0] or 0
    hashed = F.xxhash64(*keys)
    hot = [r[0] for r in small.where(F.col("_n") * HOT > total).select(hashed).collect()] or [0]  # fewer than HOT
    part = F.when(hashed.isin(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))).otherwise(0).cast("int")
    parts = F.explode(F.when(hashed.isin(hot), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_part", part).join(small.withColumn("_part", parts).hint("merge"), [*keys, "_part"], how).drop("_part")


def partitions(spark: SparkSession) -> int:
    """Exchange width: what the session asks for, and never less than its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """mapInArrow with a function from a batch to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch), schema=arrow_schema)

    return df.mapInArrow(run, schema)


# Substring hashes: a polynomial over a table of random 64-bit letters, modulo 2**64, with a final mix.
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        size = max(n, 2 * _POW["n"], 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size + 1, base & _MASK, np.uint64)
            steps[0] = 1
            _POW[key] = np.cumprod(steps, dtype=np.uint64)
        _POW["n"] = size
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Prefix:
    """Hashes of substrings of one byte string, each in constant time."""

    def __init__(self, data: bytes | np.ndarray):
        codes = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
        up, self.down = _powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_LETTERS[codes] * up[: len(codes)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + np.asarray(end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, size: int) -> np.ndarray:
        """The hashes of all substrings of size bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size * 0xD6E8FEB86659FD93 & _MASK))
