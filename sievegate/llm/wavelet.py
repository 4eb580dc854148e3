"""Operator 3: token ids as one wavelet matrix per shard.

A shard file holds bit planes of the ids, the most significant first. Below each plane stand the ids with a 0 bit, then those
with a 1 bit, each in their order. A directory of popcounts every 512 bits makes rank constant-time, and select a binary
search over it, so a shard answers access, count and select (where does the k-th occurrence of an id stand) from its one file.
Planes and directories are zstd-compressed, each on its own, so that a lookup inflates what it needs and no more.

Null texts encode like empty ones and hold the end id alone; rows that repeat a doc_id follow each other; a null doc_id sorts first.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.bpe import encoder
from sievegate.llm.common import documents, materialize, partitions, shared_path, tuned

MAGIC = b"WVMX0001"
BLOCK = 512  # bits a directory entry stands for
SHARD_TOKENS = 1 << 20


def build(ids: np.ndarray, width: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """Packed planes, popcounts before each block, and the number of zeros of each plane."""
    width = width if width is not None else max(1, int(ids.max(initial=0)).bit_length())
    seq = ids.astype(np.uint16 if width <= 16 else np.uint32)
    planes, ranks, zeros = [], [], []
    for k in range(width - 1, -1, -1):
        ones = (seq >> seq.dtype.type(k) & seq.dtype.type(1)).view(np.uint16 if width <= 16 else np.uint32).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        padded = np.zeros(-(-len(ones) // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(packed)] = packed
        per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        planes.append(padded)
        ranks.append(np.concatenate([[0], np.cumsum(per)]).astype(np.uint32))
        zeros.append(len(ones) - int(ranks[-1][-1]))
        seq = np.concatenate([seq[~ones], seq[ones]])
    return planes, ranks, zeros


def pack(ids: np.ndarray, meta: dict) -> bytes:
    """The bytes of a shard file."""
    import zstandard

    planes, ranks, zeros = build(ids)
    blobs = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for pair in zip(planes, ranks, strict=True) for x in pair]
    head = zlib.compress(json.dumps(meta | {"n": len(ids), "zeros": zeros, "sizes": [len(b) for b in blobs]}).encode(), 1)
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *blobs])


class WaveletMatrix:
    """Answers from the bytes of one shard file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, 8)
        self.meta = json.loads(zlib.decompress(data[12 : 12 + size]))
        self.n, self.zeros, self._data, self._plane = self.meta["n"], self.meta["zeros"], data, {}
        ends = np.cumsum([12 + size, *self.meta["sizes"]])
        self._at = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        self.width = len(self.zeros)

    def _blob(self, k: int, kind: type) -> np.ndarray:
        import zstandard

        if k not in self._plane:
            a, b = self._at[k]
            self._plane[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._data[a:b]), kind)
        return self._plane[k]

    def _rank1(self, level: int, pos: int) -> int:
        """Ones of a plane before pos."""
        block = pos // BLOCK
        bits = self._blob(2 * level, np.uint8)[block * BLOCK // 8 : (pos + 7) // 8]
        ones = int(self._blob(2 * level + 1, np.uint32)[block])
        return ones + int(np.unpackbits(bits, bitorder="little")[: pos - block * BLOCK].sum())

    def _bit(self, level: int, pos: int) -> int:
        return int(self._blob(2 * level, np.uint8)[pos >> 3]) >> (pos & 7) & 1

    def access(self, pos: int) -> int:
        """The id at pos."""
        if not 0 <= pos < self.n:
            raise IndexError(pos)
        out = 0
        for k in range(self.width):
            bit, ones = self._bit(k, pos), self._rank1(k, pos)
            out, pos = out << 1 | bit, self.zeros[k] + ones if bit else pos - ones
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        for k in range(self.width):
            a, b = self._rank1(k, start), self._rank1(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.width - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in [start, end)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of that kind."""
        ranks = self._blob(2 * level + 1, np.uint32).astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._blob(2 * level, np.uint8)[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id, or -1."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        pos = a + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            pos = self._select(level, bit, pos - self.zeros[level] * bit)
        return pos

    def tokens(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for k in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self._blob(2 * k, np.uint8), count=self.n, bitorder="little").view(bool)
            up, z = np.empty(self.n, kind), self.zeros[k]
            up[~ones] = seq[:z]
            up[ones] = seq[z:] | kind(1 << (self.width - 1 - k))
            seq = up
        return seq


def put(uri: str, data: bytes) -> None:
    """Writes a file under another name and renames it: a repeated task leaves whole files only."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    with fs.open_output_stream(draft := f"{path}.{context.taskAttemptId() if context else 0}.tmp") as out:
        out.write(data)
    fs.move(draft, path)


def fetch(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as source:
        return source.read()


def write(df: DataFrame, folder: str, vocabulary: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes text in ascending doc_id order and writes wavelet shards; returns a row per shard: path, part, seq, n_tokens and
    base, the ids before it in its part. Parts are ranges of doc_id, ascending."""
    spark = tuned(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder("byte", vocabulary), TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        docs: list = []
        held: list[bytes] = []
        size = seq = base = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, size, seq, base
            ids = np.frombuffer(b"".join(held), "<u4")
            path = f"{folder}/part-{part:06d}-{seq:06d}.wvm"
            put(path, pack(ids, {"doc_id": docs, "length": [len(x) // 4 for x in held]}))
            out = pa.RecordBatch.from_pydict({"path": [path], "part": [part], "seq": [seq], "n_tokens": [len(ids)], "base": [base]})
            docs, held, size, seq, base = [], [], 0, seq + 1, base + len(ids)
            return out

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                docs.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield flush()
        if docs:
            yield flush()

    return ranged.mapInArrow(run, "path string, part long, seq long, n_tokens long, base long")


def read(shards: DataFrame) -> DataFrame:
    """Per document, from the shard files: doc_id, start, n_tokens, ids_crc32. What goes to the driver is one count for each part."""
    spark = shards.sparkSession
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = {}, 0
    for part, n in totals:
        before[part], at = at, at + n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, base in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                matrix = WaveletMatrix(fetch(path))
                ids = matrix.tokens().astype("<u4")
                lengths = np.array(matrix.meta["length"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": matrix.meta["doc_id"], "start": starts + (before[part] + base), "n_tokens": lengths, "ids_crc32": crc}, schema=schema)

    return shards.select("path", "part", "base").repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "wavelet")
    shards, _ = materialize(write(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json")), "wavelet-shards")
    return read(shards)
