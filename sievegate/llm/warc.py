"""Operator 2: WARC archives. A normaliser for monolithic gzip files inflates each whole-file stream once, rewrites every record
as a gzip member of its own, and writes a sidecar index of their offsets.

Of records with equal payloads (of at least ``revisit_bytes`` bytes) that with the smallest page_id is a response, the others
revisit it. Rows that repeat the smallest page_id are the same page, and each of them is a response. A null html is an empty
payload, a null url gives a record without target; a null page_id counts as larger than all others and is not referred to
unless no other page has the payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.common import materialize, partitions, remove, shared_path, tuned

DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
FILE_BYTES = 32 << 20
RECORD_ID = "<urn:x-page:%s>"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {''.join(c for c in v if c >= ' ')}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisits: bool) -> bytes:
    headers = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", RECORD_ID % ("" if page_id is None else page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if revisits:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", RECORD_ID % first)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http if revisits else http + payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])]


class Inflated:
    """Bytes of a gzip stream, of one member or more, inflated as they are asked for."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.held, self.z, self.rest, self.open = read, bytearray(), zlib.decompressobj(31), b"", False

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.rest, self.z, self.open = self.z.unused_data, zlib.decompressobj(31), False
            raw = self.rest or self.read(CHUNK)
            self.rest = b""
            if not raw:
                return False
            out = self.z.decompress(raw, 4 * CHUNK)
            self.open = not self.z.eof  # begun, and its trailer not reached
            if self.z.unconsumed_tail:
                self.rest = self.z.unconsumed_tail
            if out:
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        return bytes(self.held[: end + len(mark)])

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self.more():
            pass
        if len(self.held) < size:
            raise EOFError("the stream ends within a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def records(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The records of a gzip stream, one by one. A stream that is cut short is an error, wherever it was cut."""
    source = Inflated(read)
    while (head := source.until(b"\r\n\r\n")) is not None:
        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield source.take(len(head) + size + 4)
    if source.open or source.held:
        raise EOFError("the stream ends within a member or a header")


class Draft:
    """A file under another name until it is whole: repeated tasks leave whole files only."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        context = TaskContext.get()
        self.draft = f"{self.path}.{context.taskAttemptId() if context else 0}.tmp"
        self.out, self.size = self.fs.open_output_stream(self.draft), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise_file(source: str, target: str, level: int = 4) -> dict:
    """Rewrites one archive; the sidecar is target + '.idx', a JSON line per record."""
    fs, path = pafs.FileSystem.from_uri(source)
    out, index, n = Draft(target), [], 0
    with fs.open_input_stream(path, compression=None) as stream:  # by default pyarrow inflates .gz itself
        for data in records(stream.read):
            at, packed = out.size, member(data, level)
            out.write(packed)
            headers, _ = parse(data[: data.find(b"\r\n\r\n") + 4])
            index.append(json.dumps({"offset": at, "length": len(packed), "type": headers.get("warc-type"), "id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest")}))
            n += 1
    out.close()
    sidecar = Draft(target + ".idx")
    sidecar.write("".join(x + "\n" for x in index).encode())
    sidecar.close()
    return {"path": target, "n_records": n, "bytes": out.size}


def write_monolithic(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, revisit_bytes: int = 0, level: int = 1) -> DataFrame:
    """Writes pages (page_id, url, html) as archives that are one gzip stream each; a row per file: path, n_records."""
    spark = tuned(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("key", F.unhex(F.sha1("payload")))
    groups = keyed.where(F.octet_length("payload") >= revisit_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    joined = keyed.join(groups, "key", "left").select("page_id", "url", "payload", "first", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)).alias("revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, z, n, raw = TaskContext.get().partitionId(), 0, None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    path = f"{folder}/part-{part:06d}-{seq:06d}.warc.gz"
                    out, z, n, raw = Draft(path), zlib.compressobj(level, zlib.DEFLATED, 31), 1, 0
                    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{part}-{seq}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(z.compress(info))
                data = page_record(*row)
                out.write(z.compress(data))
                n, raw = n + 1, raw + len(data)
                if raw >= file_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    return joined.mapInArrow(run, "path string, n_records long")


def normalise(files: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrites the archives whose addresses are in path into folder; a row per file: path, n_records, bytes. Inflates in
    pieces, so that memory is bounded by the largest record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                found = normalise_file(source, f"{folder}/{source.rpartition('/')[2]}", level)
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in found.items()})

    return files.select("path").repartition(partitions(files.sparkSession)).mapInArrow(run, "path string, n_records long, bytes long")


def read_pages(files: DataFrame) -> DataFrame:
    """The page records of normalised archives, each found by the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda x: int(x[len(RECORD_ID % "") - 1 : -1]) if x and len(x) > len(RECORD_ID % "") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path + ".idx") as source:
                    index = [json.loads(x) for x in source.read().splitlines()]
                rows = []
                with fs.open_input_file(path) as source:
                    for at in index:
                        if at["type"] not in ("response", "revisit"):
                            continue
                        source.seek(at["offset"])
                        headers, block = parse(zlib.decompress(source.read(at["length"]), 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        whole = headers["warc-type"] == "response"
                        rows.append((number(headers["warc-record-id"]), len(payload) if whole else size, digest(payload) if whole else headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], None if whole else number(headers["warc-refers-to"])))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)

    return files.select("path").repartition(partitions(files.sparkSession)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    monolithic, _ = materialize(write_monolithic(pages, f"{folder}/monolithic"), "warc-files")
    normalised, _ = materialize(normalise(monolithic, f"{folder}/members"), "warc-files")
    remove(spark, f"{folder}/monolithic")
    return read_pages(normalised)


ORACLE = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, d AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: (ascii(substr(b, CAST(i * 5 + j + 1 AS BIGINT), 1)) - 48) * (16 >> CAST(j AS INTEGER)))) AS INTEGER), 1)), 'string_agg', '') AS d
    FROM (SELECT *, list_aggregate(list_transform(string_split_regex(sha1(coalesce(html, '')), ''), lambda h: list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], 1 + instr('0123456789abcdef', h) - 1)), 'string_agg', '') AS b FROM pages))
"""
