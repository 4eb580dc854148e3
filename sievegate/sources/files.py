"""Files as blocks of text: plain text, code, CSV, DOCX, XLSX and PPTX, with a status instead of an exception."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.functions.tables import bounded

ROWS, CHARS = 4096, 4 << 20  # of one batch that a worker gives back: rows, and characters until it goes
SCHEMA = "path string, kind string, status string, failure_code string, block_index int, text string, place int"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node, name: str) -> Iterator[str]:
    return (x.text or "" for x in node.iter() if _local(x.tag) == name)


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _docx(archive: zipfile.ZipFile) -> tuple[list[tuple[str, int]], bool]:
    root = ElementTree.fromstring(archive.read("word/document.xml"))
    rows = ["".join(_texts(p, "t")) for p in root.iter() if _local(p.tag) == "p"]
    return [(t, k) for k, t in enumerate(rows, 1) if t.strip()], False


def _parts(archive: zipfile.ZipFile, pattern: str, read) -> tuple[list[tuple[str, int]], bool]:
    """Blocks of every part; a broken part leaves the others."""
    out, broken = [], False
    for k, name in enumerate(_numbered(archive, pattern), 1):
        try:
            out += read(ElementTree.fromstring(archive.read(name)), k)
        except (ElementTree.ParseError, KeyError, ValueError, IndexError):
            broken = True
    if broken and not out:
        raise ValueError("no part can be read")
    return out, broken


def _xlsx(archive: zipfile.ZipFile) -> tuple[list[tuple[str, int]], bool]:
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(_texts(x, "t")) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"]

    def cell(c) -> str:
        if c.get("t") == "inlineStr":
            return "".join(_texts(c, "t"))
        value = next(_texts(c, "v"), "")
        return shared[int(value)] if c.get("t") == "s" and value else value

    def sheet(root, k: int) -> list[tuple[str, int]]:
        rows = ["\t".join(v for c in r if _local(c.tag) == "c" and (v := cell(c))) for r in root.iter() if _local(r.tag) == "row"]
        return [(t, n) for n, t in enumerate(rows, 1) if t]

    return _parts(archive, r"xl/worksheets/sheet(\d+)\.xml", sheet)


def _pptx(archive: zipfile.ZipFile) -> tuple[list[tuple[str, int]], bool]:
    return _parts(archive, r"ppt/slides/slide(\d+)\.xml", lambda root, k: [(t, k)] if (t := "\n".join(x for x in _texts(root, "t") if x)) else [])


def _csv(content: bytes) -> list[tuple[str, int]]:
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))
    return [("\t".join(c for c in r), k) for k, r in enumerate(rows, 1) if any(c.strip() for c in r)]


OFFICE = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}


def parse(kind: str, content: bytes) -> tuple[str, str | None, list[tuple[str, int]]]:
    """status (parsed, partial, failed, unsupported), failure code, blocks of (text, place)."""
    if kind not in {"text", "code", "csv", *OFFICE}:
        return "unsupported", "UNSUPPORTED_FILE_KIND", []
    if not content:
        return "parsed", None, []
    try:
        if kind in OFFICE:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                if any(x.flag_bits & 1 for x in archive.infolist()):
                    return "failed", "PARSER_ENCRYPTED", []
                blocks, broken = OFFICE[kind](archive)
            return ("partial", "PARSER_WORKER_FAILED", blocks) if broken else ("parsed", None, blocks)
        if kind == "csv":
            return "parsed", None, _csv(content)
        text = content.decode("utf-8")
        return "parsed", None, [(text, max(1, len(text.splitlines())))]
    except UnicodeDecodeError:
        return "failed", "TEXT_DECODE_FAILED", []
    except Exception:  # whatever a broken file raises is a status of that file
        return "failed", "PARSER_WORKER_FAILED", []


def parsed(files: DataFrame) -> DataFrame:
    """Blocks of files (path, kind, content); a file without blocks has one row with a null block_index. A task holds the blocks of one
    file at a time, next to a batch of ``ROWS`` rows or ``CHARS`` characters, and a batch of files that is ``bounded``. Null content is empty,
    a null kind unsupported."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("status", pa.string()), ("failure_code", pa.string()), ("block_index", pa.int32()), ("text", pa.string()), ("place", pa.int32())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path, kind, content in zip(*batch.columns, strict=True):
                path, kind = path.as_py(), kind.as_py()
                status, code, blocks = parse(kind, content.as_py() or b"")
                for k, (text, place) in enumerate(blocks):
                    rows.append((path, kind, status, code, k, text, place))
                    size += len(text)
                    if len(rows) == ROWS or size > CHARS:
                        yield batch_of(rows)
                        rows, size = [], 0
                if not blocks:
                    rows.append((path, kind, status, code, None, None, None))
            if rows:
                yield batch_of(rows)
                rows, size = [], 0

    bounded(files.sparkSession)
    return files.select("path", "kind", "content").mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the files of a folder, their kinds by extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin("txt", "md", "log"), "text").when(ext.isin("py", "js", "ts", "java", "go", "rs", "c", "cpp", "html", "sql"), "code").otherwise(ext)
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", kind.alias("kind"), "content"))
