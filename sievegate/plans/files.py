"""Queries over files of all kinds, from their bytes to the matches of rules, and the SQL of each.

Documents become files of the kind that their number says: each line a CSV row, a paragraph, a row of one of two sheets, or a line of a
slide of ``SLIDE`` lines. Some archives are cut short, some have a part that is no XML, some kinds can't be read."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from sievegate.functions.detectors import SECRET
from sievegate.operators import parsed_files
from sievegate.plans.intake import _EMAIL
from sievegate.plans.responses import CATALOGUE
from sievegate.sources import files, views

KINDS = ["text", "code", "csv", "docx", "xlsx", "pptx", "pdf"]
SLIDE = 20
CUT, TORN, ODD = 41, 11, 37  # of a number: the archive is cut short, a part is no XML, the bytes are no UTF-8
BATCH = 64


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def _sheet(lines: list[str], index: dict[str, int]) -> str:
    """Rows of cells, by turns shared and inline strings."""
    cell = lambda k, x: f"<c t='inlineStr'><is><t>{escape(x)}</t></is></c>" if k % 2 else f"<c t='s'><v>{index.setdefault(x, len(index))}</v></c>"
    return "<s>" + "".join("<row>" + "".join(cell(k, x) for k, x in enumerate(line.split(" "))) + "</row>" for line in lines) + "</s>"


def content_of(n: int, text: str) -> bytes:
    kind, lines = KINDS[n % len(KINDS)], text.split("\n")
    if kind == "csv":
        out = io.StringIO(newline="")
        csv.writer(out).writerows(line.split(" ") for line in lines)
        return out.getvalue().encode()
    if kind in ("text", "code", "pdf"):
        return b"\xff" * (n % ODD == 0) + text.encode()
    torn = n % TORN == 0
    if kind == "docx":
        parts = {"word/document.xml": "<w:d xmlns:w='u'>" + "".join(f"<w:p><w:t>{escape(x)}</w:t></w:p>" for x in lines) + "</w:d>" * (not torn)}
    elif kind == "xlsx":
        index: dict[str, int] = {}
        half = len(lines) // 2
        parts = {"xl/worksheets/sheet1.xml": _sheet(lines[:half], index), "xl/worksheets/sheet2.xml": "<s>" if torn else _sheet(lines[half:], index)}
        parts["xl/sharedStrings.xml"] = "<s>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in index) + "</s>"
    else:
        slides = [lines[k : k + SLIDE] for k in range(0, len(lines), SLIDE)]
        parts = {f"ppt/slides/slide{k}.xml": "<p>" + "".join(f"<t>{escape(x)}</t>" for x in slide) + "</p>" for k, slide in enumerate(slides, 1)}
        if torn:
            parts[f"ppt/slides/slide{len(slides) + 1}.xml"] = "<p>"
    whole = _archive(parts)
    return whole[: len(whole) // 2] if n % CUT == 0 else whole


def _files(spark, d):
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = batch.slice(at, BATCH).to_pylist()
                cols = [[str(r["doc_id"]) for r in rows], [KINDS[r["doc_id"] % len(KINDS)] for r in rows], [content_of(r["doc_id"], r["text"]) for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    docs = views.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "path string, kind string, content binary")


def parsed_file_blocks(spark, d):
    return files.parsed(_files(spark, d)).select(F.col("path").cast("long").alias("doc_id"), "kind", "status", "failure_code", "block_index", "place", F.sha2("text", 256).alias("sha256"))


def parsed_file_matches(spark, d):
    found = parsed_files.file_matches(files.parsed(_files(spark, d)), CATALOGUE)
    return found.select(F.col("path").cast("long").alias("doc_id"), "rule_id", "count", "action")


def parsed_file_results(spark, d):
    return parsed_files.file_results(files.parsed(_files(spark, d)), CATALOGUE).withColumnRenamed("path", "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))


def wrapped_text_results(spark, d):
    """Turns of conversations as wrapped texts; some came with a file, some as another kind."""
    n = F.col("conv_id") * 7 + F.col("turn")
    turns = views.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("input_id"), F.when(n % 9 == 4, "file").otherwise("text_wrapper").alias("kind"), F.when(n % 10 != 3, F.col("text")).alias("text"), F.when(n % 13 == 6, F.lit("f")).alias("file_ref"))
    return parsed_files.file_results(parsed_files.wrapped_texts(turns), CATALOGUE).select(F.col("path").alias("input_id"), "status", "failure_code", "n_blocks", "n_matches", "action", "decision_basis")


QUERIES = [parsed_file_blocks, parsed_file_matches, parsed_file_results, wrapped_text_results]

_SECRET = SECRET.replace("'", "''")
_TAB = "chr(9)"
_CELLS = f"array_to_string(list_filter(string_split(x, ' '), lambda c: c <> ''), {_TAB})"
#: doc_id, kind, status, failure_code; and b: of those, block_index, place, text.
_BLOCKS = f"""f AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l, [{", ".join(map(repr, KINDS))}][doc_id % {len(KINDS)} + 1] AS kind FROM documents),
g AS (SELECT *, CASE WHEN kind = 'pdf' THEN 'unsupported' WHEN kind IN ('text', 'code') AND doc_id % {ODD} = 0 THEN 'failed' WHEN kind IN ('docx', 'xlsx', 'pptx') AND doc_id % {CUT} = 0 THEN 'failed' WHEN kind = 'docx' AND doc_id % {TORN} = 0 THEN 'failed'
  WHEN kind IN ('xlsx', 'pptx') AND doc_id % {TORN} = 0 THEN CASE WHEN kind = 'xlsx' AND len(list_filter(l[1:len(l) // 2], lambda x: {_CELLS} <> '')) = 0 OR text = '' THEN 'failed' ELSE 'partial' END ELSE 'parsed' END AS status FROM f),
h AS (SELECT doc_id, kind, status, CASE WHEN kind = 'pdf' THEN 'UNSUPPORTED_FILE_KIND' WHEN status = 'failed' AND kind IN ('text', 'code') THEN 'TEXT_DECODE_FAILED' WHEN status <> 'parsed' THEN 'PARSER_WORKER_FAILED' END AS failure_code, l, text FROM g),
e AS (SELECT doc_id, kind, i, x FROM (SELECT doc_id, kind, l, unnest(generate_series(1, len(l))) AS i, unnest(l) AS x, status FROM h WHERE status IN ('parsed', 'partial') AND kind IN ('csv', 'docx', 'xlsx', 'pptx'))),
r AS (SELECT doc_id, i AS o, 0 AS part, CASE WHEN kind = 'csv' THEN replace(x, ' ', {_TAB}) ELSE x END AS t, i AS place FROM e WHERE kind IN ('csv', 'docx') AND regexp_matches(x, '[^\\s]')
  UNION ALL SELECT doc_id, i, 0, {_CELLS}, CASE WHEN i <= half THEN i ELSE i - half END FROM (SELECT e.*, len(h.l) // 2 AS half, h.status FROM e JOIN h USING (doc_id) WHERE e.kind = 'xlsx') WHERE {_CELLS} <> '' AND (status = 'parsed' OR i <= half)
  UNION ALL SELECT doc_id, (i - 1) // {SLIDE}, 0, string_agg(x, chr(10) ORDER BY i), (i - 1) // {SLIDE} + 1 FROM e WHERE kind = 'pptx' AND x <> '' GROUP BY doc_id, (i - 1) // {SLIDE}
  UNION ALL SELECT doc_id, 0, 0, text, greatest(1, len(l) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END) FROM h WHERE kind IN ('text', 'code') AND status = 'parsed' AND text <> ''),
b AS (SELECT h.doc_id, kind, status, failure_code, CASE WHEN r.doc_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY o) - 1 AS INTEGER) END AS block_index, CAST(place AS INTEGER) AS place, t AS text FROM h LEFT JOIN r USING (doc_id))"""
#: Of t (id, c): m (id, rule_id, n, action, score) of CATALOGUE.
_MATCHES = f"""n AS (SELECT id, c, lower(array_to_string(list_transform(list_filter(generate_series(1, len(l)), lambda k: k = 1 OR l[k] <> l[k-1] OR NOT regexp_matches(l[k], '^[\\pP\\pS]$')), lambda k: l[k]), '')) AS norm FROM (SELECT *, string_split(c, '') AS l FROM t)),
m AS (SELECT * FROM (SELECT id, 'email' AS rule_id, len(regexp_extract_all(c, '{_EMAIL}')) AS n, 'MASK' AS action, 55 AS score FROM n UNION ALL SELECT id, 'word', (length(norm) - length(replace(norm, 'licensed', ''))) // 8, 'WARN', 25 FROM n
  UNION ALL SELECT id, 'secret', len(regexp_extract_all(norm, '{_SECRET}')), 'BLOCK', 95 FROM n
  UNION ALL SELECT id, 'ctx', CASE WHEN k >= 2 THEN k ELSE 0 END, 'WARN', 80 FROM (SELECT id, CAST(contains(norm, 'licensed') AS INTEGER) + CAST(contains(norm, 'version') AS INTEGER) + CAST(contains(norm, 'mail') AS INTEGER) AS k FROM n)) WHERE n > 0),
a AS (SELECT id, count(*) AS n_matches, max(score) AS score, ['WARN', 'MASK', 'BLOCK'][max(CASE action WHEN 'WARN' THEN 1 WHEN 'MASK' THEN 2 ELSE 3 END)] AS action FROM m GROUP BY 1)"""
_FILES = f"{_BLOCKS},\nt AS (SELECT doc_id AS id, string_agg(text, chr(10) ORDER BY block_index) AS c FROM b WHERE status = 'parsed' AND text <> '' GROUP BY 1),\n{_MATCHES}"

SQL = {
    "parsed_file_blocks": f"WITH {_BLOCKS} SELECT doc_id, kind, status, failure_code, block_index, place, sha256(text) AS sha256 FROM b",
    "parsed_file_matches": f"WITH {_FILES} SELECT id AS doc_id, rule_id, CAST(n AS BIGINT) AS count, action FROM m",
    "parsed_file_results": f"""WITH {_FILES} SELECT doc_id, status, failure_code, n_blocks, status = 'parsed' AS content_scanned, CASE WHEN status <> 'parsed' THEN 'content_unavailable' WHEN n_matches > 0 THEN 'detection' ELSE 'no_detection' END AS decision_basis,
  coalesce(n_matches, 0) AS n_matches, coalesce(action, 'ALLOW') AS action, CAST(coalesce(score, 0) AS INTEGER) AS risk_score, CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS risk_level
FROM (SELECT doc_id, status, failure_code, count(block_index) AS n_blocks FROM b GROUP BY 1, 2, 3) LEFT JOIN a ON a.id = doc_id""",
    "wrapped_text_results": f"""WITH w AS (SELECT conv_id || ':' || turn AS id, CASE WHEN k % 10 <> 3 THEN text END AS c, k % 9 = 4 OR k % 13 = 6 AS other FROM (SELECT *, conv_id * 7 + turn AS k FROM conversations)),
t AS (SELECT id, c FROM w WHERE NOT other AND c <> ''),
{_MATCHES}
SELECT id AS input_id, CASE WHEN other OR c IS NULL THEN 'failed' ELSE 'parsed' END AS status, CASE WHEN other OR c IS NULL THEN 'UNSUPPORTED_FILE_KIND' END AS failure_code, CAST(NOT other AND coalesce(c, '') <> '' AS BIGINT) AS n_blocks, coalesce(n_matches, 0) AS n_matches, coalesce(action, 'ALLOW') AS action,
  CASE WHEN other OR c IS NULL THEN 'content_unavailable' WHEN n_matches > 0 THEN 'detection' ELSE 'no_detection' END AS decision_basis FROM w LEFT JOIN a USING (id)""",
}
