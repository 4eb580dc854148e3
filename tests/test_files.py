import io
import zipfile

from pyspark.sql import functions as F

from sievegate.operators import inputs
from sievegate.sources import files


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


DOCX = office(word__document="<w:d xmlns:w='u'><w:p><w:t>one </w:t><w:t>two</w:t></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:d>")
XLSX = office(xl__sharedStrings="<s><si><t>a</t></si><si><t>b</t></si></s>", xl__worksheets__sheet1="<s><row><c t='s'><v>1</v></c><c><v>5</v></c></row><row/></s>", xl__worksheets__sheet10="<s><row><c t='inlineStr'><is><t>last</t></is></c></row></s>", xl__worksheets__sheet2="<broken")
PPTX = office(ppt__slides__slide2="<p><t>second</t></p>", ppt__slides__slide1="<p><t>first</t><t>line</t></p>")


def test_kinds():
    assert files.parse("docx", DOCX) == ("parsed", None, [("one two", 1), ("three", 3)])
    assert files.parse("xlsx", XLSX) == ("partial", "PARSER_WORKER_FAILED", [("b\t5", 1), ("last", 1)])
    assert files.parse("pptx", PPTX) == ("parsed", None, [("first\nline", 1), ("second", 2)])
    assert files.parse("csv", "﻿a,b\n\nc,d e\n".encode()) == ("parsed", None, [("a\tb", 1), ("c\td e", 3)])
    assert files.parse("code", b"x\ny\n") == ("parsed", None, [("x\ny\n", 2)])
    assert files.parse("text", b"") == ("parsed", None, [])
    assert files.parse("text", b"\xff")[1] == "TEXT_DECODE_FAILED"
    assert files.parse("docx", b"no zip")[1] == "PARSER_WORKER_FAILED"
    assert files.parse("exe", b"x")[1] == "UNSUPPORTED_FILE_KIND"


def test_folder(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.txt": b"text", "d.bin": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    rows = files.read_files(spark, str(tmp_path)).collect()
    assert sorted((r.path.rpartition("/")[2], r.status, r.text) for r in rows if r.text) == [("a.docx", "parsed", "one two"), ("a.docx", "parsed", "three"), ("b.txt", "parsed", "text")]
    assert {r.status for r in rows if r.block_index is None} == {"unsupported"}


def test_signals_and_chunks(spark):
    signals = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, 9), (1, "c", 4, 6), (2, "d", 0, 1)], "input_id int, signal_id string, start int, end int")
    parts = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 10)], "input_id int, segment int, start int, end int")
    assert {(r.signal_id, r.segment) for r in inputs.signals_to_segments(signals, parts).collect()} == {("a", 0), ("b", 1), ("c", 0)}
    df = spark.createDataFrame([("short",), ("x" * 2000,), ("line " * 30 + "\n" + "y" * 900,)], "t string").select(inputs.chunks(F.col("t")).alias("c"))
    assert [[len(x) for x in r.c] for r in df.collect()] == [[5], [900, 440], [900, 271, 149, 900]]
    none = spark.createDataFrame([], "rule_id string, version int")
    assert inputs.rule_set_version(none).first().version == "filter-rules:none"


def test_batches_of_files_are_bounded(spark):
    """No batch that goes to a worker or comes back grows with the rows of a partition."""
    import pyarrow as pa

    rows = [(str(k), "text", bytearray(b"x" * (1 << 20))) for k in range(16)]
    out = files.parsed(spark.createDataFrame(rows, "path string, kind string, content binary").coalesce(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    sizes = out.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert out.count() == 16 and sum(r["n"] for r in sizes.collect()) == 16
    assert max(r["n"] for r in sizes.collect()) <= 9
