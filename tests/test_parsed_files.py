from sievegate.operators import parsed_files
from sievegate.plans import files as plans
from sievegate.plans.responses import CATALOGUE
from sievegate.sources import files

BLOCKS = "path string, kind string, status string, failure_code string, block_index int, text string, place int"


def test_texts_and_results(spark):
    rows = [
        ("a", "csv", "parsed", None, 1, "b@c.example.com", 2), ("a", "csv", "parsed", None, 0, "mail", 1), ("a", "csv", "parsed", None, 2, "", 3), ("a", "csv", "parsed", None, 10, "licensed", 11),
        ("p", "pptx", "partial", "X", 0, "licensed", 1), ("e", "text", "parsed", None, None, None, None), ("u", "pdf", "unsupported", "U", None, None, None), (None, "text", "parsed", None, 0, "licensed", 1),
    ]
    blocks = spark.createDataFrame(rows, BLOCKS)
    assert {r.path: r.text for r in parsed_files.runtime_texts(blocks).collect()} == {"a": "mail\nb@c.example.com\nlicensed"}
    got = {r.path: (r.status, r.n_blocks, r.content_scanned, r.decision_basis, r.n_matches, r.action) for r in parsed_files.file_results(blocks, CATALOGUE).collect()}
    assert got == {"a": ("parsed", 4, True, "detection", 3, "MASK"), "p": ("partial", 1, False, "content_unavailable", 0, "ALLOW"), "e": ("parsed", 0, True, "no_detection", 0, "ALLOW"), "u": ("unsupported", 0, False, "content_unavailable", 0, "ALLOW")}
    assert parsed_files.file_results(blocks.limit(0), CATALOGUE).collect() == []


def test_wrapped_texts(spark):
    rows = [("1", "text_wrapper", "t", None), ("2", "text_wrapper", "", None), ("3", "text_wrapper", None, None), ("4", "file", "t", None), ("5", "text_wrapper", "t", "f"), ("6", None, "t", None)]
    out = parsed_files.wrapped_texts(spark.createDataFrame(rows, "input_id string, kind string, text string, file_ref string"))
    assert {r.path: (r.status, r.text) for r in out.collect()} == {"1": ("parsed", "t"), "2": ("parsed", None), **{k: ("failed", None) for k in "3456"}}


def test_batches_of_many_blocks(spark):
    n = files.ROWS * 2 + 5
    df = spark.createDataFrame([("big", "csv", bytearray("\n".join(map(str, range(n))), "utf-8")), ("none", "text", None), ("odd", None, bytearray(b"x"))], "path string, kind string, content binary")
    rows = files.parsed(df.coalesce(1)).collect()
    assert [r.text for r in rows if r.path == "big"] == [str(k) for k in range(n)]
    assert {(r.path, r.status) for r in rows if r.block_index is None} == {("none", "parsed"), ("odd", "unsupported")}


def test_files_are_parsed_once(spark, sf_dir):
    df = plans.parsed_file_results(spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow run(path") == 1
