"""Plans and their execution against a plain run, file by file."""

import random

import pytest
from pyspark.sql import functions as F

from sievegate.operators import parsing

OUTCOMES = [("success", None, None), ("success", None, "NOTE"), ("partial", None, "P"), ("skipped", None, None), ("failed", "adapter_unavailable", "A"), ("failed", "adapter_initialization_failed", None), ("failed", "step_failed", "S"), ("failed", None, None)]


def plain(plan, outcome, gate):
    """(status, ocr, failure, document) of one file."""
    steps = parsing.STEPS.get(plan, [])
    document = ocr = last = None
    partial = False

    def run(step):
        nonlocal document, ocr, last
        status, trigger, failure, made, seen = outcome[step]
        if made:
            document, ocr = made, seen
        last = failure or last
        return status, trigger, failure

    for step, _, mode in steps:
        if mode == "fallback":
            continue
        if gate.get(step):
            return "failed", "not_applicable", gate[step], None
        status, trigger, failure = run(step)
        partial = partial or status == "partial"
        if status != "failed":
            continue
        target = next((t for _, source, trig, t in parsing.ROUTES.get(plan, []) if (source, trig) == (step, trigger)), None)
        if target is None:
            return "failed", "not_applicable", failure or "PARSER_WORKER_FAILED", document
        if gate.get(target):
            return "failed", "not_applicable", gate[target], None
        status, _, failure = run(target)
        partial = True
        if status == "failed":
            return "failed", "not_applicable", failure or "PARSER_WORKER_FAILED", document
    shown = ocr if ocr in parsing.OCR_STATUSES else "not_applicable"
    return ("partial", shown, last, document) if partial else ("parsed", shown, None, document)


def test_execution_equals_a_plain_run(spark):
    rng = random.Random(4)
    capabilities = [(0, n, f"c{n}", kind, True, True) for n, kind in enumerate(dict.fromkeys(k for s in parsing.STEPS.values() for _, k, _ in s))]
    gates = {"code_parse": (True, False, "LICENSE_POLICY_VIOLATION"), "slide_parse": (False, True, "PARSER_DISABLED"), "spreadsheet_parse": (None, None, "UNSUPPORTED_FILE_KIND")}
    registry = [(p, c, k, *(gates[k][:2] if k in gates else (True, True))) for p, _, c, k, *_ in capabilities if k != "spreadsheet_parse"]
    step_gate = {step: gates[kind][2] for s in parsing.STEPS.values() for step, kind, _ in s if kind in gates}
    plans = [*parsing.STEPS, "pdf_native_then_page_ocr", "pdf_native_then_page_ocr", "image_ocr", "unsupported"]
    files, outcomes, want = [], [], {}
    for k in range(400):
        plan = rng.choice(plans)
        outcome = {step: (*rng.choice(OUTCOMES), rng.choice([None, f"{k}-{step}"]), rng.choice(["text_found", "timeout", "odd", None])) for step, *_ in parsing.STEPS.get(plan, [])}
        files.append((k, 0, plan, None))
        outcomes += [(k, step, *o) for step, o in outcome.items()]
        want[k] = plain(plan, outcome, step_gate)
    files.append((400, 0, None, "OCR_DISABLED"))
    want[400] = ("failed", "not_applicable", "OCR_DISABLED", None)
    resolved = spark.createDataFrame(files, "k int, profile int, plan_kind string, failure string")
    steps = parsing.resolutions(*(spark.createDataFrame(rows, schema) for rows, schema in (
        ([(0, True, True)], "profile int, enable_native boolean, enable_ocr boolean"),
        ([c[:5] for c in capabilities], "profile int, place int, capability_id string, step_kind string, enabled boolean"),
        ([], "profile int, capability_id string"))))[1]
    of = spark.createDataFrame(outcomes, "k int, step_id string, status string, trigger string, failure string, document string, ocr_status string")
    result = of.select("k", "step_id", F.struct("status", "trigger", "failure", "document", "ocr_status").alias("result"))
    got = parsing.execute(resolved, steps, spark.createDataFrame(registry, "profile int, capability_id string, step_kind string, enabled boolean, license_allowed boolean"), lambda due: due.join(result, ["k", "step_id"]))
    assert {r["k"]: (r["parser_status"], r["ocr_status"], r["failure"], r["document"]) for r in got.collect()} == want


PROFILES = "profile int, enable_native boolean, enable_ocr boolean"
CAPS = "profile int, place int, capability_id string, step_kind string, enabled boolean"


@pytest.mark.parametrize(
    ("switches", "lacks", "denied", "want"),
    [
        ((True, True), ["pdf_native_ocr"], [], {"pdf": "pdf_native_then_page_ocr", "image": "image_ocr", "code": "code_parse", "unknown": "unsupported", None: "unsupported"}),
        ((True, True), [], [], {"pdf": "pdf_native_ocr"}),
        ((True, True), ["pdf_native_ocr", "ocr_fallback"], [], {"pdf": "pdf_native", "image": "UNSUPPORTED_FILE_KIND"}),
        ((True, False), ["pdf_native_ocr"], [], {"pdf": "pdf_native", "image": "OCR_DISABLED"}),
        ((False, True), ["pdf_native_ocr"], [], {"pdf": "PARSER_DISABLED", "image": "image_ocr", "code": "PARSER_DISABLED"}),
        ((True, False), ["pdf_native_ocr", "pdf_native_text_extract"], [], {"pdf": "OCR_DISABLED"}),
        ((True, True), [], ["code_parse", "ocr_fallback"], {"code": "LICENSE_POLICY_VIOLATION", "image": "LICENSE_POLICY_VIOLATION", "slide": "slide_parse"}),
        ((True, True), ["image_ocr"], ["image_ocr", "ocr_fallback"], {"image": "UNSUPPORTED_FILE_KIND"}),
    ],
)
def test_resolution(spark, switches, lacks, denied, want):
    kinds = [k for k in dict.fromkeys(k for s in parsing.STEPS.values() for _, k, _ in s) if k not in lacks]
    caps = [(0, n, f"cap-{k}", k, True) for n, k in enumerate(kinds)] + [(0, 100 + n, f"off-{k}", k, False) for n, k in enumerate(kinds + lacks)]
    files = spark.createDataFrame([(k, 0, "native_parse") for k in want] + [("meta", 0, "metadata_only"), ("wrapped", 0, "wrap_text")], "file_kind string, profile int, requirement string")
    out = parsing.resolve(files, spark.createDataFrame([(0, *switches)], PROFILES), spark.createDataFrame(caps, CAPS), spark.createDataFrame([(0, f"cap-{k}") for k in denied], "profile int, capability_id string"))
    got = {r["file_kind"]: r["failure"] or r["plan_kind"] for r in out.collect()}
    assert got.pop("meta") == "metadata_only" and got.pop("wrapped") == ("wrap_text" if switches[0] else "PARSER_DISABLED")
    assert got == want


def test_the_last_enabled_capability_of_a_kind_counts(spark):
    caps = [(0, 1, "first", "code_parse", True), (0, 2, "second", "code_parse", True), (0, 3, "third", "code_parse", False)]
    _, steps = parsing.resolutions(spark.createDataFrame([(0, True, True)], PROFILES), spark.createDataFrame(caps, CAPS), spark.createDataFrame([], "profile int, capability_id string"))
    assert [r["capability_id"] for r in steps.where("plan_kind = 'code_parse'").collect()] == ["second"]


def test_a_page_without_rows_and_blocks_without_page(spark):
    native = spark.createDataFrame([(1, "b2", None, "pdf_native_page", "last"), (1, "b1", 2, "pdf_native_page", "two"), (1, "b0", 2, "other", "two too")], "input_id int, block_id string, page int, source_type string, text string")
    pages = spark.createDataFrame([(1, 2, True, True), (1, 3, True, True), (1, 4, True, False), (2, 1, True, True)], "input_id int, page int, is_candidate boolean, selected boolean")
    read = spark.createDataFrame([(1, 2, True, "ok", ["", "a", None]), (1, 4, True, "ok", ["never"]), (2, 1, True, "timeout", ["late"])], "input_id int, page int, rendered boolean, status string, texts array<string>")
    got = [(r["block_id"], r["place"]) for r in parsing.merged_blocks(native, pages, read).orderBy("place").collect()]
    assert got == [("b1", 0), ("b0", 1), ("pdf-ocr-page-2-block-2", 2), ("b2", 3)]
    documents = spark.createDataFrame([(1, 0), (2, 0), (3, 2)], "input_id int, n_skipped int")
    status = {r[0]: tuple(r[1:]) for r in parsing.merged_status(documents, pages, read).collect()}
    assert status == {1: ("partial", "text_found", "PDF_RENDER_FAILED"), 2: ("partial", "no_text_detected", "OCR_TIMEOUT"), 3: ("partial", "not_applicable", "OCR_PAGE_LIMIT_EXCEEDED")}
