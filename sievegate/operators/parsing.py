"""Parser plans as rows, and their execution with fallbacks in rounds.

A profile is a parser deployment: what its adapters can do (``capabilities``), its switches (``profiles``), the capabilities that
its licence denies. Which plan a file gets depends on its profile and kind alone, so plans are resolved for these pairs, a small
table, and files are joined with it. Execution is bulk-synchronous: a table holds where each file stands; a round runs the next
step of every file that has not ended, joins outcomes with the routes of fallbacks, and moves on. There are as many rounds as the
longest plan has steps, with fallbacks; between rounds the table is written to the shared folder.

Nulls: a null requirement or kind is unsupported; a file of an unknown profile has no adapters. Files that repeat a key are run each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegate.functions.tables import cut

# The steps of each plan (step id, kind, mode), and the routes of its fallbacks (id, source, trigger, target).
ALWAYS, FALLBACK = "always", "fallback"
STEPS = {
    "wrap_text": [("wrap-text", "wrap_text", ALWAYS)],
    "native_text": [("native-text", "native_text_extract", ALWAYS)],
    "pdf_native_ocr": [("pdf-native-ocr", "pdf_native_ocr", ALWAYS)],
    "pdf_native": [("pdf-native", "pdf_native_text_extract", ALWAYS)],
    "pdf_native_then_page_ocr": [
        ("pdf-native", "pdf_native_text_extract", ALWAYS),
        ("pdf-coverage", "pdf_coverage_evaluate", ALWAYS),
        ("pdf-render", "render_ocr_candidate_pages", ALWAYS),
        ("ocr-primary", "ocr_primary", ALWAYS),
        ("ocr-fallback", "ocr_fallback", FALLBACK),
        ("merge-blocks", "merge_blocks", ALWAYS),
    ],
    "image_ocr": [("image-ocr-primary", "image_ocr", ALWAYS), ("image-ocr-fallback", "ocr_fallback", FALLBACK)],
    "office_parse": [("office-parse", "office_parse", ALWAYS)],
    "spreadsheet_parse": [("spreadsheet-parse", "spreadsheet_parse", ALWAYS)],
    "slide_parse": [("slide-parse", "slide_parse", ALWAYS)],
    "code_parse": [("code-parse", "code_parse", ALWAYS)],
}
ROUTES = {
    "pdf_native_then_page_ocr": [("ocr-unavailable", "ocr-primary", "adapter_unavailable", "ocr-fallback"), ("ocr-init-failed", "ocr-primary", "adapter_initialization_failed", "ocr-fallback")],
    "image_ocr": [("image-ocr-unavailable", "image-ocr-primary", "adapter_unavailable", "image-ocr-fallback"), ("image-ocr-init-failed", "image-ocr-primary", "adapter_initialization_failed", "image-ocr-fallback")],
}
PLAN_OF_KIND = {"plain_text": "native_text", "pdf": "pdf_native_then_page_ocr", "image": "image_ocr", "office_document": "office_parse", "spreadsheet": "spreadsheet_parse", "slide": "slide_parse", "code": "code_parse"}
EMPTY_PLANS = ["metadata_only", "unsupported"]
OCR_STATUSES = ["text_found", "no_text_detected", "timeout", "failed"]

RESULT = "struct<status:string,trigger:string,failure:string,document:string,ocr_status:string>"


def plan_steps(spark: SparkSession) -> DataFrame:
    rows = [(plan, n, *step) for plan, steps in STEPS.items() for n, step in enumerate(steps)]
    return spark.createDataFrame(rows, "plan_kind string, ordinal int, step_id string, step_kind string, mode string")


def plan_routes(spark: SparkSession) -> DataFrame:
    rows = [(plan, n, *route) for plan, routes in ROUTES.items() for n, route in enumerate(routes)]
    return spark.createDataFrame(rows, "plan_kind string, ordinal int, rule_id string, source string, trigger string, target string")


def wanted_plan(requirement: Column, file_kind: Column) -> Column:
    """The plan that a file asks for, before anything is known of its profile."""
    by_kind = F.coalesce(*[F.when(file_kind == k, plan) for k, plan in PLAN_OF_KIND.items()], F.lit("unsupported"))
    return F.when(requirement == "metadata_only", "metadata_only").when(requirement.isNull() | requirement.isin("unsupported", "not_applicable"), "unsupported").when(requirement == "wrap_text", "wrap_text").otherwise(by_kind)


def resolutions(profiles: DataFrame, capabilities: DataFrame, denied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every (profile, wanted): the plan_kind or the failure; and the steps of every (profile, plan_kind), with their capability.
    profiles (profile, enable_native, enable_ocr), capabilities (profile, place, capability_id, step_kind, enabled), of which the
    last enabled one of a step kind counts, denied (profile, capability_id)."""
    can = capabilities.where("enabled").groupBy("profile", "step_kind").agg(F.max_by("capability_id", "place").alias("capability_id"))
    no = denied.select("profile", "capability_id", F.lit(True).alias("denied")).distinct()
    fixed = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("plan_kind", "ordinal", "step_id", "step_kind", "mode"), (plan, n, *step), strict=True)]) for plan, of in STEPS.items() for n, step in enumerate(of)]
    steps = profiles.select("*", F.explode(F.array(*fixed)).alias("_s")).select(*profiles.columns, "_s.*").join(can, ["profile", "step_kind"], "left").join(no, ["profile", "capability_id"], "left")
    lacking = F.when(F.col("capability_id").isNull(), "UNSUPPORTED_FILE_KIND").when(F.coalesce("denied", F.lit(False)), "LICENSE_POLICY_VIOLATION")
    state = steps.groupBy("profile", "enable_native", "enable_ocr", "plan_kind").agg(F.bool_and(F.col("capability_id").isNotNull()).alias("complete"), F.min_by(lacking, F.when(lacking.isNotNull(), F.col("ordinal"))).alias("lack"))
    complete = lambda plan: F.max(F.when(F.col("plan_kind") == plan, F.col("complete")))
    pdf = state.groupBy("profile").agg(complete("pdf_native_ocr").alias("both"), complete("pdf_native").alias("native"), complete("pdf_native_then_page_ocr").alias("all"))
    wanted = profiles.withColumn("wanted", F.explode(F.array(*map(F.lit, STEPS)))).join(pdf, "profile")
    degraded = F.when(F.col("both"), "pdf_native_ocr").when(F.col("native") & (~F.col("enable_ocr") | ~F.col("all")), "pdf_native").otherwise(F.col("wanted"))
    chosen = wanted.select("profile", "wanted", F.when(F.col("wanted") == "pdf_native_then_page_ocr", degraded).otherwise(F.col("wanted")).alias("plan_kind"))
    off = F.when(~F.col("enable_native") & (F.col("plan_kind") != "image_ocr"), "PARSER_DISABLED").when(~F.col("enable_ocr") & F.col("plan_kind").isin("image_ocr", "pdf_native_then_page_ocr"), "OCR_DISABLED")
    plans = chosen.join(state, ["profile", "plan_kind"]).select("profile", "wanted", "plan_kind", F.coalesce(off, "lack").alias("failure"))
    return plans, steps.select("profile", "plan_kind", "ordinal", "step_id", "step_kind", "mode", "capability_id")


def resolve(files: DataFrame, profiles: DataFrame, capabilities: DataFrame, denied: DataFrame) -> DataFrame:
    """files (profile, requirement, file_kind, and more columns) with wanted, plan_kind (null where it fails) and failure."""
    plans, _ = resolutions(profiles, capabilities, denied)
    out = files.withColumn("wanted", wanted_plan(F.col("requirement"), F.col("file_kind"))).join(plans, ["profile", "wanted"], "left")
    empty = F.col("wanted").isin(EMPTY_PLANS)
    failure = F.when(~empty, F.when(F.col("plan_kind").isNull(), "UNSUPPORTED_FILE_KIND").otherwise(F.col("failure")))
    return out.withColumn("failure", failure).withColumn("plan_kind", F.when(empty, F.col("wanted")).when(F.col("failure").isNull(), F.col("plan_kind")))


def plan_violations(plans: DataFrame, steps: DataFrame, routes: DataFrame) -> DataFrame:
    """plan_id, violations (array, in the order of the checks) of plans (plan_id, plan_kind), their steps (plan_id, place, ordinal,
    step_id, mode) and routes (plan_id, place, ordinal, source, trigger, target). place: the order in which they are listed."""
    s = steps.groupBy("plan_id").agg(F.count("*").alias("n_steps"), F.bool_or(~F.col("ordinal").eqNullSafe(F.col("place"))).alias("bad_steps"), (F.count_distinct("step_id") < F.count("*")).alias("repeated"))
    known = steps.groupBy("plan_id", "step_id").agg(F.max_by("mode", "place").alias("mode"))
    of = lambda name: known.select("plan_id", F.col("step_id").alias(name), F.col("mode").alias(f"{name}_mode"))
    joined = routes.join(of("source"), ["plan_id", "source"], "left").join(of("target"), ["plan_id", "target"], "left")
    per_route = joined.groupBy("plan_id", "source", "trigger").agg(
        F.count("*").alias("n"), F.bool_or(~F.col("ordinal").eqNullSafe(F.col("place"))).alias("bad_order"),
        F.bool_or(F.col("source_mode").isNull() | (F.col("source_mode") == FALLBACK)).alias("bad_source"), F.bool_or(F.col("target_mode").isNull() | (F.col("target_mode") != FALLBACK)).alias("bad_target"))
    r = per_route.groupBy("plan_id").agg(*[F.bool_or(c).alias(c) for c in ("bad_order", "bad_source", "bad_target")], F.bool_or(F.col("n") > 1).alias("repeated_route"))
    all_ = plans.join(s, "plan_id", "left").join(r, "plan_id", "left")
    checks = [F.when(F.col("n_steps").isNull() & ~F.col("plan_kind").isin(EMPTY_PLANS), "no_steps")]
    checks += [F.when(F.col(c), name) for c, name in (("bad_steps", "step_ordinals"), ("bad_order", "rule_ordinals"), ("repeated", "repeated_step_id"), ("bad_source", "fallback_source"), ("bad_target", "fallback_target"), ("repeated_route", "repeated_route"))]
    return all_.select("plan_id", F.array_compact(F.array(*checks)).alias("violations"))


def execute(resolved: DataFrame, steps: DataFrame, registry: DataFrame, run_step: Callable[[DataFrame], DataFrame], routes: DataFrame | None = None) -> DataFrame:
    """parser_status, ocr_status, failure, document of every row of resolved (with profile, plan_kind, failure), whose other columns
    stay.

    run_step gets the rows that are due with step_id, step_kind, capability_id, mode and the document so far, and adds ``result``
    (``RESULT``): status success, partial, skipped or failed, the trigger and failure of the latter, a document where the step makes
    one. registry (profile, capability_id, step_kind, enabled, license_allowed): a step whose adapter is unknown, off or not allowed
    ends its file with that failure and no document. steps as of resolutions()."""
    given = resolved.columns
    if clash := {"at", "target", "partial", "document", "ocr", "parser_status", "last", "result"} & set(given):
        raise ValueError(f"columns {sorted(clash)} are needed here")
    routes = plan_routes(resolved.sparkSession) if routes is None else routes
    first_route = routes.groupBy("plan_kind", F.col("source").alias("step_id"), "trigger").agg(F.min_by("target", "ordinal").alias("route"))
    ahead = Window.partitionBy("profile", "plan_kind").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)  # a plan's few steps
    after = F.min(F.when(F.col("mode") != FALLBACK, F.col("ordinal"))).over(ahead)
    steps = cut(steps.withColumn("next", after))
    starts = steps.where(F.col("mode") != FALLBACK).groupBy("profile", "plan_kind").agg(F.min("ordinal").alias("at"))
    allowed = registry.groupBy("profile", "capability_id", "step_kind").agg(F.max("enabled").alias("on"), F.max("license_allowed").alias("allowed"))
    text = lambda: F.lit(None).cast("string")
    state = resolved.join(starts, ["profile", "plan_kind"], "left").withColumns({"target": text(), "partial": F.lit(False), "last": text(), "document": text(), "ocr": text()})
    state = state.withColumn("parser_status", F.when(F.col("failure").isNotNull(), "failed").when(F.col("at").isNull(), "parsed"))
    ended = []
    while True:
        state = cut(state)
        ended.append(state.where("parser_status IS NOT NULL"))
        due = state.where("parser_status IS NULL")
        if due.isEmpty():
            break
        here = ["profile", "plan_kind"]
        ready = due.join(steps.withColumnRenamed("ordinal", "_ordinal"), here).where(F.when(F.col("target").isNull(), F.col("_ordinal") == F.col("at")).otherwise(F.col("step_id") == F.col("target")))
        ready = ready.join(allowed, ["profile", "capability_id", "step_kind"], "left")
        gate = F.when(F.col("allowed").isNull(), "UNSUPPORTED_FILE_KIND").when(~F.col("on"), "PARSER_DISABLED").when(~F.col("allowed"), "LICENSE_POLICY_VIOLATION")
        ready = ready.withColumn("_gate", gate)
        ran = run_step(ready.where("_gate IS NULL")).withColumn("result", F.col("result").cast(RESULT))
        ran = ran.unionByName(ready.where("_gate IS NOT NULL").withColumn("result", F.lit(None).cast(RESULT))).withColumn("trigger", F.col("result.trigger"))
        moved = ran.join(F.broadcast(first_route), ["plan_kind", "step_id", "trigger"], "left")  # the fixed table of routes
        r, failed = F.col("result"), F.col("result.status") == "failed"
        fallback = F.col("target").isNotNull()
        routed = failed & ~fallback & F.col("route").isNotNull()
        dead = failed & ~routed
        document, last = F.coalesce(r["document"], "document"), F.coalesce(r["failure"], "last")
        partial = F.col("partial") | (r["status"] == "partial") & ~fallback | fallback
        # a fallback goes on after the step that it stands in for
        step_after = F.when(fallback, F.col("_resume")).otherwise(F.col("next"))
        moved = moved.join(steps.select(*here, F.col("ordinal").alias("at"), F.col("next").alias("_resume")), [*here, "at"])
        over = F.when(F.col("_gate").isNotNull() | dead, "failed").when(~routed & step_after.isNull(), F.when(partial, "partial").otherwise("parsed"))
        failure = F.when(F.col("_gate").isNotNull(), F.col("_gate")).when(dead, F.coalesce(r["failure"], F.lit("PARSER_WORKER_FAILED"))).when((over == "partial"), last)
        state = moved.select(
            *[c for c in given if c != "failure"], failure.alias("failure"), F.when(routed, F.col("at")).otherwise(step_after).alias("at"), F.when(routed, F.col("route")).alias("target"),
            partial.alias("partial"), last.alias("last"), F.when(F.col("_gate").isNull(), document).alias("document"), F.when(r["document"].isNotNull(), r["ocr_status"]).otherwise(F.col("ocr")).alias("ocr"), over.alias("parser_status"))
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    ocr = F.when((F.col("parser_status") != "failed") & F.col("ocr").isin(OCR_STATUSES), F.col("ocr")).otherwise("not_applicable")
    return out.select(*[c for c in given if c != "failure"], "parser_status", ocr.alias("ocr_status"), "failure", "document")


def merged_blocks(native: DataFrame, pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """The blocks of each document in order of page, native text before recognised, block id: input_id, page, block_id, source_type,
    text, place (from 0). native (input_id, block_id, page, source_type, text), page null: last; pages (input_id, page,
    is_candidate, selected); recognised (input_id, page, rendered, status, texts) of the pages that were tried.

    Places are counted by page and added up over the pages, so no task sorts a whole document."""
    wanted = pages.where("is_candidate AND selected").select("input_id", "page").distinct()
    read = recognised.where("rendered AND coalesce(status, '') NOT IN ('timeout', 'failed')").join(wanted, ["input_id", "page"], "left_semi")
    found = read.select("input_id", "page", F.posexplode("texts").alias("n", "text")).where("coalesce(text, '') <> ''")
    block = F.concat(F.lit("pdf-ocr-page-"), "page", F.lit("-block-"), F.col("n") + 1)
    ocr = found.select("input_id", block.alias("block_id"), F.col("page").cast("int").alias("page"), F.lit("pdf_ocr_page").alias("source_type"), "text")
    rows = native.select("input_id", "block_id", F.col("page").cast("int").alias("page"), "source_type", "text").unionByName(ocr)
    rows = rows.withColumns({"_page": F.coalesce("page", F.lit(2**31 - 1)), "_origin": (~F.col("source_type").eqNullSafe(F.lit("pdf_native_page"))).cast("int")})
    within = F.row_number().over(Window.partitionBy("input_id", "_page").orderBy("_origin", "block_id"))
    before = F.sum("_n").over(Window.partitionBy("input_id").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("input_id", "_page").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    out = rows.withColumn("_within", within).join(counts, ["input_id", "_page"])
    return out.select("input_id", "page", "block_id", "source_type", "text", (F.col("_before") + F.col("_within") - 1).alias("place"))


def merged_status(documents: DataFrame, pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """input_id, parser_status, ocr_status, failure of documents (input_id, n_skipped: candidates over the limit of pages)."""
    tried = pages.where("is_candidate AND selected").select("input_id", "page").distinct().join(recognised, ["input_id", "page"], "left")
    bad = ~F.coalesce("rendered", F.lit(False))
    code = F.when(bad, "PDF_RENDER_FAILED").when(F.col("status") == "timeout", "OCR_TIMEOUT").when(F.col("status") == "failed", "OCR_FAILED")
    found = code.isNull() & F.exists(F.coalesce("texts", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    per = tried.groupBy("input_id").agg(F.min_by(code, F.when(code.isNotNull(), F.col("page"))).alias("code"), F.bool_or(found).alias("found"), F.bool_or(bad | F.coalesce(F.col("status") == "failed", F.lit(False))).alias("failed"))
    failure = F.when(F.col("n_skipped") > 0, "OCR_PAGE_LIMIT_EXCEEDED").otherwise(F.col("code"))
    ocr = F.when(F.col("found"), "text_found").when(F.col("failed"), "failed").when(F.col("failed").isNotNull(), "no_text_detected").otherwise("not_applicable")
    return documents.join(per, "input_id", "left").select("input_id", F.when(failure.isNotNull(), "partial").otherwise("parsed").alias("parser_status"), ocr.alias("ocr_status"), failure.alias("failure"))


def runtime_texts(blocks: DataFrame, key: str = "input_id", order: str = "place") -> DataFrame:
    """key, text of each document: its blocks that are not empty, in order, joined by line ends."""
    parts = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct(order, "text"))))
    return blocks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
