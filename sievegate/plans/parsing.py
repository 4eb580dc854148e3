"""Queries over parser plans, their execution and merged pages, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.operators import parsing
from sievegate.operators.parsing import FALLBACK, ROUTES, STEPS
from sievegate.sources import views

KINDS = ["plain_text", "image", "pdf", "office_document", "spreadsheet", "slide", "code", "unknown", "pdf", "image", "movie"]
REQUIREMENTS = ["native_parse", "ocr_required", "native_parse_then_ocr_fallback", "native_parse", "wrap_text", "native_parse", "metadata_only", "unsupported", "native_parse"]
STEP_KINDS = list(dict.fromkeys(kind for steps in STEPS.values() for _, kind, _ in steps))
OUTCOMES = [("partial", None, None), ("failed", "adapter_unavailable", "OCR_OFF"), ("failed", "adapter_initialization_failed", None), ("failed", "step_failed", "STEP_FAILED"), ("skipped", None, None)]
ROUND = 17
OCR = ["text_found", "no_text_detected", "odd", "failed"]


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _files(spark, d):
    """Documents and pages as files of all kinds, of 25 profiles."""
    docs = views.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("input_id"), F.col("doc_id").alias("n"))
    pages = views.table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("input_id"), (F.col("page_id") * 3 + 1).alias("n"))
    n = F.col("n")
    return docs.unionByName(pages).select("input_id", "n", (n % 25).cast("int").alias("profile"), F.when(n % 29 != 3, _pick(KINDS, F.floor(n / 2))).alias("file_kind"), F.when(n % 31 != 5, _pick(REQUIREMENTS, F.floor(n / 3))).alias("requirement"))


def _profiles(spark, d):
    n = F.col("n_nationkey").cast("int")
    base = views.table(spark, d, "nation").select(n.alias("profile"))
    profiles = base.select("profile", (F.col("profile") % 5 != 4).alias("enable_native"), (F.col("profile") % 3 != 2).alias("enable_ocr"))
    kinds = base.select("profile", F.posexplode(F.array(*map(F.lit, STEP_KINDS))).alias("k", "step_kind"))
    x = F.col("profile") * 3 + F.col("k")
    cap = lambda tag: F.concat(F.lit(tag), "profile", F.lit("-"), "k")
    first = kinds.select("profile", F.col("k").alias("place"), cap("a").alias("capability_id"), "step_kind", (x % 11 != 3).alias("enabled"), (x % 37 != 6).alias("license_allowed"))
    second = kinds.where(x % 4 == 1).select("profile", (F.col("k") + 100).alias("place"), cap("b").alias("capability_id"), "step_kind", (x % 8 != 1).alias("enabled"), F.lit(True).alias("license_allowed"))
    denied = kinds.where(x % 17 == 5).select("profile", cap("a").alias("capability_id"))
    return profiles, first.unionByName(second), denied


def parser_plans(spark, d):
    """Every file with its plan or failure, and the capabilities of its steps in order."""
    profiles, capabilities, denied = _profiles(spark, d)
    _, steps = parsing.resolutions(profiles, capabilities, denied)
    listed = steps.groupBy("profile", "plan_kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "capability_id"))), lambda x: x["capability_id"]).alias("c"))  # six at most
    out = parsing.resolve(_files(spark, d), profiles, capabilities, denied).join(listed, ["profile", "plan_kind"], "left")
    return out.select("input_id", "plan_kind", "failure", F.array_join("c", ",").alias("capabilities"))


def _step_result(due):
    """A stand-in for adapters, whose outcomes depend on the file and the step alone."""
    ordinal = F.coalesce(*[F.when(F.col("step_id") == step, n) for steps in STEPS.values() for n, (step, *_) in enumerate(steps)])
    m = ((F.col("n") * 7 + ordinal * 5) % ROUND).cast("int")
    of = lambda i: F.coalesce(*[F.when(m == k, F.lit(o[i])) for k, o in enumerate(OUTCOMES) if o[i]], F.lit("success" if i == 0 else None))
    document = F.when(m % 3 != 2, F.concat("input_id", F.lit(":"), "step_id"))
    return due.withColumn("result", F.struct(of(0).alias("status"), of(1).alias("trigger"), of(2).alias("failure"), document.alias("document"), _pick(OCR, m).alias("ocr_status")))


def parser_runs(spark, d):
    """Every file after its plan was run, with fallbacks."""
    profiles, capabilities, denied = _profiles(spark, d)
    _, steps = parsing.resolutions(profiles, capabilities, denied)
    resolved = parsing.resolve(_files(spark, d), profiles, capabilities, denied)
    return parsing.execute(resolved, steps, capabilities, _step_result).select("input_id", "plan_kind", "parser_status", "ocr_status", "failure", "document")


def parser_plan_violations(spark, d):
    """Plans of all kinds, some of them spoiled, against the rules of plans."""
    e, k = F.col("plan_id"), F.col("k")
    plans = views.table(spark, d, "events").select(F.col("event_id").alias("plan_id"), views.k().alias("k"), _pick([*STEPS, "unsupported"], F.col("event_id")).alias("plan_kind"))
    steps = plans.where(k % 10 != 3).join(F.broadcast(parsing.plan_steps(spark)), "plan_kind")  # the fixed table of steps
    place = F.col("ordinal")
    steps = steps.select("plan_id", place.alias("place"), F.when(k % 10 == 1, place * 2).otherwise(place).alias("ordinal"), F.when(k % 10 == 2, "ocr-primary").otherwise(F.col("step_id")).alias("step_id"), F.when((k % 10 == 4) & (place == 3), FALLBACK).otherwise(F.col("mode")).alias("mode"))
    routes = plans.join(F.broadcast(parsing.plan_routes(spark)), "plan_kind")
    routes = routes.select("plan_id", place.alias("place"), F.when(k % 10 == 5, place + 1).otherwise(place).alias("ordinal"), F.when(k % 10 == 6, "nobody").otherwise(F.col("source")).alias("source"), F.when(k % 10 == 7, "step_failed").otherwise(F.col("trigger")).alias("trigger"), F.when((k % 10 == 8) & (e % 2 == 0), "merge-blocks").otherwise(F.col("target")).alias("target"))
    return parsing.plan_violations(plans, steps, routes).select("plan_id", F.array_join("violations", ",").alias("violations"))


def _pages(spark, d):
    p = F.col("page_id")
    rows = views.table(spark, d, "pages").select((p % 40).alias("input_id"), F.floor(p / 40).cast("int").alias("page"), p.alias("p"), F.coalesce("html", F.lit("")).alias("html"))
    p = F.col("p")
    native = rows.where(p % 5 != 0).select("input_id", F.concat(F.lit("pdf-native-"), "page").alias("block_id"), F.when(p % 23 != 4, F.col("page")).alias("page"), F.when(p % 19 == 2, "other").otherwise("pdf_native_page").alias("source_type"), F.substring("html", 1, 40).alias("text"))
    pages = rows.select("input_id", "page", (p % 3 == 0).alias("is_candidate"), (p % 4 != 0).alias("selected"))
    texts = F.array(F.substring("html", 10, 20), F.when(p % 7 == 3, "").otherwise(F.substring("html", 30, 20)), F.when(p % 8 == 1, F.lit(None)).otherwise(F.lit("x")))
    recognised = rows.select("input_id", "page", (p % 22 != 9).alias("rendered"), _pick(["ok", "ok", "timeout", "ok", "failed", "ok", "ok"], p).alias("status"), F.when(F.col("input_id") % 6 != 1, texts).otherwise(F.array(F.lit(""))).alias("texts"))
    documents = rows.groupBy("input_id").agg(F.sum((p % 50 == 49).cast("long")).alias("n_skipped"))
    return native, pages, recognised, documents


def ocr_merged_blocks(spark, d):
    native, pages, recognised, _ = _pages(spark, d)
    return parsing.merged_blocks(native, pages, recognised).select("input_id", "place", "page", "block_id", "source_type", F.sha2("text", 256).alias("text_sha256"))


def ocr_merged_status(spark, d):
    _, pages, recognised, documents = _pages(spark, d)
    return parsing.merged_status(documents, pages, recognised)


def merged_texts(spark, d):
    native, pages, recognised, _ = _pages(spark, d)
    out = parsing.runtime_texts(parsing.merged_blocks(native, pages, recognised))
    return out.select("input_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = [parser_plans, parser_runs, parser_plan_violations, ocr_merged_blocks, ocr_merged_status, merged_texts]


def _values(rows, columns):
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _listed(names):
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


_STEP_ROWS = _values([(plan, n, *step) for plan, steps in STEPS.items() for n, step in enumerate(steps)], "plan_kind, ordinal, step_id, step_kind, mode")
_ROUTE_ROWS = _values([(plan, n, *route) for plan, routes in ROUTES.items() for n, route in enumerate(routes)], "plan_kind, ordinal, rule_id, source, trig, target")
_RESOLVED = f"""steps AS (SELECT * FROM {_STEP_ROWS}),
files AS (SELECT input_id, n, n % 25 AS profile, CASE WHEN n % 29 <> 3 THEN {_listed(KINDS)}[(n // 2) % {len(KINDS)} + 1] END AS file_kind, CASE WHEN n % 31 <> 5 THEN {_listed(REQUIREMENTS)}[(n // 3) % {len(REQUIREMENTS)} + 1] END AS requirement
  FROM (SELECT 'd' || doc_id AS input_id, doc_id AS n FROM documents UNION ALL SELECT 'p' || page_id, page_id * 3 + 1 FROM pages)),
profiles AS (SELECT n_nationkey AS profile, n_nationkey % 5 <> 4 AS native, n_nationkey % 3 <> 2 AS ocr FROM nation),
kinds AS (SELECT profile, k, step_kind, profile * 3 + k AS x FROM profiles, {_values(list(enumerate(STEP_KINDS)), "k, step_kind")}),
caps AS (SELECT profile, k AS place, 'a' || profile || '-' || k AS cap, step_kind, x % 11 <> 3 AS enabled, x % 37 <> 6 AS allowed FROM kinds
  UNION ALL SELECT profile, k + 100, 'b' || profile || '-' || k, step_kind, x % 8 <> 1, true FROM kinds WHERE x % 4 = 1),
no AS (SELECT 'a' || profile || '-' || k AS cap FROM kinds WHERE x % 17 = 5),
can AS (SELECT profile, step_kind, arg_max(cap, place) AS cap FROM caps WHERE enabled GROUP BY ALL),
psteps AS MATERIALIZED (SELECT p.profile, s.*, can.cap FROM profiles p CROSS JOIN steps s LEFT JOIN can ON can.profile = p.profile AND can.step_kind = s.step_kind),
w AS (SELECT f.*, p.native, p.ocr, CASE WHEN requirement = 'metadata_only' THEN 'metadata_only' WHEN requirement IS NULL OR requirement IN ('unsupported', 'not_applicable') THEN 'unsupported' WHEN requirement = 'wrap_text' THEN 'wrap_text'
  ELSE coalesce(CASE file_kind WHEN 'plain_text' THEN 'native_text' WHEN 'pdf' THEN 'pdf_native_then_page_ocr' WHEN 'image' THEN 'image_ocr' WHEN 'office_document' THEN 'office_parse' WHEN 'spreadsheet' THEN 'spreadsheet_parse' WHEN 'slide' THEN 'slide_parse' WHEN 'code' THEN 'code_parse' END, 'unsupported') END AS wanted
  FROM files f JOIN profiles p USING (profile)),
g AS (SELECT w.*, CASE WHEN wanted <> 'pdf_native_then_page_ocr' THEN wanted
  WHEN EXISTS (SELECT 1 FROM can WHERE can.profile = w.profile AND step_kind = 'pdf_native_ocr') THEN 'pdf_native_ocr'
  WHEN EXISTS (SELECT 1 FROM can WHERE can.profile = w.profile AND step_kind = 'pdf_native_text_extract') AND (NOT ocr OR EXISTS (SELECT 1 FROM psteps s WHERE s.profile = w.profile AND s.plan_kind = wanted AND s.cap IS NULL)) THEN 'pdf_native' ELSE wanted END AS chosen FROM w),
r AS MATERIALIZED (SELECT input_id, n, profile, CASE WHEN chosen IN ('metadata_only', 'unsupported') THEN NULL WHEN NOT native AND chosen <> 'image_ocr' THEN 'PARSER_DISABLED' WHEN NOT ocr AND chosen IN ('image_ocr', 'pdf_native_then_page_ocr') THEN 'OCR_DISABLED'
  ELSE (SELECT arg_min(CASE WHEN s.cap IS NULL THEN 'UNSUPPORTED_FILE_KIND' ELSE 'LICENSE_POLICY_VIOLATION' END, s.ordinal) FROM psteps s WHERE s.profile = g.profile AND s.plan_kind = g.chosen AND (s.cap IS NULL OR s.cap IN (SELECT cap FROM no))) END AS failure, chosen FROM g)"""
_CASES = lambda i, rest: "CASE m " + " ".join(f"WHEN {k} THEN '{o[i]}'" for k, o in enumerate(OUTCOMES) if o[i]) + f" ELSE {rest} END"
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_OCR_PAGES = f"""rows_ AS (SELECT page_id % 40 AS input_id, CAST(page_id // 40 AS INTEGER) AS page, page_id AS p, coalesce(html, '') AS html FROM pages),
native AS (SELECT input_id, 'pdf-native-' || page AS block_id, CASE WHEN p % 23 <> 4 THEN page END AS page, CASE WHEN p % 19 = 2 THEN 'other' ELSE 'pdf_native_page' END AS source_type, substr(html, 1, 40) AS text FROM rows_ WHERE p % 5 <> 0),
tried AS (SELECT input_id, page, p % 22 <> 9 AS rendered, ['ok', 'ok', 'timeout', 'ok', 'failed', 'ok', 'ok'][p % 7 + 1] AS status,
  CASE WHEN input_id % 6 <> 1 THEN [substr(html, 10, 20), CASE WHEN p % 7 = 3 THEN '' ELSE substr(html, 30, 20) END, CASE WHEN p % 8 = 1 THEN NULL ELSE 'x' END] ELSE [''] END AS texts FROM rows_ WHERE p % 3 = 0 AND p % 4 <> 0),
found AS (SELECT input_id, page, i, texts[i] AS text FROM tried, LATERAL (SELECT unnest(generate_series(1, len(texts))) AS i) WHERE rendered AND status NOT IN ('timeout', 'failed') AND coalesce(texts[i], '') <> ''),
merged AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY coalesce(page, 2147483647), CASE WHEN source_type = 'pdf_native_page' THEN 0 ELSE 1 END, block_id) - 1 AS place
  FROM (SELECT input_id, page, block_id, source_type, text FROM native UNION ALL SELECT input_id, page, 'pdf-ocr-page-' || page || '-block-' || i, 'pdf_ocr_page', text FROM found))"""

SQL = {
    "parser_plans": f"""WITH {_RESOLVED}
SELECT input_id, CASE WHEN failure IS NULL THEN chosen END AS plan_kind, failure, CASE WHEN failure IS NULL THEN c.caps END AS capabilities
FROM r LEFT JOIN (SELECT profile, plan_kind, string_agg(cap, ',' ORDER BY ordinal) AS caps FROM psteps GROUP BY ALL) c ON c.profile = r.profile AND c.plan_kind = r.chosen""",
    "parser_runs": f"""WITH RECURSIVE {_RESOLVED},
routes AS (SELECT * FROM {_ROUTE_ROWS}),
walk AS (SELECT input_id, n, profile, chosen, CAST(0 AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS target, false AS partial, CAST(NULL AS VARCHAR) AS latest, CAST(NULL AS VARCHAR) AS document, CAST(NULL AS VARCHAR) AS seen, CAST(failure AS VARCHAR) AS failure,
    CASE WHEN failure IS NOT NULL THEN 'failed' WHEN chosen IN ('metadata_only', 'unsupported') THEN 'parsed' END AS status FROM r
  UNION ALL
  SELECT input_id, n, profile, chosen, CASE WHEN routed THEN pos ELSE nxt END, CASE WHEN routed THEN route END, was OR target IS NOT NULL, last_two, CASE WHEN gate IS NULL THEN document2 END, seen2,
    CASE WHEN gate IS NOT NULL THEN gate WHEN o = 'failed' AND NOT routed THEN coalesce(f, 'PARSER_WORKER_FAILED') WHEN NOT routed AND nxt IS NULL AND (was OR target IS NOT NULL) THEN last_two END,
    CASE WHEN gate IS NOT NULL OR (o = 'failed' AND NOT routed) THEN 'failed' WHEN NOT routed AND nxt IS NULL THEN CASE WHEN was OR target IS NOT NULL THEN 'partial' ELSE 'parsed' END END
  FROM (SELECT *, o = 'failed' AND target IS NULL AND route IS NOT NULL AS routed, partial OR (o = 'partial' AND target IS NULL) AS was, coalesce(f, latest) AS last_two, coalesce(made, document) AS document2, CASE WHEN made IS NOT NULL THEN {_listed(OCR)}[m % 4 + 1] ELSE seen END AS seen2,
    (SELECT min(a.ordinal) FROM steps a WHERE a.plan_kind = chosen AND a.mode = 'always' AND a.ordinal > pos) AS nxt
   FROM (SELECT *, {_CASES(0, "'success'")} AS o, {_CASES(2, "NULL")} AS f, CASE WHEN m % 3 <> 2 THEN input_id || ':' || step_id END AS made,
      (SELECT arg_min(q.target, q.ordinal) FROM routes q WHERE q.plan_kind = chosen AND q.source = step_id AND q.trig = {_CASES(1, "NULL")}) AS route
     FROM (SELECT k.*, s.step_id, (k.n * 7 + s.ordinal * 5) % {ROUND} AS m, CASE WHEN c.cap IS NULL THEN 'UNSUPPORTED_FILE_KIND' WHEN NOT c.enabled THEN 'PARSER_DISABLED' WHEN NOT c.allowed THEN 'LICENSE_POLICY_VIOLATION' END AS gate
      FROM walk k JOIN psteps s ON s.profile = k.profile AND s.plan_kind = k.chosen AND CASE WHEN k.target IS NULL THEN s.ordinal = k.pos ELSE s.step_id = k.target END
      LEFT JOIN caps c ON c.profile = k.profile AND c.cap = s.cap AND c.step_kind = s.step_kind WHERE k.status IS NULL))))
SELECT input_id, CASE WHEN r.failure IS NULL THEN chosen END AS plan_kind, status AS parser_status, CASE WHEN status <> 'failed' AND seen IN ('text_found', 'no_text_detected', 'timeout', 'failed') THEN seen ELSE 'not_applicable' END AS ocr_status, walk.failure, document
FROM walk JOIN (SELECT input_id, failure FROM r) r USING (input_id) WHERE status IS NOT NULL""",
    "parser_plan_violations": f"""WITH plans AS (SELECT event_id AS plan_id, {_K} AS k, {_listed([*STEPS, "unsupported"])}[event_id % {len(STEPS) + 1} + 1] AS plan_kind FROM events),
s AS (SELECT plan_id, ordinal AS place, CASE WHEN k % 10 = 1 THEN ordinal * 2 ELSE ordinal END AS ordinal, CASE WHEN k % 10 = 2 THEN 'ocr-primary' ELSE step_id END AS step_id, CASE WHEN k % 10 = 4 AND ordinal = 3 THEN 'fallback' ELSE mode END AS mode FROM plans JOIN {_STEP_ROWS} USING (plan_kind) WHERE k % 10 <> 3),
q AS (SELECT plan_id, ordinal AS place, CASE WHEN k % 10 = 5 THEN ordinal + 1 ELSE ordinal END AS ordinal, CASE WHEN k % 10 = 6 THEN 'nobody' ELSE source END AS source, CASE WHEN k % 10 = 7 THEN 'step_failed' ELSE trig END AS trig, CASE WHEN k % 10 = 8 AND plan_id % 2 = 0 THEN 'merge-blocks' ELSE target END AS target FROM plans JOIN {_ROUTE_ROWS} USING (plan_kind)),
l AS (SELECT plan_id, list({{'o': ordinal, 'i': step_id, 'm': mode}} ORDER BY place) AS s FROM s GROUP BY 1),
t AS (SELECT plan_id, list({{'o': ordinal, 's': source, 't': trig, 'g': target}} ORDER BY place) AS q FROM q GROUP BY 1)
SELECT plan_id, concat_ws(',', CASE WHEN s IS NULL AND plan_kind <> 'unsupported' THEN 'no_steps' END, CASE WHEN list_transform(s, lambda x: x.o) <> range(len(s)) THEN 'step_ordinals' END, CASE WHEN list_transform(q, lambda x: x.o) <> range(len(q)) THEN 'rule_ordinals' END,
  CASE WHEN list_unique(list_transform(s, lambda x: x.i)) < len(s) THEN 'repeated_step_id' END,
  CASE WHEN len(list_filter(q, lambda x: coalesce(list_filter(s, lambda y: y.i = x.s)[-1].m, 'fallback') = 'fallback')) > 0 THEN 'fallback_source' END,
  CASE WHEN len(list_filter(q, lambda x: coalesce(list_filter(s, lambda y: y.i = x.g)[-1].m, 'always') <> 'fallback')) > 0 THEN 'fallback_target' END,
  CASE WHEN list_unique(list_transform(q, lambda x: x.s || x.t)) < len(q) THEN 'repeated_route' END) AS violations
FROM plans LEFT JOIN l USING (plan_id) LEFT JOIN t USING (plan_id)""",
    "ocr_merged_blocks": f"WITH {_OCR_PAGES} SELECT input_id, place, page, block_id, source_type, sha256(text) AS text_sha256 FROM merged",
    "ocr_merged_status": f"""WITH {_OCR_PAGES},
c AS (SELECT input_id, page, rendered, status, CASE WHEN NOT rendered THEN 'PDF_RENDER_FAILED' WHEN status = 'timeout' THEN 'OCR_TIMEOUT' WHEN status = 'failed' THEN 'OCR_FAILED' END AS code FROM tried),
d AS (SELECT input_id, sum(CASE WHEN p % 50 = 49 THEN 1 ELSE 0 END) AS skipped FROM rows_ GROUP BY 1),
x AS (SELECT d.input_id, CASE WHEN skipped > 0 THEN 'OCR_PAGE_LIMIT_EXCEEDED' ELSE (SELECT arg_min(code, page) FROM c WHERE c.input_id = d.input_id AND code IS NOT NULL) END AS failure FROM d)
SELECT input_id, CASE WHEN failure IS NULL THEN 'parsed' ELSE 'partial' END AS parser_status, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.input_id = x.input_id) THEN 'text_found'
  WHEN EXISTS (SELECT 1 FROM c WHERE c.input_id = x.input_id AND (NOT rendered OR status = 'failed')) THEN 'failed' WHEN EXISTS (SELECT 1 FROM c WHERE c.input_id = x.input_id) THEN 'no_text_detected' ELSE 'not_applicable' END AS ocr_status, failure FROM x""",
    "merged_texts": f"""WITH {_OCR_PAGES}, x AS (SELECT input_id, coalesce(string_agg(text, chr(10) ORDER BY place) FILTER (coalesce(text, '') <> ''), '') AS text FROM merged GROUP BY 1)
SELECT input_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM x""",
}
