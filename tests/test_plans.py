"""What plans must not do: work a detector out again only to test for emptiness."""

import io
import contextlib

from sievegate import catalog


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_detector_in_a_filter(spark, sf_dir):
    for name in ("dryrun_documents", "pii_union_sorted", "rules_in_order", "signal_ids", "signals_mapped"):
        plan = optimised(catalog.queries()[name](spark, sf_dir))
        assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter") and "regexp_extract_all" in line], name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        catalog.queries()["detect_email_counts"](spark, sf_dir).explain("formatted")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in out.getvalue()
