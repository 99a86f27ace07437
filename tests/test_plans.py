"""Shape of the physical plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from defectlake import catalog, schemas
from defectlake.catalog import derived as d
from defectlake.operators import enrich, findings as fo, relations, security

BAD_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "PythonMapInArrow")
#: queries that write intermediate tables or run a stream while they are built
EAGER = {n for n in catalog.queries() if n.startswith("stream")} | {"debounce_changes"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["match_cve", "correlate_exploitability", "find_taint_sources", "mark_duplicates", "diff_findings", "locate_fix", "attach_source_context", "resolve_frames"])
def test_only_equi_joins(spark, sf_dir, name):
    plan = _plan(catalog.queries()[name](spark, sf_dir))
    assert not any(bad in plan for bad in BAD_JOINS)


@pytest.mark.parametrize("name", ["attach_frame_snippets", "locate_fix", "function_context", "validate_role"])
def test_written_texts_are_not_broadcast(spark, sf_dir, name):
    """Their size is guessed from the file of keys they are made from, so the driver would have to hold them."""
    plan = _plan(catalog.queries()[name](spark, sf_dir))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_context_texts_are_made_once(spark, sf_dir):
    """A join of findings with their own texts makes the source context on both of its sides."""
    plan = _plan(catalog.queries()["function_context"](spark, sf_dir))
    assert "SortMergeJoin [ord" not in plan


def test_source_lines_are_met_in_blocks(spark):
    """Windows that cross blocks of lines, the file's start and its end are whole, and no place asks for single lines."""
    lines = spark.createDataFrame([("s", "a.c", n, f"line {n}") for n in range(1, 201)], "scan_id STRING, file STRING, line_no INT, text STRING")
    at = [1, 72, 79, 80, 81, 88, 160, 200, 205]
    found = spark.createDataFrame([("s", i, n) for i, n in enumerate(at)], "scan_id STRING, ord BIGINT, n INT").select(
        "scan_id", "ord", schemas.location(F.lit("a.c"), F.col("n")).alias("primary_location")
    )
    placed = enrich.attach_source_context(found, lines)
    assert not re.search(r"MergeJoin \[[^\]]*line_no", _plan(placed))
    got = {r["ord"]: r["source_context"] for r in placed.collect()}
    for i, n in enumerate(at):
        before, after = ([f"line {k}" for k in ks if k <= 200] for ks in (range(max(1, n - 8), n), range(n + 1, n + 9)))
        assert (got[i]["before_lines"], got[i]["after_lines"]) == (before, after)
        assert got[i]["target_line"] == (f"line {n}" if n <= 200 else "")


def test_roles_are_checked_on_functions_cut_out_once(spark, sf_dir):
    assert "MapInPandas" not in _plan(catalog.queries()["validate_role"](spark, sf_dir))


def test_only_new_findings_are_folded_whole(spark, sf_dir):
    plan = _plan(catalog.queries()["new_findings"](spark, sf_dir))
    assert plan.index("min_by") < plan.index("Join")


def test_relations_have_no_cross_join(spark, sf_dir):
    plan = _plan(relations.relate_findings(d.findings(spark, sf_dir)))
    assert not any(bad in plan for bad in BAD_JOINS)


@pytest.mark.parametrize("name", ["issue_table", "ingest_memcheck", "ingest_heap_sites", "ingest_sanitizer", "classify_lines", "scan_c_rules", "export_json"])
def test_python_only_where_functions_are_cut_out(spark, sf_dir, name):
    plan = _plan(catalog.queries()[name](spark, sf_dir))
    assert not any(node in plan for node in PYTHON)
    assert ("MapInPandas" in plan) == (name == "classify_lines")


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    found = d.findings(spark, sf_dir)
    plan = _plan(found.groupBy("scan_id").count())
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan


def test_dedupe_combines_before_its_only_shuffle(spark, sf_dir):
    plan = _plan(fo.dedupe_findings(d.findings(spark, sf_dir)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning")


def test_cap_prunes_before_the_shuffle(spark, sf_dir):
    plan = _plan(fo.cap_findings(d.findings(spark, sf_dir), 50))
    assert "WindowGroupLimit" in plan


def test_cves_broadcast_only_the_fixed_table(spark, sf_dir):
    plan = _plan(security.match_cve(d.findings(spark, sf_dir)))
    assert "BroadcastHashJoin" in plan
