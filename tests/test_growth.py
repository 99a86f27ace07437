"""What a task holds or does must not grow by the planner's guesses."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from defectlake import scale, schemas
from defectlake.operators import enrich, roles
from defectlake.sources import heap_text, reports


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_sends_no_lines_to_all_tasks(spark):
    fixes = spark.createDataFrame([("a", "free(q);\nlog(q);"), ("b", "x = malloc(1);\nfree(x);"), ("c", None)], "fix_id STRING, replace_text STRING")
    out = roles.audit_fix_safety(fixes)
    assert "Broadcast" not in physical(out)
    got = {r.fix_id: r.warning for r in out.collect()}
    assert got == {
        "a": "Use-after-free: 'q' freed on line 1 but used on line 2",
        "b": "Useless allocation: 'x' freed immediately after malloc", "c": None,
    }


def test_heap_sites_cut_lines_once(spark):
    text = "3 calls with 2.5K peak consumption from:\r\n  leaf\r\n    at /s.c:1\n  \tother \x0b\n\n"
    profiles = spark.createDataFrame([("p", text)], "scan_id STRING, output STRING").repartition(1)
    out = heap_text.ingest_heap_sites(profiles)
    assert plan(out).count("locate(") == 1
    row = out.first()
    assert (row.function, row.file, row.line, row.peak_bytes, list(row.stack)) == ("leaf", "s.c", 1, 2560, ["leaf", "other"])


def test_reports_go_to_tasks_by_size(spark, monkeypatch):
    monkeypatch.setattr(scale, "SPREAD_BYTES", 1000)
    df = spark.range(10_000)
    assert scale.spread(df).rdd.getNumPartitions() == 80


def test_dedup_in_report_makes_only_asked_columns(spark):
    error = "<error><kind>Race</kind><what>w</what><stack><frame><fn>f</fn><file>a.c</file><line>3</line></frame></stack></error>"
    raw = spark.createDataFrame([("s", 1, "helgrind", f"<valgrindoutput>{error}{error}</valgrindoutput>")], "scan_id STRING, report_id BIGINT, tool STRING, output STRING")
    out = reports.ingest_helgrind(raw).select("scan_id", "ord", "severity")
    assert plan(out).count("sha2(") == 1
    assert [tuple(r) for r in out.collect()] == [("s", reports.REPORT_SPAN, "critical")]


def test_whole_files_are_moved_once_for_their_findings(spark, monkeypatch):
    """Contexts cut from a file's row equal those of blocks of lines, and no lines are stored or moved again for them."""
    rng = random.Random(3)
    kinds = ["int f(int n) {", "def g(x):", "  if (n) {", "  }", "}", "  call(n);", "", "x = 1"]
    lines = [("s", f, n, rng.choice(kinds)) for f, size in (("a.c", 300), ("b.py", 90), ("c.c", 3)) for n in range(1, size + 1) if n % 41]
    lines = spark.createDataFrame(lines, "scan_id STRING, file STRING, line_no INT, text STRING")
    at = [(f, rng.randrange(0, size), rng.choice(["c", "python", None])) for f, size in (("a.c", 310), ("b.py", 99), ("c.c", 30), ("none", 9)) for _ in range(25)]
    found = spark.createDataFrame([("s", i, *x) for i, x in enumerate([*at, (None, 3, "c"), ("a.c", None, "c")])], "scan_id STRING, ord BIGINT, f STRING, n INT, language STRING")
    found = found.select("scan_id", "ord", "language", schemas.location(F.col("f"), F.col("n")).alias("primary_location"))
    stored, run = [], scale.materialise
    monkeypatch.setattr(scale, "materialise", lambda df, label: stored.append(label) or run(df, label))
    whole = enrich.attach_source_context(found, lines)
    assert set(stored) <= {"heavy"} and physical(whole).count("Exchange hashpartitioning") <= 4
    blocks = enrich.attach_source_context(found, lines, full_file_lines=10**6)
    got, want = ({r.ord: r.source_context for r in df.collect()} for df in (whole, blocks))
    assert got == want and sum(c is not None and c.function_body is not None for c in got.values()) > 20
