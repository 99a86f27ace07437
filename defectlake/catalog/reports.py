"""Registered ingestion queries.

The given ``events`` are written out as report texts in each tool's format (one report per event,
so the text to parse grows with the table), read back by the parsers, and compared with SQL that
computes the expected findings straight from ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake.catalog import derived as d
from defectlake.catalog.registry import Registry
from defectlake.functions.text import clamp_confidence as clamp, format_bytes, lenient_json, parse_size
from defectlake.operators import enrich, stats
from defectlake.sources import heap_text, reports, scans

query = Registry()

SPAN = reports.REPORT_SPAN
_E = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
"""


def _events(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.floor(F.col("value") * 100).cast("bigint").alias("cents"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _report(events: DataFrame, tool: str, output: Column) -> DataFrame:
    return events.select(
        F.concat(F.lit("scan"), (F.col("user_id") % 7).cast("string")).alias("scan_id"),
        F.col("event_id").alias("report_id"),
        F.lit(tool).alias("tool"),
        output.alias("output"),
    )


def _pick(index: Column, *names: str) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def memcheck_reports(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = _pick(
        F.col("k") % 6,
        "Leak_DefinitelyLost", "InvalidRead", "InvalidWrite", "UninitValue", "MismatchedFree", "Weird",
    )
    frame = _text(
        "<frame><ip>0x10</ip><obj>/usr/lib/vgpreload.so</obj><fn>malloc</fn><file>vg_malloc.c</file><line>9</line></frame>",
        "<frame><ip>0x20</ip><fn>fn_", F.col("user_id") % 8, "</fn><file>src/m", F.col("user_id") % 4,
        ".c</file><line>", F.col("k") + 1, "</line></frame>",
    )
    sizes = F.when(
        F.col("event_id") % 2 == 0,
        _text("<leakedbytes>", F.col("cents"), "</leakedbytes><leakedblocks>3</leakedblocks>"),
    ).otherwise(F.lit(""))
    freed = F.when(F.col("k") % 12 == 1, F.lit("<auxwhat>Address is 0 bytes inside a block free'd</auxwhat>")).otherwise(F.lit(""))
    second = F.when(
        F.col("k") % 12 == 7,
        F.lit("<stack><frame><fn>free</fn></frame></stack><stack><frame><fn>calloc</fn></frame></stack>"),
    ).otherwise(F.lit(""))
    error = _text(
        "<error><kind>", kind, "</kind><xwhat><text>", F.col("cents"), " bytes in 2 blocks lost & gone</text>",
        sizes, "</xwhat><stack>", frame, "</stack>", freed, second, "</error>",
    )
    broken = F.when(F.col("k") == 99, F.lit("<oops")).otherwise(F.lit(""))
    return _report(e, "valgrind", _text("<valgrindoutput>", error, error, broken, "</valgrindoutput>"))


@query(
    _E
    + f"""SELECT 'scan' || user_id % 7 AS scan_id, event_id * {SPAN} AS ord,
  CASE WHEN k % 12 IN (1, 7) THEN 'use_after_free' ELSE CASE k % 6 WHEN 0 THEN 'memory_leak' WHEN 1 THEN 'buffer_overflow'
    WHEN 2 THEN 'buffer_overflow' WHEN 3 THEN 'uninit_read' WHEN 4 THEN 'invalid_free' ELSE 'unknown' END END AS bug_type,
  CASE k % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' WHEN 2 THEN 'critical' WHEN 4 THEN 'high' ELSE 'medium' END AS severity,
  cents || ' bytes in 2 blocks lost & gone' AS message, cents AS bytes_leaked,
  CAST(CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS alloc_count,
  'src/m' || user_id % 4 || '.c' AS file, CAST(k + 1 AS INTEGER) AS line,
  CASE WHEN k % 12 = 7 THEN 'free' END AS free_kind, CASE WHEN k % 12 = 7 THEN 'calloc' END AS alloc_function
FROM e WHERE k <> 99"""
)
def ingest_memcheck(spark, sf_dir):
    out = reports.ingest_memcheck(memcheck_reports(spark, sf_dir))
    return out.select(
        "scan_id", "ord", "bug_type", "severity", "message", "bytes_leaked", "alloc_count",
        "primary_location.file", "primary_location.line", F.col("free_info.kind").alias("free_kind"),
        F.get("allocation_info.stack", F.lit(0))["function"].alias("alloc_function"),
    )


def helgrind_reports(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = _pick(F.col("k") % 4, "Race", "LockOrder", "Misc", "Other")
    error = _text(
        "<error><kind>", kind, "</kind><what>data race on v", F.col("k"), "</what><auxwhat>lock held by #2</auxwhat>",
        "<stack><frame><fn>mutex_lock</fn><file>/usr/src/hg.c</file><line>5</line></frame>",
        "<frame><fn>fn_", F.col("user_id") % 8, "</fn><file>src/t.c</file><line>", F.col("k") + 1,
        "</line></frame></stack></error>",
    )
    return _report(e, "helgrind", _text("<valgrindoutput>", error, error, "</valgrindoutput>"))


@query(
    _E
    + f"""SELECT 'scan' || user_id % 7 AS scan_id, event_id * {SPAN} AS ord, 'race_condition' AS bug_type,
  CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity,
  'data race on v' || k AS message, 'lock held by #2' AS detail, 'src/t.c' AS file, CAST(k + 1 AS INTEGER) AS line FROM e"""
)
def ingest_helgrind(spark, sf_dir):
    return reports.ingest_helgrind(helgrind_reports(spark, sf_dir)).select(
        "scan_id", "ord", "bug_type", "severity", "message", "detail", "primary_location.file", "primary_location.line"
    )


def sanitizer_reports(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = _pick(
        F.col("k") % 8,
        "heap-buffer-overflow", "stack-buffer-overflow", "Heap-Use-After-Free", "double-free",
        "null-dereference", "stack-overflow", "global-buffer-overflow", "odd thing",
    )
    out = _text(
        "  \nERROR: AddressSanitizer: ", kind, " on address 0x1\n    #0 0x4a in fn_", F.col("user_id") % 8,
        " src/m.c:", F.col("k") + 1, ":7\n    #1 0x4b in main src/m.c:40\nWARNING: soft\n",
        "Direct leak of ", F.col("cents"), " byte(s) in 2 object(s) allocated from:\n#0 0x1 in make src/a.c:3\n#1 0x2 in main src/a.c:9\n",
    )
    return _report(e, "asan", out)


@query(
    _E
    + f"""SELECT 'scan' || user_id % 7 AS scan_id, event_id * {SPAN} + 1 AS ord,
  CASE k % 8 WHEN 0 THEN 'buffer_overflow' WHEN 1 THEN 'stack_overflow' WHEN 2 THEN 'use_after_free' WHEN 3 THEN 'double_free'
    WHEN 4 THEN 'null_deref' WHEN 5 THEN 'stack_overflow' WHEN 6 THEN 'buffer_overflow' ELSE 'unknown' END AS bug_type,
  CASE WHEN k % 8 = 7 THEN 'medium' ELSE 'critical' END AS severity, CAST(2 AS INTEGER) AS frames,
  'src/m.c' AS file, CAST(k + 1 AS INTEGER) AS line FROM e
UNION ALL SELECT 'scan' || user_id % 7, event_id * {SPAN} + 2, 'unknown', 'medium', 2, 'src/a.c', 3 FROM e"""
)
def ingest_sanitizer(spark, sf_dir):
    return reports.ingest_sanitizer(sanitizer_reports(spark, sf_dir)).select(
        "scan_id", "ord", "bug_type", "severity", F.size("stack").alias("frames"),
        "primary_location.file", "primary_location.line",
    )


@query(
    _E
    + f"""SELECT 'scan' || user_id % 7 AS scan_id, event_id * {SPAN} + {SPAN // 2} AS ord, 'lsan' AS tool,
  'Direct leak of ' || cents || ' bytes in 2 object(s)' AS message, cents AS bytes_leaked, CAST(2 AS BIGINT) AS alloc_count,
  'make' AS function FROM e"""
)
def ingest_lsan_leaks(spark, sf_dir):
    return reports.ingest_lsan_leaks(sanitizer_reports(spark, sf_dir)).select(
        "scan_id", "ord", "tool", "message", "bytes_leaked", "alloc_count", F.get("stack", F.lit(0))["function"].alias("function")
    )


def cppcheck_reports(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = _pick(F.col("k") % 5, "memleak", "doubleFree", "nullPointer", "useAfterFree", "styleThing")
    sev = _pick(F.col("user_id") % 4, "error", "warning", "style", "information")
    out = _text(
        '<results version="2"><errors><error id="', kind, '" severity="', sev, '" msg="msg ', F.col("k"),
        '"><location file="src/c.c" line="', F.col("k"), '" column="2"/></error></errors></results>',
    )
    return _report(e, "cppcheck", out)


@query(
    _E
    + f"""SELECT 'scan' || user_id % 7 AS scan_id, event_id * {SPAN} AS ord,
  CASE k % 5 WHEN 0 THEN 'memory_leak' WHEN 1 THEN 'double_free' WHEN 2 THEN 'null_deref' WHEN 3 THEN 'use_after_free' ELSE 'unknown' END AS bug_type,
  CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS severity,
  'msg ' || k AS message, CASE WHEN k > 0 THEN 'src/c.c' END AS file, CASE WHEN k > 0 THEN k END AS line FROM e"""
)
def ingest_cppcheck(spark, sf_dir):
    return reports.ingest_cppcheck(cppcheck_reports(spark, sf_dir)).select(
        "scan_id", "ord", "bug_type", "severity", "message", "primary_location.file", "primary_location.line"
    )


def infer_reports(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = _pick(F.col("k") % 5, "NULL_DEREFERENCE", "RESOURCE_LEAK_C", "BUFFER_OVERRUN_L3", "DEAD_STORE", "NEW_THING")
    issue = _text(
        '{"bug_type": "', kind, '", "qualifier": "', F.repeat(F.lit("x"), F.col("k") * 3), '", "procedure": "fn_',
        F.col("user_id") % 8, '", "file": "src/i.c", "line": ', F.col("k"),
        ', "column": 1, "bug_trace": [{"filename": "src/i.c", "line_number": ', F.col("k"),
        ', "column_number": 1, "procedure_name": "fn_', F.col("user_id") % 8, '"}]}',
    )
    whole = F.when(F.col("k") == 98, F.lit("[broken")).otherwise(_text("[", issue, ", ", issue, "]"))
    return _report(e, "infer", whole)


@query(
    _E
    + f""", m AS (SELECT *, '[Infer] ' || CASE k % 5 WHEN 0 THEN 'NULL_DEREFERENCE' WHEN 1 THEN 'RESOURCE_LEAK_C'
    WHEN 2 THEN 'BUFFER_OVERRUN_L3' ELSE 'NEW_THING' END || ': ' || repeat('x', k * 3) AS full_text FROM e WHERE k % 5 <> 3 AND k <> 98)
SELECT 'scan' || user_id % 7 AS scan_id, event_id * {SPAN} AS ord,
  CASE k % 5 WHEN 0 THEN 'null_deref' WHEN 1 THEN 'memory_leak' WHEN 2 THEN 'buffer_overflow' ELSE 'unknown' END AS bug_type,
  CASE k % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN length(full_text) > 200 THEN substr(full_text, 1, 197) || '...' ELSE full_text END AS message,
  'In function: fn_' || user_id % 8 AS detail, CASE WHEN k > 0 THEN 'src/i.c' END AS file FROM m"""
)
def ingest_infer(spark, sf_dir):
    return reports.ingest_infer(infer_reports(spark, sf_dir)).select(
        "scan_id", "ord", "bug_type", "severity", "message", "detail", "primary_location.file"
    )


def allocation_reports(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    record = _text(
        '{"size": ', F.col("cents") * 100, ', "count": ', F.col("k"), ', "traceback": [{"file": "app.py", "line": ',
        F.col("k") + 1, "}]}",
    )
    return _report(e, "tracemalloc", _text("[", F.array_join(F.array_repeat(record, 21), ", "), "]"))


@query(
    _E
    + f"""SELECT 'scan' || user_id % 7 AS scan_id, event_id * {SPAN} + i AS ord, 'python_large_object' AS bug_type,
  CASE WHEN cents * 100 > 1000000 THEN 'high' WHEN cents * 100 > 100000 THEN 'medium' ELSE 'low' END AS severity,
  'Large allocation: ' || format('{{:,}}', cents * 100) || ' bytes in ' || k || ' objects' AS message,
  cents * 100 AS bytes_leaked, CAST(k + 1 AS INTEGER) AS line FROM e, range(21) r(i)"""
)
def ingest_allocation_stats(spark, sf_dir):
    return reports.ingest_allocation_stats(allocation_reports(spark, sf_dir)).select(
        "scan_id", "ord", "bug_type", "severity", "message", "bytes_leaked", "primary_location.line"
    )


def mixed_reports(spark, sf_dir) -> DataFrame:
    """Reports of six tools and one unknown tool, chosen by event."""
    makers = (
        memcheck_reports, helgrind_reports, sanitizer_reports, cppcheck_reports, infer_reports, allocation_reports,
    )
    out = None
    for i, make in enumerate(makers):
        part = make(spark, sf_dir).where(F.col("report_id") % 7 == i)
        out = part if out is None else out.unionByName(part)
    other = _report(_events(spark, sf_dir), "miri", F.lit("text")).where(F.col("report_id") % 7 == 6)
    return out.unionByName(other)


def _mixed_sql() -> str:
    """The findings of the single formats, each of its share of the reports."""
    sanitizer, leak = "'asan' AS tool, bug_type, severity, NULL AS message", "tool, 'memory_leak', 'high', message"
    parts = [
        ("memcheck", 0, "'valgrind' AS tool, bug_type, severity, message"), ("helgrind", 1, "'helgrind' AS tool, bug_type, severity, message"),
        ("sanitizer", 2, sanitizer), ("lsan_leaks", 2, leak), ("cppcheck", 3, "'cppcheck' AS tool, bug_type, severity, message"),
        ("infer", 4, "'infer' AS tool, bug_type, severity, message"), ("allocation_stats", 5, "'tracemalloc' AS tool, bug_type, severity, message"),
    ]
    return " UNION ALL ".join(
        f"SELECT scan_id, ord, {columns} FROM ({query.oracle[f'ingest_{name}']}) WHERE (ord // {SPAN}) % 7 = {share}"
        for name, share, columns in parts
    )


@query(_mixed_sql())
def ingest_reports(spark, sf_dir):
    """Every finding of a mixed table (of sanitizer blocks without the message)."""
    found = reports.ingest_reports(mixed_reports(spark, sf_dir))
    said = F.when(F.col("tool") != "asan", F.col("message"))
    return found.select("scan_id", "ord", "tool", "bug_type", "severity", said.alias("message"))


@query(
    _E
    + """SELECT 'scan' || user_id % 7 AS scan_id, event_id AS report_id,
  CASE event_id % 7 WHEN 0 THEN 'malformed XML' WHEN 4 THEN 'malformed JSON' ELSE 'unknown tool' END AS reason
FROM e WHERE (event_id % 7 = 0 AND k = 99) OR (event_id % 7 = 4 AND k = 98) OR event_id % 7 = 6"""
)
def rejected_reports(spark, sf_dir):
    return reports.rejected_reports(mixed_reports(spark, sf_dir)).drop("tool")


@query(
    """SELECT doc_id, CAST(i AS INTEGER) AS line_no FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE contains(line, 'Open file descriptor') OR contains(line, 'FILE DESCRIPTORS') OR contains(lower(line), 'inherited')
  OR contains(lower(line), 'license')"""
)
def extract_fd_leaks(spark, sf_dir):
    """The marked lines of every document (license lines stand in as marked output lines)."""
    text = F.regexp_replace("text", "(?i)license", "inherited")
    outputs = d.table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("scan_id"), F.col("doc_id").alias("report_id"), text.alias("output")
    )
    return reports.extract_fd_leaks(outputs).select(F.col("report_id").alias("doc_id"), "line_no")


# -- heap profiler text -----------------------------------------------------------------------
def heap_profiles(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    out = _text(
        "total memory allocated: ", F.col("cents"), "K\n", "calls to allocation functions: ", F.col("k") + 5, "\n",
        "peak heap memory consumption: 1.5M\ntemporary allocations: ", F.col("k"), " (12.5%)\n",
        "\nMOST CALLS TO ALLOCATION\n",
        F.col("k") + 1, " calls to allocation functions with ", F.col("cents"), "B peak consumption from\n",
        "malloc\n  at /usr/lib/m.c:4\nfn_", F.col("user_id") % 8, "\n  at /home/u/src/h.c:", F.col("k") + 2,
        "\n  in /tmp/bin\nmain\n\n",
        F.col("k") + 3, " calls with 2.5K peak consumption from:\n    leaf\n      at /s.c:1\n    fn_", F.col("user_id") % 8,
        "\n    ns_long::inner\n\nPEAK HEAP things\n  at /home/late.c:7\n\n", "4.5K leaked\npeak heap memory consumption: 2K\n",
    )
    return e.select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("scan_id"), out.alias("output"))


@query(
    _E
    + """SELECT 'p' || event_id AS scan_id, CAST(2048 AS BIGINT) AS peak_heap_bytes, cents * 1024 AS total_bytes_allocated,
  CAST(greatest(k + 5, k + 1) AS BIGINT) AS total_allocations, CAST(k AS BIGINT) AS total_temporary,
  CAST(12.5 AS DOUBLE) AS total_temporary_pct, CAST(4608 AS BIGINT) AS leaked_bytes FROM e"""
)
def ingest_heap_summary(spark, sf_dir):
    return heap_text.ingest_heap_summary(heap_profiles(spark, sf_dir))


@query(
    _E
    + """SELECT 'p' || event_id AS scan_id, 'fn_' || user_id % 8 AS function, 'h.c' AS file, CAST(k + 2 AS INTEGER) AS line,
  CAST(k + 1 AS BIGINT) AS allocations, cents AS peak_bytes, 'malloc;fn_' || user_id % 8 || ';main' AS stack, FALSE AS is_subcall FROM e
UNION ALL SELECT 'p' || event_id, 'leaf', 's.c', 1, k + 3, 2560, 'leaf;fn_' || user_id % 8 || ';ns_long', TRUE FROM e"""
)
def ingest_heap_sites(spark, sf_dir):
    return heap_text.ingest_heap_sites(heap_profiles(spark, sf_dir)).select(
        "scan_id", "function", "file", "line", "allocations", "peak_bytes", F.array_join("stack", ";").alias("stack"), "is_subcall"
    )


@query(
    _E
    + """SELECT 'p' || event_id AS scan_id,
  'peak heap memory consumption: 2K;4.5K leaked;PEAK HEAP things;ns_long;fn_' || user_id % 8 || ';leaf' AS raw, CAST(2560 AS BIGINT) AS bytes FROM e"""
)
def ingest_flame_stacks(spark, sf_dir):
    out = heap_text.ingest_flame_stacks(heap_profiles(spark, sf_dir))
    return out.select("scan_id", F.col("stack").alias("raw"), "bytes")


# -- stored scans, summaries, recordings ------------------------------------------------------
@query("SELECT min(concat('scan', user_id)) AS scan_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE concat('scan', user_id) = (SELECT min(concat('scan', user_id)) FROM events WHERE starts_with(concat('scan', user_id), 'scan1'))")
def load_scan(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events").select(F.concat(F.lit("scan"), F.col("user_id").cast("string")).alias("scan_id"))
    return scans.load_scan(rows, "scan1").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'role_' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'Allocator' ELSE 'Deallocator' END AS role,
  CASE WHEN p_size % 2 = 0 THEN 'return' ELSE 'arg0' END AS target, p_size % 3 <> 0 AS validated,
  CASE WHEN p_size % 5 = 0 THEN 0.7 ELSE 0.25 END::DOUBLE AS confidence FROM part"""
)
def read_role_summaries(spark, sf_dir):
    part = d.table(spark, sf_dir, "part")
    size = F.col("p_size")
    doc = _text(
        '{"hints": {"role_', F.col("p_partkey"), '": [{"role": "', _pick(size % 2, "Allocator", "Deallocator"),
        '", "target": "', _pick(size % 2, "return", "arg0"), '"',
        F.when(size % 3 == 0, F.lit(', "validated": false')).otherwise(F.lit("")),
        F.when(size % 5 == 0, F.lit("")).otherwise(F.lit(', "confidence": 0.25')), "}]}}",
    )
    return scans.read_role_summaries(part.select(doc.alias("value")))


@query(
    """SELECT 'r' || s_suppkey AS recording_id, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 'bin/app' || s_nationkey END, '??') AS binary,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END AS BIGINT) AS duration_ms, 'rr' AS tool FROM supplier"""
)
def list_recordings(spark, sf_dir):
    out = scans.list_recordings(recordings(spark, sf_dir))
    return out.select("recording_id", "binary", "duration_ms", "tool")


def recordings(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    return d.table(spark, sf_dir, "supplier").select(
        _text("r", key).alias("recording_id"),
        F.when(key % 3 > 0, _text("bin/app", F.col("s_nationkey"))).alias("binary"),
        F.lit(None).cast("array<string>").alias("args"),
        F.when(key % 2 == 0, key).alias("duration_ms"),
        F.lit(None).cast("int").alias("exit_code"),
        F.lit(None).cast("bigint").alias("events"),
        F.lit("rr").alias("tool"),
        F.lit(None).cast("double").alias("size_mb"),
    )


@query(
    """SELECT c.c_custkey, r.recording_id, r.place FROM customer c JOIN (
  SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY 'r' || s_suppkey DESC) AS BIGINT) AS place, 'r' || s_suppkey AS recording_id
  FROM supplier WHERE s_suppkey % 3 > 0) r ON c.c_nationkey = r.s_nationkey WHERE place <= 5"""
)
def match_recordings(spark, sf_dir):
    from defectlake.operators import relations

    headers = d.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("scan_id"), _text("/opt/x/app", F.col("c_nationkey")).alias("binary")
    )
    out = relations.match_recordings(headers, scans.list_recordings(recordings(spark, sf_dir)))
    return out.select(F.col("scan_id").cast("bigint").alias("c_custkey"), "recording_id", "place")


@query(
    """SELECT page_id, url LIKE '%.c' OR url LIKE '%.cpp' OR url LIKE '%.cc' OR url LIKE '%.h' AS by_name FROM (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/a.c' WHEN 1 THEN 'lib/b.h' WHEN 2 THEN 'src/tests/c.c' ELSE 'doc/d.md' END AS url FROM pages)
WHERE url LIKE 'src/a%' OR url LIKE 'lib%'"""
)
def select_sources(spark, sf_dir):
    path = _pick(F.col("page_id") % 4, "src/a.c", "lib/b.h", "src/tests/c.c", "doc/d.md")
    files = d.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "html")
    return scans.select_sources(files).select("page_id", F.lit(True).alias("by_name"))


# -- column functions -------------------------------------------------------------------------
@query(
    """SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice * CASE l_linenumber % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1 ELSE 1073741824 END) AS BIGINT) AS bytes
FROM lineitem"""
)
def parse_size_units(spark, sf_dir):
    unit = _pick(F.col("l_linenumber") % 4, "KiB", "mb", "furlongs", "G")
    return d.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", parse_size(F.col("l_extendedprice").cast("string"), unit).alias("bytes")
    )


@query(
    """SELECT o_orderkey, CASE WHEN b >= 1048576 THEN format('{:.1f} MB', b / 1048576.0) WHEN b >= 1024 THEN format('{:.1f} KB', b / 1024.0)
  ELSE b || ' B' END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN 64 ELSE 1 END AS b FROM orders)"""
)
def format_byte_counts(spark, sf_dir):
    size = F.floor("o_totalprice").cast("bigint") * F.when(F.col("o_orderkey") % 3 == 0, 64).otherwise(1)
    return d.table(spark, sf_dir, "orders").select("o_orderkey", format_bytes(size).alias("shown"))


@query(
    "SELECT event_id, k, CAST(CASE WHEN k % 3 = 2 THEN NULL ELSE k END AS INTEGER) AS parsed FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"
)
def lenient_json_text(spark, sf_dir):
    e = _events(spark, sf_dir)
    # fenced, with an invalid escape, or embedded in prose, or no JSON at all
    text = F.when(F.col("k") % 3 == 0, _text('```json\n{"k": ', F.col("k"), ', "re": "\\s+ \\n"}\n```')).when(
        F.col("k") % 3 == 1, _text('Sure: {"k": ', F.col("k"), "} done")
    ).otherwise(_text("no json ", F.col("k")))
    return e.select("event_id", "k", F.try_variant_get(lenient_json(text), "$.k", "int").alias("parsed"))


@query(
    _E + "SELECT event_id, CASE k % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence FROM e"
)
def clamp_confidence(spark, sf_dir):
    """Stated confidences, some of them in other words or missing."""
    e = _events(spark, sf_dir)
    stated = _pick(F.col("k") % 5, "high", "low", "medium", "HIGH")  # the fifth is missing
    return e.select("event_id", clamp(stated).alias("confidence"))


# -- enrichment -------------------------------------------------------------------------------
@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, CASE WHEN ord % 3 = 0 THEN f0 ELSE 'sym_' || line END AS function,
  CASE WHEN ord % 3 = 0 THEN file ELSE 'res.c' END AS file, CASE WHEN ord % 3 = 0 THEN line ELSE line * 2 END AS line FROM findings_d"""
)
def resolve_frames(spark, sf_dir):
    found = d.findings(spark, sf_dir)
    bare = F.col("ord") % 3 != 0
    # frames of two thirds of the findings lose file and line and carry an address instead
    stack = F.transform(
        "stack",
        lambda f: F.when(
            bare & (f["index"] == 0),
            f.withField("address", F.concat(F.lit("0x"), f["line"].cast("string")))
            .withField("file", F.lit(None).cast("string"))
            .withField("line", F.lit(None).cast("int")),
        ).otherwise(f),
    )
    symbols = (
        d.findings(spark, sf_dir)
        .select(F.col("primary_location.line").alias("line"))
        .distinct()
        .select(
            F.concat(F.lit("0x"), F.col("line").cast("string")).alias("address"),
            F.concat(F.lit("sym_"), F.col("line").cast("string")).alias("function"),
            F.lit("res.c").alias("file"),
            (F.col("line") * 2).alias("line"),
        )
    )
    out = enrich.resolve_frames(found.withColumn("stack", stack), symbols)
    first = F.get("stack", F.lit(0))
    return out.select("scan_id", "ord", first["function"].alias("function"), first["file"].alias("file"), first["line"].alias("line"))


@query(
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT doc_id, max(n) // 2 + 1 AS line, max(n) AS total FROM lines GROUP BY 1)
SELECT f.doc_id, CAST(f.line AS INTEGER) AS line, md5(t.text) AS target, 
  (SELECT md5(string_agg(text, chr(10) ORDER BY n)) FROM lines l WHERE l.doc_id = f.doc_id AND l.n BETWEEN f.line - 8 AND f.line - 1) AS before_md5,
  (SELECT md5(string_agg(text, chr(10) ORDER BY n)) FROM lines l WHERE l.doc_id = f.doc_id AND l.n BETWEEN f.line + 1 AND f.line + 8) AS after_md5,
  (SELECT md5(string_agg(text, chr(10) ORDER BY n)) FROM lines l WHERE l.doc_id = f.doc_id) AS full_md5
FROM f JOIN lines t ON t.doc_id = f.doc_id AND t.n = f.line"""
)
def attach_source_context(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents")
    split = F.split("text", "\n")
    lines = docs.select(
        F.lit("docs").alias("scan_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"),
        F.posexplode(split).alias("p", "text"),
    ).select("scan_id", "file", (F.col("p") + 1).alias("line_no"), "text")
    found = docs.select(
        F.lit("docs").alias("scan_id"),
        F.col("doc_id").alias("ord"),
        F.struct(
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"),
            (F.floor(F.size(split) / 2) + 1).cast("int").alias("line"),
            F.lit(None).cast("int").alias("column"),
        ).alias("primary_location"),
    )
    out = enrich.attach_source_context(found, lines)
    c = F.col("source_context")

    def joined(texts):
        return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))

    return out.select(
        F.col("ord").alias("doc_id"),
        F.col("primary_location.line").alias("line"),
        F.md5(c["target_line"]).alias("target"),
        F.md5(joined(c["before_lines"])).alias("before_md5"),
        F.md5(joined(c["after_lines"])).alias("after_md5"),
        F.md5(c["full_file_content"]).alias("full_md5"),
    )
