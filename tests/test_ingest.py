"""Hand-written reports and the findings they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlake import schemas
from defectlake.functions.text import strip
from defectlake.operators import findings as fo
from defectlake.sources import heap_text, reports, scans

from .conftest import rows

FRAME = "<frame><ip>{ip}</ip><fn>{fn}</fn><file>{file}</file><line>{line}</line></frame>"


def _raw(spark, tool, *texts):
    data = [("s", i, tool, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(data, schemas.RAW_REPORT_DDL)


def test_memcheck(spark):
    leak = (
        "<error><kind>Leak_DefinitelyLost</kind><xwhat><text>1,200 bytes in 3 blocks a & b</text></xwhat><stack>"
        + FRAME.format(ip="0x1", fn="malloc", file="malloc.c", line=1)
        + FRAME.format(ip="0x2", fn="make", file="/usr/x.c", line=2)
        + FRAME.format(ip="0x3", fn="user", file="src/u.c", line=30)
        + "</stack></error>"
    )
    freed = (
        "<error><kind>InvalidWrite</kind><what>Invalid write</what><auxwhat>inside a block free'd</auxwhat><stack>"
        + FRAME.format(ip="0x4", fn="w", file="src/w.c", line=4)
        + "</stack><stack>" + FRAME.format(ip="0x5", fn="free", file="f.c", line=5)
        + "</stack><stack>" + FRAME.format(ip="0x6", fn="malloc", file="m.c", line=6) + "</stack></error>"
    )
    doc = f"<valgrindoutput>{leak}{leak}{freed}</valgrindoutput>"
    out = reports.ingest_memcheck(_raw(spark, "valgrind", doc, "<a><broken" + "x" * 60, "<short/>"))
    got = rows(out, "bug_type", "severity", "bytes_leaked", "alloc_count", "primary_location.line", "free_info.kind")
    assert got == [
        ("memory_leak", "high", 1200, 3, 30, None),
        ("use_after_free", "critical", None, None, 4, "free"),
    ]
    # a third stack replaces the allocation
    uaf = out.where("bug_type = 'use_after_free'").select("allocation_info.stack").first()
    assert uaf["stack"][0]["function"] == "malloc"


def test_memcheck_falls_back_to_any_frame(spark):
    doc = (
        "<valgrindoutput><error><kind>Nope</kind><stack>"
        + FRAME.format(ip="0x1", fn="a", file="/usr/lib/a.c", line=7)
        + "</stack></error></valgrindoutput>"
    )
    out = reports.ingest_memcheck(_raw(spark, "valgrind", doc)).first()
    assert (out["bug_type"], out["severity"], out["message"]) == ("unknown", "medium", "Nope")
    assert out["primary_location"]["line"] == 7


def test_sanitizer_ignores_case_and_keeps_the_leak_summary(spark):
    text = (
        "==1==ERROR: LeakSanitizer: Detected Memory Leaks\n"
        "Direct leak of 64 byte(s) in 2 object(s) allocated from:\n#0 0x1 in make src/a.c:3:9\n"
    )
    raw = _raw(spark, "asan", text)
    found = rows(reports.ingest_reports(raw), "tool", "bug_type", "severity", "bytes_leaked")
    # the text before ERROR is a block of its own, and the summary counts beside the leak itself
    assert found == [
        ("asan", "memory_leak", "high", None),
        ("asan", "unknown", "medium", None),
        ("lsan", "memory_leak", "high", 64),
    ]
    frame = reports.ingest_lsan_leaks(raw).first()["stack"][0]
    assert (frame["function"], frame["file"], frame["line"], frame["column"]) == ("make", "src/a.c", 3, 9)


def test_infer_rejects_what_is_no_list(spark):
    raw = _raw(spark, "infer", '{"bug_type": "MEMORY_LEAK"}', "[]", "nope", '[{"bug_type": "DEAD_STORE"}, {"qualifier": "q"}]')
    assert rows(reports.ingest_infer(raw), "bug_type", "message") == [("unknown", "[Infer] UNKNOWN: q")]


def test_allocation_limits(spark):
    sizes = [100_000, 100_001, 1_000_000, 1_000_001] + [5] * 17
    text = "[" + ", ".join(f'{{"size": {n}, "count": 1}}' for n in sizes) + "]"
    out = reports.ingest_allocation_stats(_raw(spark, "memray", text))
    assert out.count() == 21 and reports.ingest_allocation_stats(_raw(spark, "memray", text), 20).count() == 20
    got = dict(out.groupBy("severity").count().collect())
    assert got == {"low": 18, "medium": 2, "high": 1}


def test_cppcheck_without_place(spark):
    text = '<results><error id="x" severity="odd" msg="m"/><error id="memleak" severity="error" msg="n"><location file="a.c" line="0"/><location file="b.c" line="4" column="2"/></error></results>'
    out = reports.ingest_cppcheck(_raw(spark, "cppcheck", text))
    assert rows(out, "bug_type", "severity", "primary_location.file", "primary_location.column") == [
        ("memory_leak", "high", "b.c", 2),
        ("unknown", "info", None, None),
    ]


def test_fingerprint_fallback_and_strict(spark):
    text = '<results><error id="memleak" msg="a"><location file="a.c" line="1"/></error><error id="memleak" msg="b"><location file="b.c" line="1"/></error></results>'
    found = reports.ingest_cppcheck(_raw(spark, "cppcheck", text))
    assert found.select("fingerprint").distinct().count() == 2
    assert fo.with_fingerprint(found, strict=True).select("fingerprint").distinct().count() == 1


def test_registered_format_replaces_parser(spark):
    raw = _raw(spark, "mytool", "a", "b")

    def parse(df):
        return fo.with_fingerprint(
            schemas.conform(df, ord=F.col("report_id"), bug_type=F.lit("unknown"), severity=F.lit("low"))
        )

    reports.register_report_format("mytool", parse)
    try:
        assert reports.ingest_reports(raw).count() == 2
        assert "mytool" in reports.known_tools()
    finally:
        reports._EXTRA.pop("mytool")


def test_mixed_reports_are_one_scan_of_the_table(spark, tmp_path):
    texts = [
        ("valgrind", "<v>" + "<error><kind>InvalidRead</kind><what>w</what></error>" * 2 + " " * 50 + "</v>"), ("valgrind", "<v><bro" + "k" * 50),
        ("asan", "==1==ERROR: heap-use-after-free\nDirect leak of 5 byte(s) in 1 object(s) allocated from:\n#0 0x1 in f a.c:1\n"),
        ("infer", '[{"bug_type": "NULL_DEREFERENCE"}, {"bug_type": "DEAD_STORE"}]'), ("infer", "[oops"), ("what", "x"),
        ("cppcheck", '<r><error id="memleak" severity="error" msg="m"/></r>'), ("tracemalloc", '[{"size": 5}]'), ("helgrind", ""), (None, "no tool"),
    ]
    data = [("s", i, tool, text) for i, (tool, text) in enumerate(texts)] + [("s", 99, "infer", None)]
    path = str(tmp_path / "raw")
    spark.createDataFrame(data, schemas.RAW_REPORT_DDL).write.parquet(path)
    parsed = reports.parse_reports(spark.read.parquet(path))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    read = reports.read_reports(spark.read.parquet(path))
    assert rows(read["rejected"], "report_id", "reason") == [(1, "malformed XML"), (4, "malformed JSON"), (5, "unknown tool")]
    found = rows(read["findings"], "ord", "tool", "bug_type")
    span = reports.REPORT_SPAN
    assert found == sorted([
        (0, "valgrind", "buffer_overflow"), (2 * span, "asan", "unknown"), (2 * span + 1, "asan", "use_after_free"),
        (2 * span + span // 2, "lsan", "memory_leak"), (3 * span, "infer", "null_deref"), (6 * span, "cppcheck", "memory_leak"),
        (7 * span, "tracemalloc", "python_large_object"),
    ], key=str)
    assert rows(reports.ingest_reports(spark.read.parquet(path)), "ord", "tool", "bug_type") == found


def test_large_report_ids_keep_the_order(spark):
    ids = [0, 7, reports.WIDE_IDS - 1, reports.WIDE_IDS, 10**13, reports.WIDE_IDS * 64 - 1]
    text = "==1==ERROR: x\nDirect leak of 5 byte(s) in 1 object(s) allocated from:\n#0 0x1 in f a.c:1\nERROR: y"
    raw = spark.createDataFrame([("s", i, "asan", text) for i in ids], schemas.RAW_REPORT_DDL)
    found = reports.parse_reports(raw).select("report_id", "part", "ord").collect()
    assert len({r["ord"] for r in found}) == len(found) == 4 * len(ids)
    order = [(r["report_id"], r["part"], r["ord"]) for r in sorted(found, key=lambda r: r["ord"])]
    assert order == sorted(order)


def test_heap_site_block(spark):
    text = (
        "3 calls to allocation functions with 26.40K peak consumption from\n"
        "  malloc\n    at /usr/src/m.c:1\n  add_log\n    at /lib/x.c:9\n    at /home/u/s.c:146\n    in /tmp/bin\n  main\n"
        "\nMOST CALLS TO x\n  at /home/z.c:1\n"
    )
    out = heap_text.ingest_heap_sites(spark.createDataFrame([("p", text)], "scan_id STRING, output STRING")).first()
    assert (out["function"], out["file"], out["line"]) == ("add_log", "s.c", 146)
    assert (out["allocations"], out["peak_bytes"], out["is_subcall"]) == (3, 27033, False)
    assert out["stack"] == ["malloc", "add_log", "main"]


def test_flame_block_ends_at_allocation_header(spark):
    text = (
        "2 calls with 1K peak consumption from:\n  leaf\n    at /a.c:1\n  main\n"
        "5 calls to allocation functions with 1K peak consumption from\n  other\n"
        "1 calls with 2K peak consumption from:\n  leaf\n  main\n"
    )
    out = heap_text.ingest_flame_stacks(spark.createDataFrame([("p", text)], "scan_id STRING, output STRING"))
    assert rows(out, "stack", "bytes") == [("main;leaf", 3072)]


def test_stored_scans_round_trip(spark, tmp_path):
    path = tmp_path / "scan.json"
    path.write_text(
        '{"scan_id": "abc1",\n "started_at": "2024-01-01T00:00:00Z",\n "errors": [{"ord": 1, "bug_type": "memory_leak", "stack": []}]}'
    )
    (tmp_path / "other.json").write_text('{"scan_id": "abc", "errors": []}')
    read = scans.read_scans(spark, str(tmp_path), "json-documents")
    assert rows(scans.load_scan(read, "abc"), "scan_id") == [("abc",)]
    assert rows(scans.load_scan(read, "abc1"), "scan_id") == [("abc1",)]
    assert rows(scans.scan_findings(read), "scan_id", "bug_type") == [("abc1", "memory_leak")]


def test_recordings_and_corpus(spark, tmp_path):
    for name, text in (("r2/meta.json", '{"recording_id": "r2", "binary": "/b/app"}'), ("r1/meta.json", "{}"), ("r0/meta.json", "{oops")):
        (tmp_path / "rec" / name).parent.mkdir(parents=True)
        (tmp_path / "rec" / name).write_text(text)
    got = scans.read_recordings(spark, str(tmp_path / "rec")).select("recording_id", "binary").collect()
    assert [tuple(r) for r in got] == [("r2", "/b/app"), ("r1", "??")]
    for name in ("a.c", "build/b.c", "lib/build.h", "lib/x.txt"):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text("int x;\n")
    corpus = scans.read_source_corpus(spark, str(tmp_path / "src"), "c1")
    assert rows(corpus, "path") == [("a.c",), ("lib/build.h",)]


def test_mixed_reports_are_not_stored_and_only_asked_columns_are_made(spark, monkeypatch):
    """Copies within a report go, those of formats without a count per fingerprint stay, and no table is written."""
    error = "<error><kind>Race</kind><what>w</what><stack>" + FRAME.format(ip="0x1", fn="f", file="a.c", line=3) + "</stack></error>"
    record = '{"size": 5, "count": 1, "traceback": [{"file": "app.py", "line": 1}]}'
    data = [("s", 1, "helgrind", f"<valgrindoutput>{error}{error}{error}</valgrindoutput>"), ("s", 2, "tracemalloc", f"[{record}, {record}]")]
    raw = spark.createDataFrame(data, schemas.RAW_REPORT_DDL)

    def stored(*_):
        raise AssertionError("a table is written")

    monkeypatch.setattr(reports.scale, "materialise", stored)
    out = reports.ingest_reports(raw).select("ord", "tool", "bug_type")
    span = reports.REPORT_SPAN
    assert rows(out) == [(span, "helgrind", "race_condition"), (2 * span, "tracemalloc", "python_large_object"), (2 * span + 1, "tracemalloc", "python_large_object")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "cross_tool_key" not in plan


def test_strip_equals_the_pattern(spark):
    texts = ["", " ", " a ", "\t\n\x0b\f\r a b \r\n", "a \x85", "a \u2028", " a\n\u2029", "\u2003a\u2003", "a\x1c ", "\x85 a", " \n\u2028 "]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t STRING")
    pattern = F.regexp_replace("t", r"^\s+|\s+$", "")
    assert df.where(~strip(F.col("t")).eqNullSafe(pattern)).count() == 0
