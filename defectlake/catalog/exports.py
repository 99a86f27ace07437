"""Registered export and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlake import scale
from defectlake.catalog import derived as d
from defectlake.catalog.registry import Registry
from defectlake.catalog.reports import mixed_reports
from defectlake.operators import export, findings as fo, heap, relations, stats
from defectlake.plans import jobs
from defectlake.streaming import jobs as streams

query = Registry()


def _listed(spark, sf_dir):
    return fo.dedupe_findings(d.findings(spark, sf_dir))


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, bug_type AS rule, CASE WHEN sev_rank < 2 THEN 'error' WHEN sev_rank = 2 THEN 'warning' WHEN sev_rank = 3 THEN 'note' ELSE 'none' END AS level,
  tool || ' ' || bug_type AS message, file AS uri, line AS start_line FROM findings_d"""
)
def sarif_results(spark, sf_dir):
    """SARIF results of every finding, read back from their JSON."""
    out = export.sarif_results(d.findings(spark, sf_dir))
    doc = F.from_json(
        "result",
        "ruleId STRING, level STRING, message STRUCT<text: STRING>, locations ARRAY<STRUCT<physicalLocation: "
        "STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT>>>>",
    )
    place = F.get(F.col("doc.locations"), F.lit(0))["physicalLocation"]
    return out.withColumn("doc", doc).select(
        "scan_id", "ord", F.col("doc.ruleId").alias("rule"), "doc.level", F.col("doc.message.text").alias("message"),
        place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"),
    )


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, rank AS line_no, CASE WHEN rank > 1 THEN ',' ELSE '' END || '{"ruleId":"' || bug_type || '","level":"'
  || CASE WHEN sev_rank < 2 THEN 'error' WHEN sev_rank = 2 THEN 'warning' WHEN sev_rank = 3 THEN 'note' ELSE 'none' END
  || '","message":{"text":"' || tool || ' ' || bug_type || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file
  || '"},"region":{"startLine":' || line || '}}}]}' AS text FROM ranked_d
UNION ALL SELECT scan_id, 0, '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "defectlake"}}, "results": [' FROM ranked_d GROUP BY 1
UNION ALL SELECT scan_id, count(*) + 1, ']}]}' FROM ranked_d GROUP BY 1"""
)
def export_sarif(spark, sf_dir):
    return export.export_sarif(_listed(spark, sf_dir))


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, rank AS line_no, '### ' || rank || '. ' || bug_type || ' — ' || severity || chr(10) || '**Location**: `' || file || ':' || line || '`  ' || chr(10)
  || '**Tool**: ' || tool || '  ' || chr(10) || tool || ' ' || bug_type || chr(10) || chr(10) AS text FROM ranked_d
UNION ALL SELECT scan_id, 0, '# Defect report — ' || scan_id || chr(10) || '## Summary' || chr(10) || '| Severity | Count |' || chr(10) || '|----------|-------|' || chr(10)
  || string_agg('| ' || severity || ' | ' || n || ' |', chr(10) ORDER BY sev_rank) || chr(10) || chr(10) || '## Issues' || chr(10)
FROM (SELECT scan_id, severity, sev_rank, count(*) AS n FROM ranked_d GROUP BY ALL) GROUP BY scan_id"""
)
def export_markdown(spark, sf_dir):
    return export.export_markdown(_listed(spark, sf_dir))


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, rank AS line_no, '{' || chr(10) || '   <defectlake_' || split_part(bug_type, '_', 1) || CASE WHEN contains(bug_type, '_') THEN '_' || split_part(bug_type, '_', 2) ELSE '' END
  || '_' || rank || '>' || chr(10) || '   Memcheck:' || CASE bug_type WHEN 'use_after_free' THEN 'Addr4' WHEN 'double_free' THEN 'Free' WHEN 'buffer_overflow' THEN 'Addr4'
    WHEN 'uninit_read' THEN 'Cond' WHEN 'null_deref' THEN 'Addr4' ELSE 'Leak_DefinitelyLost' END
  || chr(10) || '   fun:' || f0 || chr(10) || '   fun:' || f1 || chr(10) || '   fun:main' || chr(10) || '}' || chr(10) AS text FROM ranked_d WHERE tool = 'valgrind'
UNION ALL SELECT scan_id, 0, '# Auto-generated by defectlake' || chr(10) || '# ' || count(*) || ' suppression(s)' || chr(10) FROM ranked_d GROUP BY 1"""
)
def export_suppressions(spark, sf_dir):
    return export.export_suppressions(_listed(spark, sf_dir))


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, bug_type, severity, fp AS fingerprint, CAST(3 AS INTEGER) AS frames FROM findings_d"""
)
def export_json(spark, sf_dir):
    """Finding documents read back from their JSON."""
    docs = export.finding_documents(d.findings(spark, sf_dir))
    doc = F.from_json("value", "bug_type STRING, severity STRING, fingerprint STRING, stack ARRAY<STRUCT<index: INT>>")
    return docs.withColumn("doc", doc).select(
        "scan_id", "ord", "doc.bug_type", "doc.severity", "doc.fingerprint", F.size("doc.stack").alias("frames")
    )


@query(
    d.FINDINGS_CTE
    + """, day AS (SELECT strftime(ts, '%Y-%m-%d') AS scan_id, count(*) AS findings, sum(bytes_leaked) AS bytes_leaked,
  list_sort(list(DISTINCT severity)) AS severities FROM findings_d GROUP BY 1)
SELECT scan_id, '{"scan_id":"' || scan_id || '","findings":' || findings || coalesce(',"bytes_leaked":' || bytes_leaked, '')
  || ',"severities":["' || array_to_string(severities, '","') || '"]}' AS value FROM day"""
)
def export_scan_json(spark, sf_dir):
    """The JSON document of every day's scan header."""
    day = F.date_format("discovered_at", "yyyy-MM-dd").alias("scan_id")
    scans = d.findings(spark, sf_dir).groupBy(day).agg(
        F.count(F.lit(1)).alias("findings"), F.sum("bytes_leaked").alias("bytes_leaked"),
        F.array_sort(F.collect_set("severity")).alias("severities"),
    )
    return export.export_json(scans)


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, bug_type, severity, fp AS fingerprint, bytes_leaked, CAST(3 AS INTEGER) AS frames FROM deduped_d"""
)
def write_scans(spark, sf_dir):
    """Distinct findings written by scan bucket and read back."""
    path = scale.scratch_path(spark, "scans")
    found = _listed(spark, sf_dir)
    export.write_scans(found, path)
    back = spark.read.schema(found.schema).parquet(path)
    return back.select(
        "scan_id", "ord", "bug_type", "severity", "fingerprint", "bytes_leaked", F.size("stack").alias("frames")
    )


@query(
    """SELECT conv_id, CAST(count(*) AS INTEGER) AS total_steps, CAST(count(*) FILTER (role = 'user') AS INTEGER) AS completed,
  CAST(count(*) FILTER (role = 'assistant') AS INTEGER) AS skipped, CAST(count(*) FILTER (role NOT IN ('user', 'assistant')) AS INTEGER) AS remaining
FROM conversations GROUP BY 1"""
)
def session_progress(spark, sf_dir):
    """Conversations as debugging sessions: user turns completed, assistant turns skipped."""
    step = F.struct(
        F.col("turn").cast("int").alias("step"),
        (F.col("role") == "user").alias("completed"),
        (F.col("role") == "assistant").alias("skipped"),
    )
    sessions = (
        d.table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.collect_list(step).alias("steps"))
        .select(
            F.col("conv_id").cast("string").alias("session_id"), F.lit("s").alias("scan_id"), F.lit("e").alias("error_id"),
            "steps", F.lit("main").alias("git_branch"), F.lit("done").alias("state"),
        )
    )
    out = stats.session_progress(sessions)
    return out.select(
        F.col("session_id").cast("bigint").alias("conv_id"), "total_steps", "completed", "skipped", "remaining"
    )


@query("SELECT d.doc_id, d.lang, c.turn, c.role FROM documents d LEFT JOIN conversations c ON d.doc_id = c.conv_id")
def findings_with_session(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    turns = d.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("error_id"), "turn", "role")
    return relations.findings_with_session(docs, turns).withColumnRenamed("id", "doc_id")


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, CAST(count(*) AS BIGINT) AS findings, CAST(sum(coalesce(bytes_leaked, 0)) AS BIGINT) AS bytes_leaked,
  count(*) FILTER (severity = 'critical') AS critical FROM ranked_d GROUP BY 1"""
)
def keep_latest_scan_totals(spark, sf_dir):
    """Totals of all distinct findings of each scan."""
    return _listed(spark, sf_dir).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum(F.coalesce("bytes_leaked", F.lit(0))).alias("bytes_leaked"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def keep_latest(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return stats.keep_latest(rows, "o_orderdate", 20, tie="o_orderkey").drop("o_orderdate")


#: distinct findings of the mixed reports: what their stacks vary by, per tool
_MIXED = """WITH e AS (SELECT 'scan' || user_id % 7 AS scan_id, event_id % 7 AS t, user_id % 8 AS u,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
m AS (SELECT scan_id, 'valgrind' AS tool, u || '/' || k AS what, 1 AS n FROM e WHERE t = 0 AND k <> 99
  UNION ALL SELECT scan_id, 'helgrind', u || '/' || k, 1 FROM e WHERE t = 1
  UNION ALL SELECT scan_id, 'asan', u || '/' || k, 1 FROM e WHERE t = 2 UNION ALL SELECT scan_id, 'asan', 'soft', 1 FROM e WHERE t = 2
  UNION ALL SELECT scan_id, 'lsan', 'direct', 1 FROM e WHERE t = 2
  UNION ALL SELECT scan_id, 'cppcheck', CAST(k AS VARCHAR), 1 FROM e WHERE t = 3
  UNION ALL SELECT scan_id, 'infer', u || '/' || k, 1 FROM e WHERE t = 4 AND k % 5 <> 3 AND k <> 98
  UNION ALL SELECT scan_id, 'tracemalloc', CAST(k AS VARCHAR), 21 FROM e WHERE t = 5)
"""


@query(
    _MIXED
    + """SELECT scan_id, CAST(sum(n) AS BIGINT) AS total, CAST(count(DISTINCT tool || what) AS BIGINT) AS "unique",
  CAST(count(DISTINCT tool || what) AS BIGINT) AS capped FROM m GROUP BY 1"""
)
def scan_job(spark, sf_dir):
    """The whole scan job over the mixed reports: funnel per scan."""
    return jobs.run_scan(mixed_reports(spark, sf_dir))["funnel"]


# -- streams ----------------------------------------------------------------------------------
def _events_stream(spark, sf_dir):
    # a file stream lists a folder: the events file is picked by name
    schema = d.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def _memory_events(events):
    freed = F.col("event_type").isin("view", "click")
    size = F.floor(F.col("value") * 100).cast("bigint")
    return streams.event_time(events).select(
        "event_id",
        "ts",
        F.col("user_id").alias("process_id"),
        F.when(freed, F.lit("free")).otherwise(F.lit("malloc")).alias("op"),
        F.when(freed, -size).otherwise(size).alias("delta_bytes"),
        F.abs(size).alias("size"),
    )


@query(
    d.MEMORY_EVENTS_CTE
    + """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, process_id, count(*) FILTER (op = 'malloc') AS allocations,
  count(*) FILTER (op = 'free') AS frees, CAST(sum(delta_bytes) AS BIGINT) AS net_bytes
FROM memory_events_d WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM memory_events_d) GROUP BY 1, 2"""
)
def stream_heap_usage(spark, sf_dir):
    """Daily windows of the event stream that the watermark has closed."""
    usage = streams.stream_heap_usage(_memory_events(_events_stream(spark, sf_dir)), "1 day")
    out = streams.run_to_table(usage, "usage")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "process_id", "allocations", "frees", "net_bytes"
    )


_LIVE = d.MEMORY_EVENTS_CTE + """, o AS (SELECT *, event_id % 50 AS slot, lag(op) OVER w AS prev,
  max(CASE WHEN op = 'malloc' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had
FROM memory_events_d WINDOW w AS (PARTITION BY process_id, event_id % 50 ORDER BY ts, event_id))
SELECT process_id, '0x' || slot AS address, arg_max(op, ts) = 'malloc' AS live,
  CAST(CASE WHEN arg_max(op, ts) = 'malloc' THEN arg_max(abs(delta_bytes), ts) ELSE 0 END AS BIGINT) AS size,
  count(*) FILTER (op = 'malloc') AS mallocs, count(*) FILTER (op = 'free') AS frees,
  count(*) FILTER (op = 'free' AND prev = 'free' AND had = 1) AS double_frees,
  count(*) FILTER (op = 'free' AND coalesce(had, 0) = 0) AS unmatched_frees FROM o GROUP BY process_id, slot
"""


def _addressed(events):
    """Memory events with one of fifty addresses per process."""
    return _memory_events(events).select(
        "process_id",
        F.concat(F.lit("0x"), (F.col("event_id") % 50).cast("string")).alias("address"),
        "op",
        "size",
        "ts",
        F.col("event_id").alias("seq"),
    )


@query(_LIVE)
def live_objects(spark, sf_dir):
    return heap.live_objects(_addressed(d.table(spark, sf_dir, "events")))


@query(_LIVE)
def stream_live_objects(spark, sf_dir):
    """State of every (process, address slot) after the whole event stream."""
    events = _addressed(_events_stream(spark, sf_dir))
    updates = streams.run_to_table(streams.stream_live_objects(events), "live", "update")
    return streams.latest_rows(updates, ["process_id", "address"])


@query(
    """SELECT user_id, arg_max(event_type, ts) AS state, count(*) FILTER (event_type = 'click') AS tools_done,
  count(*) FILTER (event_type = 'error') AS errors, bool_or(event_type = 'purchase') AS complete FROM events GROUP BY 1"""
)
def stream_scan_progress(spark, sf_dir):
    """Users as scans: clicks are finished tools, purchases complete a scan."""
    names = {"view": "view", "click": "tool_done", "error": "error", "purchase": "complete", "signup": "signup"}
    back = {v: k for k, v in names.items()}
    from defectlake.dims import lookup

    events = streams.event_time(_events_stream(spark, sf_dir)).select(
        F.col("user_id").alias("scan_id"), lookup(names, F.col("event_type")).alias("kind"), "ts"
    )
    updates = streams.run_to_table(streams.stream_scan_progress(events), "progress", "update")
    out = streams.latest_rows(updates, ["scan_id"])
    return out.select(
        F.col("scan_id").alias("user_id"), lookup(back, F.col("state")).alias("state"), "tools_done", "errors", "complete"
    )


@query(
    """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g),
b AS (SELECT user_id, burst, max(ts) + INTERVAL 6 HOUR AS request_at, count(*) AS changes,
  arg_min(event_type, {'t': ts, 'p': event_type}) AS first_path FROM s GROUP BY 1, 2)
SELECT user_id, first_path, CAST(changes AS BIGINT) AS changes, strftime(request_at, '%Y-%m-%d %H:%M:%S') AS request_at FROM b
WHERE request_at <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)"""
)
def debounce_changes(spark, sf_dir):
    """Bursts of a user's events with less than six hours between neighbours."""
    changes = streams.event_time(_events_stream(spark, sf_dir)).select(
        F.col("user_id").alias("project"), "ts", F.col("event_type").alias("path")
    )
    out = streams.run_to_table(streams.debounce_changes(changes, "6 hours"), "debounce")
    return out.select(
        F.col("project").alias("user_id"), "first_path", "changes", F.date_format("request_at", "yyyy-MM-dd HH:mm:ss").alias("request_at")
    )


@query(
    """WITH RECURSIVE t AS (SELECT DISTINCT user_id, ts FROM events),
after_gap AS (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL 6 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM t),
r AS (SELECT user_id, min(ts) AS ts FROM t GROUP BY 1
  UNION ALL SELECT r.user_id, a.next FROM r JOIN after_gap a ON a.user_id = r.user_id AND a.ts = r.ts WHERE a.next IS NOT NULL)
SELECT CAST(r.user_id AS BIGINT) AS user_id, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS request_at, count(*) AS changes,
  string_agg(e.event_type, ',' ORDER BY e.event_type) AS paths
FROM r JOIN events e ON e.user_id = r.user_id AND e.ts = r.ts
WHERE r.ts <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) GROUP BY r.user_id, r.ts"""
)
def debounce_leading(spark, sf_dir):
    """Requests at a user's first event and at the first one six hours or more after the last request."""
    changes = streams.event_time(_events_stream(spark, sf_dir)).select(
        F.col("user_id").alias("project"), "ts", F.col("event_type").alias("path")
    )
    out = streams.run_to_table(streams.debounce_leading(changes, "6 hours"), "requests")
    return out.select(
        F.col("project").cast("bigint").alias("user_id"), F.date_format("request_at", "yyyy-MM-dd HH:mm:ss").alias("request_at"),
        "changes", F.array_join("paths", ",").alias("paths"),
    )


@query(
    """SELECT (SELECT count(*) FROM events) + count(*) AS input_rows,
  count(*) FILTER (ts <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS late_rows FROM events WHERE event_id % 10 = 0"""
)
def stream_progress(spark, sf_dir):
    """Progress rows of a stream that gets a tenth of its rows a second time, most of them late."""
    from defectlake import scale

    found = _finding_columns(streams.event_time(d.table(spark, sf_dir, "events")))
    path, listener = scale.scratch_path(spark, "progress"), streams.ProgressListener()
    for again in (False, True):
        part = found.where(F.col("ord") % 10 == 0) if again else found
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(found.schema).parquet(f"{path}/in")
        unique = stream.withWatermark("discovered_at", "1 day").dropDuplicatesWithinWatermark(["scan_id", "fingerprint"])
        streams.run_to_table(unique, "progress", path=f"{path}/run", listener=listener)
    rows = spark.read.schema(streams.PROGRESS_DDL).parquet(f"{path}/run/progress")
    return rows.agg(F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"))


def _finding_stream(spark, sf_dir):
    return _finding_columns(streams.event_time(_events_stream(spark, sf_dir)))


def _finding_columns(events):
    """Findings of events, with the columns the stream operators need."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select(
        F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("scan_id"),
        F.col("event_id").alias("ord"),
        F.concat(F.lit("fp"), k.cast("string")).alias("fingerprint"),
        F.concat(F.lit("type"), (k % 10).cast("string")).alias("bug_type"),
        F.get(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), F.col("event_id") % 5).alias("severity"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bytes_leaked"),
        F.col("ts").alias("discovered_at"),
    )


_FS = """WITH f AS (SELECT 's' || user_id % 8 AS scan_id, event_id AS ord, 'fp' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS fingerprint,
  'type' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 10 AS bug_type, event_id % 5 AS sev, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events)
"""


@query(
    _FS
    + "SELECT scan_id, fingerprint, ord FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, fingerprint ORDER BY sev, ord) AS rn FROM f) WHERE rn = 1"
)
def stream_best_finding(spark, sf_dir):
    """Most severe finding per fingerprint, kept by micro-batch merges."""
    from defectlake import scale

    base = scale.scratch_path(spark, "best")
    streams.run_best_findings(_finding_stream(spark, sf_dir), f"{base}/table", f"{base}/state").awaitTermination()
    return streams.best_findings(spark, f"{base}/table").select("scan_id", "fingerprint", "ord")


@query(
    _FS
    + """SELECT scan_id, bug_type, CASE sev WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
  CAST(count(*) AS BIGINT) AS findings, CAST(sum(bytes) AS BIGINT) AS bytes_leaked FROM f GROUP BY 1, 2, sev"""
)
def stream_scan_stats(spark, sf_dir):
    updates = streams.run_to_table(streams.stream_scan_stats(_finding_stream(spark, sf_dir)), "stats", "update")
    return streams.latest_rows(updates, ["scan_id", "bug_type", "severity"])


@query(_MIXED + "SELECT scan_id, tool, CAST(count(DISTINCT what) AS BIGINT) AS findings FROM m GROUP BY 1, 2")
def stream_findings(spark, sf_dir):
    """Report stream to first-seen findings: the reports of all events, parsed as they arrive."""
    from defectlake import scale

    raw = mixed_reports(spark, sf_dir).withColumn(
        "discovered_at", F.timestamp_seconds(F.lit(1704067200) + F.col("report_id"))
    )
    path = scale.scratch_path(spark, "raw")
    raw.write.parquet(path)
    stream = spark.readStream.schema(raw.schema).parquet(path)
    found = streams.run_to_table(streams.stream_findings(stream, "400 days"), "found")
    return found.groupBy("scan_id", "tool").agg(F.count(F.lit(1)).alias("findings"))
