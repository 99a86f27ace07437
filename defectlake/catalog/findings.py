"""Registered queries over findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlake import dims
from defectlake.catalog import derived as d
from defectlake.catalog.registry import Registry
from defectlake.functions import findings as ff
from defectlake.operators import diff, findings as fo, relations, security, stats

query = Registry()


def _both(spark, sf_dir):
    found = d.findings(spark, sf_dir)
    return found.where("scan_id = 'A'"), found.where("scan_id = 'B'")


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, rank AS number, severity, replace(bug_type, '_', ' ') AS type,
  concat(split_part(file, '/', 2), ':', line) AS location, tool,
  CASE WHEN coalesce(bytes_leaked, 0) = 0 THEN '—' ELSE format('{:,}', bytes_leaked) END AS bytes
FROM ranked_d"""
)
def issue_table(spark, sf_dir):
    """The worst distinct issues of every scan (fingerprint, dedup, rank, table)."""
    return fo.issue_table(fo.drop_uninformative(fo.dedupe_findings(d.findings(spark, sf_dir))))


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, fp AS fingerprint,
  substr(sha256('BugType.' || upper(bug_type) || ':' || f0 || '@' || file || ':' || line || ':'
    || f1 || '@' || file || ':' || line || ':' || f2 || '@' || file || ':' || line), 1, 16) AS cross_tool_key
FROM findings_d"""
)
def with_fingerprint(spark, sf_dir):
    return d.findings(spark, sf_dir).select("scan_id", "ord", "fingerprint", "cross_tool_key")


@query(
    d.FINDINGS_CTE
    + "SELECT scan_id, ord, fp AS fingerprint, severity, bug_type, tool FROM deduped_d"
)
def dedupe_findings(spark, sf_dir):
    return fo.dedupe_findings(d.findings(spark, sf_dir)).select(
        "scan_id", "ord", "fingerprint", "severity", "bug_type", "tool"
    )


@query(
    d.FINDINGS_CTE
    + """SELECT f.scan_id, f.ord,
  CASE WHEN f.ord <> w.ord THEN substr(sha256(w.scan_id || ':' || w.ord), 1, 32) END AS duplicate_of
FROM findings_d f JOIN deduped_d w ON f.scan_id = w.scan_id AND f.fp = w.fp"""
)
def mark_duplicates(spark, sf_dir):
    return fo.mark_duplicates(d.findings(spark, sf_dir)).select("scan_id", "ord", "duplicate_of")


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, CAST(row_number() OVER (PARTITION BY scan_id
  ORDER BY sev_rank, coalesce(bytes_leaked, 0) DESC, file, ord) AS BIGINT) AS priority FROM findings_d"""
)
def prioritise(spark, sf_dir):
    return fo.with_priority(d.findings(spark, sf_dir)).select("scan_id", "ord", "priority")


@query(d.FINDINGS_CTE + "SELECT scan_id, ord, rank FROM ranked_d WHERE rank <= 50")
def cap_findings(spark, sf_dir):
    return fo.cap_findings(fo.dedupe_findings(d.findings(spark, sf_dir)), 50).select(
        "scan_id", "ord", "rank"
    )


@query(
    d.FINDINGS_CTE
    + """SELECT r.scan_id, ord, r.rank AS position, t.total FROM ranked_d r
JOIN (SELECT scan_id, count(*) AS total FROM ranked_d GROUP BY 1) t ON r.scan_id = t.scan_id
WHERE rank > 40 AND rank <= 60"""
)
def page(spark, sf_dir):
    deduped = fo.dedupe_findings(d.findings(spark, sf_dir))
    return fo.page(deduped, 2, 20).select("scan_id", "ord", "position", "total")


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord FROM (
  SELECT *, k % 3 = 0 AS no_place FROM (SELECT *, line - 1 AS k FROM findings_d)) WHERE NOT (bug_type = 'unknown' AND no_place)"""
)
def drop_uninformative(spark, sf_dir):
    found = d.findings(spark, sf_dir)
    bare = (F.col("primary_location.line") - 1) % 3 == 0
    some = found.withColumn("primary_location", F.when(~bare, F.col("primary_location")))
    return fo.drop_uninformative(some).select("scan_id", "ord")


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, f0 AS bug_function, split_part(file, '/', 2) || ':' || line AS bug_location
FROM findings_d"""
)
def with_bug_function(spark, sf_dir):
    out = fo.with_bug_location(fo.with_bug_function(d.findings(spark, sf_dir)))
    return out.select("scan_id", "ord", "bug_function", "bug_location")


@query(
    d.FINDINGS_CTE
    + "SELECT scan_id, ord, file, line FROM findings_d"
)
def with_primary_location(spark, sf_dir):
    bare = d.findings(spark, sf_dir).withColumn(
        "primary_location", F.lit(None).cast("struct<file:string,line:int,column:int>")
    )
    return fo.with_primary_location(bare).select("scan_id", "ord", "primary_location.file", "primary_location.line")


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, CASE WHEN user_ext = 0 THEN 'c' WHEN user_ext = 1 THEN 'cpp'
  WHEN user_ext = 2 THEN 'python' ELSE 'rust' END AS language
FROM (SELECT *, line % 4 AS user_ext FROM findings_d)"""
)
def with_language(spark, sf_dir):
    ext = F.get(F.array(*[F.lit(x) for x in ("c", "cc", "py", "rs")]), F.col("primary_location.line") % 4)
    renamed = d.findings(spark, sf_dir).withColumn(
        "primary_location",
        F.col("primary_location").withField("file", F.concat(F.lit("src/a."), ext)),
    )
    return fo.with_language(renamed).select("scan_id", "ord", "language")


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, split_part(file, '/', 2) || ':' || line AS location, f0 AS function,
  CASE WHEN bug_type = 'use_after_free' THEN '0x' || lower(to_hex(ord * 16)) END AS watchpoint,
  CASE bug_type WHEN 'use_after_free' THEN 'USE' WHEN 'double_free' THEN 'DOU'
    WHEN 'memory_leak' THEN 'MEM' WHEN 'buffer_overflow' THEN 'BUF' WHEN 'null_deref' THEN 'NUL'
    WHEN 'race_condition' THEN 'RAC' WHEN 'uninit_read' THEN 'UNI' ELSE upper(substr(bug_type, 1, 3)) END AS head
FROM findings_d"""
)
def breakpoints(spark, sf_dir):
    out = fo.breakpoints(d.findings(spark, sf_dir))
    return out.select(
        "scan_id", "ord", "location", "function", "watchpoint", F.substring("description", 1, 3).alias("head")
    )


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, ord, CASE bug_type WHEN 'memory_leak' THEN 4 WHEN 'use_after_free' THEN 3
  WHEN 'double_free' THEN 3 WHEN 'buffer_overflow' THEN 4 WHEN 'null_deref' THEN 3 ELSE 2 END AS n_tips
FROM findings_d"""
)
def with_tips(spark, sf_dir):
    return fo.with_tips(d.findings(spark, sf_dir)).select("scan_id", "ord", F.size("tips").alias("n_tips"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEADING = "CASE bug_type " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in dims.CONTEXT_HEADINGS.items()) + " ELSE upper(bug_type) END"
_GUIDANCE = "CASE " + " ".join(f"WHEN {c} = {_quoted(v)} THEN {_quoted(t)}" for c, v, t in dims.CONTEXT_GUIDANCE) + " END"


@query(
    d.FINDINGS_CTE
    + f"""SELECT scan_id, ord, concat_ws(chr(10), '## ' || {_HEADING}, 'Tool: ' || tool || ' | Severity: ' || severity,
  'Message: ' || tool || ' ' || bug_type, 'Bytes leaked: ' || format('{{:,}}', nullif(bytes_leaked, 0)),
  CASE WHEN bytes_leaked IS NOT NULL THEN 'Blocks: 1' END, chr(10) || '### Error Stack Trace',
  '  #0 ' || f0 || ' at ' || file || ':' || line, '  #1 ' || f1 || ' at ' || file || ':' || line, '  #2 main at ' || file || ':' || line,
  chr(10) || 'USER CODE RESPONSIBLE: ' || f0 || ' at ' || file || ':' || line, 'CALLED FROM: ' || f1 || ' at ' || file || ':' || line,
  chr(10) || '### Analysis Instructions', {_GUIDANCE}) AS context_text
FROM findings_d"""
)
def finding_context_text(spark, sf_dir):
    return fo.finding_context_text(d.findings(spark, sf_dir)).select("scan_id", "ord", "context_text")


# -- statistics -------------------------------------------------------------------------------
@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, bug_type, severity, CAST(count(*) AS BIGINT) AS findings,
  CAST(sum(coalesce(bytes_leaked, 0)) AS BIGINT) AS bytes_leaked
FROM findings_d GROUP BY GROUPING SETS ((scan_id), (scan_id, bug_type), (scan_id, severity))"""
)
def scan_stats_sets(spark, sf_dir):
    return stats.scan_stats_sets(d.findings(spark, sf_dir))


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, CAST(count(*) AS BIGINT) AS total,
  CAST(sum(coalesce(bytes_leaked, 0)) AS BIGINT) AS total_bytes_leaked,
  (SELECT string_agg(bug_type || '=' || n, ',' ORDER BY bug_type) FROM
     (SELECT scan_id AS s, bug_type, count(*) AS n FROM findings_d GROUP BY 1, 2) t WHERE t.s = f.scan_id) AS by_type,
  count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'info') AS info
FROM findings_d f GROUP BY scan_id"""
)
def scan_stats(spark, sf_dir):
    entries = F.transform(
        F.array_sort(F.map_entries("error_count_by_type")),
        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
    )
    return stats.scan_stats(d.findings(spark, sf_dir)).select(
        "scan_id",
        "total",
        "total_bytes_leaked",
        F.array_join(entries, ",").alias("by_type"),
        F.try_element_at("error_count_by_severity", F.lit("critical")).alias("critical"),
        F.try_element_at("error_count_by_severity", F.lit("info")).alias("info"),
    )


@query(
    d.FINDINGS_CTE
    + """SELECT scan_id, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT fp) AS BIGINT) AS "unique",
  CAST(least(count(DISTINCT fp), 300) AS BIGINT) AS capped FROM findings_d GROUP BY scan_id"""
)
def funnel_counts(spark, sf_dir):
    return stats.funnel_counts(d.findings(spark, sf_dir), 300)


@query(
    d.FINDINGS_CTE
    + "SELECT scan_id, tool, CAST(count(*) AS BIGINT) AS error_count FROM findings_d GROUP BY 1, 2"
)
def parsed_per_tool(spark, sf_dir):
    return stats.parsed_per_tool(d.findings(spark, sf_dir))


@query(
    d.FINDINGS_CTE
    + """SELECT strftime(ts, '%Y-%m-%d') AS scan_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at,
  CAST(count(*) AS BIGINT) AS total, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high
FROM findings_d GROUP BY 1 ORDER BY min(ts) DESC LIMIT 20"""
)
def scan_history(spark, sf_dir):
    day = F.date_format("discovered_at", "yyyy-MM-dd")
    per_day = d.findings(spark, sf_dir).withColumn("scan_id", day)
    out = stats.scan_history(d.scans(spark, sf_dir), per_day, 20)
    return out.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    d.FINDINGS_CTE
    + """, per AS (SELECT scan_id, bug_type, CAST(count(*) AS BIGINT) AS n FROM findings_d GROUP BY 1, 2)
SELECT scan_id, bug_type, n, round(n / sum(n) OVER (PARTITION BY scan_id) * 100, 4) AS share,
  round(greatest(3.0, n / max(n) OVER (PARTITION BY scan_id) * 100), 4) AS bar_width FROM per"""
)
def share_and_bars(spark, sf_dir):
    counts = d.findings(spark, sf_dir).groupBy("scan_id", "bug_type").agg(F.count(F.lit(1)).alias("n"))
    return stats.bar_width(stats.share_of_total(counts, "n", ["scan_id"]), "n", 3, ["scan_id"])


# -- diff -------------------------------------------------------------------------------------
_SIDES = d.FINDINGS_CTE + """, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ord DESC) rn
  FROM findings_d WHERE scan_id = 'A') WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ord DESC) rn
  FROM findings_d WHERE scan_id = 'B') WHERE rn = 1),
n AS (SELECT (SELECT count(*) FROM b WHERE fp NOT IN (SELECT fp FROM a)) AS new_bugs,
  (SELECT count(*) FROM a WHERE fp NOT IN (SELECT fp FROM b)) AS fixed_bugs,
  (SELECT count(*) FROM b WHERE fp IN (SELECT fp FROM a)) AS persistent_bugs,
  (SELECT CAST(sum(CASE WHEN scan_id = 'B' THEN 1 ELSE -1 END * coalesce(bytes_leaked, 0)) AS BIGINT) FROM findings_d) AS bytes_delta,
  (SELECT count(*) FROM findings_d WHERE scan_id = 'A') AS rows_a,
  (SELECT count(*) FROM findings_d WHERE scan_id = 'B') AS rows_b)
"""


@query(
    _SIDES
    + """SELECT coalesce(b.fp, a.fp) AS fingerprint,
  CASE WHEN a.fp IS NULL THEN 'new' WHEN b.fp IS NULL THEN 'fixed' ELSE 'persistent' END AS status,
  coalesce(b.ord, a.ord) AS ord, coalesce(b.severity, a.severity) AS severity
FROM a FULL OUTER JOIN b ON a.fp = b.fp"""
)
def diff_findings(spark, sf_dir):
    return diff.diff_findings(*_both(spark, sf_dir)).select("fingerprint", "status", "ord", "severity")


@query(
    _SIDES
    + """SELECT 'A' AS scan_a, 'B' AS scan_b, new_bugs, fixed_bugs, persistent_bugs, bytes_delta,
  new_bugs > fixed_bugs AS regression,
  CASE WHEN new_bugs > 0 AND fixed_bugs = 0 THEN 'REGRESSION: ' || new_bugs || ' new bug(s) introduced'
    WHEN fixed_bugs > 0 AND new_bugs = 0 THEN 'IMPROVEMENT: ' || fixed_bugs || ' bug(s) fixed'
    WHEN fixed_bugs > 0 AND new_bugs > 0 THEN 'MIXED: ' || fixed_bugs || ' fixed, ' || new_bugs || ' new ('
      || CASE WHEN bytes_delta > 0 THEN '+' ELSE '' END || format('{:,}', bytes_delta) || ' bytes)'
    ELSE 'UNCHANGED: ' || persistent_bugs || ' persistent bug(s)' END AS summary FROM n"""
)
def diff_scans(spark, sf_dir):
    return diff.diff_summary(*_both(spark, sf_dir))


@query(_SIDES + "SELECT fp AS fingerprint, ord FROM b WHERE fp NOT IN (SELECT fp FROM a)")
def new_findings(spark, sf_dir):
    return diff.new_findings(*_both(spark, sf_dir)).select("fingerprint", "ord")


@query(_SIDES + "SELECT fp AS fingerprint, ord FROM a WHERE fp NOT IN (SELECT fp FROM b)")
def fixed_findings(spark, sf_dir):
    return diff.fixed_findings(*_both(spark, sf_dir)).select("fingerprint", "ord")


@query(_SIDES + "SELECT fp AS fingerprint, ord FROM b WHERE fp IN (SELECT fp FROM a)")
def persistent_findings(spark, sf_dir):
    return diff.persistent_findings(*_both(spark, sf_dir)).select("fingerprint", "ord")


@query(
    _SIDES
    + """SELECT rows_a AS original_errors, rows_b AS remaining_errors, fixed_bugs AS fixed_count,
  new_bugs AS new_regressions, fixed_bugs > 0 AND new_bugs = 0 AS verified,
  'Fixed ' || fixed_bugs || ' of ' || rows_a || ' issues. ' || new_bugs || ' regressions. '
    || persistent_bugs || ' remaining.' AS details FROM n"""
)
def verify_fix_diff(spark, sf_dir):
    return diff.verify_fix_diff(*_both(spark, sf_dir))


# -- relations --------------------------------------------------------------------------------
_RELATED = d.FINDINGS_CTE + """, listed AS (SELECT *, list_distinct(list_filter([f0, f1, f2], lambda x: x <> 'main')) AS fns
  FROM ranked_d),
pairs AS (SELECT a.scan_id, a.rank AS a_pos, b.rank AS b_pos, a.ord AS a_ord, b.ord AS b_ord,
    a.line AS a_line, a.file AS a_file, b.bug_type AS b_type,
    array_to_string(list_sort(list_intersect(a.fns, b.fns)), ', ') AS shared,
    CASE WHEN a.file = b.file AND abs(a.line - b.line) < 5 THEN 'same_root_cause'
      WHEN a.bug_type = 'memory_leak' AND b.bug_type = 'use_after_free' THEN 'masks'
      WHEN a.bug_type = 'race_condition' THEN 'amplifies' END AS relationship
  FROM listed a JOIN listed b ON a.scan_id = b.scan_id AND a.rank < b.rank
  WHERE len(list_intersect(a.fns, b.fns)) > 0),
rel AS (SELECT scan_id, a_pos, b_pos, substr(sha256(scan_id || ':' || a_ord), 1, 8) AS from_id,
  substr(sha256(scan_id || ':' || b_ord), 1, 8) AS to_id, relationship,
  CASE relationship
    WHEN 'same_root_cause' THEN 'Both near line ' || a_line || ' in ' || split_part(a_file, '/', 2) || ' (' || shared || ')'
    WHEN 'masks' THEN 'Leak in ' || shared || ' may hide the UAF'
    ELSE 'Race makes ' || b_type || ' non-deterministic' END AS explanation
FROM pairs WHERE relationship IS NOT NULL)
"""


@query(_RELATED + "SELECT * FROM rel")
def relate_findings(spark, sf_dir):
    return relations.relate_findings(fo.dedupe_findings(d.findings(spark, sf_dir)))


@query(
    _RELATED
    + """, members AS (
  SELECT scan_id, ord, unnest(fns) AS function, kind, file, bucket, leads FROM (
    SELECT scan_id, ord, fns, 'same_root_cause' AS kind, file, (line // 5)::BIGINT AS bucket, true AS leads FROM listed
    UNION ALL SELECT scan_id, ord, fns, 'same_root_cause', file, (line // 5)::BIGINT - 1, false FROM listed
    UNION ALL SELECT scan_id, ord, fns, 'masks', '', -1, bug_type = 'memory_leak' FROM listed WHERE bug_type IN ('memory_leak', 'use_after_free')
    UNION ALL SELECT scan_id, ord, fns, 'amplifies', '', -1, bug_type = 'race_condition' FROM listed))
SELECT scan_id, function, kind, file, bucket, leads, ord FROM (SELECT *, count(*) FILTER (leads) OVER g AS leaders, count(*) OVER g AS n FROM members
  WINDOW g AS (PARTITION BY scan_id, function, kind, file, bucket))
WHERE leaders > 0 AND CASE WHEN kind = 'same_root_cause' THEN n > 1 ELSE n > leaders END"""
)
def related_groups(spark, sf_dir):
    groups = relations.related_groups(fo.dedupe_findings(d.findings(spark, sf_dir)))
    return groups.select("scan_id", "function", "kind", "file", "bucket", "leads", "ord")


@query(
    _RELATED
    + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY a_pos, b_pos) AS rank FROM rel)
WHERE rank <= 5"""
)
def limit_relationships(spark, sf_dir):
    rels = relations.relate_findings(fo.dedupe_findings(d.findings(spark, sf_dir)))
    return relations.limit_relationships(rels, 5)


@query(
    """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def findings_with_analysis(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    labels = d.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("error_id"), F.lit("m").alias("model"), "quality", "toxic"
    )
    out = relations.findings_with_analysis(docs, labels)
    return out.select(F.col("id").alias("doc_id"), "lang", "analysis.quality", "analysis.toxic")


# -- security ---------------------------------------------------------------------------------
@query(
    d.FINDINGS_CTE
    + ", m AS (" + d.MITIGATIONS_SQL.format(findings="findings_d") + """)
SELECT scan_id, hardening_score, CASE WHEN hardening_score >= 95 THEN 'A+' WHEN hardening_score >= 85 THEN 'A'
  WHEN hardening_score >= 70 THEN 'B' WHEN hardening_score >= 55 THEN 'C' WHEN hardening_score >= 40 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT scan_id, CAST(sum(CASE WHEN enabled THEN CASE name WHEN 'RELRO' THEN 10 WHEN 'Sanitizer' THEN 10
  WHEN 'Debug Info' THEN 5 ELSE 15 END ELSE 0 END) AS BIGINT) AS hardening_score FROM m GROUP BY 1)"""
)
def hardening_score(spark, sf_dir):
    return security.hardening_score(d.mitigations(spark, sf_dir))


_CORRELATED = d.FINDINGS_CTE + ", m AS (" + d.MITIGATIONS_SQL.format(findings="findings_d") + """),
relevance(bug_type, pos, name) AS (VALUES ('buffer_overflow',0,'Stack Canary'),('buffer_overflow',1,'PIE'),
  ('buffer_overflow',2,'NX (No-Execute)'),('buffer_overflow',3,'FORTIFY_SOURCE'),('buffer_overflow',4,'RELRO'),
  ('stack_overflow',0,'Stack Canary'),('stack_overflow',1,'NX (No-Execute)'),('stack_overflow',2,'PIE'),
  ('use_after_free',0,'PIE'),('use_after_free',1,'NX (No-Execute)'),('use_after_free',2,'Sanitizer'),
  ('double_free',0,'Sanitizer'),('double_free',1,'PIE'),('null_deref',0,'ASLR (System)'),('null_deref',1,'PIE'),
  ('race_condition',0,'Sanitizer'),('uninit_read',0,'Sanitizer'),('uninit_read',1,'FORTIFY_SOURCE')),
corr AS (SELECT f.scan_id, f.ord, f.bug_type, f.severity, split_part(f.file, '/', 2) || ':' || f.line AS bug_location,
  coalesce(string_agg(m.name, ',' ORDER BY r.pos) FILTER (NOT m.enabled), '') AS would_prevent,
  count(*) FILTER (NOT m.enabled) AS missing
FROM findings_d f JOIN relevance r ON f.bug_type = r.bug_type JOIN m ON m.scan_id = f.scan_id AND m.name = r.name
GROUP BY ALL),
labelled AS (SELECT *, CASE WHEN bug_type IN ('buffer_overflow', 'stack_overflow') THEN
    CASE WHEN missing >= 3 THEN 'TRIVIAL' WHEN missing >= 2 THEN 'LIKELY' WHEN missing >= 1 THEN 'POSSIBLE' ELSE 'UNLIKELY' END
  WHEN bug_type = 'use_after_free' THEN CASE WHEN missing >= 2 THEN 'LIKELY' ELSE 'POSSIBLE' END
  WHEN bug_type = 'double_free' THEN CASE WHEN missing >= 1 THEN 'LIKELY' ELSE 'POSSIBLE' END
  WHEN bug_type = 'null_deref' THEN CASE WHEN missing >= 1 THEN 'POSSIBLE' ELSE 'UNLIKELY' END
  WHEN bug_type = 'race_condition' THEN 'POSSIBLE' ELSE 'UNLIKELY' END AS exploitability FROM corr)
"""


@query(
    _CORRELATED
    + "SELECT scan_id, ord, bug_type, bug_location, severity, exploitability, would_prevent FROM labelled"
)
def correlate_exploitability(spark, sf_dir):
    out = security.correlate_exploitability(d.findings(spark, sf_dir), d.mitigations(spark, sf_dir))
    return out.select(
        "scan_id", "ord", "bug_type", "bug_location", "severity", "exploitability",
        F.array_join("would_prevent", ",").alias("would_prevent"),
    )


@query(
    _CORRELATED
    + """SELECT scan_id, exploitability, CAST(CASE exploitability WHEN 'TRIVIAL' THEN 0 WHEN 'LIKELY' THEN 1
  WHEN 'POSSIBLE' THEN 2 ELSE 3 END AS INTEGER) AS exploit_rank, CAST(count(*) AS BIGINT) AS findings
FROM labelled GROUP BY 1, 2, 3"""
)
def rank_exploits(spark, sf_dir):
    ranked = security.correlate_exploitability(d.findings(spark, sf_dir), d.mitigations(spark, sf_dir))
    return (
        ranked.groupBy("scan_id", "exploitability", ff.exploit_rank(F.col("exploitability")).alias("exploit_rank"))
        .agg(F.count(F.lit(1)).alias("findings"))
        .orderBy("scan_id", "exploit_rank")
    )


@query(
    _CORRELATED
    + """SELECT scan_id, CAST(0 AS INTEGER) AS pos, 'CRITICAL: ' || n || ' bug(s) are TRIVIALLY exploitable due to missing mitigations' AS text
FROM (SELECT scan_id, count(*) AS n FROM labelled WHERE exploitability = 'TRIVIAL' GROUP BY 1)
UNION ALL SELECT scan_id, 1, 'WARNING: ' || n || ' bug(s) are LIKELY exploitable'
FROM (SELECT scan_id, count(*) AS n FROM labelled WHERE exploitability = 'LIKELY' GROUP BY 1)
UNION ALL SELECT scan_id, CAST(i + 2 AS INTEGER), name || ' DISABLED — ' FROM m
WHERE NOT enabled AND name IN ('PIE', 'Stack Canary', 'NX (No-Execute)')"""
)
def critical_findings(spark, sf_dir):
    mit = d.mitigations(spark, sf_dir)
    return security.critical_findings(
        security.correlate_exploitability(d.findings(spark, sf_dir), mit), mit
    )


@query(
    _CORRELATED
    + """SELECT scan_id, string_agg(flag, ' ' ORDER BY i) AS flags FROM (SELECT scan_id, i,
  CASE name WHEN 'PIE' THEN '-fPIE -pie' WHEN 'Stack Canary' THEN '-fstack-protector-strong'
    WHEN 'NX (No-Execute)' THEN '-Wl,-z,noexecstack' WHEN 'RELRO' THEN '-Wl,-z,relro,-z,now'
    WHEN 'FORTIFY_SOURCE' THEN '-D_FORTIFY_SOURCE=2 -O2' WHEN 'Sanitizer' THEN '-fsanitize=address,undefined' END AS flag
FROM m WHERE NOT enabled) WHERE flag IS NOT NULL GROUP BY 1"""
)
def recommended_flags(spark, sf_dir):
    return security.recommended_flags(d.mitigations(spark, sf_dir))


@query(
    d.FINDINGS_CTE
    + ", m AS (" + d.MITIGATIONS_SQL.format(findings="findings_d") + """),
w AS (SELECT scan_id, bool_or(name = 'PIE' AND NOT enabled) AS no_pie, bool_or(name = 'Stack Canary' AND NOT enabled) AS no_canary,
  bool_or(name = 'NX (No-Execute)' AND NOT enabled) AS no_nx, bool_or(name = 'ASLR (System)' AND NOT enabled) AS no_aslr,
  count(*) FILTER (NOT enabled) AS missing FROM m GROUP BY 1),
x AS (SELECT f.scan_id, f.ord, f.bug_type, w.missing, f.tool <> 'cppcheck' AS inp, f.sev_rank < 2 AS ptr, w.* EXCLUDE (scan_id, missing)
  FROM findings_d f JOIN w ON f.scan_id = w.scan_id),
y AS (SELECT *, CASE WHEN bug_type IN ('buffer_overflow', 'stack_overflow') THEN inp AND no_canary AND (no_nx OR (no_pie AND no_aslr))
  WHEN bug_type = 'use_after_free' THEN inp AND ptr AND (no_pie OR no_aslr)
  WHEN bug_type = 'null_deref' THEN inp AND no_aslr WHEN bug_type = 'race_condition' THEN inp ELSE FALSE END AS exploitable FROM x)
SELECT scan_id, ord, bug_type, exploitable, CASE WHEN NOT exploitable THEN 'infeasible' WHEN missing >= 3 THEN 'trivial'
  WHEN missing >= 1 THEN 'moderate' ELSE 'hard' END AS difficulty FROM y"""
)
def exploit_feasibility(spark, sf_dir):
    out = security.exploit_feasibility(
        d.findings(spark, sf_dir),
        d.mitigations(spark, sf_dir),
        F.col("tool") != "cppcheck",
        F.col("severity").isin("critical", "high"),
    )
    return out.select("scan_id", "ord", "bug_type", "exploitable", "difficulty")


def _cve_values(select: str) -> str:
    """The fixed CVE table as SQL VALUES for the oracle."""
    import csv
    from importlib import resources

    body = [
        line
        for line in resources.files("defectlake.data").joinpath("cve_patterns.csv").read_text("utf-8").splitlines()
        if not line.startswith("#")
    ]
    rows = [
        "({}, {}, '{}', '{}', {})".format(
            r["group_id"], i, r["bug_types"], r["cve_id"], r["similarity"]
        )
        for i, r in enumerate(csv.DictReader(body))
    ]
    return (
        d.FINDINGS_CTE
        + ", cve(group_id, pos, bug_types, cve_id, similarity) AS (VALUES " + ", ".join(rows) + """),
per AS (SELECT c.group_id, f.scan_id, count(*) AS matching_bugs, min(sev_rank) AS best,
    string_agg(DISTINCT f.bug_type, ',' ORDER BY f.bug_type) AS matched_types
  FROM (SELECT DISTINCT group_id, bug_types FROM cve) c
  JOIN findings_d f ON list_contains(string_split(c.bug_types, ';'), f.bug_type) GROUP BY 1, 2),
hit AS (SELECT p.scan_id, c.group_id, c.pos, c.cve_id, CAST(c.similarity AS DOUBLE) AS similarity, p.matching_bugs,
  split_part(c.bug_types, ';', 1) AS group_bug_type, p.matched_types,
  CASE p.best WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS your_severity
FROM cve c JOIN per p ON c.group_id = p.group_id)
"""
        + select
    )


_CVE_COLS = (
    "scan_id", "group_id", "pos", "cve_id", "similarity", "matching_bugs", "group_bug_type",
    "matched_types", "your_severity",
)


@query(_cve_values("SELECT * FROM hit"))
def match_cve(spark, sf_dir):
    return security.match_cve(d.findings(spark, sf_dir)).select(*_CVE_COLS)


@query(
    _cve_values(
        """SELECT scan_id, cve_id, similarity, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY scan_id ORDER BY similarity DESC, pos) AS rank FROM hit) WHERE rank <= 3"""
    )
)
def top_cves(spark, sf_dir):
    out = security.top_cves(security.match_cve(d.findings(spark, sf_dir)), 3)
    return out.select("scan_id", "cve_id", "similarity", "rank")


@query(
    d.FINDINGS_CTE
    + ", m AS (" + d.MITIGATIONS_SQL.format(findings="findings_d") + """)
SELECT scan_id, bool_or(enabled) FILTER (name = 'PIE') AS "PIE", bool_or(enabled) FILTER (name = 'Stack Canary') AS "Stack Canary",
  bool_or(enabled) FILTER (name = 'NX (No-Execute)') AS "NX (No-Execute)", bool_or(enabled) FILTER (name = 'RELRO') AS "RELRO",
  bool_or(enabled) FILTER (name = 'FORTIFY_SOURCE') AS "FORTIFY_SOURCE", bool_or(enabled) FILTER (name = 'Sanitizer') AS "Sanitizer",
  bool_or(enabled) FILTER (name = 'Debug Info') AS "Debug Info", bool_or(enabled) FILTER (name = 'ASLR (System)') AS "ASLR (System)"
FROM m GROUP BY 1"""
)
def mitigation_matrix(spark, sf_dir):
    return security.mitigation_matrix(d.mitigations(spark, sf_dir))


@query(
    """WITH e AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
SELECT event_id, 'valgrind' AS tool, CASE k % 4 WHEN 0 THEN 'memory_leak' WHEN 1 THEN 'buffer_overflow' WHEN 2 THEN 'null_deref' ELSE 'unknown' END AS bug_type,
  CASE k % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'high' WHEN 2 THEN 'critical' ELSE 'medium' END AS severity FROM e
UNION ALL SELECT event_id, 'helgrind', 'race_condition', CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END FROM e
UNION ALL SELECT event_id, 'infer', CASE k % 4 WHEN 0 THEN 'dangling_pointer' WHEN 1 THEN 'unknown' WHEN 2 THEN 'race_condition' ELSE 'unknown' END,
  CASE k % 4 WHEN 3 THEN 'medium' ELSE 'high' END FROM e"""
)
def classify_kind(spark, sf_dir):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")

    def kinds(tool, *names):
        rows = d.table(spark, sf_dir, "events").select(
            "event_id", F.lit(tool).alias("tool"), F.get(F.array(*[F.lit(n) for n in names]), k % 4).alias("kind")
        )
        return fo.classify_kind(rows, tool).drop("kind")

    return (
        kinds("valgrind", "Leak_StillReachable", "Overlap", "InvalidJump", "Else")
        .unionByName(kinds("helgrind", "Race", "UnlockBogus", "PthAPIerror", "Else"))
        .unionByName(kinds("infer", "STACK_VARIABLE_ADDRESS_ESCAPE", "DIVIDE_BY_ZERO", "LOCK_CONSISTENCY_VIOLATION", "Else"))
    )
