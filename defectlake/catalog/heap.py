"""Registered heap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlake.catalog import derived as d
from defectlake.catalog.registry import Registry
from defectlake.operators import heap, stats

query = Registry()


def _blocks(spark, sf_dir):
    return heap.alloc_blocks(d.findings(spark, sf_dir))


_BLOCKS = d.FINDINGS_CTE + """, blocks AS (SELECT scan_id, ord,
  CAST(row_number() OVER (PARTITION BY scan_id ORDER BY ord) - 1 AS BIGINT) AS alloc_id,
  '0x' || lower(to_hex(ord * 16)) AS address, coalesce(bytes_leaked, 0) AS size, f0 AS alloc_func,
  split_part(file, '/', 2) AS alloc_file, line AS alloc_line, 'malloc' AS alloc_via,
  CASE WHEN bug_type = 'use_after_free' THEN f0 END AS free_func, bug_type = 'memory_leak' AS leaked, bug_type,
  f0 || ';' || f1 || ';' || f2 AS chain, f1, f2
FROM findings_d)
"""


@query(
    _BLOCKS
    + """SELECT scan_id, ord, alloc_id, CASE WHEN ord = 0 THEN '0x0' ELSE address END AS address, size, alloc_func, alloc_file, alloc_line,
  alloc_via, free_func, leaked, chain FROM blocks"""
)
def alloc_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select(
        "scan_id", "ord", "alloc_id", "address", "size", "alloc_func", "alloc_file", "alloc_line",
        "alloc_via", "free_func", "leaked", F.array_join("ownership_chain", ";").alias("chain"),
    )


@query(
    _BLOCKS
    + """SELECT scan_id, alloc_func, CAST(sum(size) AS BIGINT) AS total, count(*) AS count,
  count(*) FILTER (leaked) AS leaked, CAST(sum(CASE WHEN leaked THEN size ELSE 0 END) AS BIGINT) AS leaked_bytes
FROM blocks GROUP BY 1, 2"""
)
def function_rollup(spark, sf_dir):
    return heap.function_rollup(_blocks(spark, sf_dir))


@query(
    _BLOCKS
    + """, r AS (SELECT scan_id, alloc_func, CAST(sum(size) AS BIGINT) AS total, sum(CASE WHEN leaked THEN size ELSE 0 END) AS leaked_bytes
  FROM blocks GROUP BY 1, 2)
SELECT scan_id, alloc_func, total, round(total / sum(total) OVER (PARTITION BY scan_id) * 100, 4) AS share,
  CASE WHEN leaked_bytes / greatest(total, 1) > 0.5 THEN 'mostly_leaked' WHEN leaked_bytes > 0 THEN 'partly_leaked' ELSE 'freed' END AS leak_band
FROM r QUALIFY total / sum(total) OVER (PARTITION BY scan_id) * 100 >= 2"""
)
def treemap(spark, sf_dir):
    return heap.treemap(heap.function_rollup(_blocks(spark, sf_dir))).select(
        "scan_id", "alloc_func", "total", "share", "leak_band"
    )


@query(
    _BLOCKS
    + """SELECT scan_id, CAST(sum(size) AS BIGINT) AS total_alloc, CAST(sum(CASE WHEN leaked THEN size ELSE 0 END) AS BIGINT) AS total_leaked,
  count(*) FILTER (leaked) AS leak_count, count(*) FILTER (NOT leaked) AS freed_count,
  round(sum(CASE WHEN leaked THEN size ELSE 0 END) / sum(size) * 100, 1) AS leak_pct FROM blocks GROUP BY 1"""
)
def leak_totals(spark, sf_dir):
    return heap.leak_totals(_blocks(spark, sf_dir))


@query(
    """WITH b AS (SELECT 'o' || o_custkey % 5 AS scan_id, o_orderkey AS alloc_id, CAST(floor(o_totalprice) AS BIGINT) AS size,
  o_orderstatus = 'F' AS leaked, o_orderpriority AS func FROM orders),
x AS (SELECT scan_id, CAST(alloc_id AS DOUBLE) AS x, size AS delta, 'alloc' AS type, func, size FROM b
  UNION ALL SELECT scan_id, alloc_id + 0.5, -size, 'free', func, size FROM b WHERE NOT leaked)
SELECT scan_id, x, CAST(sum(delta) OVER (PARTITION BY scan_id ORDER BY x) AS BIGINT) AS y, type, func, size FROM x"""
)
def heap_profile(spark, sf_dir):
    """Orders as blocks of five scans: finished orders leak, the others are freed."""
    blocks = d.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), (F.col("o_custkey") % 5).cast("string")).alias("scan_id"),
        F.col("o_orderkey").alias("alloc_id"),
        F.floor("o_totalprice").cast("bigint").alias("size"),
        (F.col("o_orderstatus") == "F").alias("leaked"),
        F.col("o_orderpriority").alias("alloc_func"),
        F.col("o_orderpriority").alias("free_func"),
    )
    return heap.heap_profile(blocks)


@query(
    d.MEMORY_EVENTS_CTE
    + """SELECT event_id, CAST(sum(delta_bytes) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS heap_bytes,
  CAST(sum(CASE WHEN op = 'malloc' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS allocations
FROM memory_events_d"""
)
def heap_running(spark, sf_dir):
    return heap.heap_running(d.memory_events(spark, sf_dir)).select("event_id", "heap_bytes", "allocations")


@query(
    d.MEMORY_EVENTS_CTE
    + """, b AS (SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS t, sum(delta_bytes) AS delta, count(*) FILTER (op = 'malloc') AS made
  FROM memory_events_d GROUP BY 1)
SELECT strftime(t, '%Y-%m-%d') AS t, CAST(sum(delta) OVER (ORDER BY t) AS BIGINT) AS heap_bytes, CAST(sum(made) OVER (ORDER BY t) AS BIGINT) AS allocations FROM b"""
)
def heap_timeline(spark, sf_dir):
    out = heap.heap_timeline(d.memory_events(spark, sf_dir), "1 day")
    return out.select(F.date_format("t", "yyyy-MM-dd").alias("t"), "heap_bytes", "allocations")


@query(
    d.MEMORY_EVENTS_CTE
    + """, r AS (SELECT *, CAST(sum(delta_bytes) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS heap FROM memory_events_d)
SELECT (SELECT max(heap) FROM r) AS peak_bytes, (SELECT event_id FROM r ORDER BY heap DESC, ts, event_id LIMIT 1) AS peak_event,
  (SELECT heap FROM r ORDER BY ts DESC, event_id DESC LIMIT 1) AS leaked_bytes,
  (SELECT count(*) FROM r WHERE op = 'malloc') AS total_allocations"""
)
def heap_peak(spark, sf_dir):
    return heap.heap_peak(d.memory_events(spark, sf_dir)).select(
        "peak_bytes", "peak_event", "leaked_bytes", "total_allocations"
    )


@query(d.FLAME_CTE + "SELECT * FROM flame_d")
def flame_totals(spark, sf_dir):
    return heap.flame_totals(d.flames(spark, sf_dir))


@query(
    d.FLAME_CTE
    + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY bytes DESC, stack) AS rank FROM flame_d) WHERE rank <= 5"
)
def top_flames(spark, sf_dir):
    return heap.top_flames(d.flames(spark, sf_dir), 5)


@query(
    d.FLAME_CTE
    + """, parts AS (SELECT scan_id, bytes, CAST(i - 1 AS INTEGER) AS depth, split_part(stack, ';', CAST(i AS INTEGER)) AS function
  FROM flame_d, range(1, 4) r(i)),
cells AS (SELECT scan_id, depth, function, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts GROUP BY 1, 2, 3)
SELECT *, round(bytes / sum(bytes) OVER (PARTITION BY scan_id, depth) * 100, 4) AS share FROM cells
QUALIFY bytes / sum(bytes) OVER (PARTITION BY scan_id, depth) * 100 >= 1"""
)
def flame_layers(spark, sf_dir):
    return heap.flame_layers(d.flames(spark, sf_dir))


@query(
    d.FLAME_CTE
    + """, sums AS (SELECT scan_id, function, CAST(sum(bytes) AS BIGINT) AS peak_bytes FROM
  (SELECT scan_id, bytes, unnest(string_split(stack, ';')) AS function FROM flame_d) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY peak_bytes DESC, function) AS rank FROM sums) WHERE rank <= 15"""
)
def function_bytes_from_flame(spark, sf_dir):
    return heap.function_bytes_from_flame(d.flames(spark, sf_dir))


@query(
    """SELECT * FROM (SELECT s_nationkey AS nation, s_suppkey AS site_no, CAST(floor(s_acctbal) AS BIGINT) AS peak_bytes,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(floor(s_acctbal) AS BIGINT) DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3"""
)
def top_sites(spark, sf_dir):
    sites = d.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("scan_id"), F.col("s_suppkey").alias("site_no"), F.floor("s_acctbal").cast("bigint").alias("peak_bytes")
    )
    return heap.top_sites(sites, 3).withColumnRenamed("scan_id", "nation")


@query(
    _BLOCKS
    + """, ch AS (SELECT scan_id, size, leaked, unnest(['0', '1', '2']) AS pos, unnest([alloc_func, f1, f2]) AS function FROM blocks)
SELECT scan_id, function, count(*) FILTER (pos = '0') AS allocs, CAST(sum(CASE WHEN pos = '0' THEN size ELSE 0 END) AS BIGINT) AS bytes,
  count(*) FILTER (pos = '0' AND leaked) AS leaked, count(*) FILTER (pos = '0' AND NOT leaked) AS freed FROM ch GROUP BY 1, 2"""
)
def ownership_nodes(spark, sf_dir):
    return heap.ownership_nodes(_blocks(spark, sf_dir))


@query(
    _BLOCKS
    + "SELECT DISTINCT scan_id, alloc_func AS source, f1 AS target FROM blocks UNION SELECT DISTINCT scan_id, f1, f2 FROM blocks"
)
def ownership_edges(spark, sf_dir):
    return heap.ownership_edges(_blocks(spark, sf_dir))


@query(
    """SELECT * FROM (SELECT 'h' || l_suppkey % 3 AS scan_id, 's' || l_suppkey || '.py' AS file, l_linenumber AS line,
  CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS size, count(*) AS count,
  row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY sum(CAST(floor(l_quantity) AS BIGINT)) DESC, count(*) DESC, 's' || l_suppkey || '.py', l_linenumber) AS rank
FROM lineitem GROUP BY l_suppkey, l_linenumber) WHERE rank <= 100"""
)
def allocation_by_line(spark, sf_dir):
    events = d.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("h"), (F.col("l_suppkey") % 3).cast("string")).alias("scan_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file"),
        F.col("l_linenumber").alias("line"),
        F.floor("l_quantity").cast("bigint").alias("size"),
    )
    return heap.allocation_by_line(events, 100)


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS line_no, CAST(sum(CASE WHEN regexp_matches(text, '^[A-M]') THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM l"""
)
def block_fill(spark, sf_dir):
    lines = d.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    lines = lines.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "text")
    return heap.block_fill(lines, ["doc_id"], [F.asc("line_no")], F.col("text").rlike("^[A-M]")).drop("text")


@query(
    """SELECT o_orderkey, round(greatest(4.0, o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderpriority) * 100), 4) AS bar_width FROM orders"""
)
def bar_width(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return stats.bar_width(rows, "o_totalprice", 4, ["o_orderpriority"]).select("o_orderkey", "bar_width")
