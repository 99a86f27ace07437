"""Tables derived from the given parquet tables, for Spark and (as SQL text) for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake import schemas
from defectlake.operators.findings import with_fingerprint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# -- findings ---------------------------------------------------------------------------------
SPLIT_NTZ = "TIMESTAMP_NTZ '2024-01-16 00:00:00'"
_FINDINGS_SQL = """
SELECT event_id AS ord, ts,
  CASE WHEN ts < {split} THEN 'A' ELSE 'B' END AS scan_id,
  CASE event_id % 5 WHEN 0 THEN 'valgrind' WHEN 1 THEN 'helgrind' WHEN 2 THEN 'asan'
    WHEN 3 THEN 'infer' ELSE 'cppcheck' END AS tool,
  CASE k % 10 WHEN 0 THEN 'memory_leak' WHEN 1 THEN 'use_after_free' WHEN 2 THEN 'double_free'
    WHEN 3 THEN 'buffer_overflow' WHEN 4 THEN 'null_deref' WHEN 5 THEN 'race_condition'
    WHEN 6 THEN 'uninit_read' WHEN 7 THEN 'invalid_free' WHEN 8 THEN 'stack_overflow'
    ELSE 'unknown' END AS bug_type,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high'
    WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN k % 10 = 0 THEN CAST(floor(value * 100) AS BIGINT) END AS bytes_leaked,
  concat('src/m', u % 4, '.c') AS file, CAST(k % 10 + 1 AS INT) AS line,
  concat('fn_', u) AS f0, concat('fn_', k % 5) AS f1, 'main' AS f2
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CASE WHEN ts < {split} AND user_id % 8 = 3 THEN 2 WHEN ts >= {split} AND user_id % 8 = 5 THEN 4
    ELSE user_id % 8 END AS u FROM {events}) e
"""

#: oracle view of the findings with the fingerprint; every oracle that needs it starts with this
FINDINGS_CTE = (
    "WITH RECURSIVE base_d AS (" + _FINDINGS_SQL.format(split="TIMESTAMP '2024-01-16 00:00:00'", events="events")
    + """), findings_d AS (
SELECT *,
  substr(sha256('BugType.' || upper(bug_type) || ':AnalysisTool.' || upper(tool) || ':'
    || f0 || '@' || file || ':' || line || ':' || f1 || '@' || file || ':' || line || ':'
    || f2 || '@' || file || ':' || line), 1, 16) AS fp,
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3
    ELSE 4 END AS sev_rank
FROM base_d), deduped_d AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, fp ORDER BY sev_rank, ord) AS dup_rank
  FROM findings_d) WHERE dup_rank = 1), ranked_d AS (
SELECT *, row_number() OVER (PARTITION BY scan_id
  ORDER BY sev_rank, coalesce(bytes_leaked, 0) DESC, file, ord) AS rank FROM deduped_d)
"""
)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of scans A and B with nested stacks and their fingerprint."""
    flat = spark.sql(
        _FINDINGS_SQL.format(split=SPLIT_NTZ, events="{events}"),
        events=table(spark, sf_dir, "events"),
    )
    stack = F.array(
        *[
            schemas.frame(
                F.lit(i),
                address=F.concat(F.lit("0x"), F.lower(F.hex(F.col("ord") * 16 + i))) if i == 0 else None,
                function=F.col(f"f{i}"),
                file=F.col("file"),
                line=F.col("line"),
            )
            for i in range(3)
        ]
    )
    full = schemas.conform(
        flat,
        language=F.lit("c"),
        message=F.concat_ws(" ", "tool", "bug_type"),
        stack=stack,
        primary_location=schemas.location(F.col("file"), F.col("line")),
        alloc_count=F.when(F.col("bytes_leaked").isNotNull(), F.lit(1)),
        discovered_at=F.col("ts").cast("timestamp"),
    )
    return with_fingerprint(full)


# -- mitigations ------------------------------------------------------------------------------
MITIGATIONS_SQL = """
SELECT s AS scan_id, i, n AS name, CASE WHEN s = 'A' THEN i % 2 = 0 ELSE i % 3 > 0 END AS enabled
FROM (SELECT DISTINCT scan_id AS s FROM {findings}) x
CROSS JOIN (SELECT * FROM (VALUES (0,'PIE'),(1,'Stack Canary'),(2,'NX (No-Execute)'),(3,'RELRO'),
  (4,'FORTIFY_SOURCE'),(5,'Sanitizer'),(6,'Debug Info'),(7,'ASLR (System)')) t2(i, n)) y
"""


def mitigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight mitigations per scan that occurs in the findings."""
    from defectlake import dims

    names = list(dims.MITIGATION_WEIGHTS)
    scans = findings(spark, sf_dir).select("scan_id").distinct()
    each = scans.select(
        "scan_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "name")
    )
    return each.withColumn(
        "enabled", F.when(F.col("scan_id") == "A", F.col("i") % 2 == 0).otherwise(F.col("i") % 3 > 0)
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per day of findings: the day is the scan."""
    day = F.date_format("discovered_at", "yyyy-MM-dd")
    return (
        findings(spark, sf_dir)
        .groupBy(day.alias("scan_id"))
        .agg(F.min("discovered_at").alias("started_at"))
    )


# -- memory events ----------------------------------------------------------------------------
MEMORY_EVENTS_CTE = """
WITH memory_events_d AS (
SELECT event_id, ts, user_id AS process_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'free' ELSE 'malloc' END AS op,
  CASE WHEN event_type IN ('view', 'click') THEN -1 ELSE 1 END * CAST(floor(value * 100) AS BIGINT) AS delta_bytes,
  concat('fn_', user_id % 8) AS function
FROM events)
"""


def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signed allocation event per row."""
    freed = F.col("event_type").isin("view", "click")
    size = F.floor(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.lit("heap").alias("scan_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("process_id"),
        F.when(freed, F.lit("free")).otherwise(F.lit("malloc")).alias("op"),
        F.when(freed, -size).otherwise(size).alias("delta_bytes"),
        F.concat(F.lit("fn_"), (F.col("user_id") % 8).cast("string")).alias("function"),
    )


# -- flame stacks -----------------------------------------------------------------------------
FLAME_CTE = FINDINGS_CTE + """, flame_d AS (
SELECT scan_id, concat(f2, ';', f1, ';', f0) AS stack, CAST(sum(bytes_leaked) AS BIGINT) AS bytes
FROM findings_d WHERE bytes_leaked IS NOT NULL GROUP BY 1, 2)
"""


def flames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root-first stacks of the leaking findings with their bytes."""
    names = F.transform(F.reverse("stack"), lambda f: f["function"])
    return (
        findings(spark, sf_dir)
        .where(F.col("bytes_leaked").isNotNull())
        .groupBy("scan_id", F.array_join(names, ";").alias("stack"))
        .agg(F.sum("bytes_leaked").alias("bytes"))
    )


# -- call graph -------------------------------------------------------------------------------
CALL_EDGES_CTE = """
call_edges_d AS (
SELECT p_partkey AS a, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS b, 'param' AS kind FROM part
UNION ALL
SELECT p_partkey AS a, (p_partkey * 13 + 5) % (SELECT count(*) FROM part) AS b, 'return' AS kind FROM part)
"""


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic graph of out-degree two over the parts: corpus_id, source_func, target_func, edge_type."""
    return spark.sql(
        """
        SELECT 'parts' AS corpus_id, concat('fn_', a) AS source_func, concat('fn_', b) AS target_func,
               kind AS edge_type
        FROM (
          SELECT p_partkey AS a, (p_partkey * 7 + 3) % (SELECT count(*) FROM {part}) AS b, 'param' AS kind FROM {part}
          UNION ALL
          SELECT p_partkey AS a, (p_partkey * 13 + 5) % (SELECT count(*) FROM {part}) AS b, 'return' AS kind FROM {part})
        """,
        part=table(spark, sf_dir, "part"),
    )
