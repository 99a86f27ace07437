"""Aggregates over findings and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlake import dims, scale
from defectlake.functions import findings as ff


def scan_stats(df: DataFrame) -> DataFrame:
    """Per scan: findings, total bytes leaked, and counts by defect type and severity."""
    # One shuffle of (scan, type, severity) partial counts; both maps come from its small result.
    cells = df.groupBy("scan_id", "bug_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bytes_leaked", F.lit(0))).alias("bytes")
    )
    by_type = cells.groupBy("scan_id", "bug_type").agg(
        F.sum("n").alias("n"),
        F.sum("bytes").alias("bytes"),
        *[
            F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(s)
            for s in dims.SEVERITIES
        ],
    )
    entries = F.array_sort(F.collect_list(F.struct("bug_type", "n")))
    sums = [F.sum(s).alias(s) for s in dims.SEVERITIES]
    severities = F.array(
        *[F.struct(F.lit(s).alias("key"), F.col(s).alias("n")) for s in dims.SEVERITIES]
    )
    return (
        by_type.groupBy("scan_id")
        .agg(
            F.sum("n").alias("total"),
            F.sum("bytes").alias("total_bytes_leaked"),
            F.map_from_entries(entries).alias("error_count_by_type"),
            *sums,
        )
        .select(
            "scan_id",
            "total",
            "total_bytes_leaked",
            "error_count_by_type",
            F.map_filter(
                F.map_from_entries(severities), lambda _, n: n > 0
            ).alias("error_count_by_severity"),
        )
    )


def scan_stats_sets(df: DataFrame) -> DataFrame:
    """The same counts in long form: by scan, by (scan, type), by (scan, severity)."""
    view = df.select("scan_id", "bug_type", "severity", "bytes_leaked")
    sets = view.groupingSets(
        [["scan_id"], ["scan_id", "bug_type"], ["scan_id", "severity"]],
        "scan_id",
        "bug_type",
        "severity",
    )
    return sets.agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum(F.coalesce("bytes_leaked", F.lit(0))).alias("bytes_leaked"),
    )


def funnel_counts(parsed: DataFrame, max_errors: int | None = None) -> DataFrame:
    """Per scan: parsed, unique and listed findings (``capped``: at most ``max_errors`` if given)."""
    # Distinct fingerprints are folded first, so a hot scan never sits in one count-distinct task.
    prints = parsed.groupBy("scan_id", "fingerprint").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(
            (F.col("bug_type") == "unknown") & F.col("primary_location").isNull(),
            F.struct(ff.severity_rank(F.col("severity")), F.col("ord")),
        ).alias("bare"),
    )
    listed = F.count_if(~F.col("bare"))
    return prints.groupBy("scan_id").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("unique"),
        (listed if max_errors is None else F.least(listed, F.lit(max_errors))).alias("capped"),
    )


def parsed_per_tool(parsed: DataFrame) -> DataFrame:
    """Per scan and tool: parsed findings."""
    return parsed.groupBy("scan_id", "tool").agg(F.count(F.lit(1)).alias("error_count"))


def scan_history(scans: DataFrame, findings: DataFrame, limit: int = 20) -> DataFrame:
    """Newest scans first with their total, critical and high counts."""
    counts = findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )
    newest = keep_latest(scans.select("scan_id", "started_at"), "started_at", limit, tie="scan_id")
    zero = F.lit(0).cast("bigint")
    return newest.join(counts, "scan_id", "left").select(
        "scan_id",
        "started_at",
        *[F.coalesce(c, zero).alias(c) for c in ("total", "critical", "high")],
    )


def keep_latest(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The newest ``n`` rows (take-ordered: each task keeps n)."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def share_of_total(
    df: DataFrame, value: str, keys: list[str], name: str = "share", digits: int = 4
) -> DataFrame:
    """``value`` as a percentage of its key's total (0 when the total is 0)."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    share = F.when(F.col("__total") != 0, F.col(value) / F.col("__total") * 100).otherwise(0.0)
    joined = scale.salted_lookup(df, totals, keys, salt=df.columns, how="inner")
    return joined.withColumn(name, F.round(share, digits)).drop("__total")


def bar_width(
    df: DataFrame, value: str, floor: float, keys: list[str], name: str = "bar_width"
) -> DataFrame:
    """``value`` as a percentage of its key's maximum, at least ``floor``."""
    tops = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    width = F.greatest(
        F.lit(float(floor)), F.col(value) / F.coalesce(F.nullif("__top", F.lit(0)), F.lit(1)) * 100
    )
    joined = scale.salted_lookup(df, tops, keys, salt=df.columns, how="inner")
    return joined.withColumn(name, F.round(width, 4)).drop("__top")


def session_progress(sessions: DataFrame) -> DataFrame:
    """Per session: total, completed, skipped and remaining steps."""
    done = F.size(F.filter("steps", lambda s: F.coalesce(s["completed"], F.lit(False))))
    skipped = F.size(F.filter("steps", lambda s: F.coalesce(s["skipped"], F.lit(False))))
    total = F.greatest(F.size("steps"), F.lit(0))
    return sessions.select(
        "session_id",
        "scan_id",
        "error_id",
        total.alias("total_steps"),
        done.alias("completed"),
        skipped.alias("skipped"),
        (total - done - skipped).alias("remaining"),
        "git_branch",
        "state",
    )


def corpus_language(files: DataFrame, path: str = "path") -> DataFrame:
    """Majority language of a corpus by extension; ties go to C, C++, Python, Rust in that order."""
    order = {"c": 0, "cpp": 1, "python": 2, "rust": 3}
    ext = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    counts = (
        files.select("corpus_id", dims.lookup(dims.CORPUS_LANGUAGE, ext).alias("language"))
        .groupBy("corpus_id", "language")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.when(F.col("language").isNotNull(), F.struct(F.col("n"), -dims.lookup(order, F.col("language"))))
    return counts.groupBy("corpus_id").agg(
        F.coalesce(F.max_by("language", known), F.lit("c")).alias("language")
    )
