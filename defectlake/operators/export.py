"""Exports: SARIF, Markdown, suppressions and scan documents.

A scan may have any number of findings, so documents are made as ordered lines
``(scan_id, line_no, text)`` and written by sorted partitions; no document is put together in one
row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake import dims, scale, schemas
from defectlake.functions import findings as ff
from defectlake.functions.text import nonempty
from defectlake.operators.findings import rank_order
from defectlake.operators.stats import scan_stats

TOOL_NAME = "defectlake"
SARIF_HEAD = (
    '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", '
    '"runs": [{"tool": {"driver": {"name": "' + TOOL_NAME + '"}}, "results": ['
)
SARIF_TAIL = "]}]}"


def sarif_result(df: DataFrame) -> Column:
    """SARIF result object of a finding as JSON text."""
    loc = F.col("primary_location")
    place = F.struct(
        F.struct(
            F.struct(loc["file"].alias("uri")).alias("artifactLocation"),
            F.struct(F.coalesce(loc["line"], F.lit(1)).alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    level = F.coalesce(dims.lookup(dims.SARIF_LEVELS, F.col("severity")), F.lit("warning"))
    return F.to_json(
        F.struct(
            F.col("bug_type").alias("ruleId"),
            level.alias("level"),
            F.struct(F.col("message").alias("text")).alias("message"),
            F.when(loc.isNotNull(), F.array(place)).otherwise(F.slice(F.array(place), 1, 0)).alias("locations"),
        )
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding."""
    return findings.select("scan_id", "ord", sarif_result(findings).alias("result"))


#: what the priority order reads
_ORDER = ("scan_id", "ord", "severity", "bytes_leaked", "primary_location")


def _scan_sizes(findings: DataFrame, scans: DataFrame | None) -> DataFrame:
    """Number of findings of each scan; with ``scans`` also of those that have none."""
    counts = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    if scans is None:
        return counts
    every = scans.select("scan_id").distinct().join(counts, "scan_id", "full")
    return every.select("scan_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def export_sarif(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Lines of one SARIF document per scan, results in priority order; an empty one for scans without findings."""
    needed = findings.select(*_ORDER, "bug_type", "message")
    placed = scale.ordered_position(needed, ["scan_id"], rank_order(), "line_no")
    comma = F.when(F.col("line_no") > 1, F.lit(",")).otherwise(F.lit(""))
    body = placed.select(
        "scan_id", "line_no", F.concat(comma, sarif_result(placed)).alias("text")
    )
    ends = F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit(SARIF_HEAD).alias("text")),
        F.struct((F.col("n") + 1).alias("line_no"), F.lit(SARIF_TAIL).alias("text")),
    )
    frame = _scan_sizes(findings, scans)
    return body.unionByName(frame.select("scan_id", F.inline(ends)))


def export_markdown(
    findings: DataFrame, analyses: DataFrame | None = None, scans: DataFrame | None = None
) -> DataFrame:
    """Blocks of one Markdown report per scan: block 0 is the summary, then one per finding.

    With ``scans``, scans without findings have their summary too.
    """
    needed = findings.select(*_ORDER, "id", "bug_type", "tool", "message")
    placed = scale.ordered_position(needed, ["scan_id"], rank_order(), "line_no")
    if analyses is not None:
        one = analyses.groupBy(F.col("error_id").alias("id")).agg(
            F.min_by(F.struct("root_cause", "fixes"), F.col("model")).alias("__a")
        )
        placed = placed.join(one, "id", "left")
        fixes = F.transform(
            F.coalesce("__a.fixes", F.array().cast(f"ARRAY<{schemas.CODE_FIX}>")),
            lambda x: F.concat_ws(
                "\n",
                F.concat(F.lit("**Fix**: "), x["description"]),
                F.when(nonempty(x["diff"]), F.concat(F.lit("```diff\n"), x["diff"], F.lit("\n```"))),
            ),
        )
        advice = F.when(
            F.col("__a").isNotNull(),
            F.concat_ws(
                "\n",
                F.concat(F.lit("**Root cause**: "), F.col("__a.root_cause"), F.lit("\n")),
                F.when(F.size(fixes) > 0, F.array_join(fixes, "\n")),
            ),
        )
    else:
        advice = F.lit(None).cast("string")
    place = F.coalesce(ff.location_text(F.col("primary_location")), F.lit("unknown"))
    block = F.concat_ws(
        "\n",
        F.concat(
            F.lit("### "), F.col("line_no").cast("string"), F.lit(". "), F.col("bug_type"),
            F.lit(" — "), F.col("severity"),
        ),
        F.concat(F.lit("**Location**: `"), place, F.lit("`  ")),
        F.concat(F.lit("**Tool**: "), F.col("tool"), F.lit("  ")),
        F.concat(F.col("message"), F.lit("\n")),
        advice,
        F.lit(""),
    )
    body = placed.select("scan_id", "line_no", block.alias("text"))

    counts = scan_stats(findings)
    if scans is not None:
        counts = counts.join(scans.select("scan_id", "started_at", "duration_ms"), "scan_id", "full")
        when = F.concat(
            F.lit("**Date**: "), F.col("started_at").cast("string"), F.lit("  |  **Duration**: "),
            F.col("duration_ms").cast("string"), F.lit("ms\n"),
        )
    else:
        when = F.lit(None).cast("string")
    rows = F.filter(
        F.array(
            *[
                F.concat(
                    F.lit(f"| {s} | "),
                    F.try_element_at("error_count_by_severity", F.lit(s)).cast("string"),
                    F.lit(" |"),
                )
                for s in dims.SEVERITIES
            ]
        ),
        F.isnotnull,
    )
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# Defect report — "), F.col("scan_id")),
        when,
        F.lit("## Summary"),
        F.lit("| Severity | Count |"),
        F.lit("|----------|-------|"),
        F.coalesce(F.array_join(rows, "\n"), F.lit("")),
        F.lit("\n## Issues\n"),
    )
    return body.unionByName(
        counts.select("scan_id", F.lit(0).cast("bigint").alias("line_no"), head.alias("text"))
    )


def export_suppressions(findings: DataFrame, name_prefix: str = TOOL_NAME, scans: DataFrame | None = None) -> DataFrame:
    """Memcheck suppressions: block 0 is the header, then one block per memcheck finding.

    A suppression's number is the finding's place in the scan's whole list. With ``scans``, scans without findings
    have their header too.
    """
    needed = findings.select(*_ORDER, "bug_type", "tool", "stack")
    placed = scale.ordered_position(needed, ["scan_id"], rank_order(), "line_no")
    kind = F.coalesce(
        dims.lookup(dims.SUPPRESSION_KINDS, F.col("bug_type")), F.lit("Leak_DefinitelyLost")
    )
    name = F.concat_ws(
        "_",
        F.lit(name_prefix),
        F.array_join(F.slice(F.split("bug_type", "_"), 1, 2), "_"),
        F.col("line_no").cast("string"),
    )
    frames = F.array_compact(
        F.transform(
            F.slice(F.coalesce("stack", F.array().cast(schemas.STACK)), 1, 6),
            lambda f: F.when(
                nonempty(f["function"]) & (f["function"] != "??"),
                F.concat(F.lit("   fun:"), f["function"]),
            ).when(nonempty(f["module"]), F.concat(F.lit("   obj:"), f["module"])),
        )
    )
    text = F.array_join(
        F.concat(
            F.array(
                F.lit("{"),
                F.concat(F.lit("   <"), name, F.lit(">")),
                F.concat(F.lit("   Memcheck:"), kind),
            ),
            frames,
            F.array(F.lit("}"), F.lit("")),
        ),
        "\n",
    )
    body = placed.where(F.col("tool") == "valgrind").select("scan_id", "line_no", text.alias("text"))
    head = _scan_sizes(findings, scans).select(
        "scan_id",
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat(
            F.lit(f"# Auto-generated by {TOOL_NAME}\n# "), F.col("n").cast("string"),
            F.lit(" suppression(s)\n"),
        ).alias("text"),
    )
    return body.unionByName(head)


def export_json(scans: DataFrame) -> DataFrame:
    """One JSON document per scan row."""
    return scans.select("scan_id", F.to_json(F.struct(*scans.columns)).alias("value"))


def finding_documents(findings: DataFrame) -> DataFrame:
    """One JSON document per finding (JSON lines)."""
    return findings.select("scan_id", "ord", F.to_json(F.struct(*findings.columns)).alias("value"))


def write_document_lines(lines: DataFrame, path: str) -> None:
    """Write exported lines as text below ``scan_id=…``; the files of a scan read in name order."""
    ordered = lines.repartitionByRange("scan_id", "line_no").sortWithinPartitions("scan_id", "line_no")
    ordered.select("scan_id", "text").write.partitionBy("scan_id").text(path)


def write_scans(findings: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64) -> None:
    """Persist findings in ``buckets`` folders by a hash of the scan, sorted by scan within a file.

    However many scans there are, a write makes at most ``buckets`` times SALTS files; a hot scan is written by
    many tasks, and a reader of one scan skips the other folders by ``bucket`` and row groups by ``scan_id``.
    """
    spread = (
        findings.withColumns({"bucket": scan_bucket(F.col("scan_id"), buckets), "__salt": scale.salt_of("ord")})
        .repartition("bucket", "__salt")
        .sortWithinPartitions("bucket", "scan_id", "ord")
    )
    spread.drop("__salt").write.partitionBy("bucket").format(fmt).save(path)


def scan_bucket(scan_id: Column, buckets: int = 64) -> Column:
    """Folder number of a scan's findings."""
    return F.pmod(F.xxhash64(scan_id), F.lit(buckets)).cast("int")
