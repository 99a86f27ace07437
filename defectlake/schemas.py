"""Column types of the tables the operators exchange.

Every table carries ``scan_id`` (or ``corpus_id``); ``ord`` is a BIGINT that is unique within a
scan and stands for the position a finding had in its report, so that every "first" and every tie
has one answer however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME = (
    "STRUCT<index: INT, address: STRING, function: STRING, file: STRING, line: INT, `column`: INT, "
    "module: STRING, inlined: BOOLEAN, snippet: STRING, snippet_start_line: INT>"
)
STACK = f"ARRAY<{FRAME}>"
LOCATION = "STRUCT<file: STRING, line: INT, `column`: INT>"
ALLOCATION = f"STRUCT<size: BIGINT, count: BIGINT, stack: {STACK}, kind: STRING>"
SOURCE_CONTEXT = (
    f"STRUCT<location: {LOCATION}, before_lines: ARRAY<STRING>, target_line: STRING, "
    "after_lines: ARRAY<STRING>, language: STRING, function_body: STRING, function_start_line: INT, "
    "snippet_start_line: INT, full_file_content: STRING>"
)

#: canonical finding columns in order, name -> SQL type
FINDING = {
    "scan_id": "STRING",
    "ord": "BIGINT",
    "id": "STRING",
    "tool": "STRING",
    "language": "STRING",
    "bug_type": "STRING",
    "severity": "STRING",
    "message": "STRING",
    "detail": "STRING",
    "stack": STACK,
    "primary_location": LOCATION,
    "source_context": SOURCE_CONTEXT,
    "allocation_info": ALLOCATION,
    "free_info": ALLOCATION,
    "bytes_leaked": "BIGINT",
    "bytes_lost": "BIGINT",
    "alloc_count": "BIGINT",
    "suppressed": "BOOLEAN",
    "duplicate_of": "STRING",
    "discovered_at": "TIMESTAMP",
}

FINDING_DDL = ", ".join(f"{name} {kind}" for name, kind in FINDING.items())

CODE_FIX = (
    "STRUCT<fix_id: STRING, description: STRING, diff: STRING, find_text: STRING, "
    "replace_text: STRING, confidence: STRING, pattern: STRING, breaking_change: BOOLEAN, "
    "applicable: BOOLEAN, status: STRING>"
)
BEST_PRACTICE = "STRUCT<title: STRING, explanation: STRING, example: STRING, bad_example: STRING, references: ARRAY<STRING>>"
ANALYSIS_DDL = (
    "scan_id STRING, error_id STRING, model STRING, root_cause STRING, explanation STRING, "
    f"impact STRING, cwe_ids ARRAY<STRING>, fixes ARRAY<{CODE_FIX}>, "
    f"best_practices ARRAY<{BEST_PRACTICE}>, confidence STRING"
)
DEBUG_STEP = "STRUCT<step: INT, title: STRING, completed: BOOLEAN, skipped: BOOLEAN>"
SESSION_DDL = (
    f"session_id STRING, scan_id STRING, error_id STRING, steps ARRAY<{DEBUG_STEP}>, "
    "conversation ARRAY<MAP<STRING, STRING>>, backup_files MAP<STRING, STRING>, "
    "git_branch STRING, state STRING"
)
SCAN_DDL = (
    "scan_id STRING, state STRING, started_at TIMESTAMP, duration_ms BIGINT, binary STRING, "
    "total_bytes_leaked BIGINT, error_count_by_type MAP<STRING, BIGINT>, "
    "error_count_by_severity MAP<STRING, BIGINT>, raw_outputs MAP<STRING, STRING>, "
    f"errors ARRAY<STRUCT<{', '.join(f'{n}: {t}' for n, t in FINDING.items() if n != 'scan_id')}>>"
)
RAW_REPORT_DDL = "scan_id STRING, report_id BIGINT, tool STRING, output STRING"


def frame(
    index: Column,
    address: Column | None = None,
    function: Column | None = None,
    file: Column | None = None,
    line: Column | None = None,
    column: Column | None = None,
    module: Column | None = None,
) -> Column:
    """A stack frame struct with the canonical field order and types."""
    null = F.lit(None)
    return F.struct(
        index.cast("int").alias("index"),
        (null if address is None else address).cast("string").alias("address"),
        (null if function is None else function).cast("string").alias("function"),
        (null if file is None else file).cast("string").alias("file"),
        (null if line is None else line).cast("int").alias("line"),
        (null if column is None else column).cast("int").alias("column"),
        (null if module is None else module).cast("string").alias("module"),
        F.lit(False).alias("inlined"),
        null.cast("string").alias("snippet"),
        null.cast("int").alias("snippet_start_line"),
    )


def location(file: Column, line: Column, column: Column | None = None) -> Column:
    """A source location struct."""
    return F.struct(
        file.cast("string").alias("file"),
        line.cast("int").alias("line"),
        (F.lit(None) if column is None else column).cast("int").alias("column"),
    )


def conform(df, keep: tuple[str, ...] = (), **extra: Column):
    """Select the finding columns and those to ``keep``, filling absent ones with typed nulls and deriving ``id``."""
    df = df.withColumns(extra) if extra else df
    present = set(df.columns)
    out = []
    for name, kind in FINDING.items():
        if name == "id" and name not in present:
            col = finding_id(F.col("scan_id"), F.col("ord"))
        elif name == "suppressed" and name not in present:
            col = F.lit(False)
        elif name in present:
            col = F.col(name).cast(kind)
        else:
            col = F.lit(None).cast(kind)
        out.append(col.alias(name))
    return df.select(*out, *keep)


def finding_id(scan_id: Column, ord_: Column) -> Column:
    """Replayable identifier (the reference semantics only need it to be unique)."""
    return F.substring(F.sha2(F.concat_ws(":", scan_id, ord_.cast("string")), 256), 1, 32)
