"""Scan-to-scan comparison by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake import scale
from defectlake.functions.text import with_commas
from defectlake.operators.findings import with_fingerprint


def last_per_fingerprint(df: DataFrame) -> DataFrame:
    """One row per fingerprint, the last one reported."""
    df = df if "fingerprint" in df.columns else with_fingerprint(df)
    return scale.first_by(df, ["fingerprint"], -F.col("ord"))


def diff_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both scans with ``status`` new, fixed or persistent (persistent shows B's row)."""
    left, right = last_per_fingerprint(a), last_per_fingerprint(b)
    cols = [c for c in left.columns if c in right.columns and c != "fingerprint"]
    pair = left.select("fingerprint", F.struct(*cols).alias("a")).join(
        right.select("fingerprint", F.struct(*cols).alias("b")), "fingerprint", "full_outer"
    )
    status = (
        F.when(F.col("a").isNull(), F.lit("new"))
        .when(F.col("b").isNull(), F.lit("fixed"))
        .otherwise(F.lit("persistent"))
    )
    return pair.select(
        "fingerprint", status.alias("status"), F.coalesce("b", "a").alias("row")
    ).select("fingerprint", "status", "row.*")


def new_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings of B whose fingerprint A lacks.

    Fingerprints are compared first, with the place of the last report alone, so whole rows are only folded of what is new.
    """
    left, right = (df if "fingerprint" in df.columns else with_fingerprint(df) for df in (a, b))
    last = right.groupBy("fingerprint").agg(F.max("ord").alias("ord"))
    new = last.join(left.select("fingerprint").distinct(), "fingerprint", "left_anti")
    on = [right["fingerprint"] == new["fingerprint"], right["ord"].eqNullSafe(new["ord"])]
    return last_per_fingerprint(right.join(new, on, "left_semi"))


def fixed_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings of A whose fingerprint B lacks."""
    return new_findings(b, a)


def persistent_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings of B whose fingerprint A has."""
    return last_per_fingerprint(b).join(
        last_per_fingerprint(a).select("fingerprint"), "fingerprint", "left_semi"
    )


def _compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of totals over both scans; copies are folded per fingerprint before the shuffle."""

    def side(df, mark):
        df = df if "fingerprint" in df.columns else with_fingerprint(df)
        sign = 1 if mark == "b" else -1
        rows = F.count(F.lit(1))
        return df.groupBy("fingerprint").agg(
            (rows if mark == "a" else F.lit(0)).cast("bigint").alias("in_a"),
            (rows if mark == "b" else F.lit(0)).cast("bigint").alias("in_b"),
            (F.sum(F.coalesce("bytes_leaked", F.lit(0))) * sign).alias("delta"),
        )

    keys = (
        side(a, "a")
        .unionByName(side(b, "b"))
        .groupBy("fingerprint")
        .agg(
            F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"), F.sum("delta").alias("delta")
        )
    )
    zero = F.lit(0).cast("bigint")
    return keys.agg(
        F.count_if(F.col("in_a") == 0).alias("new_bugs"),
        F.count_if(F.col("in_b") == 0).alias("fixed_bugs"),
        F.count_if((F.col("in_a") > 0) & (F.col("in_b") > 0)).alias("persistent_bugs"),
        F.coalesce(F.sum("delta"), zero).alias("bytes_delta"),
        F.coalesce(F.sum("in_a"), zero).alias("rows_a"),
        F.coalesce(F.sum("in_b"), zero).alias("rows_b"),
    )


def diff_summary(a: DataFrame, b: DataFrame, a_id: str = "A", b_id: str = "B") -> DataFrame:
    """One row: counts, byte delta over all rows, regression flag and the summary sentence."""
    return _compared(a, b).select(
        F.lit(a_id).alias("scan_a"),
        F.lit(b_id).alias("scan_b"),
        "new_bugs",
        "fixed_bugs",
        "persistent_bugs",
        "bytes_delta",
        (F.col("new_bugs") > F.col("fixed_bugs")).alias("regression"),
        summary_text(
            F.col("new_bugs"), F.col("fixed_bugs"), F.col("persistent_bugs"), F.col("bytes_delta")
        ).alias("summary"),
    )


def summary_text(new: Column, fixed: Column, persistent: Column, delta: Column) -> Column:
    """REGRESSION, IMPROVEMENT, MIXED or UNCHANGED sentence."""
    plus = F.when(delta > 0, F.lit("+")).otherwise(F.lit(""))
    # The sentences of the summary.
    return (
        F.when(
            (new > 0) & (fixed == 0),
            F.concat(F.lit("REGRESSION: "), new.cast("string"), F.lit(" new bug(s) introduced")),
        )
        .when(
            (fixed > 0) & (new == 0),
            F.concat(F.lit("IMPROVEMENT: "), fixed.cast("string"), F.lit(" bug(s) fixed")),
        )
        .when(
            (new > 0) & (fixed > 0),
            F.concat(
                F.lit("MIXED: "), fixed.cast("string"), F.lit(" fixed, "), new.cast("string"),
                F.lit(" new ("), plus, with_commas(delta), F.lit(" bytes)"),
            ),
        )
        .otherwise(
            F.concat(F.lit("UNCHANGED: "), persistent.cast("string"), F.lit(" persistent bug(s)"))
        )
    )


def verify_fix_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Did a fix work: something fixed and nothing new."""
    text = [F.col(c).cast("string") for c in ("fixed_bugs", "rows_a", "new_bugs", "persistent_bugs")]
    return _compared(before, after).select(
        F.col("rows_a").alias("original_errors"),
        F.col("rows_b").alias("remaining_errors"),
        F.col("fixed_bugs").alias("fixed_count"),
        F.col("new_bugs").alias("new_regressions"),
        ((F.col("fixed_bugs") > 0) & (F.col("new_bugs") == 0)).alias("verified"),
        F.concat(
            F.lit("Fixed "), text[0], F.lit(" of "), text[1], F.lit(" issues. "),
            text[2], F.lit(" regressions. "), text[3], F.lit(" remaining."),
        ).alias("details"),
    )
