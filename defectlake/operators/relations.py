"""Joins of findings with each other and with analyses, sessions, recordings and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake import scale
from defectlake.functions.text import basename
from defectlake.operators.findings import cap_findings

#: width of the line buckets of the same-place join; lines closer than this meet in one or the next
NEAR_LINES = 5


def relate_findings(df: DataFrame, max_findings: int | None = None) -> DataFrame:
    """Related pairs (a before b in priority order) that share a user function.

    All findings of a scan are related, or its first ``max_findings`` in priority order if given.
    Where a scan has very many findings of one function, :func:`related_groups` gives a coarser view
    without a row for every pair. A pair is the first of: same_root_cause (same file, lines less than 5 apart), masks (leak before a
    use-after-free), amplifies (race before anything).

    Each kind is its own equi-join, so only pairs that can be related are formed: near lines meet
    through (scan, file, line bucket), the others through (scan, function) with the leading
    finding restricted to leaks or races.
    """
    # small rows that are used on both sides of three joins: written once
    needed = df.select("scan_id", "ord", "id", "severity", "bytes_leaked", "bug_type", "primary_location", "stack")
    listed = cap_findings(needed, max_findings).select(
        "scan_id",
        F.col("rank").alias("pos"),
        "id",
        "bug_type",
        F.col("primary_location.file").alias("file"),
        F.coalesce("primary_location.line", F.lit(0)).alias("line"),
        _functions().alias("functions"),
    )
    listed = scale.materialise(listed, "listed")
    names = ("pos", "id", "bug_type", "file", "line", "functions")
    a = listed.select("scan_id", *[F.col(c).alias(f"a_{c}") for c in names])
    b = listed.select("scan_id", *[F.col(c).alias(f"b_{c}") for c in names])
    ordered = F.col("a_pos") < F.col("b_pos")

    bucket = F.floor(F.col("b_line") / NEAR_LINES)
    near = (
        a.where(F.col("a_file").isNotNull())
        .withColumn("file", F.col("a_file"))
        .withColumn("bucket", F.floor(F.col("a_line") / NEAR_LINES))
        .join(
            b.where(F.col("b_file").isNotNull())
            .withColumn("file", F.col("b_file"))
            .withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))),
            ["scan_id", "file", "bucket"],
        )
        .where(ordered & (F.abs(F.col("a_line") - F.col("b_line")) < NEAR_LINES))
        .where(F.arrays_overlap("a_functions", "b_functions"))
        .drop("file", "bucket")
    )
    close = F.coalesce(
        (F.col("a_file") == F.col("b_file"))
        & (F.abs(F.col("a_line") - F.col("b_line")) < NEAR_LINES),
        F.lit(False),
    )

    def through_function(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = F.array_intersect("a_functions", "b_functions")
        return (
            left.withColumn("fn", F.explode("a_functions"))
            .join(right.withColumn("fn", F.explode("b_functions")), ["scan_id", "fn"])
            .where(ordered & ~close)
            # a pair that shares several functions meets once per function: keep the first
            .where(F.col("fn") == F.array_min(shared))
            .drop("fn")
        )

    leaks = F.col("a_bug_type") == "memory_leak"
    races = F.col("a_bug_type") == "race_condition"
    masks = through_function(a.where(leaks), b.where(F.col("b_bug_type") == "use_after_free"))
    amplifies = through_function(a.where(races), b)

    shared = F.array_join(F.array_sort(F.array_intersect("a_functions", "b_functions")), ", ")

    def emit(pairs: DataFrame, kind: str, text: Column) -> DataFrame:
        return pairs.select(
            "scan_id",
            "a_pos",
            "b_pos",
            F.substring("a_id", 1, 8).alias("from_id"),
            F.substring("b_id", 1, 8).alias("to_id"),
            F.lit(kind).alias("relationship"),
            text.alias("explanation"),
        )

    # The sentences of the explanations.
    return (
        emit(
            near,
            "same_root_cause",
            F.concat(
                F.lit("Both near line "), F.col("a_line").cast("string"), F.lit(" in "),
                basename(F.col("a_file")), F.lit(" ("), shared, F.lit(")"),
            ),
        )
        .unionByName(
            emit(masks, "masks", F.concat(F.lit("Leak in "), shared, F.lit(" may hide the UAF")))
        )
        .unionByName(
            emit(
                amplifies,
                "amplifies",
                F.concat(F.lit("Race makes "), F.col("b_bug_type"), F.lit(" non-deterministic")),
            )
        )
    )


def _functions() -> Column:
    """User functions of a stack, distinct and sorted."""
    names = F.transform("stack", lambda f: f["function"])
    return F.array_sort(
        F.array_distinct(F.filter(names, lambda fn: F.coalesce(~fn.isin("main", "??", ""), F.lit(False))))
    )


def related_groups(df: DataFrame) -> DataFrame:
    """Findings that may be related, as groups: a row per group and member, so the rows grow with the findings.

    Groups are coarser than the pairs of :func:`relate_findings`: lines of one group are up to nine apart where a pair's are
    less than five, and neither priority order nor a nearer relation of the same two findings is looked at.

    A group is a scan, a function and a kind: ``same_root_cause`` with a file and a bucket of five lines, whose
    members lie in it or in the next one; ``masks`` with leaks as leaders and uses after free as members;
    ``amplifies`` with races as leaders and the other findings as members. Groups without both sides (for
    ``same_root_cause``, of one finding) are left out.
    """
    bucket = F.floor(F.coalesce("primary_location.line", F.lit(0)) / NEAR_LINES)
    file, bug = F.col("primary_location.file"), F.col("bug_type")

    def entry(kind: str, place: Column | None, number: Column | None, leads: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit("") if place is None else place).alias("file"),
            (F.lit(-1) if number is None else number).cast("bigint").alias("bucket"),
            leads.alias("leads"),
        )

    entries = F.array_compact(
        F.array(
            F.when(file.isNotNull(), entry("same_root_cause", file, bucket, F.lit(True))),
            F.when(file.isNotNull(), entry("same_root_cause", file, bucket - 1, F.lit(False))),
            F.when(bug == "memory_leak", entry("masks", None, None, F.lit(True))),
            F.when(bug == "use_after_free", entry("masks", None, None, F.lit(False))),
            entry("amplifies", None, None, bug == "race_condition"),
        )
    )
    key = ["scan_id", "function", "kind", "file", "bucket"]
    members = (
        df.select("scan_id", "ord", "id", F.explode(_functions()).alias("function"), entries.alias("entries"))
        .select("scan_id", "function", F.inline("entries"), "ord", "id")
    )
    sides = members.groupBy(*key).agg(F.count_if("leads").alias("leaders"), F.count_if(~F.col("leads")).alias("others"))
    alone = F.col("kind") == "same_root_cause"
    whole = sides.where(
        (F.col("leaders") > 0) & F.when(alone, F.col("leaders") + F.col("others") > 1).otherwise(F.col("others") > 0)
    )
    # a function may be in a third of all stacks: the side of groups is small, and a hot group is split at run time
    whole = scale.materialise(whole, "groups")
    return members.join(whole.select(*key), key)


def limit_relationships(rels: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` relationships of every scan in list order."""
    order = [F.col("a_pos").asc(), F.col("b_pos").asc()]
    return scale.top_n(rels, ["scan_id"], order, n, salt=["a_pos", "b_pos"])


def findings_with_analysis(findings: DataFrame, analyses: DataFrame) -> DataFrame:
    """Left join on the finding's id; of several analyses the first by ``model`` text is taken."""
    rest = [c for c in analyses.columns if c not in ("scan_id", "error_id")]
    one = analyses.groupBy("error_id").agg(F.min_by(F.struct(*rest), F.col("model")).alias("analysis"))
    return findings.join(one.withColumnRenamed("error_id", "id"), "id", "left")


def findings_with_session(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Left join of debugging sessions on the finding's id."""
    cols = [F.col(c).alias(f"session_{c}" if c in findings.columns else c) for c in sessions.columns if c != "error_id"]
    return findings.join(sessions.select(F.col("error_id").alias("id"), *cols), "id", "left")


def match_recordings(scans: DataFrame, recordings: DataFrame, n: int = 5) -> DataFrame:
    """Recordings of the same program as the scan, the first ``n`` by descending recording id."""
    left = scans.select("scan_id", basename(F.col("binary")).alias("program"))
    # only the n newest recordings of a program can be in any scan's list, so cut before the join
    newest = scale.top_n(
        recordings.withColumn("program", basename(F.col("binary"))),
        ["program"],
        [F.desc("recording_id")],
        n,
        salt=["recording_id"],
        rank_col="place",
    )
    # one program may be behind a third of the scans
    return scale.salted_lookup(left, newest, ["program"], salt=["scan_id"], how="inner").drop("binary")


def annotate_custom_roles(calls: DataFrame, summaries: DataFrame) -> DataFrame:
    """Calls of validated custom allocators and deallocators, with role and note text."""
    roles = summaries.where(F.col("validated")).select("name", "role", "target").distinct()
    named = roles.withColumnRenamed("name", "callee")
    # a popular allocator is called from everywhere
    hits = scale.salted_lookup(calls, named, ["callee"], salt=["function"], how="inner")
    return hits.withColumn(
        "note", note_of(F.col("callee"), F.col("role"), F.col("target"))
    )


def note_of(name: Column, role: Column, target: Column) -> Column:
    """'f() → returns heap memory via return' or 'f() → frees arg0'."""
    return F.when(
        role == "Allocator", F.concat(name, F.lit("() → returns heap memory via "), target)
    ).otherwise(F.concat(name, F.lit("() → frees "), target))
