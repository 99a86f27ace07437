"""Known-vulnerability matching, mitigation scoring and exploitability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake import dims, scale
from defectlake.functions import findings as ff
from defectlake.functions.text import basename


def match_cve(findings: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """CVEs whose group shares a defect type with the scan's findings."""
    # Fixed 161-row table; a given table is joined without a hint.
    table = dims.cve_patterns(findings.sparkSession) if patterns is None else patterns
    rank = {s: i for i, s in enumerate(reversed(dims.SEVERITIES))}
    types = findings.groupBy("scan_id", "bug_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce(dims.lookup(rank, F.col("severity")), F.lit(0))).alias("worst"),
    )
    groups = table.select("group_id", "bug_types").distinct()
    member = groups.select("group_id", F.explode("bug_types").alias("bug_type"))

    def meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        # few types and groups: a table of the user is met over salts, the fixed one is broadcast
        if patterns is None:
            return left.join(F.broadcast(right), key)
        return scale.salted_lookup(left, right, [key], salt=["scan_id"], how="inner")

    hits = (
        meet(types, member, "bug_type")
        .groupBy("scan_id", "group_id")
        .agg(
            F.sum("n").alias("matching_bugs"),
            F.max("worst").alias("worst"),
            F.array_sort(F.collect_set("bug_type")).alias("matched_types"),
        )
    )
    names = F.array(*[F.lit(s) for s in reversed(dims.SEVERITIES)])
    return meet(hits, table, "group_id").select(
        "scan_id",
        "group_id",
        "pos",
        "cve_id",
        "name",
        "similarity",
        "description",
        "affected_software",
        "exploit_likelihood",
        "cvss_score",
        "matching_bugs",
        F.get(F.col("bug_types"), F.lit(0)).alias("group_bug_type"),
        F.array_join("matched_types", ",").alias("matched_types"),
        F.get(names, F.col("worst")).alias("your_severity"),
    )


def top_cves(matches: DataFrame, n: int = 3) -> DataFrame:
    """Most similar first; equal similarity keeps table order."""
    order = [F.desc("similarity"), F.asc("pos")]
    return scale.top_n(matches, ["scan_id"], order, n, salt=["pos"])


def _disabled(mitigations: DataFrame) -> DataFrame:
    """Per scan: the sorted set of known mitigations that are off."""
    off = F.collect_set(F.when(~F.col("enabled"), F.col("name")))
    return mitigations.groupBy("scan_id").agg(F.array_sort(off).alias("__off"))


def correlate_exploitability(findings: DataFrame, mitigations: DataFrame) -> DataFrame:
    """Per finding of a mitigable type: missing mitigations, exploitability and scenario."""
    # One row per scan (at most eight names), so every finding meets one row; hot scans are salted.
    off = _disabled(mitigations)
    by_type: dict[str, list[tuple[str, str]]] = {}
    for bug, name, text in dims.MITIGATION_RELEVANCE:
        by_type.setdefault(bug, []).append((name, text))
    relevant = F.create_map(
        *[
            x
            for bug, items in by_type.items()
            for x in (
                F.lit(bug),
                F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in items]),
            )
        ]
    )
    known = findings.where(F.col("bug_type").isin(*by_type))
    joined = scale.salted_lookup(known, off, ["scan_id"], salt=["ord"])
    off_names = F.coalesce(F.col("__off"), F.array().cast("array<string>"))
    missing = F.filter(
        F.try_element_at(relevant, F.col("bug_type")), lambda m: F.array_contains(off_names, m["name"])
    )
    n = F.size("__missing")
    bug = F.col("bug_type")
    loc = F.col("primary_location")
    return (
        joined.withColumn("__missing", missing)
        .select(
            "scan_id",
            "ord",
            F.substring("id", 1, 8).alias("bug_id"),
            "bug_type",
            F.when(
                loc.isNotNull(), F.concat_ws(":", basename(loc["file"]), loc["line"].cast("string"))
            )
            .otherwise(F.lit(""))
            .alias("bug_location"),
            "severity",
            F.transform(
                "__missing", lambda m: F.concat(m["name"], F.lit(": "), m["text"])
            ).alias("missing_mitigations"),
            exploitability(bug, n).alias("exploitability"),
            scenario(bug, off_names).alias("attack_scenario"),
            F.transform("__missing", lambda m: m["name"]).alias("would_prevent"),
        )
    )


def exploitability(bug: Column, missing: Column) -> Column:
    """Label from the defect type and the number of its missing mitigations."""

    def label(*steps: tuple[int, str], default: str) -> Column:
        out = F.when(F.lit(False), "")
        for low, name in steps:
            out = out.when(missing >= low, name)
        return out.otherwise(F.lit(default))

    return (
        F.when(
            bug.isin("buffer_overflow", "stack_overflow"),
            label((3, "TRIVIAL"), (2, "LIKELY"), (1, "POSSIBLE"), default="UNLIKELY"),
        )
        .when(bug == "use_after_free", label((2, "LIKELY"), default="POSSIBLE"))
        .when(bug == "double_free", label((1, "LIKELY"), default="POSSIBLE"))
        .when(bug == "null_deref", label((1, "POSSIBLE"), default="UNLIKELY"))
        .when(bug == "race_condition", F.lit("POSSIBLE"))
        .otherwise(F.lit("UNLIKELY"))
    )


def scenario(bug: Column, off_names: Column) -> Column:
    """Report text of the defect type with a sentence per missing mitigation."""
    out = F.when(F.lit(False), "")
    for kind, template in dims.SCENARIOS.items():
        parts: list[Column] = []
        rest = template
        while "{" in rest:
            text, _, rest = rest.partition("{")
            key, _, rest = rest.partition("}")
            name, sentence = dims.SCENARIO_PARTS[key]
            parts.append(F.lit(text))
            parts.append(
                F.when(F.array_contains(off_names, name), F.lit(sentence)).otherwise(F.lit(""))
            )
        parts.append(F.lit(rest))
        out = out.when(bug == kind, F.trim(F.concat(*parts)))
    return out.otherwise(F.lit(""))


def rank_exploits(correlations: DataFrame) -> DataFrame:
    """Most exploitable first, report order among equals."""
    return correlations.orderBy("scan_id", ff.exploit_rank(F.col("exploitability")), "ord")


def hardening_score(mitigations: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Per scan: weighted sum of the enabled mitigations and its grade."""
    if weights is None:
        points = F.coalesce(dims.lookup(dims.MITIGATION_WEIGHTS, F.col("name")), F.lit(0))
        scored = mitigations.withColumn("points", points)
    else:
        points = weights.select("name", F.col("weight").alias("points"))
        scored = scale.salted_lookup(mitigations, points, ["name"], salt=["scan_id"])
    score = F.sum(F.when(F.col("enabled"), F.coalesce("points", F.lit(0))).otherwise(0))
    out = scored.groupBy("scan_id").agg(score.cast("bigint").alias("hardening_score"))
    grade = F.when(F.lit(False), "")
    for low, name in dims.GRADES:
        grade = grade.when(F.col("hardening_score") >= low, name)
    return out.withColumn("grade", grade.otherwise(F.lit("F")))


def mitigation_matrix(mitigations: DataFrame) -> DataFrame:
    """Wide form: one column per mitigation."""
    names = list(dims.MITIGATION_WEIGHTS)
    return mitigations.groupBy("scan_id").pivot("name", names).agg(F.max("enabled"))


def critical_findings(correlations: DataFrame, mitigations: DataFrame) -> DataFrame:
    """Headline sentences per scan in report order."""
    counts = correlations.groupBy("scan_id").agg(
        F.count_if(F.col("exploitability") == "TRIVIAL").alias("trivial"),
        F.count_if(F.col("exploitability") == "LIKELY").alias("likely"),
    )
    lines = F.array(
        # The sentences of the list.
        F.struct(
            F.lit(0).alias("pos"),
            F.when(
                F.col("trivial") > 0,
                F.concat(
                    F.lit("CRITICAL: "), F.col("trivial").cast("string"),
                    F.lit(" bug(s) are TRIVIALLY exploitable due to missing mitigations"),
                ),
            ).alias("text"),
        ),
        F.struct(
            F.lit(1).alias("pos"),
            F.when(
                F.col("likely") > 0,
                F.concat(
                    F.lit("WARNING: "), F.col("likely").cast("string"),
                    F.lit(" bug(s) are LIKELY exploitable"),
                ),
            ).alias("text"),
        ),
    )
    from_bugs = counts.select("scan_id", F.inline(lines)).where(F.col("text").isNotNull())
    order = {name: i + 2 for i, name in enumerate(dims.MITIGATION_WEIGHTS)}
    detail = F.col("detail") if "detail" in mitigations.columns else F.lit("")
    from_flags = mitigations.where(
        ~F.col("enabled") & F.col("name").isin(*dims.HEADLINE_MITIGATIONS)
    ).select(
        "scan_id",
        dims.lookup(order, F.col("name")).alias("pos"),
        F.concat(F.col("name"), F.lit(" DISABLED — "), detail).alias("text"),
    )
    return from_bugs.unionByName(from_flags)


def recommended_flags(mitigations: DataFrame) -> DataFrame:
    """Distinct build flags of the disabled mitigations per scan, in first-seen order."""
    order = {name: i for i, name in enumerate(dims.MITIGATION_WEIGHTS)}
    flags = (
        F.col("compiler_flag")
        if "compiler_flag" in mitigations.columns
        else dims.lookup(dims.MITIGATION_FLAGS, F.col("name"))
    )
    off = mitigations.where(~F.col("enabled") & ~F.col("name").isin(*dims.FLAG_EXEMPT))
    each = off.select(
        "scan_id",
        (F.coalesce(dims.lookup(order, F.col("name")), F.lit(99)) * 100).alias("base"),
        F.posexplode(F.split(flags, " ")).alias("i", "flag"),
    )
    first = (
        each.where(F.col("flag") != "")
        .groupBy("scan_id", "flag")
        .agg(F.min(F.col("base") + F.col("i")).alias("pos"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "flag")))
    return first.groupBy("scan_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["flag"]), " ").alias("flags")
    )


def exploit_feasibility(
    findings: DataFrame, mitigations: DataFrame, has_input: Column, controls_pointer: Column
) -> DataFrame:
    """Boolean feasibility of each finding given the scan's missing mitigations."""
    joined = scale.salted_lookup(findings, _disabled(mitigations), ["scan_id"], salt=["ord"])
    modelled = ("PIE", "Stack Canary", "NX (No-Execute)", "ASLR (System)", "RELRO", "FORTIFY_SOURCE")
    off = F.coalesce(F.col("__off"), F.array().cast("array<string>"))

    def lacks(name):
        return F.array_contains(off, name)

    bug = F.col("bug_type")
    no_pie, no_canary = lacks("PIE"), lacks("Stack Canary")
    no_nx, no_aslr = lacks("NX (No-Execute)"), lacks("ASLR (System)")
    feasible = (
        F.when(
            bug.isin("buffer_overflow", "stack_overflow"),
            has_input & no_canary & (no_nx | (no_pie & no_aslr)),
        )
        .when(bug == "use_after_free", has_input & controls_pointer & (no_pie | no_aslr))
        .when(bug == "null_deref", has_input & no_aslr)
        .when(bug == "race_condition", has_input)
        .otherwise(F.lit(False))
    )
    missing = F.size("off")
    present = F.filter(F.array(*[F.lit(m) for m in modelled]), lambda m: ~F.array_contains("off", m))
    difficulty = (
        F.when(~F.col("exploitable"), F.lit("infeasible"))
        .when(missing >= 3, F.lit("trivial"))
        .when(missing >= 1, F.lit("moderate"))
        .otherwise(F.lit("hard"))
    )
    blocked = F.when(F.col("exploitable"), F.array().cast("array<string>")).otherwise(present)
    base = joined.withColumns({"off": off, "exploitable": F.coalesce(feasible, F.lit(False))})
    return base.select(
        "scan_id",
        "ord",
        "bug_type",
        "exploitable",
        difficulty.alias("difficulty"),
        missing.alias("missing_count"),
        F.array_join(blocked, ", ").alias("blocked_by"),
        F.concat(
            F.lit("Exploit "),
            F.when(F.col("exploitable"), F.lit("feasible")).otherwise(F.lit("blocked")),
            F.lit(": "), missing.cast("string"), F.lit(" mitigation(s) missing"),
            F.when(
                F.size(blocked) > 0, F.concat(F.lit(", blocked by "), F.array_join(blocked, ", "))
            ).otherwise(F.lit("")),
        ).alias("explanation"),
    )
