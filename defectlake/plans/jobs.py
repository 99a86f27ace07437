"""The three whole jobs: scan, taint and report on stored scans.

A job materialises the tables that several of its steps read and returns frames; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from defectlake import scale
from defectlake.operators import (
    corpus,
    diff,
    enrich,
    export,
    findings as fo,
    graph,
    relations,
    security,
    stats,
)
from defectlake.sources.reports import read_reports


def run_scan(
    raw_reports: DataFrame,
    max_errors: int | None = None,
    symbols: DataFrame | None = None,
    source_lines: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Reports to ranked, enriched findings with statistics; all findings unless ``max_errors`` is given."""
    read = read_reports(raw_reports)
    parsed = read["findings"]
    unique = fo.drop_uninformative(fo.dedupe_findings(parsed))
    listed = fo.cap_findings(unique, max_errors)
    if symbols is not None:
        listed = enrich.resolve_frames(listed, symbols)
    listed = fo.with_primary_location(listed)
    if source_lines is not None:
        listed = enrich.attach_source_context(listed, source_lines)
        listed = enrich.attach_frame_snippets(listed, source_lines)
    listed = scale.materialise(fo.with_language(listed), "listed")
    return {
        "findings": listed,
        "rejected": read["rejected"],
        "funnel": stats.funnel_counts(parsed, max_errors),
        "per_tool": stats.parsed_per_tool(parsed),
        "stats": stats.scan_stats(listed),
    }


def taint_state(sources_corpus: DataFrame) -> dict[str, DataFrame]:
    """Functions, input sources, data flow (``edges`` and ``hubs``) and tainted variables of a source corpus.

    Function bodies are read once for the facts and once for the inputs; the later joins read the stored,
    narrow fact table.
    """
    functions = scale.materialise(corpus.extract_functions(sources_corpus), "functions")
    facts = corpus.extract_flow_facts(functions)
    for name in ("calls", "call_args", "globals_read", "globals_written"):
        facts[name] = scale.materialise(facts[name], name)
    facts = graph.with_call_facts(functions, facts)
    inputs = scale.materialise(corpus.find_taint_sources(functions), "inputs")
    relations = graph.flow_relations(functions, facts)
    flows = scale.materialise(relations["edges"], "flows")
    hubs = scale.materialise(relations["hubs"], "hubs")
    tainted = graph.propagate_taint(
        graph.taint_seeds(inputs, facts), graph.taint_rules(functions, facts, flows)
    )
    return {
        "functions": functions,
        "sources": inputs,
        "edges": flows,
        "hubs": hubs,
        "calls": graph.call_edges(facts),
        "tainted": tainted,
    }


def run_taint(
    sources_corpus: DataFrame, findings: DataFrame, max_depth: int | None = None
) -> dict[str, DataFrame]:
    """Source corpus and findings (with ``corpus_id``) to ranked attack paths, of any length unless ``max_depth`` is given."""
    state = taint_state(sources_corpus)
    every = state["calls"].unionByName(state["edges"].select(*state["calls"].columns))
    paths = graph.taint_paths(state["sources"], findings, every, state["tainted"], max_depth, state["hubs"])
    paths = scale.materialise(graph.flow_description(graph.score_taint_paths(paths)), "paths")
    return {
        **state,
        "paths": paths,
        "top_paths": graph.rank_taint_paths(paths),
        "size": graph.graph_size(
            state["edges"], state["calls"], state["functions"], state["tainted"], state["hubs"]
        ),
        "summary": graph.taint_summary(
            paths, state["sources"], state["tainted"], findings, state["functions"]
        ),
    }


def run_report(findings: DataFrame, mitigations: DataFrame) -> dict[str, DataFrame]:
    """Security and export tables of stored findings."""
    correlations = scale.materialise(
        security.correlate_exploitability(findings, mitigations), "correlations"
    )
    matches = security.match_cve(findings)
    return {
        "cves": matches,
        "top_cves": security.top_cves(matches),
        "correlations": security.rank_exploits(correlations),
        "score": security.hardening_score(mitigations),
        "critical": security.critical_findings(correlations, mitigations),
        "flags": security.recommended_flags(mitigations),
        "relationships": relations.relate_findings(findings),
        "sarif": export.export_sarif(findings),
        "markdown": export.export_markdown(findings),
        "suppressions": export.export_suppressions(findings),
    }


def run_diff(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Two scans compared."""
    return {"rows": diff.diff_findings(a, b), "summary": diff.diff_summary(a, b)}
