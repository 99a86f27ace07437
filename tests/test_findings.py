"""Properties of the finding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlake import schemas
from defectlake.catalog import derived as d
from defectlake.functions.text import format_bytes, lenient_json, truncate
from defectlake.operators import diff, export, findings as fo, heap, relations, stats

from .conftest import rows


def test_dedupe_is_idempotent_and_winners_point_nowhere(spark, sf_dir):
    found = d.findings(spark, sf_dir)
    once = fo.dedupe_findings(found)
    assert rows(fo.dedupe_findings(once), "scan_id", "ord") == rows(once, "scan_id", "ord")
    marked = fo.mark_duplicates(found)
    assert marked.count() == found.count()
    assert marked.where("duplicate_of IS NULL").count() == once.count()


def test_diff_partitions_the_keys(spark, sf_dir):
    found = d.findings(spark, sf_dir)
    a, b = found.where("scan_id = 'A'"), found.where("scan_id = 'B'")
    keys = b.select("fingerprint").distinct().count()
    assert diff.new_findings(a, b).count() + diff.persistent_findings(a, b).count() == keys
    same = diff.diff_summary(a, a).first()
    assert (same["new_bugs"], same["fixed_bugs"], same["bytes_delta"], same["regression"]) == (0, 0, 0, False)
    assert same["summary"].startswith("UNCHANGED")
    assert diff.verify_fix_diff(b, b.limit(0)).first()["verified"]


def test_stats_add_up(spark, sf_dir):
    found = d.findings(spark, sf_dir)
    for row in stats.scan_stats(found).collect():
        assert sum(row["error_count_by_type"].values()) == row["total"]
        assert sum(row["error_count_by_severity"].values()) == row["total"]


def test_running_heap_ends_at_the_leaked_bytes(spark, sf_dir):
    blocks = heap.alloc_blocks(d.findings(spark, sf_dir))
    last = heap.heap_profile(blocks).groupBy("scan_id").agg(F.max_by("y", "x").alias("end"))
    kept = blocks.where("leaked OR free_func IS NULL").groupBy("scan_id").agg(F.sum("size").alias("kept"))
    assert rows(last, "scan_id", "end") == rows(kept, "scan_id", "kept")


def test_alloc_block_sites(spark):
    def frame(i, fn, file=None, line=None):
        return (i, None, fn, file, line, None, None, False, None, None)

    stack = [frame(0, "strdup"), frame(1, "_x"), frame(2, "user", "d/u.c", 7)]
    data = [
        ("s", 1, "use_after_free", "high", 5, stack, (5, 1, [frame(0, "malloc"), frame(1, "strdup"), *stack[1:]], None), None),
        ("s", 2, "memory_leak", "low", None, [frame(0, "??")], None, (1, 1, [frame(0, "rel", "d/f.c", 3)], "free")),
    ]
    df = spark.createDataFrame(
        data,
        f"scan_id STRING, ord BIGINT, bug_type STRING, severity STRING, bytes_leaked BIGINT, stack {schemas.STACK}, "
        f"allocation_info {schemas.ALLOCATION}, free_info {schemas.ALLOCATION}",
    ).withColumn("primary_location", F.lit(None).cast(schemas.LOCATION))
    got = rows(
        heap.alloc_blocks(df), "alloc_id", "address", "size", "alloc_via", "alloc_func", "alloc_file", "alloc_line",
        "free_func", "free_file", "leaked", "ownership_chain",
    )
    assert got == [
        (0, "0x0000", 5, "strdup", "user", "u.c", 7, "user", "u.c", False, ["_x", "user"]),
        (1, "0x0001", 0, "malloc", "??", "??", 0, "rel", "f.c", True, []),
    ]


def test_relations_follow_rank_order(spark, sf_dir):
    rels = relations.relate_findings(fo.dedupe_findings(d.findings(spark, sf_dir)))
    assert rels.where("a_pos >= b_pos").count() == 0
    assert rels.groupBy("scan_id", "a_pos", "b_pos").count().where("count > 1").count() == 0


def test_text_helpers(spark):
    df = spark.createDataFrame([(1536,), (1047527424,), (12,)], "n BIGINT")
    assert rows(df.select(format_bytes(F.col("n")))) == [("1.5 KB",), ("12 B",), ("999.0 MB",)]
    long = spark.range(1).select(truncate(F.lit("x" * 201), 200, ellipsis=True)).first()[0]
    assert len(long) == 200 and long.endswith("...")
    texts = ['```json\n{"a": "\\d \\\\d \\n"}\n```', 'so {"a": "q"} ok', "none", '{"a": "C:\\\\p"}']
    got = (
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
        .select("i", F.try_variant_get(lenient_json(F.col("t")), "$.a", "string").alias("a"))
        .orderBy("i")
        .collect()
    )
    assert [r["a"] for r in got] == ["\\d \\d \n", "q", None, "C:\\p"]


def test_exports_write_and_read_in_order(spark, sf_dir, tmp_path):
    found = fo.dedupe_findings(d.findings(spark, sf_dir))
    path = str(tmp_path / "sarif")
    export.write_document_lines(export.export_sarif(found), path)
    import json

    for scan in ("A", "B"):
        parts = sorted((tmp_path / "sarif" / f"scan_id={scan}").glob("*.txt"))
        doc = json.loads("".join(p.read_text() for p in parts))
        results = doc["runs"][0]["results"]
        assert len(results) == found.where(F.col("scan_id") == scan).count()
        assert results[0]["level"] == "error"
    export.write_scans(found, str(tmp_path / "scans"))
    assert spark.read.parquet(str(tmp_path / "scans")).count() == found.count()


def test_sarif_without_place(spark):
    df = spark.createDataFrame([("s", 1, "unknown", "info", "m", None)], f"scan_id STRING, ord BIGINT, bug_type STRING, severity STRING, message STRING, primary_location {schemas.LOCATION}")
    assert '"level":"none"' in export.sarif_results(df).first()["result"]
    assert '"locations":[]' in export.sarif_results(df).first()["result"]


def test_documents_of_scans_without_findings(spark, sf_dir):
    found = fo.dedupe_findings(d.findings(spark, sf_dir))
    scans = spark.createDataFrame(
        [("A", None, 5), ("empty", None, 7)], "scan_id STRING, started_at TIMESTAMP, duration_ms BIGINT"
    )
    sarif = export.export_sarif(found, scans).where("scan_id = 'empty'").orderBy("line_no").collect()
    assert [r.line_no for r in sarif] == [0, 1]
    assert export.export_markdown(found, scans=scans).where("scan_id = 'empty'").count() == 1
    head = export.export_suppressions(found, scans=scans).where("scan_id = 'empty'").first().text
    assert " 0 suppression(s)" in head
    assert export.export_sarif(found, scans).where("scan_id = 'B'").count() > 2
