"""Streams give what a batch gives, however the input is cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlake import scale
from defectlake.catalog import derived as d
from defectlake.streaming import jobs as streams

from .conftest import rows


def _stream(spark, df, files):
    path = scale.scratch_path(spark, "in")
    df.repartition(files).write.parquet(path)
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


def test_stats_in_one_or_many_batches(spark, sf_dir):
    found = d.findings(spark, sf_dir).select("scan_id", "bug_type", "severity", "bytes_leaked", "discovered_at")
    keys = ["scan_id", "bug_type", "severity"]
    batch = rows(streams.stream_scan_stats(found))
    for files in (1, 5):
        updates = streams.run_to_table(streams.stream_scan_stats(_stream(spark, found, files)), "stats", "update")
        assert rows(streams.latest_rows(updates, keys), *keys, "findings", "bytes_leaked") == batch


def test_late_rows_are_dropped(spark):
    def part(path, *data):
        df = spark.createDataFrame(list(data), "ts STRING, process_id BIGINT, op STRING, delta_bytes BIGINT")
        df = df.withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
        return df.schema

    path, sink = scale.scratch_path(spark, "late"), scale.scratch_path(spark, "sink")

    def run(schema):
        usage = streams.stream_heap_usage(spark.readStream.schema(schema).parquet(path), "1 hour", delay="10 minutes")
        query = (
            usage.writeStream.format("parquet").option("path", f"{sink}/data").option("checkpointLocation", f"{sink}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run(part(path, ("2024-01-01 00:10:00", 1, "malloc", 5), ("2024-01-01 03:00:00", 1, "malloc", 7)))
    run(part(path, ("2024-01-01 00:20:00", 1, "malloc", 100), ("2024-01-01 06:00:00", 1, "free", -7)))
    got = rows(spark.read.parquet(f"{sink}/data"), "net_bytes")
    assert got == [(5,), (7,)]  # the row of 00:20 came after its window had closed


def test_live_objects(spark):
    data = [
        (1, "0xa", "malloc", 8, "2024-01-01 00:00:01", 1), (1, "0xa", "free", 0, "2024-01-01 00:00:02", 2),
        (1, "0xb", "free", 0, "2024-01-01 00:00:03", 3),
        (1, "0xc", "malloc", 4, "2024-01-01 00:00:04", 4), (1, "0xc", "free", 0, "2024-01-01 00:00:05", 5), (1, "0xc", "free", 0, "2024-01-01 00:00:06", 6),
        (2, "0xa", "malloc", 4, "2024-01-01 00:00:07", 7), (2, "0xa", "realloc", 16, "2024-01-01 00:00:08", 8),
    ]
    df = spark.createDataFrame(data, "process_id BIGINT, address STRING, op STRING, size BIGINT, ts STRING, seq BIGINT")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    updates = streams.run_to_table(streams.stream_live_objects(_stream(spark, df, 1)), "live", "update")
    got = rows(streams.latest_rows(updates, ["process_id", "address"]))
    assert [r[:8] for r in got] == [
        (1, "0xa", False, 0, 1, 1, 0, 0),
        (1, "0xb", False, 0, 0, 1, 0, 1),
        (1, "0xc", False, 0, 1, 2, 1, 0),
        (2, "0xa", True, 16, 1, 0, 0, 0),
    ]


EVENTS = "process_id BIGINT, address STRING, op STRING, size BIGINT, ts TIMESTAMP, seq BIGINT"


def _append(spark, path, df):
    """Add a file and return the stream of all files so far."""
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_live_objects_with_late_events_over_batches(spark):
    import random

    from defectlake.operators import heap

    rng = random.Random(5)
    data = [(1 + i % 2, f"0x{rng.randrange(4)}", rng.choice(["malloc", "free", "realloc"]), rng.randrange(90), 1_700_000_000 + 20 * i, i) for i in range(90)]
    moved = sorted(data, key=lambda r: r[4] + rng.randrange(500))  # up to eight minutes late
    df = spark.createDataFrame(moved, EVENTS.replace("ts TIMESTAMP", "ts BIGINT")).withColumn("ts", F.timestamp_seconds("ts"))
    want = rows(heap.live_objects(df), "process_id", "address", "live", "size", "mallocs", "frees", "double_frees", "unmatched_frees")
    path, run = scale.scratch_path(spark, "late"), scale.scratch_path(spark, "run")
    for start in range(0, 90, 30):
        part = spark.createDataFrame(moved[start : start + 30], EVENTS.replace("ts TIMESTAMP", "ts BIGINT")).withColumn("ts", F.timestamp_seconds("ts"))
        stream = streams.stream_live_objects(_append(spark, path, part))
        updates = streams.run_to_table(stream, "live", "update", path=run)
    got = streams.latest_rows(updates, ["process_id", "address"])
    assert rows(got, "process_id", "address", "live", "size", "mallocs", "frees", "double_frees", "unmatched_frees") == want


def test_live_objects_share_state_rows(spark):
    """Blocks of one part don't mix, and there are as many state rows as parts, however many blocks."""
    import random

    from defectlake.operators import heap

    rng = random.Random(7)
    data = [(1 + i % 3, f"0x{rng.randrange(40)}", rng.choice(["malloc", "free", "realloc"]), rng.randrange(90), 1_700_000_000 + 9 * i, i) for i in range(400)]
    moved = sorted(data, key=lambda r: r[4] + rng.randrange(500))
    cols = ("process_id", "address", "live", "size", "mallocs", "frees", "double_frees", "unmatched_frees")

    def frame(part):
        return spark.createDataFrame(part, EVENTS.replace("ts TIMESTAMP", "ts BIGINT")).withColumn("ts", F.timestamp_seconds("ts"))

    path, run, listener = scale.scratch_path(spark, "late"), scale.scratch_path(spark, "run"), streams.ProgressListener()
    for start in (0, 200):
        stream = streams.stream_live_objects(_append(spark, path, frame(moved[start : start + 200])), parts=3)
        updates = streams.run_to_table(stream, "live", "update", path=run, listener=listener)
    assert rows(streams.latest_rows(updates, ["process_id", "address"]), *cols) == rows(heap.live_objects(frame(moved)), *cols)
    progress = spark.read.schema(streams.PROGRESS_DDL).parquet(f"{run}/progress")
    assert progress.agg(F.max("state_rows")).first()[0] == 3


def test_leading_edge_and_progress(spark):
    def part(*seconds):
        data = [("p", 1_700_000_000 + s, f"f{s}") for s in seconds]
        return spark.createDataFrame(data, "project STRING, ts BIGINT, path STRING").withColumn("ts", F.timestamp_seconds("ts"))

    parts = part(0, 1, 1), part(3, 2, 6, 6), part(5, 70, 71), part(200)
    found = []
    for cuts in (1, 4):
        path, run, listener = scale.scratch_path(spark, "in"), scale.scratch_path(spark, "run"), streams.ProgressListener()
        whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        for df in (whole,) if cuts == 1 else parts:
            stream = streams.debounce_leading(_append(spark, path, df), "3 seconds")
            out = streams.run_to_table(stream, "requests", path=run, listener=listener)
        found.append(rows(out.select((F.unix_timestamp("request_at") - 1_700_000_000).alias("at"), "paths"), "at", "paths"))
        progress = spark.read.schema(streams.PROGRESS_DDL).parquet(f"{run}/progress")
        assert progress.agg(F.sum("input_rows")).first()[0] == 11
        # only the last change waits; the state of what came before has ended
        assert progress.orderBy(F.desc("batch")).first()["state_rows"] == 1
    assert found[0] == found[1] == sorted([(0, ["f0"]), (3, ["f3"]), (6, ["f6", "f6"]), (70, ["f70"])], key=str)


def test_best_finding_over_batches(spark, sf_dir):
    found = d.findings(spark, sf_dir)
    base = scale.scratch_path(spark, "best")
    streams.run_best_findings(_stream(spark, found, 4), f"{base}/t", f"{base}/s").awaitTermination()
    from defectlake.operators.findings import dedupe_findings

    assert rows(streams.best_findings(spark, f"{base}/t"), "scan_id", "fingerprint", "ord") == rows(
        dedupe_findings(found), "scan_id", "fingerprint", "ord"
    )
    # one folder per part is named by the last commit, and folders that none names are gone
    commit = streams._commit(spark, f"{base}/t")
    assert set(streams._names(f"{base}/t/data")) <= set(commit.values()) | set(streams._commit(spark, f"{base}/t", 3).values()) | {3}
    assert len(streams.best_findings(spark, f"{base}/t").inputFiles()) <= len(commit) * 8
