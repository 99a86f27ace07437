"""Streaming operators.

Transformations take and give streaming (or batch) frames; ``run_*`` helpers attach sinks. State
is keyed by fine keys (scan and fingerprint, process and address), never by scan alone where rows
could pile up, and event time is a TIMESTAMP with a watermark wherever state must end.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from defectlake import scale
from defectlake.operators import findings as fo
from defectlake.sources.reports import ingest_reports


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Make the event time a TIMESTAMP (watermarks reject TIMESTAMP_NTZ); the session zone is UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_findings(raw: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Findings of a report stream, the first seen per (scan, fingerprint) within the watermark.

    ``raw`` has the report columns and ``discovered_at``. First seen is not most severe: for that
    use :func:`run_best_findings`.
    """
    found = ingest_reports(raw, per_report_dedup=False)
    return found.withWatermark("discovered_at", delay).dropDuplicatesWithinWatermark(
        ["scan_id", "fingerprint"]
    )


#: parts of a best-findings table; a micro-batch rewrites those that it touches
BEST_PARTS = 64


def run_best_findings(found: DataFrame, path: str, checkpoint: str, parts: int = BEST_PARTS):
    """Start a query that keeps the most severe finding per fingerprint in the table at ``path``.

    The table lies in ``parts`` hash parts. A micro-batch merges its winners into the parts that they touch, writes those
    under its own number and then a commit that says for every part which batch wrote it last. A repeated batch
    starts from the commit before it and so gives the same; folders that no recent commit names are deleted.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("part", F.pmod(F.xxhash64("scan_id", "fingerprint"), F.lit(parts)).cast("int"))
        winners = scale.materialise(fo.dedupe_findings(placed), "winners")
        touched = [r.part for r in winners.select("part").distinct().collect()]  # at most ``parts``
        before = _commit(spark, path, batch_id)
        old = _parts(spark, path, {p: b for p, b in before.items() if p in touched})
        both = winners if old is None else winners.unionByName(old)
        merged = fo.dedupe_findings(both)
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/batch={batch_id}")
        now = {**before, **{p: batch_id for p in touched}}
        rows = spark.createDataFrame(sorted(now.items()), "part INT, batch BIGINT").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")
        # readers of the commit before may still be at work; older ones are gone
        _delete_unnamed(path, set(now.values()) | set(before.values()) | {batch_id})

    return (
        found.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _names(folder: str) -> list[int]:
    """Numbers of the ``batch=`` folders in a folder."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith("batch="))


def _commit(spark, path: str, below: int | None = None) -> dict[int, int]:
    """Batch that wrote each part, by the last commit (of a batch before ``below``); a commit without its mark is none."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(f"{path}/commits")
    for batch in reversed(_names(f"{path}/commits")):
        done = system.get_file_info(f"{base}/batch={batch}/_SUCCESS").type == fs.FileType.File
        if done and (below is None or batch < below):
            return {r.part: r["batch"] for r in spark.read.schema("part INT, batch BIGINT").parquet(f"{path}/commits/batch={batch}").collect()}
    return {}


def _parts(spark, path: str, commit: dict[int, int]) -> DataFrame | None:
    """Rows of the parts that a commit names."""
    if not commit:
        return None
    folders = [f"{path}/data/batch={batch}/part={part}" for part, batch in sorted(commit.items())]
    rows = spark.read.option("basePath", f"{path}/data").parquet(*folders)
    return rows.drop("batch")


def _delete_unnamed(path: str, named: set[int]) -> None:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(f"{path}/data")
    for batch in _names(f"{path}/data"):
        if batch not in named:
            system.delete_dir(f"{base}/batch={batch}")


def best_findings(spark, path: str) -> DataFrame:
    """Current most severe finding per (scan, fingerprint): the parts of the last commit, nothing older."""
    rows = _parts(spark, path, _commit(spark, path))
    if rows is None:
        raise ValueError(f"no commit below {path}")
    return rows.drop("part")


#: kinds of progress events in the order a scan passes them
PROGRESS_KINDS = (
    "scan_start", "tool_done", "parse_done", "symbolize_done", "ai_start", "ai_progress", "ai_done",
    "complete", "error",
)


def stream_scan_progress(events: DataFrame) -> DataFrame:
    """State per scan: latest kind, tools done, errors, first and last event (update mode)."""
    kind = F.col("kind")
    return events.groupBy("scan_id").agg(
        F.max_by("kind", F.struct("ts", "kind")).alias("state"),
        F.count_if(kind == "tool_done").alias("tools_done"),
        F.count_if(kind == "error").alias("errors"),
        F.bool_or(kind == "complete").alias("complete"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("updated_at"),
    )


def debounce_changes(changes: DataFrame, gap: str = "2 seconds", delay: str = "1 minute") -> DataFrame:
    """One re-scan request per burst of changes of a project: a session that ends after ``gap``."""
    return (
        changes.withWatermark("ts", delay)
        .groupBy("project", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("changes"), F.min_by("path", F.struct("ts", "path")).alias("first_path"))
        .select(
            "project",
            F.col("session_window.start").alias("started_at"),
            F.col("session_window.end").alias("request_at"),
            "changes",
            "first_path",
        )
    )


REQUEST_DDL = "project STRING, request_at TIMESTAMP, changes BIGINT, paths ARRAY<STRING>"
_REQUEST_STATE = "last BIGINT, times ARRAY<BIGINT>, paths ARRAY<STRING>"


def _request_stepper(gap: int):
    """The state step of one project, made here so that it travels without this package."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, paths = state.get if state.exists else (None, [], [])
        waiting = list(zip(times, paths))
        if not state.hasTimedOut:
            for frame in batches:
                waiting += zip(frame["ts"].astype("datetime64[us]").astype("int64").tolist(), frame["path"].tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        ready: dict[int, list[str]] = {}
        for at, path in waiting:
            if at <= mark:
                ready.setdefault(at, []).append(path)
        waiting = [w for w in waiting if w[0] > mark]
        out = []
        for at in sorted(ready):
            if last is None or at - last >= gap:
                last = at
                out.append((*key, pd.Timestamp(at, unit="us"), len(ready[at]), sorted(ready[at])))
        if last is not None and mark >= last + gap:
            last = None  # whatever comes now is late enough for a request of its own
        if waiting or last is not None:
            state.update((last, [w[0] for w in waiting], [w[1] for w in waiting]))
            wake = min([w[0] for w in waiting] + ([] if last is None else [last + gap]))
            state.setTimeoutTimestamp(-(-wake // 1000))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["project", "request_at", "changes", "paths"])

    return step


def debounce_leading(changes: DataFrame, gap: str = "2 seconds", delay: str = "1 minute") -> DataFrame:
    """A re-scan request at a project's first change, and at the first one ``gap`` or more after the last request.

    ``changes`` are (project, ts, path). Changes in between ask for nothing; those of the request's very time are listed.
    Changes wait in the state until the watermark has passed them, so requests don't depend on how the input is cut
    or ordered within ``delay``. A project's state ends when nothing waits and its last request is ``gap`` old.
    """
    micros = int(pd.Timedelta(gap) / pd.Timedelta(1, "us"))
    narrow = changes.select(F.col("project").cast("string").alias("project"), "ts", "path")
    return narrow.withWatermark("ts", delay).groupBy("project").applyInPandasWithState(
        _request_stepper(micros), REQUEST_DDL, _REQUEST_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_heap_usage(
    events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Allocations, frees and net bytes per window and process."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", delay)
        .groupBy(window.alias("w"), "process_id")
        .agg(
            F.count_if(F.col("op") == "malloc").alias("allocations"),
            F.count_if(F.col("op") == "free").alias("frees"),
            F.sum("delta_bytes").alias("net_bytes"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "process_id",
            "allocations",
            "frees",
            "net_bytes",
        )
    )


LIVE_DDL = (
    "process_id BIGINT, address STRING, live BOOLEAN, size BIGINT, mallocs BIGINT, frees BIGINT, "
    "double_frees BIGINT, unmatched_frees BIGINT"
)
_LIVE_STATE = (
    "processes ARRAY<BIGINT>, addresses ARRAY<STRING>, live ARRAY<BOOLEAN>, size ARRAY<BIGINT>, mallocs ARRAY<BIGINT>, "
    "frees ARRAY<BIGINT>, double_frees ARRAY<BIGINT>, unmatched_frees ARRAY<BIGINT>, last ARRAY<BIGINT>, "
    "times ARRAY<BIGINT>, seqs ARRAY<BIGINT>, ops ARRAY<STRING>, sizes ARRAY<BIGINT>, places ARRAY<INT>"
)
#: hash parts of the blocks of :func:`stream_live_objects`; a part is one state row and one call in Python
LIVE_PARTS = 4096


def _live_stepper(idle: int | None):
    """The state step of one part of the blocks, made here so that it travels without this package."""
    columns = [c.split()[0] for c in LIVE_DDL.split(", ")]

    def apply(blocks: dict, events: list[tuple]) -> None:
        for _, _, op, n, key in sorted(events, key=lambda e: e[:2]):
            block = blocks.get(key)
            if block is None:
                continue
            live, _, mallocs, frees, double, unmatched, last = block
            if op == "free":
                frees += 1
                if not live:
                    double, unmatched = (double + 1, unmatched) if mallocs else (double, unmatched + 1)
                blocks[key] = False, 0, mallocs, frees, double, unmatched, last
            else:  # malloc and realloc make the block live with its new size
                blocks[key] = True, n, mallocs + (op == "malloc"), frees, double, unmatched, last

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        blocks, waiting, touched = {}, [], set()
        if state.exists:
            processes, addresses, *values, times, seqs, ops, sizes, places = state.get
            keys = list(zip(processes, addresses))
            blocks = dict(zip(keys, zip(*values)))
            waiting = [(*e, keys[i]) for *e, i in zip(times, seqs, ops, sizes, places)]
        if not state.hasTimedOut:
            for frame in batches:
                at = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
                sizes = frame["size"].fillna(0).astype("int64").tolist()
                processes = [None if p is None else int(p) for p in frame["process"]]
                keys = list(zip(processes, frame["address"].tolist()))
                waiting += zip(at, frame["seq"].tolist(), frame["op"].tolist(), sizes, keys)
                touched.update(keys)
                for k, t in zip(keys, at):
                    block = blocks.get(k, (False, 0, 0, 0, 0, 0, 0))
                    blocks[k] = (*block[:6], max(block[6], t))
        mark = state.getCurrentWatermarkMs() * 1000
        # no event can come before these any more
        apply(blocks, [e for e in waiting if e[0] <= mark])
        waiting = [e for e in waiting if e[0] > mark]
        shown = {k: blocks[k] for k in touched}
        apply(shown, waiting)
        if idle is not None:
            awaited = {e[4] for e in waiting}
            blocks = {k: b for k, b in blocks.items() if b[0] or k in awaited or mark < b[6] + idle}
        if blocks:
            placed = {k: i for i, k in enumerate(blocks)}
            state.update((
                *([k[i] for k in blocks] for i in range(2)), *([b[i] for b in blocks.values()] for i in range(7)),
                *([e[i] for e in waiting] for i in range(4)), [placed[e[4]] for e in waiting],
            ))
            due = [max(e[0] for e in waiting)] if waiting else []
            if idle is not None:
                due += [b[6] + idle for k, b in blocks.items() if not b[0] and k not in awaited]
            if due:
                state.setTimeoutTimestamp(-(-min(due) // 1000))
        elif state.exists:
            state.remove()
        if touched:
            yield pd.DataFrame([(*k, *b[:6]) for k, b in shown.items()], columns=columns)

    return step


def stream_live_objects(events: DataFrame, delay: str = "10 minutes", idle: str | None = None, parts: int = LIVE_PARTS) -> DataFrame:
    """State of every (process, address): live size, double frees, frees without allocation.

    ``events`` are (process_id, address, op, size, ts, seq). Rows are emitted in update mode. Events wait in the state until the
    watermark has passed them and are then
    applied in order; a row shows what those that wait make of the block too, so out-of-order events within ``delay``
    give what :func:`defectlake.operators.heap.live_objects` gives. What waits is bounded by ``delay`` and a
    micro-batch's part of it by the source's trigger limit. A block that isn't live and has had no event for ``idle`` is forgotten.

    A call in Python costs far more than an event, so blocks lie in ``parts`` hash parts of process and address: a micro-batch
    makes at most that many calls, and a part that it touches is written whole. Neither one process nor one address
    gathers in a part. A checkpoint goes with its number of parts.
    """
    micros = None if idle is None else int(pd.Timedelta(idle) / pd.Timedelta(1, "us"))
    part = F.pmod(F.xxhash64("process_id", "address"), F.lit(parts)).cast("int")
    narrow = events.select(
        part.alias("part"), F.col("process_id").cast("string").alias("process"), "address", "op", "size", "ts", "seq"
    )
    return narrow.withWatermark("ts", delay).groupBy("part").applyInPandasWithState(
        _live_stepper(micros), LIVE_DDL, _LIVE_STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def stream_scan_stats(found: DataFrame, window: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and leaked bytes per (scan, type, severity); windowed frames can run in append mode."""
    keys: list[Column | str] = ["scan_id", "bug_type", "severity"]
    if window:
        found = found.withWatermark("discovered_at", delay)
        keys = [F.window("discovered_at", window).alias("w"), *keys]
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum(F.coalesce("bytes_leaked", F.lit(0))).alias("bytes_leaked"),
    )


PROGRESS_DDL = (
    "batch BIGINT, input_rows BIGINT, state_rows BIGINT, late_rows BIGINT, watermark STRING, recorded_at STRING"
)


class ProgressListener(StreamingQueryListener):
    """Keeps one row per micro-batch of the queries it hears of, and writes them when asked."""

    def __init__(self) -> None:
        self.rows: dict[str, list[tuple]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.runId), [])
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(o.numRowsTotal for o in p.stateOperators)
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        row = (p.batchId, p.numInputRows, state, late, p.eventTime.get("watermark"), p.timestamp)
        self.rows.setdefault(str(p.runId), []).append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def write(self, spark, run_id: str, path: str, timeout: float = 60) -> DataFrame:
        """Append the rows of an ended run to the table at ``path``; events arrive a little after the run itself."""
        self.ended.setdefault(run_id, threading.Event()).wait(timeout)
        rows = spark.createDataFrame(self.rows.pop(run_id, []), PROGRESS_DDL)
        rows.coalesce(1).write.mode("append").parquet(path)
        return spark.read.schema(PROGRESS_DDL).parquet(path)


def run_to_table(
    df: DataFrame, label: str, mode: str = "append", path: str | None = None, listener: ProgressListener | None = None
) -> DataFrame:
    """Run a stream over all available input and read its rows back from the shared folder (or ``path``, to go on there).

    In update mode the rows of every batch are kept with their ``batch`` number. A ``listener`` gets the progress of the
    run, which is appended to the table ``progress`` beside the data.
    """
    spark = df.sparkSession
    path = path or scale.scratch_path(spark, label)
    if listener is not None:
        spark.streams.addListener(listener)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
        if listener is not None:
            listener.write(spark, str(query.runId), f"{path}/progress")
    finally:
        if listener is not None:
            spark.streams.removeListener(listener)
    return spark.read.parquet(f"{path}/data")


def latest_rows(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key of an update-mode table."""
    return scale.first_by(updates, keys, -F.col("batch")).drop("batch")
