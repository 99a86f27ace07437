"""Best-fit packing by hierarchical residual packing.

Every task packs its own pieces best-fit, largest first, and closes bins that are nearly full. The
pieces of underfull bins go on singly to the next round, where fewer tasks pack what several former ones left;
rounds go on until one task has packed the rest, or until a round closes hardly any bin, after which
each task keeps the bins it makes. Only (bin, fill) rows move; the token ids stay where they were made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, documents, store, text_slices
from defectlake.llm.encode import default_tokenizer, encoder

CAPACITY = 1024
#: id after each document
END_ID = 2
#: a bin with at most this many free places is closed
SLACK = 4
#: former tasks whose underfull bins meet in one task of the next round
FAN_IN = 8
#: items of one task in the later rounds
ITEMS_PER_TASK = 100_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
BINS = "bin bigint, offset bigint, fill bigint, closed boolean"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item (0 < length <= capacity), largest first, and the fill of each bin."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free_lists: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_mask = 0  # bit f: some bin has f free places
    fills: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = free_mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            target = free_lists[free].pop()
            if not free_lists[free]:
                free_mask &= ~(1 << free)
        else:
            free, target = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = target, fills[target]
        fills[target] += size
        left = free - size
        if left:
            free_lists[left].append(target)
            free_mask |= 1 << left
    return bins, offsets, np.array(fills, dtype=np.int64)


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pack_rows(lengths: np.ndarray, capacity: int, slack: int, task: int, last: bool) -> list[pa.Array]:
    bins, offsets, fills = best_fit(lengths, capacity)
    fill = fills[bins] if len(bins) else bins
    if not last:
        # an underfull bin goes on as the items it came from, which fit elsewhere more easily
        loose = fill < capacity - slack
        bins[loose] = len(fills) + np.arange(int(loose.sum()))
        offsets[loose] = 0
        fill = np.where(loose, lengths, fill)
    return [
        pa.array(bins + (task << 32)), pa.array(offsets), pa.array(fill), pa.array(fill >= capacity - slack),
    ]


def _first_round(tokenizer: str, capacity: int, end_id: int, slack: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = encoder(tokenizer, special_as_text)
        task = TaskContext.get().partitionId()
        ids_col: list[pa.Array] = []
        piece, start, length, crc = [], [], [], []
        for part in text_slices(batches):
            ids, ends = ids_of.texts(part.column("text"))
            counts = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = np.append(ids[a:b], end_id).astype("<u4")
                pieces = _cut(len(own), capacity)
                counts.append(len(pieces))
                for k, (s, n) in enumerate(pieces):
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(own[s : s + n]))
            repeat = np.repeat(np.arange(len(counts)), counts)
            ids_col.append(part.column("doc_id").cast(pa.int64()).take(pa.array(repeat)))
        if not piece:
            return
        sizes = np.array(length, dtype=np.int64)
        columns = [
            pa.concat_arrays(ids_col), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(sizes), pa.array(crc, pa.int64()), *_pack_rows(sizes, capacity, slack, task, False),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "closed"]
        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _later_round(capacity: int, slack: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(batches)
        if not sum(part.num_rows for part in parts):
            return
        table = pa.Table.from_batches(parts).sort_by("item")
        lengths = table.column("length").to_numpy()
        task = (level << 24) + TaskContext.get().partitionId()
        columns = [table.column("item").combine_chunks(), *_pack_rows(lengths, capacity, slack, task, last)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "bin", "offset", "fill", "closed"])

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slack: int = SLACK,
    fan_in: int = FAN_IN,
    special_as_text: bool = False,
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text) with its place in a packed sequence.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one
    piece that holds the end id. The string of a special token in a text is that token, or text with ``special_as_text``. Rows with equal or null doc_id are packed each by itself. Other
    columns are not read. An empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = _first_round(tokenizer or default_tokenizer(), capacity, end_id, slack, special_as_text)
    pieces = store(narrow.transform(arrow_map, run, f"{PIECES}, {BINS}"), "pieces")

    # a bin starts with the piece at offset 0; underfull bins are the items of the next round
    def underfull(table: DataFrame) -> DataFrame:
        return table.where("offset = 0 and not closed").select(F.col("bin").alias("item"), F.col("fill").alias("length"))

    levels: list[DataFrame] = []
    items, tasks = underfull(pieces), max(1, pieces.rdd.getNumPartitions())
    left = items.count()
    last = left < 2
    while not last:
        # the last round is that of one task that sees all, or one after a round that closed hardly any bin
        stalled = bool(levels) and left > 0.99 * before
        tasks = tasks if stalled else max(-(-tasks // fan_in), -(-left // ITEMS_PER_TASK))
        last = stalled or tasks == 1
        merge = _later_round(capacity, slack, len(levels) + 1, last)
        level = store(items.repartition(tasks).transform(arrow_map, merge, f"item bigint, {BINS}"), "bins")
        levels.append(level)
        items, before = underfull(level), left
        left = items.count()

    # from the last round down: where each bin of a round ended up
    final: DataFrame | None = None
    for level in reversed(levels):
        moved = level.select("item", "bin", "offset")
        if final is not None:
            moved = (
                moved.join(final, "bin", "left")
                .select(
                    "item",
                    F.coalesce("to_bin", "bin").alias("bin"),
                    (F.col("offset") + F.coalesce("to_offset", F.lit(0))).alias("offset"),
                )
            )
        final = moved.select(F.col("item").alias("bin"), F.col("bin").alias("to_bin"), F.col("offset").alias("to_offset"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if final is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(final, "bin", "left").select(
        *columns,
        F.coalesce("to_bin", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("to_offset", F.lit(0))).alias("offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
