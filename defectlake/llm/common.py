"""Small helpers shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from defectlake.scale import scratch_path

#: bytes of text that Python code works on at once
SLICE_BYTES = 4 << 20
_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[2]
    if not root.is_dir():  # it is in an archive that was sent already
        return
    folder = tempfile.mkdtemp(prefix="package-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/defectlake", "zip", root, "defectlake"))
    _SENT.add(context.applicationId)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with functions of this package."""
    send_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``size`` bytes of text, and one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    # the worker serves other tasks later; what this one no longer needs goes back
    pa.default_memory_pool().release_unused()


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1 for every i, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
