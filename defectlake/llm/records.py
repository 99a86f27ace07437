"""Token ids as length-delimited binary records with an offset index.

A record file is a row of frames: length of the payload in bytes (unsigned 64 bit), masked checksum of
those 8 bytes (32 bit), payload, masked checksum of the payload, all little-endian. The payload is the
ids of one document, 16 bit each if the vocabulary fits and else 32 bit. A checksum is the CRC-32 of the
bytes, rotated right by 15 bits and moved by a constant, so that records that hold checksums themselves
don't look valid by chance. Files follow each other in ascending doc_id order, and so do the
records in a file. The index, a Parquet table written by the same job, has one row per record: its
file, byte offset, number of ids and first id's place in the file; it names only files of finished tasks,
so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, documents, text_slices
from defectlake.llm.encode import default_tokenizer, encoder
from defectlake.scale import scratch_path

END_ID = 0
#: Fixed value: the constant that masks a checksum
MASK_DELTA = 0xA282EAD8
INDEX = "file string, doc_id bigint, ord bigint, byte_offset bigint, n_tokens bigint, start_in_file bigint, id_bytes int"


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int = 0) -> memoryview:
    """Payload of the frame that begins at ``at``; raises ValueError on a damaged frame."""
    head = data[at : at + 8]
    size, check = struct.unpack("<QI", data[at : at + 12])
    payload = data[at + 12 : at + 12 + size]
    if check != masked(head) or len(payload) != size:
        raise ValueError(f"damaged record length at byte {at}")
    if struct.unpack("<I", data[at + 12 + size : at + 16 + size])[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload


def frame_bytes(n_tokens: int, id_bytes: int) -> int:
    return n_tokens * id_bytes + 16


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str, tokenizer: str, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        ids_of = encoder(tokenizer, special_as_text)
        id_bytes = 2 if max(ids_of.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        # an attempt never writes over the file of another one
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        out, at, ids_before = None, 0, 0
        try:
            for part in text_slices(batches):
                if out is None:
                    system, base = _open(folder)
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}")
                ids, ends = ids_of.texts(part.column("text"))
                offsets, counts, starts, frames = [], [], [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    framed = frame(np.append(ids[a:b], end_id).astype(f"<u{id_bytes}").tobytes())
                    frames.append(framed)
                    offsets.append(at)
                    counts.append(b - a + 1)
                    starts.append(ids_before)
                    at += len(framed)
                    ids_before += b - a + 1
                out.write(b"".join(frames))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n), part.column("doc_id"), part.column("ord"), pa.array(offsets, pa.int64()),
                        pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), pa.array([id_bytes] * n, pa.int32()),
                    ],
                    ["file", "doc_id", "ord", "byte_offset", "n_tokens", "start_in_file", "id_bytes"],
                )
        finally:
            if out is not None:
                out.close()

    return run


def write_records(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, special_as_text: bool = False
) -> DataFrame:
    """Write ``docs`` (doc_id, text) as record files and index below ``folder``; return the index.

    ``folder`` must be one that all executors share. A null text is empty and so holds the end id alone. The string of a
    special token in a text is that token, or text with ``special_as_text``. Rows
    with a null doc_id come first; rows of one doc_id follow each other, ordered by a hash of the text, and
    each has its own record. Other columns are not read. An empty table gives an empty index.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("ord", F.xxhash64("text"))
        .repartitionByRange("doc_id", "ord")
        .sortWithinPartitions("doc_id", "ord")
        .select("doc_id", "ord", "text")
    )
    writer = _writer(f"{folder}/data", tokenizer or default_tokenizer(), end_id, special_as_text)
    ordered.transform(arrow_map, writer, INDEX).write.parquet(f"{folder}/index")
    return read_index(docs.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``: the number of ids before a record in the order of all files."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = index.groupBy("file").agg(
        F.min(F.struct("doc_id", "ord")).alias("first"), F.sum("n_tokens").alias("ids")
    )
    # one row per file
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "file").withColumn("start", F.col("base") + F.col("start_in_file")).drop("base")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = base = handle = None
        opened = ""
        for batch in batches:
            if system is None:
                system, base = _open(folder)
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "byte_offset", "n_tokens", "id_bytes")))
            crcs, counts = [], []
            for file, offset, n_tokens, id_bytes in rows:
                if file != opened:
                    if handle is not None:
                        handle.close()
                    handle, opened = system.open_input_file(f"{base}/{file}"), file
                data = memoryview(handle.read_at(frame_bytes(n_tokens, id_bytes), offset))
                ids = np.frombuffer(unframe(data), dtype=f"<u{id_bytes}")
                crcs.append(zlib.crc32(ids.astype("<u4")))
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )
        if handle is not None:
            handle.close()

    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` names, in any order, with checks: doc_id, start, n_tokens, ids_crc32."""
    rows = index.select("file", "byte_offset", "n_tokens", "id_bytes", "doc_id", "start")
    return rows.transform(arrow_map, _reader(f"{folder}/data"), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_record_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "records")
    return read_records(write_records(documents(spark, sf_dir), folder), folder)


QUERIES = {"op8_record_output": op8_record_output}
