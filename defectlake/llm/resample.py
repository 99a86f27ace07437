"""Importance resampling towards a target, ranked by parallel sorting by regular sampling.

Features are runs of one to three words, hashed into buckets. What the target and the corpus hold in each bucket gives the
bucket's gain, a document weighs the sum of its features' gains, and a Gumbel draw on top of that makes the
documents with the highest scores a sample without replacement.

Words are hashed once per slice; the hash of a longer run is put together from those of its words, as a CRC-32 of joined
texts follows from the parts. Scores are sorted as runs, one per task; rows at regular places of each run give the
splitters. Rows go to the segment between two splitters, segments are sorted by themselves, and the counts of the segments
before it turn a row's place in its segment into its rank. A segment that lies beyond the draw isn't sorted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, documents, ragged_index, store, text_slices

SEED = 42
BUCKETS = 10_000
#: words in the longest feature
LONGEST = 3
#: documents of fewer words are not drawn
LEAST_WORDS = 20
PER_CENT = 5
#: rows of each run from which splitters are chosen; they come to the driver
SAMPLES = 32
SLICE = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


@lru_cache(maxsize=1)
def _zeros_tables() -> np.ndarray:
    """Lookup tables [k, byte place, byte]: what 2**k zero bytes after a text make of its CRC-32, without the constant."""
    bits = np.array([1 << i for i in range(32)], dtype=np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> np.uint32(1)) ^ np.uint32(0xEDB88320), byte >> np.uint32(1))
    moved = byte[bits & np.uint32(255)] ^ (bits >> np.uint32(8))  # each bit after one zero byte
    tables = []
    for _ in range(32):
        table = np.zeros((4, 256), dtype=np.uint32)
        for place in range(4):
            for bit in range(8):
                table[place] ^= np.where(np.arange(256) >> bit & 1, moved[8 * place + bit], 0).astype(np.uint32)
        tables.append(table)
        moved = _shift(table, moved)
    return np.stack(tables)


def _shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low, high = crc & np.uint32(0xFFFF), crc >> np.uint32(16)
    return table[0, low & 255] ^ table[1, low >> 8] ^ table[2, high & 255] ^ table[3, high >> 8]


def joined_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of two texts one after the other, from that of each and the length of the second."""
    crc, tables = first.copy(), _zeros_tables()
    for k in range(int(second_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero(second_bytes >> k & 1)
        crc[at] = _shift(tables[k], crc[at])
    return crc ^ second


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of each feature of some texts, and the number of words of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, values = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values if values is not None else b"", np.uint8)
    data = _LOWER[data[int(borders[0]) : int(borders[-1])]]
    borders = borders - borders[0]
    word = _WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    filled = borders[:-1][np.diff(borders) > 0]
    begins[filled] = word[filled]  # a text's first word begins with the text
    starts = np.flatnonzero(begins)
    breaks = np.flatnonzero(begins | ~word)
    ends = np.append(breaks, len(data))[np.searchsorted(breaks, starts, side="right")]
    lengths = ends - starts
    letters = data[ragged_index(starts, lengths)].tobytes()
    word_borders = np.append(0, np.cumsum(lengths))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(word_borders), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_pylist()
    alone = np.fromiter((zlib.crc32(w) for w in distinct), np.uint32, len(distinct))[code]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))[code]
    text_of = np.searchsorted(borders, starts, side="right") - 1
    n_words = np.bincount(text_of, minlength=len(texts))
    owners, found, crc = [text_of], [alone], alone
    for more in range(1, longest):
        # runs that can be one word longer: their last word is of the same text
        goes = np.flatnonzero(text_of[more:] == text_of[: len(text_of) - more]) if len(text_of) > more else np.empty(0, np.int64)
        longer = np.zeros(len(code), dtype=np.uint32)
        longer[goes] = joined_crc(crc[goes], spaced[goes + more], lengths[goes + more] + 1)
        owners.append(text_of[goes])
        found.append(longer[goes])
        crc = longer
    return np.concatenate(owners), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), n_words


def _count(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in text_slices(batches, "text", SLICE):
            total += np.bincount(features(part.column("text"), buckets, longest)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all ``texts`` (text) per bucket. Every task adds up its own; the result has ``buckets`` numbers."""
    counted = texts.select(F.col("text").cast("string").alias("text")).transform(
        arrow_map, _count(buckets, longest), "bucket bigint, n bigint"
    )
    total = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket at most
        total[row.bucket] = row.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more likely a feature is in the target, with one added per bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(gain: np.ndarray, seed: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            owner, bucket, n_words = features(part.column("text"), len(gain), longest)
            n = part.num_rows
            # whole numbers below 2**53 are exact in doubles
            weight = np.bincount(owner, weights=gain[bucket], minlength=n).astype(np.int64)
            count = np.bincount(owner, minlength=n)
            keys = [f"{seed}:{'' if i is None else i}".encode() for i in part.column("doc_id").to_pylist()]
            drawn = np.array([int(hashlib.sha256(k).hexdigest()[:8], 16) for k in keys], dtype=np.float64)
            noise = np.floor(-1000 * np.log(-np.log((drawn + 0.5) / 4294967296)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(count, pa.int64()),
                    pa.array(weight, pa.int64()), pa.array(weight + noise.astype(np.int64), pa.int64()),
                ],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition."""
    from pyspark import TaskContext

    number, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        names = [*batch.schema.names, "part", "place"]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, number, dtype=np.int32)), pa.array(np.arange(at, at + n))], names
        )
        at += n


def _rank(bases: list[int]):
    """Turn the places of sorted segments, one in each partition, into ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows:
                at = bases[batch.column("segment")[0].as_py()] if at is None else at
                rank = pa.array(np.arange(at + 1, at + 1 + batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("at"), rank], ["run", "at", "rank"])
                at += batch.num_rows

    return run


def _segment_of(splitters: list[tuple]):
    columns = [np.array(c, dtype=np.int64) for c in zip(*splitters)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = np.zeros(batch.num_rows, dtype=np.int32)
            if columns:
                rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "id_key", "run", "at")]
                # both kinds of rows in one order; a splitter comes before the row it equals
                both = np.lexsort((
                    np.append(np.zeros(len(columns[0]), np.int8), np.ones(batch.num_rows, np.int8)),
                    *(np.append(c, r) for c, r in zip(reversed(columns), reversed(rows))),
                ))
                passed = np.cumsum(both < len(columns[0]))
                mine = both >= len(columns[0])
                segment[both[mine] - len(columns[0])] = passed[mine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    return run


def ranked(rows: DataFrame, draw: int, samples: int = SAMPLES) -> DataFrame:
    """``rows`` (doc_id, score, eligible and others) with the rank of the ``draw`` first eligible ones, else null.

    Highest score first, ties to the smaller doc_id, a null doc_id before all; rows that are equal in both are told
    apart by where they lie, so one score may be that of any number of rows.
    """
    lead = F.when(F.col("eligible"), -F.col("score"))
    keyed = rows.withColumns({"lead": lead, "id_key": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    sorted_runs = keyed.sortWithinPartitions(F.col("lead").asc_nulls_last(), "id_key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    runs = store(
        sorted_runs.transform(arrow_map, _place, f"{fields}, part int, place bigint")
        .withColumnsRenamed({"part": "run", "place": "at"}),
        "runs",
    )
    key = ["lead", "id_key", "run", "at"]
    chosen = runs.where("eligible")
    sizes = chosen.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    step = F.ceil(F.col("n") / samples)
    # one row in every n/samples of each run, from the middle of its stretch
    regular = (
        chosen.join(sizes, "run").where(F.col("at") % step == F.floor(step / 2)).select(*key).collect()
    )
    points = sorted(tuple(r) for r in regular)
    segments = max(1, runs.sparkSession.sparkContext.defaultParallelism, runs.rdd.getNumPartitions())
    splitters = [points[len(points) * k // segments] for k in range(1, segments)] if points else []
    splitters = sorted(set(splitters))
    fields = "lead bigint, id_key bigint, run int, at bigint"
    dealt = store(
        chosen.select(*key).transform(arrow_map, _segment_of(splitters), f"{fields}, segment int"), "dealt"
    )
    counts = {r.segment: r.n for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    bases, before = [], 0
    for segment in range(len(splitters) + 1):
        bases.append(before)
        before += counts.get(segment, 0)
    needed = [s for s, base in enumerate(bases) if base < draw]
    # one segment to a partition, by its number
    drawn = (
        dealt.where(F.col("segment") < len(needed))
        .repartitionById(max(1, len(needed)), F.col("segment"))
        .sortWithinPartitions(*key)
        .transform(arrow_map, _rank(bases), "run int, at bigint, rank bigint")
        .where(F.col("rank") <= draw)
    )
    return runs.join(store(drawn, "drawn"), ["run", "at"], "left").select(*rows.columns, "rank")


def resample(
    docs: DataFrame,
    target: DataFrame,
    per_cent: int = PER_CENT,
    seed: int = SEED,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of ``docs`` (doc_id, text).

    ``target`` (text) is what the sample should resemble. Of the N documents with ``least_words`` words or more,
    N * per_cent // 100 are drawn: rank 1, 2, ... by descending score, ties to the smaller doc_id (null first, null draws
    as an empty id); the others' rank is null. A null or empty text has no words and the weight 0, and so has one without
    word characters. Repeated rows are rows of their own, each with its own rank. A text is worked on as a whole, some
    dozens of times its size in memory. Other columns are not read. An empty table gives no rows; an empty target counts 0.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(narrow, buckets, longest), bucket_counts(target, buckets, longest))
    scored = store(
        narrow.transform(
            arrow_map, _weigh(gain, seed, longest), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
        ).withColumn("eligible", F.col("n_words") >= least_words),
        "scored",
    )
    n = scored.where("eligible").count()
    return ranked(scored, per_cent * n // 100).drop("eligible")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
