"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every three-word gram of a test item is a seed. A training text is read once: its grams are looked up in a bit table
of the seeds, and where hits lie close together a passage is cut out, with some words around it. Hits are then
joined to the seeds of test items. A seed's worth is its rarity in the corpus, log2(grams / occurrences); a passage
and an item that share distinct seeds worth MIN_BITS together are aligned word by word (local alignment, equal
words 2, words with the same beginning 1, others and gaps -1). The score is the alignment's share of the item's
alignment with itself.

The bit table has a fixed size whatever the benchmark; it only spares work, the join decides. Nothing is dropped for
being common: a test passage that stands in a third of all documents has seeds of less worth, but many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, documents, ragged_index, store, text_slices
from defectlake.llm.near_dup import words_of

SEED = 3
#: bits of the table of seeds (at most so many numbers come to the driver)
TABLE_BITS = 22
#: words without a hit that end a passage, and words taken on either side of one
GAP, AROUND = 16, 16
#: distinct seeds and their worth that a passage and an item must share to be aligned
MIN_SEEDS, MIN_BITS = 3, 36.0
#: least score of a contaminated passage
SCORE = 0.4
SLICE = 2 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word number in the text and hash of every gram of SEED words of space-joined words."""
    split = pc.split_pattern(words.cast(pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    flat = hashed[coded.indices.to_numpy(zero_copy_only=False)]
    borders = split.offsets.to_numpy().astype(np.int64)
    borders = borders - borders[0]
    counts = np.maximum(np.diff(borders) - SEED + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = ragged_index(borders[:-1], counts)
    value = flat[at]
    for step in range(1, SEED):
        value = value * _MULTIPLIER + flat[at + step]
    value ^= value >> np.uint64(31)
    return text, at - borders[:-1][text], value


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "words", SLICE):
        text, place, value = _gram_hashes(part.column("words"))
        yield pa.RecordBatch.from_arrays(
            [part.column("item").take(pa.array(text)), pa.array(place), pa.array(value.view(np.int64))],
            ["item", "place", "seed"],
        )


PASSAGE = (
    "doc_id bigint, text_hash bigint, passage bigint, first_word bigint, words string, hits array<bigint>, "
    "grams bigint, seen array<bigint>, times array<bigint>"
)


def _cut_passages(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        mask = np.uint64((1 << TABLE_BITS) - 1)
        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, "words", SLICE):
            text, place, value = _gram_hashes(part.column("words"))
            hit = np.flatnonzero(table[(value & mask).astype(np.int64)])
            seen, times = np.unique(value[hit], return_counts=True)
            # a row that counts hits for the whole slice
            rows: list[tuple] = [(None, None, None, None, None, None, len(value), seen.view(np.int64), times)]
            t, p = text[hit], place[hit]
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (p[1:] - p[:-1] > GAP)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(hit))
            split: tuple[int, list[str]] = (-1, [])
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a < MIN_SEEDS:
                    continue
                k = int(t[a])
                if split[0] != k:
                    split = (k, part.column("words")[k].as_py().split(" "))
                low = max(0, int(p[a]) - AROUND)
                chosen = split[1][low : int(p[b - 1]) + SEED + AROUND]
                rows.append((
                    part.column("doc_id")[k].as_py(), part.column("text_hash")[k].as_py(), number, low, " ".join(chosen),
                    value[hit[a:b]].view(np.int64), None, None, None,
                ))
                number += 1
            names = [x.split()[0] for x in PASSAGE.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.int64()] + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    return run


def align(item: np.ndarray, passage: np.ndarray, like: np.ndarray) -> tuple[int, int]:
    """Best local score and the passage position after its last word. ``like`` holds the scores of word pairs."""
    gap = 1
    ramp = gap * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for i in range(len(item)):
        fresh = np.maximum(row - gap, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + like[i])
        # a gap in the item: the best earlier place less a step for each word since
        fresh = np.maximum.accumulate(fresh + ramp) - ramp
        top = int(fresh.argmax())
        if fresh[top] > best:
            best, end = int(fresh[top]), top
        row = fresh
    return best, end


def pair_scores(item: list[str], passage: list[str]) -> np.ndarray:
    """2 for equal words, 1 for words of five letters or more that begin alike, -1 for others."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(item + passage))}
    stems = {w: (w[:5] if len(w) >= 5 else w) for w in codes}
    stem_codes = {s: i for i, s in enumerate(dict.fromkeys(stems.values()))}
    a, b = (np.array([codes[w] for w in x]) for x in (item, passage))
    sa, sb = (np.array([stem_codes[stems[w]] for w in x]) for x in (item, passage))
    equal, begin = a[:, None] == b[None, :], sa[:, None] == sb[None, :]
    return np.where(equal, 2, np.where(begin, 1, -1))


def best_alignment(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Score between 0 and 1 and the first and past-last word of the aligned part of ``passage``."""
    like = pair_scores(item, passage)
    best, end = align(np.arange(len(item)), np.arange(len(passage)), like)
    if not best:
        return 0.0, 0, 0
    # the same alignment read backwards from its end gives its start
    _, back = align(np.arange(len(item)), np.arange(end), like[::-1, :end][:, ::-1])
    return best / (2 * len(item)), end - back, end


def _score_pairs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "words", 4 << 20):
            found = [
                best_alignment(i.split(" "), p.split(" "))
                for i, p in zip(part.column("item_words").to_pylist(), part.column("words").to_pylist())
            ]
            keep = [k for k, x in enumerate(found) if x[0] >= least]
            first = part.column("first_word").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c).take(pa.array(keep, pa.int64())) for c in ("doc_id", "text_hash", "item")),
                    pa.array([found[k][0] for k in keep], pa.float64()),
                    pa.array([first[k] + found[k][1] for k in keep], pa.int64()),
                    pa.array([found[k][2] - found[k][1] for k in keep], pa.int64()),
                ],
                ["doc_id", "text_hash", "item", "score", "start_word", "n_words"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """(doc_id, text_hash, item_id, score, start_word, n_words) of each text and test item that it holds.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. text_hash is ``xxhash64(text)``, which tells rows of
    one doc_id apart. Null and empty texts hold nothing; an item of fewer than three words, or with fewer than three
    distinct grams, can't be told from chance and is not looked for. Items of equal words are aligned once and
    reported each. Repeated rows give one row. Other columns are not read.
    """
    spark = docs.sparkSession
    listed = store(
        benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).where("item_words != ''")
        .withColumn("item", F.xxhash64("item_words")),
        "items",
    )
    items = listed.select("item", "item_words").dropDuplicates(["item"])
    seeds = store(
        items.withColumnRenamed("item_words", "words").transform(arrow_map, _item_seeds, "item bigint, place bigint, seed bigint"),
        "seeds",
    )
    size = 1 << TABLE_BITS
    used = seeds.select(F.pmod("seed", F.lit(size)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    table = np.zeros(size, dtype=bool)
    table[used] = True
    bits = np.packbits(table, bitorder="little").tobytes()

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        words_of(F.col("text")).alias("words"),
    )
    read = store(rows.transform(arrow_map, _cut_passages(bits), PASSAGE), "passages")
    passages = read.where("passage IS NOT NULL").select("doc_id", "text_hash", "passage", "first_word", "words", "hits")
    total = max(2, read.agg(F.sum("grams")).first()[0] or 2)
    counted = read.select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy(F.col("x.seen").alias("seed")).agg(
        F.sum("x.times").alias("times")
    )
    worth = store(
        seeds.select("item", "seed").distinct().join(counted, "seed").select(
            "item", "seed", (F.lit(math.log2(total)) - F.log2("times")).alias("bits")
        ),
        "worth",
    )
    candidates = store(
        passages.select("passage", F.explode(F.array_distinct("hits")).alias("seed"))
        .join(worth, "seed")
        .groupBy("passage", "item")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bits").alias("bits"))
        .where((F.col("n") >= MIN_SEEDS) & (F.col("bits") >= MIN_BITS))
        .select("passage", "item"),
        "candidates",
    )
    scored = (
        candidates.join(items, "item").join(passages.drop("hits"), "passage")
        .select("doc_id", "text_hash", "item", "item_words", "first_word", "words")
        .transform(
            arrow_map, _score_pairs(score), "doc_id bigint, text_hash bigint, item bigint, score double, start_word bigint, n_words bigint"
        )
        .groupBy("doc_id", "text_hash", "item")
        .agg(F.max(F.struct("score", -F.col("start_word"), "n_words")).alias("best"))
        .select("doc_id", "text_hash", "item", "best.*")
        .withColumnsRenamed({"col2": "start_word"})
    )
    return store(scored, "scored").join(listed.select("item", "item_id"), "item").select(
        "doc_id", "text_hash", "item_id", "score", (-F.col("start_word")).alias("start_word"), "n_words"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start_word", "n_words")


QUERIES = {"op3_decontamination": op3_decontamination}
