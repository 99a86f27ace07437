"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A document is its five-word shingles, each weighted by 1 + ln(count). Every shingle sends arrivals of a
Poisson process whose rate is its weight into random slots; a slot keeps its first arrival. Two documents agree in
a slot with their probability Jaccard similarity. A shingle stops when its next arrival comes after the
last slot was filled, so a signature costs about as much as the shingles and m log m arrivals together.

Bands of slots put documents into buckets. Exact copies (of the words) are one node from the start, so a bucket
holds different texts. In each bucket all are compared with one leader, the text that shares most buckets with
others, and not with each other. Where a bucket still holds several classes after that, members of different classes
are compared if what they share with the leader leaves it possible that they are similar enough. A comparison is exact:
the Jaccard similarity of the whole sets of shingles, which is what probability Jaccard is for equal weights. Classes
are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, documents, ragged_index, store, text_slices

SHINGLE = 5
SIMILARITY = 0.8
#: 40 bands of 8 slots find a pair of similarity 0.8 with probability 0.9994
BANDS, ROWS = 40, 8
SLICE = 2 << 20
#: arrivals that are drawn at once
ARRIVALS = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: Column) -> Column:
    """Lower-case words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def words_of(text: Column) -> Column:
    return F.coalesce(normal(text.cast("string")), F.lit(""))


def node_of(doc_id: Column, text: Column, words: Column) -> Column:
    """Hash of the words; of the text itself if it has no word, of the doc_id if the text is null."""
    content = (
        F.when(text.isNull(), F.concat(F.lit("0"), F.coalesce(doc_id.cast("string"), F.lit(""))))
        .when(words == "", F.concat(F.lit("1"), text.cast("string")))
        .otherwise(F.concat(F.lit("2"), words))
    )
    return F.unhex(F.substring(F.sha2(content, 256), 1, 32))


def id_key(doc_id: Column) -> Column:
    """A doc_id that equals itself when it is null."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(1 << 63)))


def with_node(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, id_key, words and node."""
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .withColumn("words", words_of(F.col("text")))
        .select(
            "doc_id", id_key(F.col("doc_id")).alias("id_key"), "words",
            node_of(F.col("doc_id"), F.col("text"), F.col("words")).alias("node"),
        )
    )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct shingles of space-joined words, sorted by text and hash.

    A text of one to four words has one shingle, of all its words; one without words has none.
    """
    split = pc.split_pattern(words.cast(pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    flat = hashed[coded.indices.to_numpy(zero_copy_only=False)]
    borders = split.offsets.to_numpy().astype(np.int64)
    borders = borders - borders[0]
    sizes = np.where(pc.equal(words, "").to_numpy(zero_copy_only=False), 0, np.diff(borders))
    counts = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = ragged_index(borders[:-1], counts)
    end = borders[1:][text]
    value = flat[at]
    for step in range(1, SHINGLE):
        place = at + step
        value = value * _MULTIPLIER + np.where(place < end, flat[np.minimum(place, len(flat) - 1)], 0)
    value = _mix(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.ones(len(text), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(first)
    return text[starts], value[starts], np.diff(np.append(starts, len(text)))


def weight(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(text: np.ndarray, value: np.ndarray, weights: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """The shingle (upper 32 bits of its hash) that arrives first in each of m slots of each text."""
    slots = np.full(n_texts * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    time, drawn = np.zeros(len(text)), np.zeros(len(text), dtype=np.uint64)
    last = np.full(n_texts, np.inf)
    step = 1
    while len(text):
        after = np.empty(len(text))
        for low in range(0, len(text), ARRIVALS // step):
            some = slice(low, low + ARRIVALS // step)
            numbers = drawn[some, None] + np.arange(1, step + 1, dtype=np.uint64)
            random = _mix(value[some, None] + numbers * _MULTIPLIER)
            gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[some, None]
            times = time[some, None] + np.cumsum(gap, axis=1)
            slot = (_mix(random) % np.uint64(m)).astype(np.int64) + (text[some] * m)[:, None]
            # a time's bits sort as the time does, so one minimum keeps the time and its shingle
            packed = times.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            np.minimum.at(slots, slot.ravel(), (packed | (value[some] >> np.uint64(32))[:, None]).ravel())
            after[some] = times[:, -1]
        filled = slots.reshape(n_texts, m).max(axis=1) >> np.uint64(32)
        empty = filled == np.uint64(0xFFFFFFFF)
        last = np.where(empty, np.inf, filled.astype(np.uint32).view(np.float32))
        time = after
        going = time < last[text]
        text, value, weights, time, drawn = text[going], value[going], weights[going], time[going], drawn[going] + np.uint64(step)
        step = min(16, step * 2)
    return (slots & np.uint64(0xFFFFFFFF)).reshape(n_texts, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.ones((len(signature), 1), dtype=np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    for k in range(rows):
        keys = _mix(keys * _MULTIPLIER + parts[:, :, k])
    return keys


def _band_rows(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "words", SLICE):
            text, value, counts = shingles(part.column("words"))
            n = part.num_rows
            keys = band_keys(signatures(text, value, weight(counts), n, bands * rows), bands, rows)
            has = np.bincount(text, minlength=n) > 0  # without a word there is no bucket
            ends = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), lists], ["doc_id", "node", "bands"])

    return run


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "words", SLICE):
        text, value, _ = shingles(part.column("words"))
        ends = np.searchsorted(text, np.arange(part.num_rows + 1))
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        yield pa.RecordBatch.from_arrays(
            [part.column("gid"), pa.array([value[a:b].tobytes() for a, b in spans], pa.binary())], ["gid", "shingles"]
        )


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingles, given as sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "shingles_a", 16 << 20):
            columns = [part.column(c).to_pylist() for c in ("shingles_a", "shingles_b")]
            found = np.array([jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(*columns)])
            keep = pa.array(np.flatnonzero(found >= similarity - 1e-9))
            yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep)], ["a", "b"])

    return run


RELATION = "a bigint, b bigint, size_a bigint, size_b bigint, removed bigint, added array<bigint>"


def _relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What of the leader's shingles (a) a member (b) lacks, and which others it has."""
    for part in text_slices(batches, "shingles_a", 16 << 20):
        rows = []
        for x, y in zip(part.column("shingles_a").to_pylist(), part.column("shingles_b").to_pylist()):
            leader, own = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            added = np.setdiff1d(own, leader, assume_unique=True)
            rows.append((len(leader), len(own), len(leader) - len(own) + len(added), added.view(np.int64)))
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
        names = ["size_a", "size_b", "removed", "added"]
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *columns], ["a", "b", *names])


def _across(mixed: DataFrame, relations: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of different classes of a bucket that can be similar enough, by what is known of its leader.

    Two members have in common at most what neither lacks of the leader, and those of their other shingles that more
    than one member of this leader has. Pairs that can't reach the similarity by that are not formed.
    """
    each = relations.select(F.col("a").alias("leader"), F.col("b").alias("gid"), F.explode("added").alias("shingle"))
    common = store(each.groupBy("leader", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "common")
    extra = each.join(common, ["leader", "shingle"]).groupBy("leader", "gid").agg(F.count(F.lit(1)).alias("extra"))
    known = store(
        relations.select(F.col("a").alias("leader"), F.col("b").alias("gid"), "size_a", "size_b", "removed")
        .join(extra, ["leader", "gid"], "left")
        .withColumn("extra", F.coalesce("extra", F.lit(0))),
        "known",
    )
    placed = store(mixed.where("gid != leader").join(known, ["leader", "gid"]), "placed")
    names = ("gid", "root", "size_b", "removed", "extra")
    one = placed.select("bucket", "size_a", *[F.col(c).alias(f"{c}_1") for c in names])
    other = placed.select("bucket", *[F.col(c).alias(f"{c}_2") for c in names])
    most = F.col("size_a") - F.greatest("removed_1", "removed_2") + F.least("extra_1", "extra_2")
    needed = (F.col("size_b_1") + F.col("size_b_2")) * (similarity / (1 + similarity))
    return (
        one.join(other, (one["bucket"] == other["bucket"]) & (F.col("root_1") < F.col("root_2")) & (most >= needed - 1e-6))
        .select(F.least("gid_1", "gid_2").alias("a"), F.greatest("gid_1", "gid_2").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(gid, root) of every node with an edge in ``edges`` (a, b), by alternating large and small stars.

    Each round is written to the shared folder. The root is the least id of its component.
    """
    now = store(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            return now.select(F.col("b").alias("gid"), F.col("a").alias("root"))
        seen = mark
        # large star: a node's larger neighbours go to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that the join is of two plain sides and a hub's edges can be split at run time
        least = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        large = store(large, "large")
        least = store(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = store(small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "small")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Node, class and kept document of every distinct text of ``docs`` (doc_id, text).

    Columns: node, rep (least doc_id of the node), class_id (least doc_id of the class), root (one per class).
    """
    hashed = with_node(docs)
    signed = store(
        hashed.select("doc_id", "node", "words").transform(
            arrow_map, _band_rows(bands, rows), "doc_id bigint, node binary, bands array<bigint>"
        ),
        "signed",
    )
    nodes = store(
        signed.groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
        .withColumn("gid", F.xxhash64("node")),
        "nodes",
    )
    members = nodes.select("gid", F.explode("bands").alias("bucket"))
    buckets = store(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    crowded = store(members.join(buckets, "bucket"), "crowded")
    # the leader is the text that shares most buckets with others: of a text and its edited copies, the text
    central = store(crowded.groupBy("gid").agg(F.sum("n").alias("weight")), "central")
    ranked = store(crowded.select("gid", "bucket").join(central, "gid"), "ranked")
    leaders = store(
        ranked.groupBy("bucket").agg(F.max(F.struct("weight", "gid")).alias("top")).select("bucket", F.col("top.gid").alias("leader")),
        "leaders",
    )
    shared = store(ranked.select("gid", "bucket").join(leaders, "bucket"), "shared")
    stars = store(
        shared.where("gid != leader").select(F.col("leader").alias("a"), F.col("gid").alias("b")).distinct(), "stars"
    )
    compared = store(stars.select(F.col("a").alias("gid")).union(stars.select("b")).distinct(), "compared")
    wanted = nodes.join(compared, "gid").select(
        "gid", F.col("node").alias("of_node"), id_key(F.col("rep")).alias("of_id")
    )
    profiles = store(
        hashed.join(wanted.hint("shuffle_hash"), (F.col("node") == F.col("of_node")) & (F.col("id_key") == F.col("of_id")))
        .select("gid", "words")
        .transform(arrow_map, _profiles, "gid bigint, shingles binary")
        .dropDuplicates(["gid"]),
        "profiles",
    )

    def with_profiles(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            own = profiles.select(F.col("gid").alias(side), F.col("shingles").alias(f"shingles_{side}"))
            pairs = pairs.join(own, side)
        return pairs

    def links(pairs: DataFrame) -> DataFrame:
        return with_profiles(pairs).transform(arrow_map, _verify(similarity), "a bigint, b bigint")

    first = store(links(stars), "links")
    roots = components(first)
    # buckets that hold more than one class: members of different classes meet
    placed = store(
        shared.join(roots, "gid", "left").select("bucket", "gid", "leader", F.coalesce("root", "gid").alias("root")), "placed"
    )
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
    mixed = store(placed.join(mixed, "bucket"), "mixed")
    led = mixed.where("gid != leader").select(F.col("leader").alias("a"), F.col("gid").alias("b")).distinct()
    relations = store(with_profiles(led).transform(arrow_map, _relate, RELATION), "relations")
    across = _across(mixed, relations, similarity).join(
        stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"
    )
    second = store(links(across), "links")
    if not second.isEmpty():
        roots = components(first.unionByName(second))
    rooted = store(nodes.select("gid", "node", "rep").join(roots, "gid", "left").withColumn("root", F.coalesce("root", "gid")), "rooted")
    least = store(rooted.groupBy("root").agg(F.min("rep").alias("class_id")), "least")
    return rooted.join(least, "root").select("node", "rep", "class_id", "root")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id and is_kept of each row of ``docs`` (doc_id, text); class_id is the class's least doc_id.

    Rows whose words are the same are always of one class. A text without a word is of the class of its exact copies,
    a null text is alone (null texts of one doc_id, or without one, are together). Rows without a doc_id share
    the classes of their texts. Other columns are not read. Repeated rows are kept as rows.
    """
    found = store(classes(docs, similarity, bands, rows).select("node", "class_id"), "classes")
    return (
        with_node(docs).select("doc_id", "node").join(found, "node")
        .select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_kept"))
    )


def without_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: the one with the least doc_id. The columns of ``docs`` stay as they are."""
    kept = (
        classes(docs, similarity)
        .where(F.col("rep").eqNullSafe(F.col("class_id")))
        .groupBy("root", id_key(F.col("rep")).alias("__id"))  # texts that share a doc_id and a class leave one row
        .agg(F.min("node").alias("__node"))
    )
    kept = store(kept.select("__id", "__node"), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = (
        docs.select(row, F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
        .withColumn("__words", words_of(F.col("__text")))
        .select("__row", id_key(F.col("__doc")).alias("__id"), node_of(F.col("__doc"), F.col("__text"), F.col("__words")).alias("__node"))
    )
    return (
        keyed.join(kept.hint("shuffle_hash"), ["__id", "__node"])
        .dropDuplicates(["__id", "__node"])
        .select("__row.*")
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
