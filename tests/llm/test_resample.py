"""Importance resampling against a row-by-row version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from defectlake.llm import resample as R

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = ["Rare words point at the target, as these do.", None, "", "one more item about über things", "target target target"]


def runs(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def direct(docs, target, per_cent=5, least=20, buckets=10_000):
    def counts(texts):
        found = Counter()
        for text in texts:
            found.update(zlib.crc32(f.encode()) % buckets for f in runs(text)[1])
        return found

    s, t = counts(x for _, x in docs), counts(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        n, found = runs(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, n, len(found), weight, score])
    order = sorted(
        (i for i, r in enumerate(rows) if r[1] >= least), key=lambda i: (-rows[i][4], -(1 << 63) if rows[i][0] is None else rows[i][0])
    )
    ranks = {i: k + 1 for k, i in enumerate(order[: per_cent * len(order) // 100])}
    return sorted((tuple(r) + (ranks.get(i),) for i, r in enumerate(rows)), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id bigint, text string, score int, rank string")


def got(spark, docs, **more):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id bigint, text string")
    return sorted((tuple(r) for r in R.resample(frame(spark, docs), target, **more).collect()), key=str)


def test_equals_direct(spark):
    docs = [(i, f"Text {i} of the Target, über {i % 13} rare things; " * (i % 11)) for i in range(400)]
    docs += [(900, None), (901, ""), (902, " .,;"), (903, "x" * 100_000), (904, "a " * 30_000), (None, "null id " * 20), (905, "日本語 🎉 ünï" * 9)]
    assert got(spark, docs, per_cent=30) == direct(docs, TARGET, 30)


def test_equal_scores_and_repeated_rows(spark):
    # one score for most rows: segments cut through it, and every row has a rank of its own
    text = "the same words again and again " * 5
    docs = [(7, text)] * 600 + [(None, text)] * 50 + [(i, text) for i in range(8, 20)]
    found = got(spark, docs, per_cent=90)
    assert found == direct(docs, TARGET, 90)
    assert sorted(r[-1] for r in found if r[-1]) == list(range(1, 90 * len(docs) // 100 + 1))


def test_ranks_over_many_runs(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("score"), (F.col("id") % 3 > 0).alias("eligible")
    ).repartition(13)
    found = R.ranked(rows, 5000).collect()
    want = sorted((r for r in found if r.eligible), key=lambda r: (-r.score, r.doc_id))[:5000]
    assert {r.doc_id: r.rank for r in found if r["rank"]} == {r.doc_id: k + 1 for k, r in enumerate(want)}
    assert len(found) == 20_000


def test_empty(spark):
    assert got(spark, []) == []
    docs = [(1, "too short")]
    assert got(spark, docs) == direct(docs, TARGET)
    nothing = spark.createDataFrame([], "text string")
    assert R.resample(frame(spark, docs), nothing).collect()[0].n_features == 3


def test_joined_crc():
    rng = np.random.default_rng(0)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 300, (200, 2))] + [(b"x", b"y" * 70_000)]
    one, other = (np.array([zlib.crc32(p[k]) for p in parts], dtype=np.uint32) for k in (0, 1))
    sizes = np.array([len(p[1]) for p in parts])
    assert R.joined_crc(one, other, sizes).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_features_of_slices():
    texts = ["Ab cd", None, "", "x1 Éa-b", "é" * 50, "a b c d"]
    owner, bucket, n = R.features(pa.array(["skipped", *texts]).slice(1))
    for i, text in enumerate(texts):
        count, found = runs(text)
        assert n[i] == count
        assert sorted(bucket[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in found)
