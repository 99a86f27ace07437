"""Alignment against a plain Smith-Waterman table, and planted, edited and clean texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlake.llm import decontaminate as d


def _plain(like):
    h = np.zeros((like.shape[0] + 1, like.shape[1] + 1), dtype=int)
    for i in range(like.shape[0]):
        for j in range(like.shape[1]):
            h[i + 1, j + 1] = max(0, h[i, j] + like[i, j], h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


@pytest.mark.parametrize("seed", range(20))
def test_alignment_equals_plain_table(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcdef") for _ in range(rng.randint(1, 15))]
    passage = [rng.choice("abcdef") for _ in range(rng.randint(1, 25))]
    like = d.pair_scores(item, passage)
    best, _ = d.align(np.arange(len(item)), np.arange(len(passage)), like)
    assert best == _plain(like)


def test_alignment_finds_its_place():
    item = "one two three four five".split()
    score, start, end = d.best_alignment(item, "x y one two 3 four five z".split())
    assert (start, end) == (2, 7) and score == pytest.approx((2 * 4 - 1) / 10)
    assert d.best_alignment(["a"], ["b"]) == (0.0, 0, 0)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(40)) for i in range(20)] + [(90, "too short"), (91, None), (92, "")]
    items.append((20, items[0][1]))
    rows, want = [], set()
    for i in range(20):
        words = items[i][1].split(" ")
        edited = [w if rng.random() > 0.2 else "changed" for w in words]
        dropped = [w for w in words if rng.random() > 0.15]
        for k, part in enumerate((words, edited, dropped)):
            rows.append((100 * i + k, f"{text(rng.randint(0, 300))} {' '.join(part).upper()}. {text(100)}"))
            want.add((100 * i + k, i))
    want |= {(k, 20) for k in range(3)}
    rows += [(5000 + i, text(400)) for i in range(100)] + [(6000, None), (6001, ""), (6002, "the of and"), (None, items[3][1]), (None, items[3][1])]
    want.add((None, 3))
    docs = spark.createDataFrame([(i, t, "item") for i, t in rows], "doc_id bigint, text string, item string")
    return docs, spark.createDataFrame(items, "item_id bigint, text string"), want


def test_planted_passages(planted):
    docs, items, want = planted
    got = d.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0.4 <= r.score <= 1 for r in got)
    exact = next(r for r in got if r.doc_id is None)
    assert exact.score == 1 and exact.start_word == 0 and exact.n_words == 40


def test_given_benchmark(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts, tests = docs.collect(), items.collect()
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()}
    assert {(x.doc_id, y.item_id) for x in texts for y in tests if y.text in x.text} <= got
    assert len({x for x, _ in got}) < 0.1 * len(texts)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert d.contaminated(docs, items).count() == 0
    assert d.contaminated(items.select(F.col("item_id").alias("doc_id"), "text"), items.limit(0)).count() == 0
