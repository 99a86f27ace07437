"""Near-duplicates against the comparison of all pairs, and the estimator against the exact similarity."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from defectlake.llm import near_dup


def _shingles(text):
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return {}
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return {g: 1 + math.log(n) for g, n in Counter(grams).items()}


def _similarity(a, b):
    """Probability Jaccard of weighted shingles."""
    sa, sb = sum(a.values()), sum(b.values())
    p, q = {k: v / sa for k, v in a.items()}, {k: v / sb for k, v in b.items()}
    keys = set(p) | set(q)
    return sum(1 / sum(max(p.get(k, 0) / p[i], q.get(k, 0) / q[i]) for k in keys) for i in set(p) & set(q))


def _classes(rows, similarity=0.8):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    grams = [(i, _shingles(t or "")) for i, t in rows]
    for x, (i, a) in enumerate(grams):
        for j, b in grams[:x]:
            if a and b and len(a.keys() & b.keys()) / len(a.keys() | b.keys()) >= similarity - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    by_text: dict = {}
    for i, t in rows:
        if t is not None:
            first = by_text.setdefault(t, i)
            parent[max(root(i), root(first))] = min(root(i), root(first))
    return {i: root(i) for i, _ in rows}


def test_classes_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 6000]
    got = near_dup.near_duplicates(docs.where("length(text) < 6000")).collect()
    assert {r.doc_id: r.class_id for r in got} == _classes(rows)
    assert all(r.is_kept == (r.doc_id == r.class_id) for r in got)


def test_chains_copies_and_odd_rows(spark):
    words = [f"w{i}" for i in range(120)]
    base = " ".join(words)
    rows = [(i, " ".join(words[:-3] + [f"x{i}", "y", "z"])) for i in range(1, 30)]
    rows += [(100 + i, base) for i in range(50)] + [(200, base.upper() + "!!"), (300, ""), (301, ""), (302, "?!"), (303, None), (304, None)]
    chain = list(words)
    for step in range(6):  # each near the one before, the last far from the first
        chain = chain[6:] + [f"c{step}{k}" for k in range(6)]
        rows.append((400 + step, " ".join(chain)))
    rows += [(500, "one two"), (501, "One, two."), (502, "one three"), (503, "solo " * 40), (504, "solo " * 40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, node int")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == _classes(rows)
    kept = near_dup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near_dup.near_duplicates(docs).count() == 5
    assert sorted(str(r.text) for r in near_dup.without_copies(docs).collect()) == ["None", "a b c d e f", "g h i j k l"]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("other", [" ".join(f"w{i}" for i in range(20, 220)), "w1 w2 w3 w4 w5 w6 " * 30 + " ".join(f"w{i}" for i in range(150))])
def test_estimate(other):
    texts = [" ".join(f"w{i}" for i in range(200)), other]
    text, value, counts = near_dup.shingles(pa.array(texts))
    weights = near_dup.weight(counts)
    signature = near_dup.signatures(text, value, weights, 2, 4000)
    exact = _similarity(*map(_shingles, texts))
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, 300), (300, 100), (7, 7)]
    got = {r.gid: r.root for r in near_dup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {200: 100, 300: 100}


def test_short_texts_fill_their_signature():
    text, value, counts = near_dup.shingles(pa.array(["a", "", "b c"]))
    assert np.bincount(text, minlength=3).tolist() == [1, 0, 1]
    signature = near_dup.signatures(text, value, near_dup.weight(counts), 3, 320)
    assert (signature[0] == value[0] >> np.uint64(32)).all()
