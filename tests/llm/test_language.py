"""Kneser-Ney models: they are distributions, they tell languages apart, and they reject what is none."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from defectlake.llm import language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs.where(~language.held_out(F.col("doc_id"))))


def _toy(texts, order=3):
    codes = np.concatenate([np.append(language._codes(t), 0) for t in texts])
    points = np.unique(codes[codes != 0]).astype(np.uint32)
    shell = language.Model([], points, [], [], 0.0)
    keys = language._grams(shell.symbols(codes), order)[codes != 0]
    counts = []
    for n in range(1, order + 1):
        own, count = np.unique(keys & np.uint64((1 << 8 * n) - 1), return_counts=True)
        counts.append({"x": pd.Series(count, index=own)})
    return language.kneser_ney(counts, ["x"], points), points


def test_models_are_distributions():
    model, points = _toy(["abra cadabra", "banana band", "cab"])
    size = len(points) + 2
    for context in (0, 2 << 8 | 3, 3 << 8 | 4, 200 << 8 | 7):
        keys = np.array([context << 8 | s for s in range(size)], dtype=np.uint64)
        assert abs((2.0 ** model.log_probs(keys).astype(np.float64)).sum() - 1) < 1e-3


def test_seen_is_likelier_than_unseen():
    model, _ = _toy(["banana"] * 3 + ["band"])
    scores, _, letters = model.score(["banana", "bnaaan", "zzz", "", "12"])
    assert scores[0, 0] < scores[1, 0] < scores[2, 0]
    assert letters.tolist() == [6, 6, 3, 0, 0]


def test_lookup_table():
    keys = np.arange(0, 5000, 3, dtype=np.uint64)
    table = language.Table(keys, np.arange(len(keys), dtype=np.float32)[:, None])
    found = table.find(np.arange(5000, dtype=np.uint64))
    assert [(i, table.values[r, 0]) for i, r in enumerate(found) if r >= 0] == [(int(k), i) for i, k in enumerate(keys)]


def test_held_out_accuracy(docs, model):
    told = language.identify(docs, model, ("doc_id", "lang")).where(language.held_out(F.col("doc_id")) & (F.col("bits") > 0))
    right, n = told.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 150 and right / n > 0.97


def test_rejection(spark, docs, model):
    kept = language.of_known_language(docs, model)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert kept.count() >= 0.995 * docs.count()
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 34 !!", 0.5), (4, "xqzvw kkjqx zzqwx vvkqj " * 30, 0.5), (5, "日本語の文章です" * 20, 0.5),
                                 (None, "the that and of with", 0.5)], "doc_id bigint, text string, score double")
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert all(got[i].rejected for i in (1, 2, 3, 4, 5)) and not got[None].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [r.score for r in language.of_known_language(odd, model).collect()] == [0.5]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert language.identify(none, language.train(none)).first().lang_pred == "und"
    assert language.identify(none.limit(0), language.train(none.limit(0))).count() == 0


def test_every_letter_of_large_alphabets_counts(spark):
    rng = np.random.default_rng(11)
    # two languages of 3000 letters each that share half of them
    alphabets = {"x": np.arange(0x4E00, 0x4E00 + 3000), "y": np.arange(0x4E00 + 1500, 0x4E00 + 4500)}
    chance = 1 / np.arange(1, 3001)
    text = lambda k: "".join(map(chr, rng.choice(rng_order[k], 400, p=chance / chance.sum())))
    rng_order = {k: rng.permutation(v) for k, v in alphabets.items()}
    rows = [(i, text(k), k) for i in range(120) for k in alphabets]
    model = language.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    seen = {ord(c) for _, t, _ in rows for c in t}
    assert len(model.points) > 0.9 * len(seen) > 253
    # letters that are rare in both, of which each still has its own symbol
    rare = {k: "".join(map(chr, [p for p in rng_order[k][300:900] if (p in alphabets["x"]) != (p in alphabets["y"])])) for k in alphabets}
    told = language.identify(spark.createDataFrame(list(rare.items()), "doc_id string, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in told} == {"x": "x", "y": "y"}
    assert len(set(model.symbols(model.points.copy()).tolist())) == len(model.points)
